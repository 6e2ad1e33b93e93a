import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from modalith.plans.registry import ORACLES, QUERIES
from modalith.sources.views import TABLES

SF = "/root/testdata/sf0.001"


def cells(df):
    shown = lambda v: None if v is None or v != v else round(float(v), 8) + 0.0 if isinstance(v, float) else str(v)
    rows = [tuple(str(shown(v)) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, oracle, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want[list(got.columns)])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r.source_modality for r in rows} == {"mandatory", "recommended", "optional", "nice_to_have"}
    assert all(r.lower_bound <= r.rate and r.lower_bound <= r.upper_bound and not math.isnan(r.rate) for r in rows)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
