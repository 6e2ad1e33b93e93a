"""Logical observations from physical attempts: identity, de-duplication, selection, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a blank or absent identity part stands for.
LEGACY = "legacy"
IDENTITY = ["run_id", "model", "dataset", "variant", "task", "item_id", "sample_kind", "sample_index"]


def identity_part(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x.cast("string")), F.lit("")), F.lit(LEGACY))


def dedupe_latest(attempts: DataFrame, key: list[str], ok: Column, order: list[Column]) -> DataFrame:
    """One row a key: the latest that is ok, else the latest. order must be total, latest last.

    A window of row_number = 1: Spark keeps only the group's top row on the map side, so a key with very many
    attempts sends one row a task."""
    w = Window.partitionBy(*key).orderBy(F.when(ok, 0).otherwise(1), *(c.desc() for c in order))
    return attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ledger(attempts: DataFrame, key: list[str], ok: Column, order: list[Column]) -> DataFrame:
    """All attempts with is_latest: whether the attempt is its observation's survivor."""
    w = Window.partitionBy(*key).orderBy(F.when(ok, 0).otherwise(1), *(c.desc() for c in order))
    return attempts.withColumn("is_latest", F.row_number().over(w) == 1)


def latest_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by `order`, which must be total, as one pre-combined aggregation."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(*key, *(F.col(f"b.{c}").alias(c) for c in [*order, *rest]))


def exact_pairs(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Per identity in either arm: its class. An identity pairs if it occurs once in both arms and is eligible in both.

    left, right: key and a boolean column `eligible`."""
    side = lambda df, tag: df.groupBy(*key).agg(F.count("*").alias(f"n_{tag}"), F.bool_and("eligible").alias(f"ok_{tag}"))
    both = side(left, "a").join(side(right, "b"), key, "full_outer")
    cls = (
        F.when((F.coalesce("n_a", F.lit(0)) > 1) | (F.coalesce("n_b", F.lit(0)) > 1), "duplicate")
        .when(F.col("n_a").isNull() | F.col("n_b").isNull(), "unmatched")
        .when(~(F.col("ok_a") & F.col("ok_b")), "ineligible")
        .otherwise("matched")
    )
    return both.select(*key, cls.alias("pair_class"))


def id_difference(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(side, key): identifiers that only one side has."""
    e, o = expected.select(key).distinct(), observed.select(key).distinct()
    return e.join(o, key, "left_anti").select(F.lit("missing").alias("side"), key).union(o.join(e, key, "left_anti").select(F.lit("extra").alias("side"), key))


def exact_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns; an id that either side lacks or repeats is an error, told by their number."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = side(left, "a").join(side(right, "b"), key, "full_outer")
    wrong = both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("unknown"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated")).first().asDict()
    if any(wrong.values()):
        raise ValueError(f"ids must match exactly once: {wrong}")
    return left.join(right, key)
