"""Keys past a million, where seed ids (cut to six digits) repeat; what draws and orders give at other sizes."""

import duckdb
import pytest

from modalith.plans.registry import ORACLES, QUERIES
from modalith.sources.views import TABLES
from test_queries import SF, cells


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """sf0.001 with parts numbered so that every ten of them share a seed id."""
    path, con = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    shifted = {"part": "* REPLACE (p_partkey + 1000000 AS p_partkey)", "lineitem": "* REPLACE (l_partkey + 1000000 AS l_partkey)"}
    for t in TABLES:
        con.execute(f"COPY (SELECT {shifted.get(t, '*')} FROM '{SF}/{t}.parquet') TO '{path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), con


def same(spark, repeated, name):
    path, con = repeated
    got, want = QUERIES[name](spark, path).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want[list(got.columns)])


def test_proposals_of_repeated_seed_ids(spark, repeated):
    same(spark, repeated, "proposal_join")


def test_turns_of_repeated_seed_ids(spark, repeated):
    """The SQL leaves open how items of one seed and turn are placed; which items a turn has, it doesn't."""
    from modalith.plans.observation_queries import SEPARATED, separated

    path, con = repeated
    got = separated(spark, path).groupBy("seed_id", "item_id", "turn").count().toPandas()
    want = con.execute(SEPARATED + " SELECT seed_id, item_id, (m + s) % 4 AS turn, count(*) AS count FROM b GROUP BY ALL").df()
    assert cells(got) == cells(want)
    batches = con.execute(SEPARATED + " SELECT batch, count(*) AS n FROM x GROUP BY 1").df()
    assert cells(separated(spark, path).groupBy("batch").count().toPandas()) == cells(batches)


def test_sources_of_repeated_item_ids(spark, repeated):
    same(spark, repeated, "source_resolve")


def test_narrowed_sources_of_repeated_item_ids(spark, repeated):
    same(spark, repeated, "source_resolve_narrowed")


def test_attempts_of_repeated_item_ids_count_once(spark, repeated):
    same(spark, repeated, "stale_semi")


def test_pivot_of_repeated_seed_ids(spark, repeated):
    same(spark, repeated, "statement_pivot")


def parts_of(tmp_path_factory, rows):
    """A folder with parts of (key, name, size) only, and its view in DuckDB."""
    path, con = tmp_path_factory.mktemp("parts"), duckdb.connect()
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_type VARCHAR, p_size INTEGER)")
    con.executemany("INSERT INTO part VALUES (?, ?, 'SMALL', ?)", rows)
    con.execute(f"COPY part TO '{path}/part.parquet' (FORMAT parquet)")
    return str(path), con


def test_prompts_of_repeated_seed_ids(spark, repeated):
    """a statement's number is its strength's, however many parts share a seed id. The SQL leaves open how statements
    of one number follow each other; which ones there are, and their numbers' order, it doesn't."""
    from modalith.plans.text_queries import requests

    path, con = repeated
    got = {r.seed_id: r.prompt.split("\n") for r in requests(spark, path).collect()}
    want = {k: p.split("\n") for k, p in con.execute(ORACLES["batch_prompts"].split("SELECT seed_id, sha256(prompt)")[0] + "SELECT seed_id, prompt FROM b").fetchall()}
    assert got.keys() == want.keys() and len(got) == 20
    for k, lines in got.items():
        assert len(lines) == 41 and sorted(lines) == sorted(want[k])
        assert [x[:3] for x in lines] == [x[:3] for x in want[k]]


def test_prompts_of_repeated_seed_ids_without_ties(spark, tmp_path_factory):
    """parts of one name and size leave no order open, so the digests are the SQL's."""
    rows = [(k, f"bolt {str(k)[:6]}", 4) for k in [*range(100000, 100004), *range(1000000, 1000035)]]
    same(spark, parts_of(tmp_path_factory, rows), "batch_prompts")


def test_prompts_of_few_parts_go_by_part(spark, tmp_path_factory):
    """DuckDB leaves statements of one number in the table's order where a seed's parts lie side by side."""
    same(spark, parts_of(tmp_path_factory, [(k, f"bolt {-k}", k % 7) for k in range(1000000, 1000026) if k % 10 < 6]), "batch_prompts")


def test_prompts_of_parts_without_key_or_name(spark, tmp_path_factory):
    """statements that are null are left out; a seed of none has no request, one without an id has."""
    same(spark, parts_of(tmp_path_factory, [(1, None, 1), (None, "hot bolt", 2), (2, "ring", None), (1000030, None, 3), (1000031, "old ring", 3)]), "batch_prompts")


def test_draws_in_arrays_are_the_md5_draws():
    """a slot of a draw is no row; its md5 is the one that the SQL takes."""
    from hashlib import md5

    from modalith.functions import draws

    for n, first, last in ((1, 0, 1), (7, 8, 12), (12345, 98, 101)):
        got = [(int(b), int(i)) for bs, taken in draws.taken("20260518", first, last, n) for b, i in zip(bs, taken)]
        want = [(b, int(md5(f"20260518:{b}:{j}".encode()).hexdigest()[:8], 16) % n) for b in range(first, last) for j in range(n)]
        assert sorted(got) == sorted(want)
        for b, w in draws.weights("20260518", first, last, n, most=3 * n):
            assert w.tolist() == [sum(x == (b, i) for x in want) for i in range(n)] if n < 10 else w.sum() == n


@pytest.mark.parametrize("name", ["attached_intervals", "bootstrap_rate", "bootstrap_delta", "auroc_bootstrap"])
def test_draws_become_no_rows(spark, name):
    """no join or aggregate takes draws times clusters."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "md5(" not in plan


def test_text_lengths_are_not_joined(spark):
    """no table of a row a text is a join's side, which the driver would gather for a broadcast."""
    plan = QUERIES["tfidf_weights"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "p_partkey" in x.split("Join", 1)[1]]


def test_items_are_made_in_all_tasks(spark):
    """parts lie in one split, however many; what is made of them doesn't stay in its task."""
    from modalith.sources.views import frame

    assert frame(spark, SF, "part").rdd.getNumPartitions() == 1
    assert frame(spark, SF, "v_items").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_of_one_shape_classify_alike(spark):
    """digits only part words, wherever they stand and however many."""
    from pyspark.sql import functions as F

    from modalith.functions import text as tx

    texts = ["It must 7not fail", "cannot1cannot22cannot", "can't9 shall3n't", "It would be useful if 12", "nice 4to have", "The system exports 907", "system 12 exports", "Is useful 5.", "required 3 to", "must1not2", "0", "", "MAY٣not"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").withColumn("s", tx.shape(F.col("x")))
    both = tx.with_text_modality(tx.with_text_modality(rows, "x", "t"), "s", "u").select("t", "u").collect()
    assert len(both) == len(texts) and all(r.t == r.u for r in both)


def test_few_shapes_of_texts_go_to_the_answers(spark):
    """answers of some shapes are neither shuffled nor joined by their texts."""
    from modalith.plans.text_queries import answers

    plan = answers(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_many_shapes_of_texts_are_joined(spark, monkeypatch):
    from modalith.plans import text_queries

    few = QUERIES["transitions"](spark, SF).toPandas()
    monkeypatch.setattr(text_queries, "SHAPES", 1)
    assert cells(QUERIES["transitions"](spark, SF).toPandas()) == cells(few)


@pytest.mark.parametrize("runs", [0, 20_000])
def test_places_within_keys_are_joined_by_range(spark, monkeypatch, runs):
    """F16: a key's rows don't meet in one task, and a null key is a key."""
    from pyspark.sql import functions as F

    from modalith.operators import order

    monkeypatch.setattr(order, "RUNS", runs, raising=False)
    monkeypatch.setattr(order, "RANGE_ROWS", 100, raising=False)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    out = order.row_number_within(rows, ["k"], ["id"], "n", "of")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("_p" in x for x in plan.splitlines() if "Join" in x)
    assert sorted((r.id, r.n, r.of) for r in out.collect()) == [(i, i // 3 + 1, 1000) for i in range(3000)]


def test_snapshots_keep_what_they_read(spark):
    """F16: what is dealt by ranges carries no text of an answer."""
    plan = QUERIES["snapshot_wide"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "requirement" not in plan and "modals_found" not in plan


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """a task holds no more of more rows."""
    from modalith.operators import order

    monkeypatch.setattr(order, "RANGE_ROWS", 10, raising=False)
    out = order.row_number(spark.range(1000), ["id"], "n")
    assert out.rdd.getNumPartitions() == 100
    assert [(r.id, r.n) for r in out.orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]


def test_fallback_counts_by_index_at_once(spark):
    """indices are counted in one aggregation, not sorted for joins."""
    plan = QUERIES["batch_fallback"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "request_index" in x]


def test_recounts_rank_nothing(spark):
    """the report row's counts come from its own aggregation, without its AUROCs."""
    plan = QUERIES["rate_recount"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "auroc" not in plan and "variation" not in plan


def test_objects_are_found_without_a_scan(spark):
    """the regular expression and the scan over characters agree; only deep nesting is left to the scan."""
    import random

    from pyspark.sql import functions as F

    from modalith.functions import parse

    draw = random.Random(5)
    texts = ["".join(draw.choice('{}{}""\\a\n') for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    texts += [None, "", '{"a": 1} and {"b": {"c": "}"}}', "{" * 9 + "}" * 9, "{" * 9 + "}" * 8, 'so {"q\\', '{"q\\\\', '{"é😀}"}😀{', "{}" * 400, '{"a":"' + '\\"' * 400 + '"']
    raw, none = F.col("raw"), F.struct(F.array().cast("array<string>").alias("found"), F.lit(False).alias("open"))
    rows = spark.createDataFrame([(x,) for x in texts], "raw string")
    scan = F.when(F.contains(raw, F.lit("{")), parse.scanned(raw)).otherwise(none)
    got = rows.select(raw, raw.rlike(parse.READABLE).alias("read"), parse.objects(raw).alias("a"), scan.alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert sum(r.read is False for r in got) < 0.02 * len(got)
    long = spark.createDataFrame([('{"a":"' + '\\"' * 200_000 + '"}',), ("{" + '"a",' * 200_000 + "}",), ("{}" * 200_000,)], "raw string")
    assert long.where(raw.rlike(parse.READABLE)).select(F.size(parse.objects(raw)["found"]).alias("n")).agg(F.sum("n")).first()[0] == 200_002


def test_text_features_are_kept_in_all_tasks(spark):
    """parts lie in one split; a fold's fits neither run in one task nor cut n-grams again."""
    from modalith.operators import probes
    from modalith.sources.views import frame

    data, _, _ = probes.features(frame(spark, SF, "part").select("p_name"), None, "p_name")
    assert data.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "_grams" not in data.columns and "transform(" not in data._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("most", [200_000, 0])
def test_grams_of_texts_are_not_broadcast(spark, repeated, monkeypatch, most):
    """F1 of round 3: the driver gathers no table of a row a text and gram; many grams are joined by merging. Texts are
    shuffled, not their grams."""
    from modalith.operators import vectors

    monkeypatch.setattr(vectors, "GRAMS", most, raising=False)
    plan = QUERIES["tfidf_weights"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) == 1 and ("BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0] if most else "SortMergeJoin" in joins[0])
    assert not most or plan.count("Exchange hashpartitioning") == 1
    same(spark, repeated, "tfidf_weights")
