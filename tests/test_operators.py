import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalith.operators import graph, metrics, observe, order, resample, scores, vectors
from modalith.sources import log_store, sinks


def test_majority_ties_go_to_the_weakest(spark):
    rows = [(1, "mandatory"), (1, "optional"), (2, "recommended"), (2, "recommended"), (2, None), (3, None)]
    s = scores.label_shares(spark.createDataFrame(rows, "item_id int, label string"), ["item_id"])
    got = {r.item_id: (r.m, r.h, r.valid_n, r.total_n) for r in s.select("item_id", scores.majority().alias("m"), scores.entropy().alias("h"), "valid_n", "total_n").collect()}
    assert got[1][0] == "optional" and math.isclose(got[1][1], math.log(2) / math.log(4))
    assert got[2] == ("recommended", 0.0, 2, 3) and got[3][:2] == (None, None)


def test_score_schema_is_pinned():
    assert len(scores.SCORE_SCHEMA) == 49 and len(set(scores.SCORE_SCHEMA.names)) == 49


def test_dedupe_takes_the_latest_ok_else_the_latest(spark):
    rows = [("a", 1, "ok"), ("a", 2, "bad"), ("b", 1, "bad"), ("b", 2, "bad"), ("c", 1, "ok"), ("c", 2, "ok")]
    df = spark.createDataFrame(rows, "k string, seq int, status string")
    got = observe.dedupe_latest(df, ["k"], F.col("status") == "ok", [F.col("seq")])
    assert {(r.k, r.seq) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_exact_pairs_need_one_eligible_row_on_either_side(spark):
    mk = lambda rows: spark.createDataFrame(rows, "k string, eligible boolean")
    got = observe.exact_pairs(mk([("a", True), ("b", True), ("b", True), ("c", True), ("d", False)]), mk([("a", True), ("b", True), ("d", True), ("e", True)]), ["k"])
    assert {r.k: r.pair_class for r in got.collect()} == {"a": "matched", "b": "duplicate", "c": "unmatched", "d": "ineligible", "e": "unmatched"}


def test_auroc_counts_ties_half_and_is_undefined_for_one_class(spark):
    df = spark.createDataFrame([("x", 1, 2.0), ("x", 0, 1.0), ("x", 1, 1.0), ("x", 0, 0.5), ("y", 1, 1.0)], "g string, y int, s double")
    got = {r.g: r.auroc for r in metrics.auroc(df, ["g"], F.col("y"), F.col("s")).collect()}
    assert got == {"x": 0.875, "y": None}


def test_components_of_long_chains(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert set(got.values()) == {"n000", "z1"} and got["n060"] == "n000"


def test_bootstrap_of_equal_clusters_has_no_width(spark):
    rows = spark.createDataFrame([(f"c{i}", k % 2) for i in range(10) for k in range(4)], "c string, y int")
    clusters = resample.cluster_sums(rows, "c", {"num": F.col("y"), "den": F.lit(1)})
    rates = {r.rate for r in resample.bootstrap_rates(clusters, "num", "den", 20, "1").collect()}
    assert rates == {0.5}


@pytest.mark.parametrize("points,clusters", [([[1, 0], [1, 0], [0, 1]], 2), ([[0, 0]] * 5, 5), ([[1, 0], [1, 0], [1, 0]], 1)])
def test_average_linkage(points, clusters):
    assert vectors.cluster_diagnostics(points, 0.35)["clusters"] == clusters


def test_points_at_the_threshold_stay_apart():
    d = np.array([[0, 0.35], [0.35, 0]])
    assert vectors.average_linkage(d, 0.35) == [0, 1] and vectors.average_linkage(d, 0.3501) == [0, 0]


def test_cluster_entropy_is_over_observed_clusters():
    d = vectors.cluster_diagnostics([[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], 0.35)
    p = np.array([2, 1, 1]) / 4
    assert d["clusters"] == 3 and math.isclose(d["cluster_entropy"], float(-(p * np.log(p)).sum() / np.log(3)))


def test_orders_without_one_task(spark):
    rng = np.random.default_rng(5)
    rows = [(int(v), i, "ab"[i % 2]) for i, v in enumerate(rng.integers(0, 20, 300))]
    df = spark.createDataFrame(rows, "v int, i int, k string")
    got = {r.i: r.n for r in order.row_number(df, ["v", "i"], "n").collect()}
    assert got == {i: n for n, (_, i, _) in enumerate(sorted(rows), 1)}
    within = {r.i: (r.n, r.c) for r in order.row_number_within(df, ["k"], ["v", "i"], "n", "c").collect()}
    assert within == {i: (n, 150) for k in "ab" for n, (_, i, _) in enumerate(sorted(r for r in rows if r[2] == k), 1)}
    ranks = {r.i: r.rank for r in order.average_ranks(df, "v", "rank").collect()}
    values = [r[0] for r in rows]
    assert all(math.isclose(ranks[i], sum(x < v for x in values) + (values.count(v) + 1) / 2) for v, i, _ in rows)
    dealt = [r.b for r in spark.range(1, 12).select(order.equal_buckets(F.col("id"), F.lit(11), 3).alias("b")).collect()]
    assert dealt == [1] * 4 + [2] * 4 + [3] * 3


def test_request_clusters_are_the_components_of_pairs(spark):
    from modalith.plans.observation_queries import request_components, request_pairs

    pairs = request_pairs(spark, "/root/testdata/sf0.001").toPandas()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in pairs.itertuples():
        a, b = sorted((find(r.left_request), find(r.right_request)))
        root[b] = a
    got = request_components(spark, "/root/testdata/sf0.001").toPandas().set_index(["model", "item_id"]).cluster
    assert len(got) == len(pairs) > 0
    assert all(got[(r.model, r.item_id)] == find(r.left_request) == find(r.right_request) for r in pairs.itertuples())


def test_request_clusters_fall_back_where_a_request_is_blank(spark):
    df = spark.createDataFrame([("r1", "r2", "c1"), (" ", "r2", "c2")], "l string, r string, c string")
    assert sorted(x.cluster for x in graph.request_clusters(df, "l", "r", "c").collect()) == ["c1", "c2"]


def test_scores_of_runs_with_equal_file_names(spark, tmp_path):
    for run, value in (("a", "1"), ("b", "2")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "uq_scores.csv").write_text(f"item_id,score\ni1,{value}\n")
    manifest = spark.createDataFrame([(str(tmp_path / r / "uq_scores.csv"), f"m-{r}") for r in "ab"], "path string, model string")
    got = sorted((r.model, r.score) for r in log_store.read_scores(spark, manifest, ["item_id", "score"]).collect())
    assert got == [("m-a", "1"), ("m-b", "2")]
    with pytest.raises(FileNotFoundError):
        log_store.read_scores(spark, spark.createDataFrame([(str(tmp_path / "c.csv"), "m")], "path string, model string"), ["item_id"])


def test_markdown_is_whole_or_an_error(spark):
    assert len(sinks.markdown(spark.range(1500).toDF("n")).splitlines()) == 1502
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(11).toDF("n"), most=10)


def test_log_round_trip(spark, tmp_path):
    tail = tmp_path / "tail.jsonl"
    tail.write_text('{"run_id": "r1", "model": "m", "request_seed": 7, "request_indices": [1, 2]}\nnot json\n{"run_id": "r2", "error": ""}\n')
    rows, bad = log_store.read_jsonl(spark, str(tail))
    assert {r.run_id for r in rows.collect()} == {"r1", "r2"} and [r.prefix for r in bad.collect()] == ["not json"]
    sinks.compact(spark, rows, str(tmp_path / "store"))
    with pytest.raises(FileExistsError):
        sinks.compact(spark, rows, str(tmp_path / "store"))
    both = log_store.read_log(spark, str(tmp_path / "store"), str(tail), columns=["run_id", "no_such"], run_ids=["r1"])
    assert both.columns == ["run_id"] and both.count() == 2
    assert log_store.read_log(spark, None, str(tmp_path / "absent")).count() == 0
    assert log_store.read_log(spark, str(tmp_path / "store"), None, run_ids=[]).count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, seq int, v string")
    got = sinks.upsert(old, new, ["k"], "seq")
    assert {(r.k, r.v) for r in got.collect()} == {("a", "z"), ("b", "y")}
    path, candidate = str(tmp_path / "t"), str(tmp_path / "t_candidate")
    assert [sinks.write_if_changed(x, path, candidate) for x in (old, old, got)] == [False, False, True]
    m = sinks.manifest({"t": old})
    sinks.verify(m, {"t": old})
    with pytest.raises(RuntimeError):
        sinks.verify(m, {"t": new})
    assert sinks.markdown(new).splitlines()[-1] == "| a | 2 | z |"
    sinks.write_csv(old, str(tmp_path / "csv"), ["v", "k"])
    assert log_store.read_csv(spark, str(tmp_path / "csv"), ["v", "k"]).orderBy("k").first().v == "x"


def test_requirements_from_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<doc><req id="1" marker="M"><text_body>The  system\nshall x.</text_body></req><req id="2"><text_body>y</text_body></req></doc>')
    rows = log_store.read_requirements(spark, str(tmp_path / "d.xml")).orderBy("requirement_id").collect()
    assert [tuple(r) for r in rows] == [("1", "M", 1, "", "The system shall x."), ("2", "", 0, "", "y")]
