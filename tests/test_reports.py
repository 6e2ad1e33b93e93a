import pytest
from pyspark.sql import functions as F

from modalith.operators import observe, order, resample, scores

KEYS = ["model", "item_id"]
SCHEMA = "model string, item_id string, sample_kind string, label string, confidence double, seq long"


def rows(spark):
    data = [("a", "i", "deterministic", "optional", 0.9, 1), ("b", "i", "deterministic", "mandatory", 0.6, 1), ("a", "j", "deterministic", None, 0.5, 1)]
    data += [("a", "i", "stochastic", x, 0.5, k) for k, x in enumerate(("optional", "optional", "mandatory", None))]
    data += [("b", "i", "stochastic", None, 0.5, 0)]
    return spark.createDataFrame(data, SCHEMA)


def build(spark, **kw):
    found = scores.build(rows(spark), KEYS, ["item_id"], "model", ["seq"], **({"plan": 5} | kw))
    return {(r.model, r.item_id, r.uq_method): r for r in found.collect()}


def test_every_method_has_its_rows(spark):
    got = build(spark)
    assert set(got) == {("a", "i", "verbalized_confidence"), ("b", "i", "verbalized_confidence"), (None, "i", "model_ensemble_disagreement"), *(("a", "i", m) for m in ("modality_consistency", "predictive_entropy", "variation_ratio"))}
    group = got["a", "i", "variation_ratio"]
    assert (group.valid_n, group.total_n, group.parse_failures, group.stochastic_complete, group.pred_modality) == (3, 5, 2, False, "optional")
    assert abs(group.uncertainty_score - 1 / 3) < 1e-12 and abs(got["a", "i", "verbalized_confidence"].uncertainty_score - 0.1) < 1e-12
    ensemble = got[None, "i", "model_ensemble_disagreement"]
    assert (ensemble.uncertainty_score, ensemble.pred_modality, ensemble.total_n) == (0.5, "optional", 2)


def test_small_groups_go_and_semantic_scores_come(spark):
    assert ("a", "i", "variation_ratio") not in build(spark, min_valid=4)
    semantic = spark.createDataFrame([("a", "i", 0.25), ("z", "i", 0.5)], "model string, item_id string, semantic_score double")
    got = build(spark, semantic=semantic)
    assert got["a", "i", "acse_semantic_entropy"].uncertainty_score == 0.25 and ("z", "i", "acse_semantic_entropy") not in got


def test_a_plan_is_not_guessed(spark):
    with pytest.raises(ValueError):
        build(spark, plan=None)
    group = build(spark, plan=None, infer=True)["a", "i", "variation_ratio"]
    assert (group.total_n, group.sampling_plan_source) == (4, "inferred")


def test_ids_must_match_once(spark):
    mk = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert observe.exact_join(mk([1, 2]), mk([2, 1]), "id").count() == 2
    for left, right in (([1], [1, 2]), ([1, 2], [1]), ([1], [1, 1])):
        with pytest.raises(ValueError):
            observe.exact_join(mk(left), mk(right), "id")


def test_intervals_belong_to_their_own_rows(spark):
    data = [("x", f"c{i}", i % 2, 1) for i in range(40)] + [("y", f"c{i}", 1, 1) for i in range(5)] + [("z", "c", 0, 0)]
    c = spark.createDataFrame(data, "k string, c string, num int, den int")
    got = {r.k: r for r in resample.rate_intervals(c, ["k"], "c", "num", "den", 200, "1").collect()}
    assert set(got) == {"x", "y"} and (got["y"].ci_low, got["y"].ci_high) == (1.0, 1.0)
    assert 0.2 < got["x"].ci_low < 0.5 < got["x"].ci_high < 0.8
    table = resample.attach(c.select("k").distinct(), resample.rate_intervals(c, ["k"], "c", "num", "den", 50, "1"), ["k"], "p")
    assert {r.k: r.p_ci_low is None for r in table.collect()} == {"x": False, "y": False, "z": True}


def test_unknown_names_come_last(spark):
    df = spark.createDataFrame([("b",), ("q",), ("a",), ("c",)], "n string")
    assert [r.n for r in df.orderBy(order.display_position(F.col("n"), ["c", "b"]), "n").collect()] == ["c", "b", "a", "q"]
