import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalith.operators import probes, vectors
from modalith.plans import catalog  # noqa: F401  registers the queries
from modalith.plans.registry import QUERIES
from modalith.sources.views import frame

SF = "/root/testdata/sf0.001"


def auroc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None


def table(spark):
    return frame(spark, SF, "v_vectors").orderBy("vec_id").toPandas()


def logistic(x, y, w, ridge, rounds=60):
    """Newton's method; the intercept isn't penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, pen = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        grad = x.T @ (w * (p - y)) / w.sum() + pen * b
        hess = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + np.diag(pen)
        b -= np.linalg.solve(hess, grad)
    return b


def test_held_out_predictions_are_those_of_plain_folds(spark):
    t = table(spark)
    x, y = np.array(t.embedding.tolist(), dtype=float), (t.label < 5).astype(float).to_numpy()
    got = QUERIES["held_out_predictions"](spark, SF).toPandas().set_index("vec_id")
    fold = got.loc[t.vec_id].fold.to_numpy()
    assert (t.assign(fold=fold).groupby("item").fold.nunique() == 1).all()
    for k in range(3):
        train, held = fold != k, fold == k
        n = int(train.sum())
        mean = x[train].mean(axis=0)
        _, _, axes = np.linalg.svd(x[train] - mean, full_matrices=False)
        z = x @ axes[: min(128, 64, n)].T
        sd = z[train].std(axis=0, ddof=1)
        keep = sd > 1e-9  # with fewer rows than axes the last ones hold nothing but rounding
        z = (z[:, keep] - z[train][:, keep].mean(axis=0)) / sd[keep]
        counts = np.array([(y[train] == v).sum() for v in (0, 1)])
        b = logistic(z[train], y[train], n / (2 * counts[y[train].astype(int)]), 1 / n)
        want = 1 / (1 + np.exp(-(z[held] @ b[:-1] + b[-1])))
        ours = np.array(got.loc[t.vec_id[held]].probabilities.tolist())[:, 1]
        assert np.abs(ours - want).max() < 0.02


def test_probe_summary_is_that_of_its_predictions(spark):
    p = QUERIES["held_out_predictions"](spark, SF).toPandas()
    r = QUERIES["probe_summary"](spark, SF).first()
    each = [auroc(g.target, g.probabilities.str[1]) for _, g in p.groupby("fold")]
    each = [a for a in each if a is not None]
    assert r.folds == 3 and math.isclose(r.mean_auroc, np.mean(each), abs_tol=1e-3) and math.isclose(r.sd_auroc, np.std(each, ddof=1), abs_tol=2e-3)
    assert (r.lo is None) == (r.draws < 900)
    assert r.lo is None or r.lo <= r.hi


def test_budgets_are_chosen_inside_the_training_fold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    rows = [(i, i % 24, [float(a) for a in v], float((v[0] * v[1] > 0))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, g int, e array<double>, y double").withColumn("fold", F.col("g") % 3)
    data, steps, width = probes.features(df.withColumn("_y", F.col("y")), "e", None)
    best, curve = probes.select_budget(data, steps, width, "g", (1, 8, 8), 2)
    assert [b for b, _ in curve] == [1, 8] and best == min(curve, key=lambda c: (c[1], c[0]))[0] == 8
    out = probes.held_out(df, F.col("y") == 1, "fold", "g", vector="e", kind="boosted", budgets=(1, 8)).collect()
    assert len(out) == 240 and auroc([r.target for r in out], [r.probabilities[1] for r in out]) > 0.8
    for budgets in ((), (0, 2)):
        with pytest.raises(ValueError):
            probes.select_budget(data, steps, width, "g", budgets, 2)
    with pytest.raises(ValueError):
        probes.select_budget(data.withColumn("_y", F.lit(1.0)).withColumn("g", F.lit(1)), steps, width, "g", (1,), 2)


def test_intervals_need_nine_tenths_of_the_draws(spark):
    got = spark.createDataFrame([(899,), (900,)], "n int").select(probes.enough(F.col("n"), 1000).alias("ok")).collect()
    assert [r.ok for r in got] == [False, True]


def clusters(x, threshold):
    """Average linkage from the list of pair distances."""
    x = np.array(x, dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(1 - unit @ unit.T, 0, 2)
    parts = [{i} for i in range(len(x))]
    while len(parts) > 1:
        mean, a, b = min((np.mean([d[i, j] for i in p for j in q]), a, b) for a, p in enumerate(parts) for b, q in enumerate(parts) if a < b)
        if mean >= threshold:
            break
        parts[a] |= parts.pop(b)
    return d, parts


def score(x, threshold, weight):
    d, parts = clusters(x, threshold)
    n = len(x)
    share = [len(p) / n for p in parts]
    entropy = -sum(p * math.log(p) for p in share) / math.log(len(share)) if len(share) > 1 else 0.0
    mean = lambda who: np.mean([d[i, j] for i in who for j in who if i < j]) if len(who) > 1 else 0.0
    tops = [p for p in parts if len(p) == max(map(len, parts))]
    return [(1 - weight) * entropy + weight * min(1.0, max(mean(range(n)), mean(p)) / threshold) for p in tops], len(parts)


def test_semantic_queries_against_plain_linkage(spark):
    items = table(spark).groupby("item").embedding.apply(list).to_dict()
    got = {r.item: r for r in QUERIES["semantic_clusters"](spark, SF).collect()}
    assert set(got) == set(items)
    for k, x in items.items():
        wanted, n = score(x, 0.35, 0.2)
        assert got[k].clusters == n and any(math.isclose(got[k].semantic_uncertainty_score, w, abs_tol=1e-6) for w in wanted)
    grid = {(r.threshold, r.weight): r for r in QUERIES["semantic_grid"](spark, SF).collect()}
    assert set(grid) == {(t, w) for t in vectors.THRESHOLDS for w in vectors.WEIGHTS}
    for (t, w), r in grid.items():
        each = [score(x, t, w)[0] for x in items.values()]
        assert r.items == len(items) and np.mean([min(e) for e in each]) - 1e-6 <= r.mean_score <= np.mean([max(e) for e in each]) + 1e-6


def test_sensitivity_run_against_its_scores(spark):
    t = table(spark)
    label = (t.groupby("item").label.mean() < 4.5).to_dict()
    rows = QUERIES["sensitivity_run"](spark, SF).collect()
    assert len(rows) == 60 and all(r.reproduced for r in rows)
    items = t.groupby("item").embedding.apply(list).to_dict()
    own = {k: vectors.cluster_diagnostics(x, 0.35) for k, x in items.items()}
    value = {k: 0.8 * d["cluster_entropy"] + 0.2 * d["dispersion"] for k, d in own.items()}
    for r in rows:
        who = [k for k in items if r.slice == "all" or k % 2 == 0]
        assert r.n == len(who)
        if (r.threshold, r.weight) == (0.35, 0.2):
            want = auroc([label[k] for k in who], [value[k] for k in who])
            assert (r.auroc is None and want is None) or math.isclose(r.auroc, want, abs_tol=1e-6)
            assert want is None or (r.delta, r.delta_lo, r.delta_hi) == (0.0, 0.0, 0.0)


def test_projection_is_that_of_the_covariance(spark):
    t = table(spark)
    x = np.array(t.embedding.tolist(), dtype=float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = np.abs(x @ axes[:2].T)
    got = QUERIES["pca_projection"](spark, SF).toPandas().set_index("vec_id").loc[t.vec_id]
    assert np.abs(got[["abs_x", "abs_y"]].to_numpy() - want).max() < 1e-4
