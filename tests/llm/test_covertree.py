import numpy as np
import pytest
from pyspark.sql import types as T

from modalith.llm import covertree
from modalith.llm.queries import op8_covertree


def brute(rows, threshold=0.9):
    """{row: (n_links, component)} by all pairs; rows: (id, vector or None), ids unique."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = {i: rows[i][0] for i in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a, i in enumerate(ok):
            best = min([label[i], *(label[ok[b]] for b in np.flatnonzero(near[a]))])
            if best < label[i]:
                label[i], changed = best, True
    links = dict.fromkeys(range(len(rows)), 0) | {i: int(near[a].sum()) for a, i in enumerate(ok)}
    return {rows[i][0]: (links[i], label[i]) for i in range(len(rows))}


@pytest.mark.parametrize("dim,block,pivots", [(3, 4096, 1024), (3, 40, 5), (16, 25, 1024), (64, 100, 2)])
def test_links_and_components_are_those_of_all_pairs(spark, dim, block, pivots):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(30, dim))
    x = np.concatenate([base[rng.integers(0, 30, 250)] + rng.normal(size=(250, dim)) * rng.choice([0, 0.05, 0.3], size=(250, 1)), rng.normal(size=(60, dim)) * 1e3])
    rows = [(int(i) * 2 + 1, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * dim), (5002, [float("nan")] * dim), (5003, [float("inf")] + [1.0] * (dim - 1)), (5004, []), (5005, [None] + [1.0] * (dim - 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.links(df, block=block, pivots=pivots).collect()}
    assert got == brute(rows)
    assert max(n for n, _ in got.values()) > 5


def test_query_on_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op8_covertree(spark, sf).collect()}
    want = brute([(i, [float(c) for c in v]) for i, v in zip(e.vec_id.tolist(), e.embedding)])
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType()), T.StructField("n_links", T.StringType())])
    rows = [(1, [1.0, 0.0], "a", "b"), (1, [1.0, 0.0], None, None), (1, [0.0, 1.0], None, None), (2, [1e300, 1e290], None, None), (3, [1e-300, 0.0], None, None), (None, [1.0, 0.0], None, None), (4, [1.0, 0.0, 0.0], None, None)]
    got = covertree.links(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 0, None), (1, 0, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4)]
    assert covertree.links(spark.createDataFrame([], schema)).count() == 0
    assert covertree.links(spark.createDataFrame([(1, None, None, None)], schema)).count() == 1


def test_nodes_out_of_reach_are_never_compared(monkeypatch):
    rng = np.random.default_rng(1)
    centers = np.eye(6)[:, :6]
    x = np.concatenate([c + rng.normal(size=(300, 6)) * 0.05 for c in centers])
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[rng.permutation(len(x))]
    compared, plain = [], covertree.direct

    def counted(x, y, a, b, *rest):
        compared.append(len(a) * len(b))
        plain(x, y, a, b, *rest)

    monkeypatch.setattr(covertree, "direct", counted)
    found = np.zeros((len(x), len(x)), dtype=bool)

    def meet(p, q, mask):
        assert not (found[np.ix_(p, q)] & mask).any()
        found[np.ix_(p, q)] |= mask

    tree = covertree.build(x)
    covertree.traverse(x, x, tree, tree, 0.98, meet, True)
    want = np.triu(x @ x.T >= 0.98, 1)
    assert ((found | found.T) == (want | want.T)).all()
    assert sum(compared) < len(x) ** 2 / 4
