import random

import numpy as np
from pyspark.sql import types as T

from modalith.llm import quality

SF = "/root/testdata/sf0.01"


def test_em_recovers_accuracies_of_planted_labellers():
    rng = random.Random(5)
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.6]
    counts = {}
    truth = {}
    for _ in range(20000):
        good = rng.random() < 0.8
        code = 0
        for a in right:
            vote = quality.NONE if rng.random() < 0.2 else (quality.GOOD if good == (rng.random() < a) else quality.BAD)
            code = code * 3 + vote
        counts[code] = counts.get(code, 0) + 1
        truth[code] = truth.get(code, 0) + good
    posterior, rates, share = quality.estimate(counts)
    assert abs(share - 0.8) < 0.03
    for j, a in enumerate(right):
        told = rates[1][j][quality.GOOD] / (rates[1][j][quality.GOOD] + rates[1][j][quality.BAD])
        assert abs(told - a) < 0.04
    hit = sum(truth[c] if posterior[c] >= 0.5 else counts[c] - truth[c] for c in counts)
    assert hit / 20000 > 0.95


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.classify(docs.select("doc_id", "text")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() > 0.997
    assert (~bad.keep).mean() > 0.9


def test_scores_are_the_logistic_of_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    w = np.linspace(-1, 1, quality.DIMS + 1)
    for r in quality.score(docs, w).collect():
        n, found = quality.ratios(r.text)
        z = quality.features(r.text, found, n) @ w[:-1] + w[-1]
        assert abs(r.quality_score - 1 / (1 + np.exp(-z))) < 1e-6


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("keep", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    rows = [(1, None, "x", None), (2, "", "x", []), (None, "A clean line of words.", None, ["a"]), (3, "A clean line of words.", None, None), (3, "### " * 9000, None, None)]
    got = quality.classify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {r.doc_id: r.keep for r in got if r.doc_id in (1, 2)} == {1: False, 2: False}
    assert quality.classify(spark.createDataFrame([], schema)).count() == 0
    same = quality.classify(spark.createDataFrame([rows[2], rows[2]], schema)).collect()
    assert [r.keep for r in same] == [True, True]


def test_query_is_the_plain_classifier(spark):
    """All texts of the small table are the training sample, so the whole of it can be done by hand."""
    from modalith.llm.queries import op5_quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    told = {d: quality.ratios(t or "") for d, t in zip(docs.doc_id, docs.text)}
    codes = {d: quality.pattern(*told[d]) for d in told if told[d][0]}
    counts = {}
    for c in codes.values():
        counts[c] = counts.get(c, 0) + 1
    posterior, _, _ = quality.estimate(counts)
    x = np.array([quality.features(t, told[d][1], told[d][0]) for d, t in zip(docs.doc_id, docs.text) if d in codes])
    w = quality.fit(x, np.array([posterior[codes[d]] for d in docs.doc_id if d in codes]))
    want = dict(zip([d for d in docs.doc_id if d in codes], 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))))
    got = op5_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.quality_score - want.get(r.doc_id, 0.0)) < 1e-3
        assert r.keep == (r.quality_score >= 0.5)


def test_results_can_have_other_names(spark):
    df = spark.createDataFrame([(1, "A line of words.", "mine")], "doc_id long, text string, keep string")
    row = quality.classify(df, names=("s", "k")).first()
    assert row.keep == "mine" and row.k is True
