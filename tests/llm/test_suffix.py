import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from modalith.llm import suffix
from modalith.llm.queries import op10_suffix

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text, by counting every substring."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = suffix.merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        kept, last = b"", 0
        for lo, hi in spans:
            kept, last = kept + t[last:lo], hi
        kept += t[last:]
        out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def bare(texts, length):
    """Each text without what brute force says repeats."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    return [suffix.without(t, suffix.merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])).decode("utf-8", "ignore") for t in raw]


def compare(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, **kw).collect()}
    want = brute(texts, kw.get("length", 400))
    assert [got[i] for i in range(len(texts))] == want
    return sum(w[1] > 0 for w in want)


def family(rng, n, length):
    """Texts that share stretches in many ways: copies, edits, common passages, periodic and short texts."""
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = rng.choice(base)
        kind = rng.randrange(6)
        if kind == 0:
            k = rng.randrange(len(t))
            t = t[:k] + word() + t[k:]
        elif kind == 1:
            t = word() * rng.randint(1, 4) + t[: rng.randrange(len(t))] + rng.choice(base)
        elif kind == 2:
            t = " ".join(word() for _ in range(rng.randint(0, 40)))
        elif kind == 3:
            t = rng.choice(["", None, "ab" * rng.randint(1, 3 * length), "a" * rng.randint(1, 2 * length)])
        out.append(t)
    return out


@pytest.mark.parametrize("seed,most", [(1, 8192), (2, 8192), (3, 2), (4, 3)])
def test_against_counting_every_substring(spark, seed, most):
    rng = random.Random(seed)
    assert compare(spark, family(rng, 60, 40), length=40, gram=8, most=most) > 10


@pytest.mark.parametrize("seed", [11, 12])
def test_longer_repeats_lie_within_shorter_ones(spark, seed):
    texts = family(random.Random(seed), 60, 40)
    assert compare(spark, texts, length=40, gram=8, passage=24) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.without_passages for r in suffix.remove_repeats(docs, length=40, gram=8, passage=24).collect()}
    assert [got[i] for i in range(len(texts))] == bare(texts, 24)


def test_long_documents_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 64)
    import numpy as np

    rng = random.Random(5)
    texts = [t.encode() for t in family(rng, 30, 40) if t] + [bytes(rng.choice(b"ab") for _ in range(3000))]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    cut = [x.tolist() for x in suffix.anchor_runs(data, offsets, 40, 8)]
    monkeypatch.setattr(suffix, "CHUNK", 1 << 20)
    assert cut == [x.tolist() for x in suffix.anchor_runs(data, offsets, 40, 8)]


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = op10_suffix(spark, SF).toPandas().set_index("doc_id")
    for d, want in zip(docs.doc_id, brute(docs.text, 400)):
        r = got.loc[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
    for d, text in zip(docs.doc_id, bare(docs.text, suffix.PASSAGE)):
        assert got.loc[d].text == text


def test_maximal_repeats_have_all_occurrences(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = word(50)
    texts = [word(30) + shared + word(30) for _ in range(4)] + [word(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix.maximal_repeats(docs, length=40, gram=8).collect()
    assert {r.doc for r in rows} == {0, 1, 2, 3}
    for r in rows:
        assert r.length >= 50 and shared[:40] in texts[r.doc] and texts[r.doc][r.start : r.start + 50] == texts[r.doc][30:80]


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("doc", T.LongType())])
    t = "x y z " * 100
    docs = spark.createDataFrame([(1, t, "k", 1), (1, t, "k", 1), (2, t, None, None), (None, None, None, None), (5, "", None, None)], schema)
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == 5 and sum(r.n_removed for r in got) == 3 * len(t)
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
