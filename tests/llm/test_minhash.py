import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from modalith.llm import minhash
from modalith.llm.queries import op1_minhash

SF = "/root/testdata/sf0.001"


def bag(text, width=5):
    words = (text or "").lower().split()
    k = min(width, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def classes(rows, threshold=0.8):
    """Least id of the component of each (id, text) under equal texts and links at the threshold, by all pairs."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and 0.8 * max(bags[i].total(), bags[j].total()) <= min(bags[i].total(), bags[j].total()):
                if minhash.weighted_jaccard(bags[i], bags[j]) >= threshold:
                    root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(rows))]


def test_signatures_are_unbiased():
    rng = random.Random(3)
    items = [np.uint64(rng.getrandbits(64)) for _ in range(300)]
    weights = [rng.choice([1, 1, 1, 2, 3, 7, 20]) for _ in items]
    x = np.array([h for h, w in zip(items, weights) for _ in range(w)], dtype=np.uint64)
    for cut in (0.2, 0.5, 0.9):
        kept = [(h, w if rng.random() < cut else rng.randrange(w)) for h, w in zip(items, weights)]
        y = np.array([h for h, w in kept for _ in range(w)], dtype=np.uint64)
        true = minhash.weighted_jaccard(Counter(x.tolist()), Counter(y.tolist()))
        sig = minhash.signatures([x, y], 4000)
        assert abs((sig[0] == sig[1]).mean() - true) < 5 * (true * (1 - true) / 4000) ** 0.5 + 1e-3
    alone, again = minhash.signatures([x], 200), minhash.signatures([y, x[::-1].copy()], 200)
    assert (alone[0] == again[1]).all()
    assert (minhash.signatures([np.array([5], dtype=np.uint64)], 200) != 0).all()


@pytest.mark.parametrize("block", [2048, 8])
def test_classes_are_those_of_all_pairs(spark, block):
    """Families of drifting copies, whose members link to some of each other only."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(5):
        text = [word() for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(25):
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 3, " ".join(text)))
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, "x " * 5000), (1006, "x " * 4500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, block=block).collect()}
    assert [got[k] for k, _ in rows] == classes(rows)


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = op1_minhash(spark, SF).toPandas().set_index("doc_id")
    want = classes(list(zip(docs.doc_id.tolist(), docs.text)))
    assert got.loc[docs.doc_id].class_id.tolist() == want
    assert (got.kept == (got.class_id == got.index)).all()


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("class_id", T.StringType()), T.StructField("rep", T.StringType())])
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (1, "a b c", "x", "y"), (1, "d e f", None, None), (None, "a b c", None, None), (7, None, None, None)], schema)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
