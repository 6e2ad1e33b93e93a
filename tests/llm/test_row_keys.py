import random
from collections import Counter

from pyspark.sql import types as T

from modalith.llm import minhash, mixing, suffix

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def text_of(seed, n=80):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", len(t)) for i, t in rows], SCHEMA)


def test_take_keeps_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "one"), (None, "one two"), (7, "one two three"), (7, "four words are here"), (7, "four words are here"), (8, "alone")]
    got = Counter((r.doc_id, r.text) for r in mixing.take(table(spark, rows)).collect())
    # one source: 1.5 of all words are in demand, so each row is taken whole at least once
    assert all(got[k] >= n for k, n in Counter(rows).items())
    words = lambda pairs: sum(len(t.split()) for _, t in pairs)
    assert words(got.elements()) == int(1.5 * words(rows))


def test_strip_repeats_leaves_each_row_its_own_text(spark):
    shared = text_of("shared")
    own = [text_of(k) for k in range(6)]
    rows = [(1, own[0] + shared), (1, own[1] + shared), (1, own[2]), (None, own[3] + shared), (None, own[4]), (2, own[5])]
    got = [(r.doc_id, r.text, r.n_chars) for r in suffix.strip_repeats(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(((i, t, len(t)) for i, t in zip((1, 1, 1, None, None, 2), own)), key=str)


def test_keep_one_leaves_one_row_of_each_class(spark):
    a, b, c = text_of("a"), text_of("b"), text_of("c")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (3, ""), (3, "")]
    got = [(r.doc_id, r.text) for r in minhash.keep_one(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (3, ""), (3, "")], key=str)


def test_copies_under_one_id_survive_the_stages(spark):
    a, b = text_of("a"), text_of("b")
    docs = mixing.take(suffix.strip_repeats(minhash.keep_one(table(spark, [(1, a), (1, a), (2, b), (None, b)]))))
    assert {r.text for r in docs.collect()} >= {a, b}
