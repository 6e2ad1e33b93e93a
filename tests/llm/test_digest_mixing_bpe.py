import hashlib
import math
import re
import struct
import unicodedata

import pytest
from pyspark.sql import types as T

from modalith.llm import bpe, digest, mixing
from modalith.llm.queries import op6_mixing, op7_digest, op9_bpe, vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("fingerprint", T.StringType())])
ODD = [(1, None, "a", "x"), (2, "", None, "x"), (3, "Été  TÊTE", "b", "x"), (4, "Été tête ", "b", None), (4, "two words", "b", "x"), (9, "w " * 3000, "a", "x"), (None, "null id", None, None)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)


def test_digest_against_plain_python(spark, documents):
    got = op7_digest(spark, SF).toPandas().set_index("doc_id")
    texts = [t or "" for t in documents.text]
    assert len(got) == len(texts)
    canon = [re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).casefold()).strip() for t in texts]
    for i, doc in enumerate(documents.doc_id):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        row = got.loc[doc]
        assert row.n_chars == len(t)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == float(row.fingerprint == row.edited_fingerprint)
        assert row.near_next == float(canon[i] == canon[(i + 1) % len(texts)])
    for a, b in zip(canon, [got.loc[d].fingerprint for d in documents.doc_id]):
        assert (canon.count(a) > 1) == (sum(got.fingerprint == b) > 1)


def test_canonical_forms_agree_and_odd_rows_survive(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = digest.fingerprints(docs).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.text): r.fingerprint for r in rows}
    assert by[(3, ODD[2][1])] == by[(4, ODD[3][1])]
    assert by[(1, "")] == by[(2, "")]
    assert digest.fingerprints(docs.limit(0)).count() == 0
    assert digest.with_next(digest.canonical_digests(docs), "doc_id", ["text"]).count() == len(ODD)
    assert digest.with_next(digest.canonical_digests(docs.limit(0)), "doc_id", ["text"]).count() == 0


def test_colliding_buckets_are_told_apart_by_bytes(spark):
    rows = spark.createDataFrame([(1, "a", "f"), (2, "a", "f"), (3, "b", "f"), (4, "c", "g")], "doc_id long, canon string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in digest.separate(rows, digest.collisions(rows)).collect()}
    assert got[1] == got[2] != got[3] and got[4] == "g"


def water(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Targets by repeated capping and sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mixing_meets_targets(spark, documents):
    got = op6_mixing(spark, SF).toPandas()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in zip(documents.doc_id, documents.text)}
    source = dict(zip(documents.doc_id, documents.source))
    sums = {}
    for d, n in size.items():
        sums[source[d]] = sums.get(source[d], 0) + n
    want = water(sums)
    assert len(got) == len(size)
    taken = {}
    for r in got.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]]
        assert math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert list(got.position) == sorted(got.position)
    again = op6_mixing(spark, SF).toPandas()
    assert again.equals(got)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD)
    assert sum(r.taken for r in got) <= 2 * sum(r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "", "a", None), (2, None, "b", None)], SCHEMA)
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


def test_bpe_is_the_librarys(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(vocabulary_path())
    got = op9_bpe(spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(documents.doc_id, documents.text):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got.loc[d].n_tokens == len(ids)
        assert got.loc[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got.loc[d].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_streams_long_pieces_and_odd_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(vocabulary_path())
    vocab = bpe.load_vocabulary(vocabulary_path())
    enc, dec, plain = bpe.Encoder(vocab), bpe.Decoder(vocab), bpe.Decoder(vocab, joined=False)
    texts = ["", "ΑΣ Σ'S İ\x1cx\x85y", "<|endoftext|>a <|startoftext|>", "abcdefg" * 5000, "é" * 20000, "á'LL 12³", "%$#!" * 9000, "漢字かな 한국어 👍🏽"]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        ids = enc.encode(t)
        assert list(ids) == want
        assert "".join(dec.feed([i]) for i in ids) + dec.end() == lib.decode(want, skip_special_tokens=False)
        assert enc.encode((plain.feed(ids) + plain.end()).strip()) == ids
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = bpe.encode_documents(docs, vocabulary_path()).collect()
    assert len(got) == len(ODD) and not [r for r in got if r.doc_id in (1, 2)][0].ids
    assert bpe.roundtrip_digests(docs.limit(0), vocabulary_path()).count() == 0


def test_bpe_slices_change_nothing(spark, documents, monkeypatch):
    enc = bpe.Encoder(bpe.load_vocabulary(vocabulary_path()))
    texts = [t for t in documents.text[:60] if t] + ["a <|endoftext|> b" * 9, "  \n x" * 50, "\x1cab\x85 c"]
    whole = [enc.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "SLICE", 7)
    assert [enc.encode(t) for t in texts] == whole


def test_bpe_holds_a_slice_of_a_long_text():
    import tracemalloc

    enc = bpe.Encoder(bpe.load_vocabulary(vocabulary_path()))
    text = " ".join(f"word{i % 977}" for i in range(1_000_000))
    enc.encode(text[:100_000])
    tracemalloc.start()
    n = sum(len(ids) for ids in enc.parts(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1_000_000 and peak < 8 << 20  # 8 MB, where the ids alone take more than that of a text of 9 MB
