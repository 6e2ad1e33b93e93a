import hashlib
import re
import struct

import corpus_pipeline
import pytest
from pyspark.sql import types as T

from modalith.llm import mixing, quality, suffix
from modalith.llm.queries import vocabulary_path
from test_minhash import classes
from test_suffix import bare

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF))
        tables[name] = (docs.toPandas(), out.toPandas(), out)
        if name != "bpe":
            assert out.columns == columns
        docs = out

    before, after, _ = tables["quality"]
    scored = quality.classify(spark.read.parquet(f"{SF}/documents.parquet")).where("keep").toPandas()
    assert sorted(after.doc_id) == sorted(scored.doc_id) and 0 < len(after) < len(before)

    before, after, _ = tables["minhash"]
    want = classes(list(zip(before.doc_id.tolist(), before.text)))
    assert sorted(after.doc_id) == sorted(set(want)) and len(after) < len(before)

    before, after, _ = tables["suffix"]
    got = after.set_index("doc_id")
    for d, t in zip(before.doc_id, bare(before.text, suffix.PASSAGE)):
        assert got.loc[d].text == t and got.loc[d].n_chars == len(t)
    assert len(after) == len(before)

    before, after, _ = tables["mixing"]
    size = lambda t: len(re.findall(mixing.WORD, t))
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before)).collect()}
    sums = {}
    for d, t in zip(after.doc_id, after.text):
        sums[d] = sums.get(d, 0) + size(t)
    assert sums == {d: n for d, n in taken.items() if n}

    before, after, _ = tables["bpe"]
    lib = tokenizers.Tokenizer.from_file(vocabulary_path())
    digests = sorted(hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest() for i in (lib.encode(t, add_special_tokens=False).ids for t in before.text))
    assert sorted(after.ids_sha256) == digests

    final = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(final.ids_sha256) == digests


def test_odd_rows(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("kept", T.StringType()), ("taken", T.LongType()))])
    rows = [(1, None, None, None, None, None, 1), (2, "", "en", "a", 0, "k", None), (3, "Some plain words of text.", "en", "a", 25, "k", 3), (4, "Some plain words of text.", "en", None, 25, None, None), (5, "word " * 20000, "en", "a", 100000, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, ""))
            assert name == "bpe" or docs.columns == schema.names
        assert (docs.count() > 0) == bool(data)
