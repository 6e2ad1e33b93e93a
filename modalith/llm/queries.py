"""The registered queries of the training-data operators, opN_<name>, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.llm import bpe, covertree, digest, htmltext, linkgraph, minhash, mixing, quality, suffix, toolcalls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the driver finds a public vocabulary file; executors get its content by broadcast."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linkgraph.judge(_read(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.tool_calls(_read(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixing.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = digest.canonical_digests(docs)
    clash = digest.collisions(rows)
    rows = digest.separate(rows, clash).drop("canon")
    rows = digest.with_next(rows, "doc_id", ["text", "fingerprint"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    n = F.char_length("text")
    edited = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half))).withColumn("canon", digest.canonical(F.col("edited")))
    edited = edited.withColumn("own", F.col("fingerprint")).withColumn("fingerprint", digest.digest(F.col("canon")))
    edited = digest.separate(edited, clash)
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("fingerprint").alias("edited_fingerprint"),
        F.when(F.col("own") == F.col("fingerprint"), F.when(digest.canonical(F.col("text")) == F.col("canon"), 1.0)).otherwise(0.0).alias("near_edited"),
        F.when(F.col("own") == F.col("next_fingerprint"), 1.0).otherwise(0.0).alias("near_next"),
    ).na.fill(0.0, ["near_edited"])


def op8_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.links(_read(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(_read(spark, sf_dir, "documents"), vocabulary_path())


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.remove_repeats(_read(spark, sf_dir, "documents"), passage=suffix.PASSAGE)
    return rows.drop("kept").withColumnRenamed("without_passages", "text")


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_html": op2_html,
    "op3_urls": op3_urls,
    "op4_toolcalls": op4_toolcalls,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_digest": op7_digest,
    "op8_covertree": op8_covertree,
    "op9_bpe": op9_bpe,
    "op10_suffix": op10_suffix,
}
#: The others hash, tokenise, learn or parse in ways that SQL can't express; tests/llm/ has their brute-force versions.
ORACLES: dict[str, str] = {"op3_urls": linkgraph.oracle(), "op4_toolcalls": toolcalls.ORACLE}
