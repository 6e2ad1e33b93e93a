"""Canonical exact digests of documents: Unicode normalisation, case and white-space folding, a 128-bit xxhash, and
byte comparison inside equal buckets. DataFrame expressions only.

Null texts count as empty; empty texts all share one fingerprint. Repeated ids keep all their rows. Texts of any
length are hashed whole. Empty tables give empty results. Extra columns of the input are ignored, so their names can't
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from modalith.llm.runtime import fits, materialize, shuffle_partitions

#: A table of keys is broadcast up to so many rows (about 16 MB), and joined by a shuffle beyond.
BROADCAST_KEYS = 500_000
SALT = 0x5EED_5EED
SPACES = r"[\s\p{Z}]+"


def _compose(c: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))


def canonical(text: Column) -> Column:
    """NFC, full case folding, NFC again; runs of white space become one space; trimmed.

    A text with as many bytes as characters is ASCII, where folding is lower() and composition does nothing; only
    the others pay for the JVM's Unicode library."""
    c = F.coalesce(text, F.lit(""))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _compose(c), F.lit(True))
    plain = F.octet_length(c) == F.char_length(c)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(c)).otherwise(_compose(folded)), SPACES, " "))


def digest(canon: Column) -> Column:
    """32 hex digits of two 64-bit xxhashes with different seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SALT), canon)), 16, "0")))


def canonical_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, canon, fingerprint) of every row."""
    return (
        docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("canon", canonical(F.col("text")))
        .withColumn("fingerprint", digest(F.col("canon")))
    )


def collisions(rows: DataFrame) -> DataFrame:
    """(fingerprint, canon, place): canonical texts that share a fingerprint but not their bytes, numbered by byte
    order within it. Empty unless the hash collides.

    Only buckets with two rows or more are compared, and copies are combined before the shuffle, so a bucket
    with a third of all rows costs one row a task."""
    spark = rows.sparkSession
    multi = materialize(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    side = F.broadcast(multi) if fits(multi, BROADCAST_KEYS) else multi
    texts = rows.select("fingerprint", "canon").join(side, "fingerprint", "left_semi").groupBy("fingerprint", "canon").agg(F.count("*").alias("n"))
    texts = materialize(texts.select("fingerprint", "canon"))
    clash = texts.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    found = texts.join(clash, "fingerprint", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")))
    found = materialize(found)
    return found if not found.isEmpty() else spark.createDataFrame([], found.schema)


def separate(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """Rows with fingerprints that differ wherever the canonical bytes differ: a collision's place is appended."""
    if clash.isEmpty():
        return rows
    return (
        rows.join(clash, ["fingerprint", "canon"], "left")
        .withColumn("fingerprint", F.when(F.col("place") > 1, F.concat_ws("-", "fingerprint", F.col("place").cast("string"))).otherwise(F.col("fingerprint")))
        .drop("place")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, canon, fingerprint): equal fingerprints exactly where the canonical bytes are equal."""
    rows = canonical_digests(docs, id_col, text_col)
    return separate(rows, collisions(rows))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fingerprint, kept, n): one row for each canonical text, with the least id and the number of rows."""
    return fingerprints(docs, id_col, text_col).groupBy("fingerprint").agg(F.min(id_col).alias("kept"), F.count("*").alias("n"))


def likeness(left: Column, left_canon: Column, right: Column, right_canon: Column) -> Column:
    """1 where the fingerprints and then the bytes agree, else 0: an exact digest knows no degrees."""
    return F.when((left == right) & (left_canon == right_canon), F.lit(1.0)).otherwise(F.lit(0.0))


def with_next(rows: DataFrame, id_col: str, carry: list[str]) -> DataFrame:
    """Each row with the columns `carry` of the next row in descending id order as next_<name>; the first follows
    the last. Equal ids are ordered by their text's hash and the text.

    One shuffle by ranges of ids: the bounds are actual ids, quantiles of the whole column, and the row that heads
    a range is also sent to the range before it, where it stands last. No range needs another one's rows."""
    spark = rows.sparkSession
    n = 8 * shuffle_partitions(spark)
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    span = rows.select(key.alias("k")).agg(F.max("k"), F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()
    if span[0] is None:
        return rows.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in carry))
    bounds = sorted({b for b in span[1] if b < span[0]}, reverse=True)
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    long_array = lambda xs: F.lit([int(x) for x in xs]).cast(T.ArrayType(T.LongType())) if xs else F.array().cast(T.ArrayType(T.LongType()))
    # how many bounds are at or above the id: first among every step-th bound, then within that stretch
    coarse = F.size(F.filter(long_array([p[0] for p in parts if p]), lambda x: x >= F.col("__k")))
    fine = F.element_at(F.array(*(long_array(p) for p in parts)), F.greatest(F.col("__c"), F.lit(1)))
    placed = (
        rows.withColumn("__k", key)
        .withColumn("__c", coarse)
        .withColumn("__b", F.greatest(F.col("__c") - 1, F.lit(0)) * step + F.size(F.filter(fine, lambda x: x >= F.col("__k"))))
    )
    head = F.when(F.col("__k") == F.lit(span[0]), F.lit(len(bounds))).when(F.col("__b") > 0, F.when(F.element_at(long_array(bounds), F.greatest(F.col("__b"), F.lit(1))) == F.col("__k"), F.col("__b") - 1)) if bounds else F.when(F.col("__k") == F.lit(span[0]), F.lit(0))
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("lent"))
    dealt = placed.withColumn("__to", F.explode(F.array_compact(F.array(own, F.when(head.isNotNull(), F.struct(head.alias("b"), F.lit(True).alias("lent")))))))
    dealt = dealt.withColumns({"__b": F.col("__to.b"), "__lent": F.col("__to.lent"), "__h": F.xxhash64("text")})
    # one window for all carried columns, on plain columns: it needs a single exchange
    order = Window.partitionBy("__b").orderBy("__lent", F.desc("__k"), "__h", "text")
    dealt = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carry))
    return dealt.where("not __lent").drop("__k", "__c", "__b", "__to", "__lent", "__h")
