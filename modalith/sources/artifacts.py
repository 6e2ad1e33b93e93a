"""Derived stores: lossless raw tables, embedding caches, semantic builds, macro files, log compaction with its tail."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.operators import vectors
from modalith.sources.log_store import exists, read_jsonl
from modalith.sources.sinks import compact, digest

#: The column of a raw table that lists which names a row had, so that absent and null stay apart.
PRESENT = "_present"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file_system(spark, path)
    fs.setWriteChecksum(False)  # other writers append to such files, and know of no checksum
    try:
        out = fs.create(p, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
    finally:
        fs.setWriteChecksum(True)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


# raw rows as a table, and back


def rows_to_table(rows: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """Columns of schema and PRESENT from a column of JSON objects; what a row holds beyond them is kept as JSON."""
    known = F.array(*(F.lit(f.name) for f in schema))
    names = F.json_object_keys(body)
    parsed = rows.withColumn("_r", F.from_json(body, schema)).withColumn(PRESENT, names)
    extra = F.map_filter(F.from_json(F.col(body), "map<string,string>"), lambda k, _: ~F.array_contains(known, k))
    return parsed.select(*(F.col(f"_r.`{f.name}`").alias(f.name) for f in schema), F.when(F.size(extra) > 0, extra).alias("_extra"), PRESENT)


def table_to_rows(table: DataFrame, schema: T.StructType, body: str = "body") -> DataFrame:
    """JSON objects from rows_to_table(): absent names stay absent, null ones are null, in the schema's order."""
    if set(table.columns) != {*(f.name for f in schema), "_extra", PRESENT}:
        raise ValueError(f"not a table of raw rows: {table.columns}")
    pairs = [F.when(F.array_contains(PRESENT, f.name), F.concat(F.lit(json.dumps(f.name) + ":"), F.coalesce(F.to_json(F.to_variant_object(F.array(F.col(f"`{f.name}`")))), F.lit("[null]")))) for f in schema]
    # each value went through an array of one, whose brackets go again
    bare = [F.regexp_replace(p, r'^("[^"]*":)\[(.*)\]$', "$1$2") for p in pairs]
    return table.select(F.concat(F.lit("{"), F.concat_ws(",", *bare), F.lit("}")).alias(body), "_extra")


def prefiltered(spark: SparkSession, path: str, needle: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines that hold a text, which is looked for before any line is parsed."""
    lines = spark.read.text(path).where(F.contains(F.col("value"), F.lit(needle)))
    return lines.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def compact_tail(spark: SparkSession, tail: str, path: str, schema: T.StructType) -> int:
    """Compact the tail of JSON lines, verify the copy, and then empty the tail; refused while a lock file stands beside
    it, or where a line can't be read, since emptying would lose it."""
    if exists(spark, tail + ".lock"):
        raise RuntimeError(f"{tail} is locked by a writer")
    rows, bad = read_jsonl(spark, tail, schema)
    if not bad.isEmpty():
        raise ValueError("the tail holds lines that aren't JSON")
    n, _ = compact(spark, rows, path)
    fs, p = _file_system(spark, tail)
    if fs.getFileStatus(p).isDirectory():
        fs.delete(p, True)
        fs.mkdirs(p)
    else:
        write_text(spark, tail, "")
    return n


# embeddings of sampled answers


def read_embeddings(samples: DataFrame, cache: DataFrame, run_id: str, backend: str) -> DataFrame:
    """samples (embedding_index, item_id, sample_index, run_id) with the vectors of a cache (embedding_index, item_id,
    backend, embedding). Any row of either side without its fellow, another item, run or backend, a repeated
    sample, and vectors of several widths are errors, told by their number."""
    both = samples.withColumnsRenamed({"item_id": "i1"}).join(cache.withColumnsRenamed({"item_id": "i2"}), "embedding_index", "full_outer")
    checks = {
        "samples without a vector": F.count_if(F.col("embedding").isNull()),
        "vectors without a sample": F.count_if(F.col("i1").isNull()),
        "misaligned rows": F.count_if(F.col("i1") != F.col("i2")),
        "rows of another run": F.count_if(F.col("run_id") != run_id),
        "vectors of another backend": F.count_if(F.col("backend") != backend),
        "widths beyond one": F.greatest(F.count_distinct(F.size("embedding")) - 1, F.lit(0)),
    }
    found = both.agg(*(c.alias(k) for k, c in checks.items())).first().asDict()
    found["repeated samples"] = samples.groupBy("item_id", "sample_index").count().where("count > 1").count()
    wrong = {k: n for k, n in found.items() if n}
    if wrong:
        raise ValueError(f"the embedding cache doesn't fit its samples: {wrong}")
    return both.select("embedding_index", F.col("i1").alias("item_id"), "sample_index", "embedding")


def semantic_build(samples: DataFrame, folder: str, backend: str, thresholds: tuple[float, ...] = (vectors.DISTANCE_THRESHOLD,)) -> tuple[DataFrame, bool]:
    """(clusters of each item, whether they were there): built once for the same samples, backend and settings, and
    kept in a folder that is named by their digest, with a manifest that is written last."""
    spark = samples.sparkSession
    rows, h = digest(samples.select("item_id", "vec_id", "embedding"))
    key = json.dumps({"rows": rows, "hash": f"{h:x}", "backend": backend, "thresholds": thresholds}, sort_keys=True)
    at = f"{folder}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    there = exists(spark, f"{at}/manifest.json") and read_text(spark, f"{at}/manifest.json") == key
    if not there:
        vectors.semantic_clusters(samples.withColumnRenamed("item_id", "item"), thresholds).write.mode("overwrite").parquet(f"{at}/items")
        write_text(spark, f"{at}/manifest.json", key)
    return spark.read.schema(vectors.CLUSTER_SCHEMA).parquet(f"{at}/items"), there


# report artifacts


def read_artifact(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """A report table in CSV; a missing file, a missing column or no row is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in needed if c not in rows.columns]
    if missing or rows.isEmpty():
        raise ValueError(f"{path}: " + (f"missing columns {missing}" if missing else "no rows"))
    return rows


def number_text(kind: str, x: Column, high: Column | None = None) -> Column:
    """A number as reports print it. Percent 1 place, AUROC 3, counts with commas, intervals in brackets."""
    percent = lambda c: F.format_string("%.1f\\%%", (c * 100).cast("double"))
    if kind == "percent":
        return percent(x)
    if kind == "auroc":
        return F.format_string("%.3f", x.cast("double"))
    if kind == "count":
        return F.format_number(x, 0)
    if kind == "range":
        return F.concat(percent(x), F.lit("--"), percent(high))
    if kind == "ci":
        return F.concat(F.lit("["), percent(x), F.lit(", "), percent(high), F.lit("]"))
    raise ValueError(f"unknown kind of number: {kind}")


def macro_lines(macros: DataFrame) -> DataFrame:
    r"""(name, value) as lines \newcommand{\name}{value}, by name; a name that isn't of letters only, or that comes
    twice, is an error."""
    bad = macros.groupBy("name").count().where("count > 1 OR NOT name RLIKE '^[A-Za-z]+$'")
    if not bad.isEmpty():
        raise ValueError(f"macro names that repeat or aren't of letters: {[r.name for r in bad.limit(20).collect()]}")
    return macros.orderBy("name").select(F.concat(F.lit("\\newcommand{\\"), "name", F.lit("}{"), "value", F.lit("}")).alias("value"))


def read_macros(lines: DataFrame) -> DataFrame:
    """(name, value) of lines as macro_lines() writes them; other lines are comments."""
    pattern = r"^\\newcommand\{\\([A-Za-z]+)\}\{(.*)\}$"
    rows = lines.where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("value"))


def macro_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, before, after, change) of two sets of macros."""
    both = old.toDF("name", "before").join(new.toDF("name", "after"), "name", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.withColumn("change", change)
