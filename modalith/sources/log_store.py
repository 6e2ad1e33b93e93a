"""Scans of the answer log and its companions: CSV, JSON lines, compacted Parquet, XML."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One physical answer; what a record holds beyond these is kept in `extra` as JSON.
ATTEMPT = T.StructType(
    [T.StructField(c, T.StringType()) for c in "run_id provider_id profile_id model dataset_id benchmark_variant task item_id seed_id sample_kind source_modality source_statement prompt_version raw_text error host parsed_json parse_status confidence_scale output_contract_version job_config_sha request_seed request_payload_sha batch_id batch_order".split()]
    + [T.StructField(c, T.DoubleType()) for c in ("temperature", "top_p", "latency_s")]
    + [T.StructField(c, T.LongType()) for c in "sample_index batch_item_count usage_completion_tokens requirement_word_count retry_count".split()]
    + [T.StructField("request_indices", T.ArrayType(T.IntegerType()))]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, which may be one that only Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path on its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string rows with a declared header; nothing is inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = ATTEMPT) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): lines that aren't JSON are set apart with the first 160 characters, and stop nothing."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select(F.left("value", F.lit(160)).alias("prefix"))


def read_log(spark: SparkSession, compacted: str | None, tail: str | None, schema: T.StructType = ATTEMPT, columns: list[str] | None = None, run_ids: list[str] | None = None) -> DataFrame:
    """The compacted half and the tail as one log; what is missing is empty. Unknown column names are ignored, an empty
    list of runs gives no rows, and both reach the Parquet scan."""
    parts = []
    if compacted and exists(spark, compacted):
        parts.append(spark.read.schema(schema).parquet(compacted))
    if tail and exists(spark, tail):
        parts.append(read_jsonl(spark, tail, schema)[0])
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if run_ids is not None:
        out = out.where(F.col("run_id").isin(run_ids) if run_ids else F.lit(False))
    return out.select(*[c for c in columns if c in out.columns]) if columns else out


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_trees(spark: SparkSession, paths: list[str], reader) -> DataFrame:
    """Several trees of one kind, in order, each row with the number of its tree; a tree may be missing, but not all."""
    out = None
    for i, p in enumerate(paths):
        if not exists(spark, p):
            continue
        part = reader(spark, p).withColumn("tree", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_scores(spark: SparkSession, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """Score files of selected runs, tagged by the manifest's (path, model, dataset, variant); a missing one is an error."""
    rows = manifest.collect()  # a row for each selected run
    missing = [r.path for r in rows if not exists(spark, r.path)]
    if missing:
        raise FileNotFoundError(f"score files are missing: {missing}")
    whole = {qualified(spark, r.path): r for r in rows}
    if len(whole) < len(rows):
        raise ValueError("the manifest lists a score file twice")
    # a scan names files by their whole URI, so equal names in different runs' folders stay apart
    plain = lambda p: re.sub("^([a-z0-9]+):/+", r"\1:/", p)  # noqa: E731  file:/x and file:///x are one
    tags = spark.createDataFrame([(plain(p), *(r[c] for c in manifest.columns if c != "path")) for p, r in whole.items()], T.StructType([T.StructField("_file", T.StringType()), *(f for f in manifest.schema if f.name != "path")]))
    # a listed path is a file, or the folder that one writer's files are in
    file = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")
    listed = F.array(*(F.lit(plain(p)) for p in whole))
    scores = read_csv(spark, list(whole), columns).withColumn("_file", file).withColumn("_file", F.when(F.array_contains(listed, F.col("_file")), F.col("_file")).otherwise(F.regexp_replace("_file", "/[^/]+$", "")))
    return scores.join(F.broadcast(tags), "_file").drop("_file")  # as many rows as runs were listed above


REQUIREMENT = "struct<_id:string,_marker:string,section:array<string>,text_body:string>"


def _requirement(r: Column) -> list[Column]:
    marker = F.coalesce(F.trim(r["_marker"]), F.lit(""))
    marks = F.size(F.filter(F.split(marker, r"[,;/ ]+"), lambda m: m != ""))
    section = F.array_join(F.coalesce(r["section"], F.array().cast("array<string>")), " > ")
    return [r["_id"].alias("requirement_id"), marker.alias("marker"), marks.alias("marker_count"), section.alias("section"), F.trim(F.regexp_replace(r["text_body"], r"\s+", " ")).alias("text")]


def read_requirements(spark: SparkSession, path: str, row_tag: str = "req") -> DataFrame:
    """Requirement nodes of XML files: (id, marker, number of markers, section path, text)."""
    rows = spark.read.schema(T.StructType.fromDDL(REQUIREMENT[7:-1])).option("rowTag", row_tag).xml(path)
    return rows.select(F.struct("*").alias("r")).select(*_requirement(F.col("r")))


def requirements_of(documents: DataFrame, xml: str, keep: list[str], row_tag: str = "req") -> DataFrame:
    """As read_requirements(), from a column of XML documents, with the columns `keep` of each."""
    parsed = F.from_xml(F.col(xml), f"`{row_tag}` array<{REQUIREMENT}>")
    return documents.select(*keep, F.explode(parsed[row_tag]).alias("r")).select(*keep, *_requirement(F.col("r")))


def canonical_row(*columns: str) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "true"})
