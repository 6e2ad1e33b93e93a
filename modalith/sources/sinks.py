"""Writers: pinned CSV, append, verified compaction, registry upsert, tables in Markdown, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.operators.observe import latest_of
from modalith.sources.log_store import exists


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """One file with the columns in their pinned order; null is blank. For report tables, not for logs."""
    rows.select(*fields).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def append(rows: DataFrame, path: str) -> None:
    """A file for each task, so writers need no lock; a failed job leaves nothing behind."""
    rows.write.mode("append").json(path)


def digest(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and a sum of row hashes that no order changes: equal tables have equal digests."""
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r.n, int(r.h)


def compact(spark: SparkSession, log: DataFrame, path: str) -> tuple[int, int]:
    """Write a log as compressed Parquet, read it back, and fail unless both sides agree; the caller may then drop
    the tail. An existing target is refused: compaction never overwrites."""
    if exists(spark, path):
        raise FileExistsError(path)
    before = digest(log)
    log.write.option("compression", "zstd").parquet(path)
    after = digest(spark.read.schema(log.schema).parquet(path))
    if before != after:
        raise RuntimeError(f"the compacted log differs: {before} and {after}")
    return after


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the latest of each key."""
    return latest_of(old.unionByName(new, allowMissingColumns=True), key, [order])


def write_if_changed(rows: DataFrame, path: str, candidate: str) -> bool:
    """Leave a reviewed table as it is and write what differs beside it; returns whether it differs."""
    spark = rows.sparkSession
    if not exists(spark, path):
        rows.write.parquet(path)
        return False
    if digest(spark.read.parquet(path)) == digest(rows):
        return False
    rows.write.mode("overwrite").parquet(candidate)
    return True


def markdown(rows: DataFrame, most: int = 100_000) -> str:
    """A report table, whole; one of more than `most` rows is no report and an error."""
    head = rows.columns
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    body = [["" if v is None else str(v).replace("|", "\\|") for v in r] for r in found]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in [head, ["---"] * len(head), *body])


def manifest(tables: dict[str, DataFrame]) -> str:
    """Canonical JSON of each table's digest, with a SHA-256 of the whole."""
    body = {name: {"rows": n, "hash": f"{h:x}", "columns": df.columns} for name, df in sorted(tables.items()) for n, h in [digest(df)]}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return json.dumps({"tables": body, "sha256": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True)


def verify(text: str, tables: dict[str, DataFrame]) -> None:
    """Fails unless the tables are those of the manifest."""
    if json.loads(text) != json.loads(manifest(tables)):
        raise RuntimeError("the tables differ from their manifest")
