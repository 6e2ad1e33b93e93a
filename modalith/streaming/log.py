"""The append-only log as a stream: counts, and the latest row of each key kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.sources.session import new_folder


def read_log(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """New files of a folder, each read once."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


def run_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key over all that has arrived, from a stateful aggregation that runs until the source is drained."""
    spark, folder = log.sparkSession, new_folder(log.sparkSession, "stream")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/{number}")
        last[:] = [number]

    counts = log.groupBy(*keys).agg(F.count("*").alias("n"))
    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/table/{last[0]}") if last else spark.createDataFrame([], counts.schema)


def upsert_latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, merged batch by batch into a table of versions; a replayed batch changes nothing."""
    spark, folder = log.sparkSession, new_folder(log.sparkSession, "stream")
    rest = [c for c in log.columns if c not in key and c not in order]
    latest = lambda df: df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("b")).select(*key, "b.*")
    seen: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        target = f"{folder}/table/{number}"
        before = [p for p in seen if p != target]
        rows = batch.unionByName(batch.sparkSession.read.parquet(before[-1])) if before else batch
        latest(rows).write.mode("overwrite").parquet(target)
        if target not in seen:
            seen.append(target)

    q = log.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(seen[-1]) if seen else spark.createDataFrame([], log.schema)
