"""Shared helpers: intermediate tables in the cluster's shared folder, and distributed connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of an Arrow batch that a Python worker holds at once, where the session keeps Spark's default of 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Documents can be long; a worker should hold a thousand of them at a time, not ten thousand."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lean(run):
    """A mapInArrow function that gives its memory back to the system when its partition is done: workers are
    reused, and what an idle one holds counts against its executor."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one for a local master
    (tests); on a cluster that is an error, since executors don't share such a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        path = tempfile.mkdtemp(prefix="modalith-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut, and a lost executor
    costs only the tasks that were reading, since the files are not on its disk. Then the tables `spent`, which
    nothing needs any more, are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out._modalith_table = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no plan reads any more."""
    for df in tables:
        if path := getattr(df, "_modalith_table", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done: its cleaner goes by what the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that bound."""
    return df.limit(rows + 1).count() <= rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as (u long, v long): (id, component), component the least id.

    Alternating large-star and small-star steps. Every step is one aggregation by node (pre-combined on the map
    side, so a hub sends one row a task) and one equi-join that adaptive execution can split; the number of
    edges never grows. Only nodes that have an edge are returned. Stops when a round changes nothing.
    """
    cur = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = materialize(cur)
    # two numbers that stand for the set of edges: a round that leaves both alone has reached the fixpoint
    digest = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = cur.agg(*digest).first()
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        cur = materialize(small.where("u <> v").distinct(), cur)
        after = cur.agg(*digest).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("v").alias("id")).distinct()
    return cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(roots.join(cur, roots["id"] == cur["u"], "left_anti").select("id", F.col("id").alias("component")))


def is_key(rows: DataFrame, id_col: str) -> bool:
    """Whether id_col holds integers of which none is null or repeated."""
    if rows.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return False
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty()


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with a unique long __row. It is written at once: the numbers follow the partitions as they were read."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """((doc, id, text), whether ids are unique), with doc a key of the row: the id where ids are unique and
    integers, else a hash of id, text and the place among equal rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if is_key(rows, "id"):
        return rows.select(F.col("id").cast("long").alias("doc"), "id", "text"), True
    place = F.row_number().over(Window.partitionBy("id", F.xxhash64("text")).orderBy("text"))
    return materialize(rows.withColumn("k", place).select(F.xxhash64("id", "text", "k").alias("doc"), "id", "text")), False
