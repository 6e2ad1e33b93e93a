"""Running sums, row numbers and ranks over a total order, without bringing all rows into one task.

Rows are dealt by ranges of the order and kept; then each range needs only the sum of the ranges before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modalith.sources.session import checkpoint


#: Rows of a range, about: what a task holds doesn't grow with the rows.
RANGE_ROWS = 500_000
#: Up to so many pairs of range and key are broadcast.
RUNS = 20_000


def ranges(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows before each, by the columns `order`, ascending with null first."""
    n = ranges(rows.sparkSession, rows.count())
    ranged = checkpoint(rows.withColumn("_v", value).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    before = _before(ranged.groupBy("_p").agg(F.sum("_v").alias("_s")))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(before), "_p")  # a row a partition
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_p", "_v", "_before")


def _before(sums: DataFrame) -> DataFrame:
    """(_p, _before): the sum of _s over the ranges before each."""
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_p", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, kept, with their range and their place in it from 0: sorted before they are kept, so that whoever reads
    them neither shuffles nor sorts again."""
    n = ranges(rows.sparkSession, rows.count())
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = checkpoint(ranged.withColumn("_id", F.monotonically_increasing_id()))  # the range times 2**33, and the place
    return kept.withColumns({"_p": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND(2**33 - 1)}).drop("_id")


def row_number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number from 1; order must be total."""
    placed = _placed(rows, order)
    before = _before(placed.groupBy("_p").agg(F.count("*").alias("_s")))
    out = placed.join(F.broadcast(before), "_p")  # a row a range
    return out.withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def row_number_within(rows: DataFrame, keys: list[str], order: list[str], name: str, count: str) -> DataFrame:
    """rows with their number from 1 within their keys, and the number of rows of the keys; a key may hold any share
    of the rows. What is joined is a row a range and key, so that no task gets more of a key than a range."""
    placed = _placed(rows, [*keys, *order])
    runs = placed.groupBy("_p", *keys).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = checkpoint(runs.select(F.col("_p").alias("_q"), *(F.col(k).alias(f"_k_{k}") for k in keys), "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(*keys)).alias(count)))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_p") == F.col("_q"))
    out = placed.join(F.broadcast(runs) if runs.count() <= RUNS else runs, same)
    return out.withColumn(name, F.col("_i") - F.col("_first") + F.col("_ahead") + 1).select(*rows.columns, name, count)


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the rank of value, ties taking the mean of theirs: ranked as one row a distinct value."""
    by = rows.groupBy(value).agg(F.count("*").alias("_n"))
    ranks = running_sum(by, [value], F.col("_n"), "_less").select(value, (F.col("_less") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, value)


def equal_buckets(number: Column, total: Column, buckets: int) -> Column:
    """The bucket from 1 of a row number, as ntile deals them: the first ones take what doesn't divide."""
    size, extra = F.floor(total / buckets), total % buckets
    longer = extra * (size + 1)
    return F.when(number <= longer, F.ceil(number / (size + 1))).otherwise(extra + F.ceil((number - longer) / size)).cast("long")


def display_position(name: Column, known: list[str]) -> Column:
    """The place of a name in a given order, and one place behind all for others."""
    at = F.array_position(F.array(*map(F.lit, known)), name)
    return F.when(at > 0, at).otherwise(len(known) + 1)
