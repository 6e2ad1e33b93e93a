"""Mixing sources to target weights along a time-varying curriculum. DataFrame expressions only.

Each source has a weight schedule over training time, a line from `start` to `end` times its weight. Its integral
is the source's cumulative token demand; inverting that gives the time at which a document that begins after so
many of its source's tokens is due, and a range sort by that time is the training order.

Null texts and texts without words have size 0 and nothing is taken of them. Null sources form one source, the
last. Repeated rows count as often as they occur; `take` tells rows with null or repeated ids apart by a number of
their own. An empty table gives an empty result. `mix` ignores extra columns, and `take` passes them on. Texts of any
length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modalith.llm.runtime import fits, is_key, materialize, with_row_key

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source are summed in slices of about so many.
SLICE_ROWS = 4096
#: A table with a row for each source is broadcast up to so many rows (some MB), and joined by a shuffle beyond.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, weight, target) from (source, n_docs, source_size).

    Sources in code point order, null last, take the weights in turn. The words in demand, `share` of all, are
    dealt by weight, at most `most` times its size to a source, and what exceeds that is dealt again by weight.
    The fixpoint in closed form: sources fill up in the order of bound by weight, so running sums in that order
    tell for each source whether it is full at the level that the others share. Needs one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    rows = rows.withColumn("bound", F.lit(most) * F.col("source_size")).withColumn("level", F.col("bound") / F.col("weight"))
    everything = Window.partitionBy()
    filling = Window.orderBy("level", F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("demand", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("bound").over(filling), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
        .withColumn("rate", (F.col("demand") - F.col("full_before")) / F.col("weight_left"))
    )
    # the level of those that aren't full is the rate at the first source whose own level is above it
    rows = rows.withColumn("open", F.min(F.when(F.col("level") > F.col("rate"), F.struct("level", "rate"))).over(everything))
    target = F.when(F.col("open").isNull() | (F.col("level") <= F.col("open.rate")), F.col("bound")).otherwise(F.col("weight") * F.col("open.rate"))
    return rows.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def due(before: Column, total: Column, start: Column, end: Column) -> Column:
    """The time in [0, 1] at which a source with a rate that runs linearly from start to end has met `before` of
    `total` tokens: the integral start*t + (end-start)*t*t/2, scaled to total at 1, solved for t."""
    area = (start + end) / 2
    y = F.when(total > 0, before / total).otherwise(F.lit(0.0)) * area
    slope = end - start
    curved = 2 * y / (start + F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * slope * y)))
    return F.least(F.lit(1.0), F.coalesce(curved, F.lit(0.0)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    schedule: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)),
    key_col: str | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, taken, position) for every row of docs, unsorted; with key_col, which
    tells rows of one id apart, that column too.

    A source with a target of k whole sizes and a rest takes each document k times and then documents in a fixed
    hashed order until the rest is met; at the edge a part of one document. So the words taken of a source are its
    target rounded down, and no document exceeds `most` times its size. The order depends on id and text alone.

    The running sum has two levels: sums of slices of a source, their running sum, and running sums inside a
    slice. A source with a third of all rows is so many slices and never one task."""
    # the scan and the word count happen once; what is kept is some bytes a document
    key = [] if key_col is None else [key_col]
    rows = materialize(docs.select(*key, F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")))
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    plan = materialize(targets(sizes, weights, share, most))
    small = fits(plan, BROADCAST_SOURCES)
    side = lambda df: F.broadcast(df) if small else df

    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    first, last = (F.element_at(F.array(*(F.lit(float(s[i])) for s in schedule)), (turn % len(schedule)) + 1) for i in (0, 1))
    plan = plan.withColumn("start", first).withColumn("end", last).withColumn("slices", F.ceil(F.col("n_docs") / SLICE_ROWS)).withColumnRenamed("source", "s")
    joined = rows.join(side(plan), rows["source"].eqNullSafe(plan["s"])).drop("s", "n_docs", "weight")
    joined = joined.withColumn("slice", F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * F.col("slices")).cast("long"))

    slices = materialize(joined.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).drop("n"))
    slices = slices.withColumnRenamed("source", "s").withColumnRenamed("slice", "k")
    small_slices = fits(slices, BROADCAST_SOURCES)
    joined = joined.join(F.broadcast(slices) if small_slices else slices, joined["source"].eqNullSafe(slices["s"]) & (joined["slice"] == slices["k"])).drop("s", "k")
    inside = Window.partitionBy("source", "slice").orderBy("h", "id", "size", *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("before") + F.sum("size").over(inside) - F.col("size")
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.floor(F.col("target")) - whole.cast("long") * F.col("source_size")
    out = joined.withColumn("begins", begins)
    taken = F.when(F.col("source_size") > 0, whole.cast("long") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begins")))).otherwise(F.lit(0))
    return out.select(
        *key,
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        taken.cast("long").alias("taken"),
        due(F.col("begins") + F.col("size") / 2, F.col("source_size"), F.col("start"), F.col("end")).alias("position"),
    )


def in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Range sort by position; equal positions by a hash of the id, so that sources alternate."""
    return mixed.orderBy("position", F.xxhash64(id_col), id_col)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """Rows of docs as often as the mix takes them, in training order: a whole text for each full pass, and for a
    document that is taken in part its first words so many, joined by spaces. Rows of which nothing is taken go."""
    unique = is_key(docs, id_col)
    docs, key = (docs, id_col) if unique else (with_row_key(docs), "__row")
    rows = docs.withColumn("__size", words(F.col(text_col)))
    mixed = materialize(mix(docs, id_col, text_col, source_col, key_col=None if unique else key).select(F.col(key).alias("__id"), F.col("taken").alias("__taken"), F.col("position").alias("__position"), (F.col("target") / F.col("source_size")).alias("__passes")))
    dealt = rows.join(mixed.where("__taken > 0"), rows[key] == mixed["__id"])
    dealt = dealt.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__taken") / F.col("__size")).cast("long") - 1)))
    part = F.least(F.col("__size"), F.col("__taken") - F.col("__k") * F.col("__size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), 0), 1, part.cast("int")), " ")
    dealt = dealt.withColumn("__text", F.when(part < F.col("__size"), cut).otherwise(F.col(text_col)))
    dealt = dealt.withColumn("__at", (F.col("__k") + F.col("__position")) / F.greatest(F.col("__passes"), F.lit(1.0)))
    out = dealt.orderBy("__at", F.xxhash64(id_col), id_col, "__k", key)
    return out.select(*(F.col("__text").alias(c) if c == text_col else F.char_length("__text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else docs[c] for c in docs.columns if c != "__row"))
