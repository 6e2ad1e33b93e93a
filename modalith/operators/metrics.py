"""Metrics over score rows; undefined where a class or a denominator is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalith.functions.stats import share
from modalith.operators.order import row_number_within


def auroc(rows: DataFrame, keys: list[str], label: Column, score: Column) -> DataFrame:
    """(keys, auroc, n, n_pos): Mann-Whitney with half a point for ties.

    Counted on distinct scores: labels are summed by (keys, score) first, so that the window that ranks sees a row
    a score and not a row an observation."""
    by = rows.select(*keys, label.cast("long").alias("y"), score.alias("s")).where("s is not null").groupBy(*keys, "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    below = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("neg_below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(below), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("neg_below") + (F.col("n") - F.col("pos")) / 2))
    out = ranked.groupBy(*keys).agg(wins.alias("wins"), F.sum("n").alias("n"), F.sum("pos").alias("n_pos"))
    return out.select(*keys, share(F.col("wins"), F.col("n_pos") * (F.col("n") - F.col("n_pos"))).alias("auroc"), "n", "n_pos")


def average_precision(rows: DataFrame, keys: list[str], label: Column, score: Column) -> DataFrame:
    """(keys, avg_precision): mean over positives of the precision at their score, ties taken together."""
    by = rows.select(*keys, label.cast("long").alias("y"), score.alias("s")).groupBy(*keys, "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.withColumns({"cum_pos": F.sum("pos").over(upto), "cum_n": F.sum("n").over(upto)})
    return run.groupBy(*keys).agg(share(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), F.sum("pos")).alias("avg_precision"))


def calibration_error(rows: DataFrame, keys: list[str], label: Column, p: Column, bins: int = 10) -> DataFrame:
    """(keys, ece): expected calibration error over equal-width bins; p = 1 falls into the last."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1))
    per = rows.select(*keys, label.cast("double").alias("y"), p.alias("p"), b.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"))
    return per.groupBy(*keys).agg(share(F.sum(F.abs(F.col("y") - F.col("p"))), F.sum("n")).alias("ece"))


def macro_f1(rows: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    """(keys, accuracy, macro_f1) over the labels that occur as gold or prediction."""
    sides = rows.select(*keys, F.explode(F.array(F.struct(F.col(gold).alias("label"), (F.col(gold) == F.col(pred)).cast("long").alias("tp"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("e")).select(*keys, "e.*")
    per = sides.groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    f1 = F.col("tp") * 2.0 / (F.col("g") + F.col("p"))
    return per.groupBy(*keys).agg(share(F.sum("tp"), F.sum("g")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def deferral(rows: DataFrame, keys: list[str], wrong: Column, uncertainty: Column, ties: list[Column], shares: tuple[float, ...] = (0.1, 0.2)) -> DataFrame:
    """(keys, q, coverage, error) after the share q of most uncertain rows, rounded up, is deferred."""
    placed = rows.select(*keys, wrong.cast("double").alias("_w"), (-uncertainty).alias("_u"), *(t.alias(f"_t{i}") for i, t in enumerate(ties)))
    ranked = row_number_within(placed, keys, ["_u", *(f"_t{i}" for i in range(len(ties)))], "_r", "_n")
    parts = []
    for q in shares:
        kept = F.col("_r") > F.ceil(F.col("_n") * q)
        parts.append(ranked.groupBy(*keys).agg(F.lit(q).alias("q"), share(F.count_if(kept), F.count("*")).alias("coverage"), share(F.sum(F.when(kept, F.col("_w"))), F.count_if(kept)).alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def monotonicity(rows: DataFrame, keys: list[str], seed: str, ordinal: str, p: Column, tolerance: float = 0.05) -> DataFrame:
    """(keys, monotonicity_*): how often and how far p rises as the modality weakens, by the largest rise of each seed.
    1e-9 stands against rounding."""
    s = rows.groupBy(*keys, seed, ordinal).agg(F.avg(p).alias("p"))
    up = F.lead("p").over(Window.partitionBy(*keys, seed).orderBy(F.desc(ordinal))) - F.col("p")  # a row a modality
    x = s.withColumn("up", up).where("up IS NOT NULL").groupBy(*keys, seed).agg(F.max(F.greatest("up", F.lit(0.0))).alias("m"))
    m = F.col("m")
    return x.groupBy(*keys).agg(F.count_if(m > tolerance + 1e-9).alias("monotonicity_violations"), F.count_if(m > 1e-9).alias("monotonicity_strict_violations"), (F.round(F.avg(m), 9) + F.lit(0.0)).alias("monotonicity_mean_max_increase"), (F.round(F.max(m), 9) + F.lit(0.0)).alias("monotonicity_max_increase"))
