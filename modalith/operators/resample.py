"""Cluster bootstrap from sufficient statistics, and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalith.functions import draws as counts
from modalith.operators.order import row_number, row_number_within


def cluster_sums(rows: DataFrame, cluster: str, sums: dict[str, Column]) -> DataFrame:
    """(i, <sums>): one row a cluster, numbered from 0 by name. All rows enter here; what follows is small."""
    per = rows.groupBy(F.col(cluster).alias("c")).agg(*(F.sum(e).alias(k) for k, e in sums.items()))
    return row_number(per, ["c"], "i").withColumn("i", F.col("i") - 1).drop("c")


#: Parts that the draws of one table of clusters are dealt over; each part gets the clusters once.
PARTS = 20


def _dealt(rows: DataFrame, draws: int, parts: int) -> DataFrame:
    """rows for each part of the draws, `part` from 0."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(min(parts, draws) - 1))))


def _part(part: int, draws: int, parts: int) -> range:
    """The draws of one of the parts."""
    parts = min(parts, draws)
    return range(part * draws // parts, (part + 1) * draws // parts)


def draw_sums(clusters: DataFrame, keys: list[str], num: str, den: str, draws: int, seed: str) -> DataFrame:
    """(keys, b, n, d): the weighted sums of each draw. clusters: one row a (keys, i), numbered from 0 within its keys.

    A task holds the clusters' sums of one key and draws by md5 from them, so no slot of a draw becomes a row: what is
    shuffled is PARTS times the clusters, whatever the draws."""
    schema = clusters.select(*keys).schema.add("b", "long").add("n", "double").add("d", "double")

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        i = table.column("i").to_numpy()
        sums = np.zeros((2, len(i)))
        for k, c in enumerate((num, den)):
            sums[k, i] = table.column(c).to_numpy()
        own = _part(key[-1].as_py(), draws, PARTS)
        got = [sums @ w.astype(float) for _, w in counts.weights(seed, own.start, own.stop, len(i))]
        same = {k: pa.array([v.as_py()] * len(own), table.schema.field(k).type) for k, v in zip(keys, key)}
        return pa.table(same | {"b": pa.array(own, "int64"), "n": pa.array([float(g[0]) for g in got]), "d": pa.array([float(g[1]) for g in got])})

    slim = clusters.select(*keys, F.col("i").cast("long").alias("i"), F.col(num).cast("double").alias(num), F.col(den).cast("double").alias(den))
    return _dealt(slim.fillna(0.0, [num, den]), draws, PARTS).groupBy(*keys, "part").applyInArrow(run, schema)


def bootstrap_rates(clusters: DataFrame, num: str, den: str, draws: int, seed: str) -> DataFrame:
    """(b, rate): the ratio of weighted sums in each draw; undefined draws are dropped."""
    return draw_sums(clusters, [], num, den, draws, seed).where("d > 0").select("b", (F.col("n") / F.col("d")).alias("rate"))


def numbered_within(clusters: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """clusters with their number i from 0 and their keys' count m."""
    return row_number_within(clusters, keys, [cluster], "i", "m").withColumn("i", F.col("i") - 1)


def bootstrap_auroc(rows: DataFrame, keys: list[str], cluster: str, label: Column, scores: dict[str, Column], draws: int, seed: str) -> DataFrame:
    """(keys, score, b, auroc): the same draws of clusters for every score; draws with one class only are left out.

    Ranks are not additive, so each draw ranks anew, on sums by distinct score. A task holds the sums of one key and score
    in the order of the score, once, and weighs them anew for each of its draws: no draw becomes a row before its AUROC."""
    named = F.array(*(F.struct(F.lit(k).alias("score"), v.cast("double").alias("s")) for k, v in scores.items()))
    slim = rows.select(*keys, F.col(cluster).alias("c"), label.cast("long").alias("y"), F.explode(named).alias("x")).select(*keys, "c", "y", "x.*").where("s IS NOT NULL")
    slim = slim.groupBy(*keys, "c", "score", "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    numbered = numbered_within(rows.select(*keys, F.col(cluster).alias("c")).distinct(), keys, "c")
    placed = slim.join(numbered, [*keys, "c"]).select(*keys, "score", "i", "m", "s", F.col("pos").cast("double").alias("pos"), (F.col("n") - F.col("pos")).cast("double").alias("neg"))
    schema = placed.select(*keys, "score").schema.add("b", "long").add("auroc", "double")
    parts = 4

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        i, s, pos, neg = (table.column(c).to_numpy() for c in ("i", "s", "pos", "neg"))
        at = np.argsort(s, kind="stable")
        i, s, pos, neg = i[at], s[at], pos[at], neg[at]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        own, found = _part(key[-1].as_py(), draws, parts), []
        for _, drawn in counts.weights(seed, own.start, own.stop, table.column("m")[0].as_py()):
            w = drawn[i].astype(float)
            p, q = np.add.reduceat(w * pos, first), np.add.reduceat(w * neg, first)
            both = p.sum() * q.sum()
            found.append(float((p * (np.cumsum(q) - q / 2)).sum() / both) if both else None)
        same = {k: pa.array([v.as_py()] * len(own), table.schema.field(k).type) for k, v in zip([*keys, "score"], key)}
        return pa.table(same | {"b": pa.array(own, "int64"), "auroc": pa.array(found, "float64")})

    return _dealt(placed, draws, parts).groupBy(*keys, "score", "part").applyInArrow(run, schema).where("auroc IS NOT NULL")


def rate_intervals(clusters: DataFrame, keys: list[str], cluster: str, num: str, den: str, draws: int, seed: str, level: float = 0.95) -> DataFrame:
    """(keys, ci_low, ci_high): an interval for each row of a table, from draws of its own clusters.

    clusters: one row a (keys, cluster) with the sums num and den. All rows are resampled in one plan."""
    rates = draw_sums(numbered_within(clusters, keys, cluster), keys, num, den, draws, seed).where("d > 0")
    tail = (1 - level) / 2
    ends = [(F.round(F.percentile(F.col("n") / F.col("d"), F.lit(q)), 9) + F.lit(0.0)).alias(k) for k, q in (("ci_low", tail), ("ci_high", 1 - tail))]
    return rates.groupBy(*keys).agg(*ends)


def attach(table: DataFrame, intervals: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """table with the interval of each row as <prefix>_ci_low and <prefix>_ci_high, blank where it has none."""
    return table.join(intervals.withColumnsRenamed({c: f"{prefix}_{c}" for c in ("ci_low", "ci_high")}), keys, "left")


def capped(rows: DataFrame, group: str, order: list[Column], cap: int, total: int) -> DataFrame:
    """At most `cap` rows of each group and `total` in all, the first by `order`."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= cap)
    return first.orderBy(*order).limit(total).drop("_k")
