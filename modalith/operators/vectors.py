"""Embedding analytics: distances, semantic clusters, centroids, folds, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalith.functions.stats import draw
from modalith.sources.session import checkpoint

#: Fixed values of the semantic score.
DISTANCE_THRESHOLD, DISPERSION_WEIGHT = 0.35, 0.2
#: The grid of settings whose scores are compared.
THRESHOLDS, WEIGHTS = (0.10, 0.20, 0.35, 0.50, 0.70), (0.0, 0.1, 0.2, 0.3, 0.5, 1.0)
CLUSTER_SCHEMA = "item long, threshold double, n long, clusters long, cluster_entropy double, mean_pairwise double, dominant_share double, dominant_mean double, dispersion double"


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def padded(v: Column, width: int) -> Column:
    """v at a width: what is beyond it cut off, what is missing zero."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)


def pair_distances(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, i, j, distance) for i < j within each group, which is one item's samples."""
    left = rows.select(group, F.col(key).alias("i"), doubles(F.col(vector)).alias("a"))
    right = rows.select(group, F.col(key).alias("j"), doubles(F.col(vector)).alias("b"))
    return left.join(right, group).where("i < j").select(group, "i", "j", (1 - cosine(F.col("a"), F.col("b"))).alias("distance"))


def average_linkage(distance, threshold: float) -> list[int]:
    """Cluster labels of rows by average linkage: the closest two clusters merge while their mean distance is below
    the threshold, strictly; ties go to the clusters that come first."""
    import numpy as np

    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                d = float(np.mean(distance[np.ix_(groups[a], groups[b])]))
                if best is None or d < best[0] - 1e-12:
                    best = (d, a, b)
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    labels = [0] * len(distance)
    for k, g in enumerate(groups):
        for i in g:
            labels[i] = k
    return labels


def cluster_diagnostics(vectors, threshold: float) -> dict[str, float]:
    """Diagnostics of one item's samples. Entropy is over the logarithm of the observed clusters; the dominant
    cluster is the largest, a tie going to the label that sorts first as text."""
    import numpy as np

    x = np.asarray(vectors, dtype=float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    distance = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(distance, 0)
    n = len(x)
    labels = average_linkage(distance, threshold)
    sizes = {k: labels.count(k) for k in sorted(set(labels), key=lambda k: f"cluster_{k}")}
    p = np.array(list(sizes.values())) / n
    entropy = float(-(p * np.log(p)).sum() / np.log(len(p))) if len(p) > 1 else 0.0
    upper = distance[np.triu_indices(n, 1)]
    top = max(sizes, key=sizes.get)
    inside = [i for i in range(n) if labels[i] == top]
    within = distance[np.ix_(inside, inside)][np.triu_indices(len(inside), 1)]
    mean, dominant = (float(v.mean()) if len(v) else 0.0 for v in (upper, within))
    return {"n": n, "clusters": len(sizes), "cluster_entropy": entropy, "mean_pairwise": mean, "dominant_share": sizes[top] / n, "dominant_mean": dominant, "dispersion": min(1.0, max(mean, dominant) / threshold)}


def semantic_clusters(rows: DataFrame, thresholds: tuple[float, ...] = (DISTANCE_THRESHOLD,)) -> DataFrame:
    """CLUSTER_SCHEMA from (item, vec_id, embedding): one group an item (its few samples), one distance matrix for all
    thresholds."""

    def run(key, table):
        import pyarrow as pa

        order = sorted(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist()))
        out = [{"item": key[0].as_py(), "threshold": t} | cluster_diagnostics([v for _, v in order], t) for t in thresholds]
        return pa.Table.from_pylist(out)

    return rows.select("item", "vec_id", "embedding").groupBy("item").applyInArrow(run, CLUSTER_SCHEMA)


def semantic_score(weight: float | Column = DISPERSION_WEIGHT) -> Column:
    w = F.lit(weight) if isinstance(weight, float) else weight
    return (1 - w) * F.col("cluster_entropy") + w * F.col("dispersion")


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): component means, summed on the map side by (group, place)."""
    per = rows.select(group, F.posexplode(doubles(F.col(vector))).alias("k", "x")).groupBy(group, "k").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return per.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: F.round(s["m"], 9) + F.lit(0.0)).alias("centroid"))


def group_fold(group: Column, folds: int, seed: int = 0) -> Column:
    """A fold for each group by hash: all rows of a group share it, and any engine computes the same."""
    return draw(str(seed), group) % folds


def char_ngrams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams inside words padded with one space, as an array."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def cut(n: int):
        def of(w: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1)))
            return F.when(F.char_length(w) >= n, F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(words, of))

    return F.concat(*map(cut, sizes))


#: Up to so many distinct n-grams are broadcast.
GRAMS = 200_000


def tfidf(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, weight): character n-grams of texts in one shared space, by count times smoothed inverse document
    frequency, each text of length 1. Texts are dealt by their key before they are cut, so a text's grams are counted, and
    its length taken from a window, where they are. Few n-grams are broadcast with their frequency; more are joined by
    merging. Spark, which takes grams for no larger than texts, would broadcast the texts' grams."""
    dealt = rows.select(key, text).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    grams = dealt.select(key, F.explode(char_ngrams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    n = rows.agg(F.count("*").alias("_n"))
    df = grams.groupBy("gram").agg(F.count("*").alias("_df"))
    idf = checkpoint(df.join(F.broadcast(n)).select("gram", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf")))
    idf = F.broadcast(idf) if idf.count() <= GRAMS else idf.hint("merge")
    raw = grams.join(idf, "gram").select(key, "gram", (F.col("tf") * F.col("_idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "gram", (F.col("raw") / norm).alias("weight"))
