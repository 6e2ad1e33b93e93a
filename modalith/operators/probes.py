"""Probes of embeddings and texts: fold-local features, logistic and boosted classifiers, inner choice of a budget."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalith.operators.vectors import char_ngrams, doubles, group_fold
from modalith.sources.session import checkpoint

#: Fixed values of the probes.
COMPONENTS, ITERATIONS, BUDGET, FOLDS = 128, 1000, 300, 3
LEARNING_RATE, LEAVES_DEPTH, MIN_LEAF = 0.08, 5, 30
#: Places of hashed character n-grams.
HASHED = 1024


def balanced(rows: DataFrame, label: str, weight: str = "w") -> DataFrame:
    """rows with a weight that gives every class the same share."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    side = n.join(total).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(weight))
    return rows.join(F.broadcast(side), label)  # a row a class


def features(rows: DataFrame, vector: str | None, text: str | None) -> tuple[DataFrame, list, int]:
    """rows with raw features, the stages that are fitted on a fold's training rows, and the width. A text's hashed
    n-grams are dealt over all tasks, as texts are few bytes in one split, and kept: each fold reads them many times."""
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import array_to_vector

    if text:
        dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        hashed = HashingTF(numFeatures=HASHED, inputCol="_grams", outputCol="_tf").transform(dealt.withColumn("_grams", char_ngrams(F.col(text))))
        return checkpoint(hashed.drop("_grams")), [IDF(inputCol="_tf", outputCol="_x")], HASHED
    width = rows.select(F.max(F.size(vector))).first()[0] or 0
    return rows.withColumn("_x", array_to_vector(doubles(F.col(vector)))), [], width


def classifier(kind: str, n: int, iterations: int, seed: int):
    """The last stages of a probe: a standardised logistic regression with unit ridge, or boosted trees."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler

    if kind == "logistic":
        return [StandardScaler(inputCol="_p", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="_y", weightCol="w", maxIter=iterations, tol=1e-8, regParam=1 / max(1, n), standardization=False, probabilityCol="_prob", rawPredictionCol="_raw")]
    if kind == "boosted":
        return [GBTClassifier(featuresCol="_p", labelCol="_y", weightCol="w", maxIter=iterations, maxDepth=LEAVES_DEPTH, stepSize=LEARNING_RATE, minInstancesPerNode=MIN_LEAF, seed=seed).setProbabilityCol("_prob").setRawPredictionCol("_raw")]
    raise ValueError(f"unknown probe: {kind}")


def fit(train: DataFrame, steps: list, width: int, kind: str, iterations: int, components: int, seed: int = 0):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA

    n = train.count()
    k = max(1, min(components, width, n))
    return Pipeline(stages=[*steps, PCA(k=k, inputCol="_x", outputCol="_p"), *classifier(kind, n, iterations, seed)]).fit(balanced(train, "_y"))


def log_loss(scored: DataFrame) -> float:
    p = F.greatest(F.least(F.element_at("_ps", F.col("_y").cast("int") + 1), F.lit(1 - 1e-15)), F.lit(1e-15))
    return scored.agg(F.avg(-F.log(p)).alias("l")).first().l


def predicted(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("_ps", vector_to_array("_prob"))


def select_budget(train: DataFrame, steps: list, width: int, group: str, budgets: tuple[int, ...], components: int, folds: int = 5, seed: int = 0) -> tuple[int, list[tuple[int, float]]]:
    """(budget, curve) of boosted trees: the least log loss on an inner hold-out of whole groups, the smaller budget on a
    tie. The hold-out is the first of `folds` whose sides both have every class; features are fitted again within."""
    budgets = tuple(sorted(set(budgets)))
    if not budgets or budgets[0] < 1:
        raise ValueError("budgets must be positive")
    dealt = train.withColumn("_inner", group_fold(F.col(group), folds, seed + 1)).persist()
    try:
        classes = dealt.select("_y").distinct().count()
        for k in range(folds):
            inside, held = dealt.where(F.col("_inner") != k), dealt.where(F.col("_inner") == k)
            if inside.select("_y").distinct().count() == held.select("_y").distinct().count() == classes:
                break
        else:
            raise ValueError("no inner split has every class on both sides")
        curve = [(b, log_loss(predicted(fit(inside, steps, width, "boosted", b, components, seed), held))) for b in budgets]
    finally:
        dealt.unpersist()
    return min(curve, key=lambda x: (x[1], x[0]))[0], curve


def held_out(rows: DataFrame, label: Column, fold: str, group: str, vector: str | None = None, text: str | None = None, kind: str = "logistic", folds: int = FOLDS, iterations: int = ITERATIONS, budgets: tuple[int, ...] = (BUDGET,), components: int = COMPONENTS) -> DataFrame:
    """rows with target, prediction, probabilities and budget: each fold predicted by a probe that was fitted on the
    other folds only, features and all. label: 0 or 1."""
    data, steps, width = features(rows.withColumn("_y", label.cast("double")), vector, text)
    parts = []
    for k in range(folds):
        train = data.where(F.col(fold) != k)
        budget = iterations
        if kind == "boosted":
            budget = select_budget(train, steps, width, group, budgets, components)[0] if len(budgets) > 1 else budgets[0]
        scored = predicted(fit(train, steps, width, kind, budget, components), data.where(F.col(fold) == k))
        parts.append(scored.select(*rows.columns, F.col("_y").cast("int").alias("target"), "prediction", F.col("_ps").alias("probabilities"), F.lit(budget).alias("budget")))
    return reduce(DataFrame.union, parts)


def enough(defined: Column, draws: int) -> Column:
    """Whether so many of the draws gave a value that an interval may be shown: nine tenths."""
    return defined >= math.ceil(0.9 * draws)
