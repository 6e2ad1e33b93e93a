"""Uncertainty scores: one group of repeated answers to one row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.sources.views import MODALITIES

#: The score row: identity, counts, measures (a fixed contract).
STRINGS = "run_id run_group_id provider_id profile_id model task uq_method item_id seed_id batch_id sample_batch_ids source_modality gold_modality pred_modality sampling_plan_source uncertainty_measure label_distribution text_modality text_modality_basis text_modality_parse_status strict_text_overcommit_kind".split()
INTS = "valid_n total_n parse_failures y_true y_pred ordinal_strength requirement_word_count source_word_count completion_tokens".split()
DOUBLES = "confidence p_yes numeric_strength uncertainty_score length_ratio".split()
BOOLEANS = "stochastic_complete text_overcommit text_undercommit strict_text_overcommit text_modality_correct text_modality_multi_modal label_text_consistent text_high_conf_overcommit_80 text_high_conf_overcommit_90 strict_text_high_conf_overcommit_80 strict_text_high_conf_overcommit_90 label_correct_text_overcommit_80 label_correct_text_overcommit_90".split()
SCORE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in STRINGS]
    + [T.StructField("text_modality_modals_found", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.IntegerType()) for c in INTS]
    + [T.StructField(c, T.DoubleType()) for c in DOUBLES]
    + [T.StructField(c, T.BooleanType()) for c in BOOLEANS]
)


def label_shares(samples: DataFrame, keys: list[str], label: str = "label", labels: tuple[str, ...] = MODALITIES) -> DataFrame:
    """(keys, valid_n, total_n, n_<label>...): counts over the full label set; rows without a label are failures."""
    counts = [F.count_if(F.col(label) == k).alias(f"n_{k}") for k in labels]
    return samples.groupBy(*keys).agg(F.count(label).alias("valid_n"), F.count("*").alias("total_n"), *counts)


def p_of(k: str) -> Column:
    return F.when(F.col("valid_n") > 0, F.col(f"n_{k}") / F.col("valid_n"))


def majority(labels: tuple[str, ...] = MODALITIES) -> Column:
    """The label with most votes; a tie goes to the weakest, the last in the list."""
    best = F.greatest(*(F.col(f"n_{k}") for k in labels))
    out = F.lit(None).cast("string")
    for k in labels:
        out = F.when(F.col(f"n_{k}") == best, F.lit(k)).otherwise(out)
    return F.when(F.col("valid_n") > 0, out)


def majority_share(labels: tuple[str, ...] = MODALITIES) -> Column:
    return F.greatest(*(p_of(k) for k in labels))


def entropy(labels: tuple[str, ...] = MODALITIES) -> Column:
    """Entropy of the label shares over the logarithm of the size of the full label set."""
    h = sum((F.when(p_of(k) > 0, -p_of(k) * F.log(p_of(k))).otherwise(F.lit(0.0)) for k in labels), F.lit(0.0))
    return F.when(F.col("valid_n") > 0, h / math.log(len(labels)))


def methods(shares: DataFrame, keys: list[str], plan: int = 1) -> DataFrame:
    """(keys, uq_method, uncertainty_score, valid_n, total_n, parse_failures, stochastic_complete, pred_modality): a row for
    each method of a stochastic group."""
    total = F.greatest(F.col("total_n"), F.lit(plan))
    scored = shares.withColumns({"m": majority(), "s": majority_share(), "h": entropy(), "t": total})
    rows = F.array(*(F.struct(F.lit(n).alias("uq_method"), v.alias("uncertainty_score")) for n, v in (("modality_consistency", 1 - F.col("s")), ("predictive_entropy", F.col("h")), ("variation_ratio", 1 - F.col("s")))))
    out = scored.select(*keys, "valid_n", "t", "m", F.explode(rows).alias("r"))
    return out.select(*keys, "r.uq_method", "r.uncertainty_score", "valid_n", F.col("t").alias("total_n"), (F.col("t") - F.col("valid_n")).alias("parse_failures"), (F.col("t") == F.col("valid_n")).alias("stochastic_complete"), F.col("m").alias("pred_modality"))


def build(observed: DataFrame, keys: list[str], item: list[str], model: str, order: list[str], plan: int | None, min_valid: int = 1, semantic: DataFrame | None = None, infer: bool = False) -> DataFrame:
    """(keys, uq_method, uncertainty_score, pred_modality, valid_n, total_n, parse_failures, stochastic_complete,
    sampling_plan_source) from observations that were de-duplicated before.

    observed: keys, model, sample_kind, label (null where the answer wasn't read), confidence. Deterministic answers
    give verbalized_confidence; groups of at least min_valid read samples give the sampled methods, and the semantic
    one where `semantic` (keys, semantic_score) has the group; items with labels of two models or more give the
    ensemble's. plan: samples planned for an item; without one, only infer=True takes what was observed for it."""
    if plan is None and not infer:
        raise ValueError("a sampling plan is needed; infer=True would take it from the observations")
    source = "inferred" if plan is None else "planned"
    one = F.lit(1).cast("long")
    det = observed.where("sample_kind = 'deterministic' AND label IS NOT NULL")
    columns = ["uq_method", "uncertainty_score", "pred_modality", "valid_n", "total_n", "parse_failures", "stochastic_complete"]
    verbal = det.select(*keys, F.lit("verbalized_confidence"), 1 - F.col("confidence"), "label", one, one, F.lit(0).cast("long"), F.lit(None).cast("boolean")).toDF(*keys, *columns)

    groups = label_shares(observed.where("sample_kind = 'stochastic'"), keys).where(F.col("valid_n") >= max(1, min_valid))
    sampled = methods(groups, keys, plan or 1).select(*keys, *columns)
    out = verbal.unionByName(sampled)
    if semantic is not None:
        base = sampled.where("uq_method = 'variation_ratio'").drop("uq_method", "uncertainty_score")
        out = out.unionByName(base.join(semantic, keys).withColumns({"uq_method": F.lit("acse_semantic_entropy"), "uncertainty_score": F.col("semantic_score")}).select(*keys, *columns))

    # one label a model, its latest
    each = det.groupBy(*item, model).agg(F.max(F.struct(*order, "label")).alias("b")).select(*item, F.col("b.label").alias("label"))
    views = label_shares(each, item).where("valid_n >= 2")
    ensemble = views.select(*item, F.lit("model_ensemble_disagreement").alias("uq_method"), (1 - majority_share()).alias("uncertainty_score"), majority().alias("pred_modality"), "valid_n", "total_n", F.lit(0).cast("long").alias("parse_failures"), F.lit(None).cast("boolean").alias("stochastic_complete"))
    return out.unionByName(ensemble, allowMissingColumns=True).withColumn("sampling_plan_source", F.lit(source))


def min_max(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """value scaled to [0, 1] within its group; 0 where the group is constant."""
    stats = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return rows.join(stats, keys).withColumn(name, F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def accept_threshold(rows: DataFrame, keys: list[str], score: str, wrong: Column, target: float) -> DataFrame:
    """(keys, threshold, coverage, accepted_error): the largest score up to which the accepted rows' error is within the target."""
    by = rows.select(*keys, F.col(score).alias("s"), wrong.cast("long").alias("w")).groupBy(*keys, "s").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.withColumns({"cw": F.sum("w").over(upto), "cn": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*keys))})
    ok = run.where(F.col("cw") / F.col("cn") <= target).groupBy(*keys).agg(F.max(F.struct("s", "cn", "cw")).alias("b"), F.max("total").alias("total"))
    return ok.select(*keys, F.col("b.s").alias("threshold"), (F.col("b.cn") / F.col("total")).alias("coverage"), (F.col("b.cw") / F.col("b.cn")).alias("accepted_error"))
