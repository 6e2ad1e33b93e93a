"""Uncertainty scores, metrics, report tables and resampling."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from modalith.functions.stats import Rate, flag, r9, share
from modalith.operators import metrics, order, resample, scores
from modalith.plans.registry import query
from modalith.plans.text_queries import ANSWERS, READ, STRICT, answers
from modalith.sources.session import checkpoint
from modalith.sources.views import MODALITIES, ctes, frame

LN4 = math.log(4)
SHARES = ctes("v_samples") + """, c AS (SELECT item_id, count(label) AS valid_n, count(*) AS total_n, count(*) FILTER (label = 'mandatory') AS a, count(*) FILTER (label = 'recommended') AS b, count(*) FILTER (label = 'optional') AS o, count(*) FILTER (label = 'nice_to_have') AS w FROM v_samples GROUP BY 1)
, m AS (SELECT *, greatest(a, b, o, w) AS best, CASE WHEN valid_n = 0 THEN NULL WHEN w = greatest(a, b, o, w) THEN 'nice_to_have' WHEN o = greatest(a, b, o, w) THEN 'optional' WHEN b = greatest(a, b, o, w) THEN 'recommended' ELSE 'mandatory' END AS label FROM c)"""
ENTROPY = "-(" + " + ".join(f"CASE WHEN {x} > 0 THEN ({x} / valid_n) * ln({x} / valid_n) ELSE 0 END" for x in "abow") + f") / {LN4!r}"


def shares(spark, sf):
    return scores.label_shares(frame(spark, sf, "v_samples"), ["item_id"])


@query("label_distribution", SHARES + " SELECT item_id, round(a / valid_n, 9) AS p_mandatory, round(b / valid_n, 9) AS p_recommended, round(o / valid_n, 9) AS p_optional, round(w / valid_n, 9) AS p_nice_to_have FROM c WHERE valid_n > 0")
def label_distribution(spark, sf):
    return shares(spark, sf).where("valid_n > 0").select("item_id", *(r9(scores.p_of(k)).alias(f"p_{k}") for k in MODALITIES))


@query("majority_label", SHARES + " SELECT item_id, label, round(best / valid_n, 9) AS share FROM m WHERE valid_n > 0")
def majority_label(spark, sf):
    return shares(spark, sf).where("valid_n > 0").select("item_id", scores.majority().alias("label"), r9(scores.majority_share()).alias("share"))


@query("label_consistency", SHARES + " SELECT item_id, round(1 - best / valid_n, 9) AS consistency_uncertainty FROM m WHERE valid_n > 0")
def label_consistency(spark, sf):
    return shares(spark, sf).where("valid_n > 0").select("item_id", r9(1 - scores.majority_share()).alias("consistency_uncertainty"))


@query("predictive_entropy", SHARES + f" SELECT item_id, round({ENTROPY}, 9) + 0.0 AS h FROM m WHERE valid_n > 0")
def predictive_entropy(spark, sf):
    return shares(spark, sf).where("valid_n > 0").select("item_id", r9(scores.entropy()).alias("h"))


@query("variation_ratio", SHARES + " SELECT item_id, round((valid_n - best) / valid_n, 9) AS vr FROM m WHERE valid_n > 0")
def variation_ratio(spark, sf):
    return shares(spark, sf).where("valid_n > 0").select("item_id", r9(1 - scores.majority_share()).alias("vr"))


@query("completeness", SHARES + " SELECT item_id, valid_n, greatest(total_n, 60) AS total_n, greatest(total_n, 60) - valid_n AS parse_failures, valid_n = greatest(total_n, 60) AS stochastic_complete FROM c")
def completeness(spark, sf):
    m = scores.methods(shares(spark, sf), ["item_id"], plan=60).where("uq_method = 'variation_ratio'")
    return m.select("item_id", "valid_n", "total_n", "parse_failures", "stochastic_complete")


@query("uq_scores", SHARES + f", s AS (SELECT item_id, valid_n, total_n, label, best / valid_n AS p, {ENTROPY} AS h FROM m WHERE valid_n > 0) SELECT item_id, 'modality_consistency' AS uq_method, round(1 - p, 9) AS uncertainty_score, label AS pred_modality, CAST(valid_n AS INT) AS valid_n, CAST(total_n AS INT) AS total_n FROM s UNION ALL SELECT item_id, 'predictive_entropy', round(h, 9) + 0.0, label, CAST(valid_n AS INT), CAST(total_n AS INT) FROM s UNION ALL SELECT item_id, 'variation_ratio', round(1 - p, 9), label, CAST(valid_n AS INT), CAST(total_n AS INT) FROM s")
def uq_scores(spark, sf):
    """Score rows in the pinned schema, of which the filled columns are returned."""
    m = scores.methods(shares(spark, sf).where("valid_n > 0"), ["item_id"])
    have = set(m.columns)
    full = m.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in scores.SCORE_SCHEMA))
    return full.select("item_id", "uq_method", r9("uncertainty_score").alias("uncertainty_score"), "pred_modality", "valid_n", "total_n")


@query("ensemble", ctes("v_samples") + ", l AS (SELECT item_id, event_type, label FROM (SELECT *, row_number() OVER (PARTITION BY item_id, event_type ORDER BY sample_id DESC) AS n FROM v_samples WHERE value > 20) WHERE n = 1 AND label IS NOT NULL) SELECT item_id, count(*) AS n_models, count(DISTINCT label) AS n_labels, round(1 - 1 / count(*)::DOUBLE, 9) AS disagreement FROM l GROUP BY 1 HAVING count(*) >= 2")
def ensemble(spark, sf):
    """Deterministic labels of several models on one item, and how much they disagree."""
    s = frame(spark, sf, "v_samples").where("value > 20").groupBy("item_id", "event_type").agg(F.max_by("label", "sample_id").alias("label"))
    per = scores.label_shares(s.where("label IS NOT NULL"), ["item_id"]).where("valid_n >= 2")
    n_labels = sum((flag(F.col(f"n_{k}") > 0) for k in MODALITIES), F.lit(0))
    return per.select("item_id", F.col("valid_n").alias("n_models"), n_labels.cast("long").alias("n_labels"), r9(1 - scores.majority_share()).alias("disagreement"))


@query("acse_normalise", "SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 9) AS score FROM events WINDOW w AS (PARTITION BY event_type)")
def acse_normalise(spark, sf):
    return scores.min_max(frame(spark, sf, "events"), ["event_type"], "value", "score").select("event_id", r9("score").alias("score"))


@query("acse_calibration", "WITH b AS (SELECT event_type, value AS s, count(*) FILTER (user_id % 3 = 0) AS w, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER u AS cw, sum(n) OVER u AS cn, sum(n) OVER (PARTITION BY event_type) AS t FROM b WINDOW u AS (PARTITION BY event_type ORDER BY s)) SELECT event_type, max(s) AS threshold, round(max(cn) / max(t), 9) AS coverage, round(max_by(cw, s) / max(cn), 9) AS accepted_error FROM r WHERE cw / cn <= 0.34 GROUP BY 1")
def acse_calibration(spark, sf):
    t = scores.accept_threshold(frame(spark, sf, "events"), ["event_type"], "value", F.col("user_id") % 3 == 0, 0.34)
    return t.select("event_type", "threshold", r9("coverage").alias("coverage"), r9("accepted_error").alias("accepted_error"))


@query("task3_scores", ctes("v_samples") + ", r AS (SELECT item_id, CASE WHEN value > 60 THEN 'strengthens' WHEN value > 20 THEN 'preserves' WHEN value > 2 THEN 'weakens' END AS relation FROM v_samples) SELECT item_id, count(relation) AS valid_n, count(*) FILTER (relation IS NULL) AS parse_failures, round(1 - greatest(count(*) FILTER (relation = 'strengthens'), count(*) FILTER (relation = 'preserves'), count(*) FILTER (relation = 'weakens')) / count(relation), 9) AS relation_consistency FROM r GROUP BY 1 HAVING count(relation) > 0")
def task3_scores(spark, sf):
    labels = ("strengthens", "preserves", "weakens")
    v = F.col("value")
    s = frame(spark, sf, "v_samples").withColumn("relation", F.when(v > 60, "strengthens").when(v > 20, "preserves").when(v > 2, "weakens"))
    g = scores.label_shares(s, ["item_id"], "relation", labels).where("valid_n > 0")
    return g.select("item_id", "valid_n", (F.col("total_n") - F.col("valid_n")).alias("parse_failures"), r9(1 - scores.majority_share(labels)).alias("relation_consistency"))


F1 = ctes("v_answers") + ", l AS (SELECT model, x.label, count(*) FILTER (source_modality = x.label AND pred_modality = x.label) AS tp, count(*) FILTER (source_modality = x.label) AS g, count(*) FILTER (pred_modality = x.label) AS p FROM v_answers, (VALUES ('mandatory'), ('recommended'), ('optional'), ('nice_to_have')) AS x(label) GROUP BY 1, 2)"


@query("accuracy_f1", F1 + " SELECT model, round(sum(tp) / sum(g), 9) AS accuracy, round(avg(2.0::DOUBLE * tp / (g + p)), 9) AS macro_f1 FROM l WHERE g + p > 0 GROUP BY 1")
def accuracy_f1(spark, sf):
    m = metrics.macro_f1(frame(spark, sf, "v_answers"), ["model"], "source_modality", "pred_modality")
    return m.select("model", r9("accuracy").alias("accuracy"), r9("macro_f1").alias("macro_f1"))


@query("brier", ctes("v_scored") + " SELECT lang, round(avg((p - quality) * (p - quality)), 9) AS brier, count(*) AS n FROM v_scored GROUP BY 1")
def brier(spark, sf):
    return frame(spark, sf, "v_scored").groupBy("lang").agg(r9(F.avg(F.pow(F.col("p") - F.col("quality"), F.lit(2)))).alias("brier"), F.count("*").alias("n"))


@query("ece", ctes("v_scored") + " SELECT lang, round(sum(abs(y - p)) / sum(n), 9) AS ece FROM (SELECT lang, least(floor(p * 10), 9) AS b, count(*) AS n, sum(quality) AS y, sum(p) AS p FROM v_scored GROUP BY 1, 2) GROUP BY 1")
def ece(spark, sf):
    return metrics.calibration_error(frame(spark, sf, "v_scored"), ["lang"], F.col("quality"), F.col("p")).select("lang", r9("ece").alias("ece"))


def rank_auroc(view: str, keys: str, label: str, score: str) -> str:
    return f", r AS (SELECT {keys}, {label} AS y, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0::DOUBLE AS k FROM {view}) SELECT {keys}, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 9) AS auroc, count(*) AS n, count(*) FILTER (y = 1) AS n_pos FROM r GROUP BY {keys}"


@query("auroc", ctes("v_scored") + rank_auroc("v_scored", "lang", "quality", "n_chars"))
def auroc(spark, sf):
    return metrics.auroc(frame(spark, sf, "v_scored"), ["lang"], F.col("quality"), F.col("n_chars")).select("lang", r9("auroc").alias("auroc"), "n", "n_pos")


@query("error_auroc", ctes("v_answers") + ", e AS (SELECT *, CASE WHEN pred_modality <> source_modality THEN 1 ELSE 0 END AS wrong, 1 - confidence AS u FROM v_answers)" + rank_auroc("e", "model", "wrong", "u"))
def error_auroc(spark, sf):
    m = metrics.auroc(frame(spark, sf, "v_answers"), ["model"], F.col("pred_modality") != F.col("source_modality"), 1 - F.col("confidence"))
    return m.select("model", r9("auroc").alias("auroc"), "n", "n_pos")


@query("selective_deferral", ctes("v_scored") + ", r AS (SELECT lang, CASE WHEN y_pred <> quality THEN 1 ELSE 0 END AS wrong, row_number() OVER (PARTITION BY lang ORDER BY 1 - abs(p - 0.5) DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM v_scored) SELECT lang, CAST(q AS DOUBLE) AS q, round(count(*) FILTER (k > ceil(n * q)) / count(*), 9) AS coverage, round(sum(wrong) FILTER (k > ceil(n * q)) / count(*) FILTER (k > ceil(n * q)), 9) AS error FROM r, (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) AS t(q) GROUP BY 1, 2")
def selective_deferral(spark, sf):
    d = metrics.deferral(frame(spark, sf, "v_scored"), ["lang"], F.col("y_pred") != F.col("quality"), 1 - F.abs(F.col("p") - 0.5), [F.col("doc_id")])
    return d.select("lang", "q", r9("coverage").alias("coverage"), r9("error").alias("error"))


@query("overcommit", ctes("v_answers") + " SELECT source_modality, round(count(*) FILTER (pred_ordinal > ordinal) / count(*), 9) AS over_rate, round(count(*) FILTER (pred_ordinal < ordinal) / count(*), 9) AS under_rate, round(avg(CAST(greatest(pred_ordinal - ordinal, 0) AS DOUBLE)), 9) AS severity_all, round(sum(greatest(pred_ordinal - ordinal, 0)) / nullif(count(*) FILTER (pred_ordinal > ordinal), 0), 9) AS severity_given FROM v_answers WHERE ordinal < 3 GROUP BY 1")
def overcommit(spark, sf):
    up = F.greatest(F.col("pred_ordinal") - F.col("ordinal"), F.lit(0))
    over, n = F.count_if(F.col("pred_ordinal") > F.col("ordinal")), F.count("*")
    return frame(spark, sf, "v_answers").where("ordinal < 3").groupBy("source_modality").agg(r9(share(over, n)).alias("over_rate"), r9(share(F.count_if(F.col("pred_ordinal") < F.col("ordinal")), n)).alias("under_rate"), r9(F.avg(up.cast("double"))).alias("severity_all"), r9(share(F.sum(up), over)).alias("severity_given"))


@query("overcommit_hc", ctes("v_answers") + " SELECT CAST(tau AS DOUBLE) AS tau, round(count(*) FILTER (pred_ordinal > ordinal AND confidence >= tau) / count(*), 9) AS hc_all, round(count(*) FILTER (pred_ordinal > ordinal AND confidence >= tau) / count(*) FILTER (source_modality <> 'mandatory'), 9) AS hc_overcommittable FROM v_answers, (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) AS t(tau) GROUP BY 1")
def overcommit_hc(spark, sf):
    rows = frame(spark, sf, "v_answers").withColumn("tau", F.explode(F.array(F.lit(0.8), F.lit(0.9))))
    hit = F.count_if((F.col("pred_ordinal") > F.col("ordinal")) & (F.col("confidence") >= F.col("tau")))
    return rows.groupBy("tau").agg(r9(share(hit, F.count("*"))).alias("hc_all"), r9(share(hit, F.count_if(F.col("source_modality") != "mandatory"))).alias("hc_overcommittable"))


@query("unsupported_accept", ctes("v_answers") + " SELECT model, round(count(*) FILTER (decision = 'yes' AND confidence >= 0.9) / count(*), 9) AS rate, count(*) AS n FROM v_answers WHERE task = 'task1' AND source_modality <> 'mandatory' GROUP BY 1")
def unsupported_accept(spark, sf):
    """The answer must be yes and its confidence high; a high p_yes alone doesn't count."""
    rows = frame(spark, sf, "v_answers").where("task = 'task1' AND source_modality <> 'mandatory'")
    return rows.groupBy("model").agg(r9(share(F.count_if((F.col("decision") == "yes") & (F.col("confidence") >= 0.9)), F.count("*"))).alias("rate"), F.count("*").alias("n"))


@query("weak_rates", ctes("v_answers") + " SELECT model, round(count(*) FILTER (pred_modality = 'nice_to_have') / count(*), 9) AS weak_recall, round(count(*) FILTER (pred_ordinal > 0) / count(*), 9) AS weak_strengthening FROM v_answers WHERE source_modality = 'nice_to_have' GROUP BY 1")
def weak_rates(spark, sf):
    rows = frame(spark, sf, "v_answers").where("source_modality = 'nice_to_have'")
    return rows.groupBy("model").agg(r9(share(F.count_if(F.col("pred_modality") == "nice_to_have"), F.count("*"))).alias("weak_recall"), r9(share(F.count_if(F.col("pred_ordinal") > 0), F.count("*"))).alias("weak_strengthening"))


@query("weak_gated", ctes("v_answers") + " SELECT model, count(*) FILTER (pred_ordinal > 0 AND confidence >= 0.9) AS num, round(count(*) FILTER (pred_ordinal > 0 AND confidence >= 0.9) / count(*), 9) AS of_all_weak, round(count(*) FILTER (pred_ordinal > 0 AND confidence >= 0.9) / nullif(count(*) FILTER (pred_ordinal > 0), 0), 9) AS of_strengthened FROM v_answers WHERE source_modality = 'nice_to_have' GROUP BY 1")
def weak_gated(spark, sf):
    rows = frame(spark, sf, "v_answers").where("source_modality = 'nice_to_have'")
    num = F.count_if((F.col("pred_ordinal") > 0) & (F.col("confidence") >= 0.9))
    return rows.groupBy("model").agg(num.alias("num"), r9(share(num, F.count("*"))).alias("of_all_weak"), r9(share(num, F.count_if(F.col("pred_ordinal") > 0))).alias("of_strengthened"))


@query("length_terciles", ctes("v_scored") + " SELECT CAST(t AS BIGINT) AS tercile, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 9) AS rate, CAST(min(n_chars) AS BIGINT) AS shortest FROM (SELECT *, ntile(3) OVER (ORDER BY n_chars, doc_id) AS t FROM v_scored) GROUP BY 1")
def length_terciles(spark, sf):
    """Buckets of equal count over a total order."""
    rows = frame(spark, sf, "v_scored").select("n_chars", "doc_id", "quality").withColumn("all", F.lit(1))
    t = order.equal_buckets(F.col("k"), F.col("n"), 3)
    return order.row_number_within(rows, ["all"], ["n_chars", "doc_id"], "k", "n").groupBy(t.alias("tercile")).agg(F.count("*").alias("n"), r9(F.avg(F.col("quality").cast("double"))).alias("rate"), F.min("n_chars").alias("shortest"))


MONO = ctes("v_answers") + ", s AS (SELECT seed_id, ordinal, avg(CASE WHEN decision = 'yes' THEN confidence ELSE 1 - confidence END) AS p FROM v_answers GROUP BY 1, 2), d AS (SELECT seed_id, lead(p) OVER (PARTITION BY seed_id ORDER BY ordinal DESC) - p AS up FROM s), x AS (SELECT seed_id, max(greatest(up, 0)) AS m FROM d WHERE up IS NOT NULL GROUP BY 1)"


@query("monotonicity", MONO + " SELECT count(*) AS seeds, count(*) FILTER (m > 0.05::DOUBLE + 1e-9) AS violations, count(*) FILTER (m > 1e-9) AS strict_violations, round(avg(m), 9) AS mean_increase, round(max(m), 9) AS max_increase FROM x")
def monotonicity(spark, sf):
    """p_yes must not rise as the modality weakens, beyond a tolerance of 0.05; 1e-9 stands against rounding."""
    p = F.when(F.col("decision") == "yes", F.col("confidence")).otherwise(1 - F.col("confidence"))
    s = frame(spark, sf, "v_answers").groupBy("seed_id", "ordinal").agg(F.avg(p).alias("p"))
    up = F.lead("p").over(Window.partitionBy("seed_id").orderBy(F.desc("ordinal"))) - F.col("p")
    x = s.withColumn("up", up).where("up IS NOT NULL").groupBy("seed_id").agg(F.max(F.greatest("up", F.lit(0.0))).alias("m"))
    return x.agg(F.count("*").alias("seeds"), F.count_if(F.col("m") > 0.05 + 1e-9).alias("violations"), F.count_if(F.col("m") > 1e-9).alias("strict_violations"), r9(F.avg("m")).alias("mean_increase"), r9(F.max("m")).alias("max_increase"))


@query("corr_spearman", ctes("v_scored") + ", r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY length(source) * 1000 + quality * 10 + toxic) + (count(*) OVER (PARTITION BY length(source) * 1000 + quality * 10 + toxic) - 1) / 2.0::DOUBLE AS b, n_chars, quality FROM v_scored) SELECT round(corr(a, b), 9) AS spearman, round(corr(CAST(n_chars AS DOUBLE), CAST(quality AS DOUBLE)), 9) AS pearson FROM r")
def corr_spearman(spark, sf):
    rows = frame(spark, sf, "v_scored").withColumn("other", F.char_length("source") * 1000 + F.col("quality") * 10 + F.col("toxic"))
    ranked = order.average_ranks(order.average_ranks(rows.select("n_chars", "other", "quality"), "n_chars", "a"), "other", "b")
    return ranked.agg(r9(F.corr("a", "b")).alias("spearman"), r9(F.corr(F.col("n_chars").cast("double"), F.col("quality").cast("double"))).alias("pearson"))


@query("task3_metrics", ctes("v_answers") + " SELECT model, round(count(*) FILTER (pred_ordinal > ordinal AND kind % 2 = 0) / nullif(count(*) FILTER (pred_ordinal > ordinal), 0), 9) AS strengthening_recall, round(count(*) FILTER (pred_ordinal <> ordinal AND kind = 9) / nullif(count(*) FILTER (pred_ordinal <> ordinal), 0), 9) AS false_preserve, round(count(*) FILTER (instr(requirement, 'system') > 0) / count(*), 9) AS evidence_in_source FROM v_answers GROUP BY 1")
def task3_metrics(spark, sf):
    up, moved = F.col("pred_ordinal") > F.col("ordinal"), F.col("pred_ordinal") != F.col("ordinal")
    return frame(spark, sf, "v_answers").groupBy("model").agg(r9(share(F.count_if(up & (F.col("kind") % 2 == 0)), F.count_if(up))).alias("strengthening_recall"), r9(share(F.count_if(moved & (F.col("kind") == 9)), F.count_if(moved))).alias("false_preserve"), r9(share(F.count_if(F.instr("requirement", "system") > 0), F.count("*"))).alias("evidence_in_source"))


SUMMARY_KEYS = "model, task, sample_kind"


@query("metric_summary", ctes("v_answers") + f", e AS (SELECT *, CASE WHEN pred_modality <> source_modality THEN 1 ELSE 0 END AS wrong, 1 - confidence AS u FROM v_answers), g AS (SELECT {SUMMARY_KEYS}, count(*) AS total, round(avg(CAST(1 - wrong AS DOUBLE)), 9) AS accuracy, round(avg(confidence), 9) AS mean_confidence FROM e GROUP BY {SUMMARY_KEYS}), x AS (SELECT * FROM (" + f"SELECT {SUMMARY_KEYS}, round((sum(k) FILTER (wrong = 1) - count(*) FILTER (wrong = 1) * (count(*) FILTER (wrong = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (wrong = 1) * count(*) FILTER (wrong = 0), 0), 9) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY {SUMMARY_KEYS} ORDER BY u) + (count(*) OVER (PARTITION BY {SUMMARY_KEYS}, u) - 1) / 2.0::DOUBLE AS k FROM e) GROUP BY {SUMMARY_KEYS})) SELECT model, task, sample_kind, total, accuracy, mean_confidence, auroc FROM g JOIN x USING ({SUMMARY_KEYS})")
def metric_summary(spark, sf):
    keys = SUMMARY_KEYS.split(", ")
    rows = frame(spark, sf, "v_answers").withColumn("wrong", F.col("pred_modality") != F.col("source_modality"))
    g = rows.groupBy(*keys).agg(F.count("*").alias("total"), r9(F.avg(flag(~F.col("wrong")).cast("double"))).alias("accuracy"), r9(F.avg("confidence")).alias("mean_confidence"))
    return g.join(metrics.auroc(rows, keys, F.col("wrong"), 1 - F.col("confidence")).select(*keys, r9("auroc").alias("auroc")), keys)


CELLS = "model, dataset, variant"


@query("snapshot_task2", ANSWERS + f", f AS (SELECT {CELLS}, count(*) AS attempts, count(*) FILTER (status <> 'ok') AS parse_failures FROM v_attempts WHERE task = 'task2' GROUP BY {CELLS}), s AS (SELECT {CELLS}, count(*) AS n, count(*) FILTER ({READ}) AS readable, count(*) FILTER ({STRICT}) AS strict_n, count(*) FILTER (coalesce(gen > ordinal, false)) AS broad_n, round(count(*) FILTER ({STRICT}) / count(*) FILTER ({READ}), 9) AS strict_rate, round(count(*) FILTER (pred_modality = source_modality) / count(*), 9) AS label_accuracy FROM a WHERE task = 'task2' GROUP BY {CELLS}) SELECT * FROM s JOIN f USING ({CELLS})")
def snapshot_task2(spark, sf):
    keys = CELLS.split(", ")
    fails = frame(spark, sf, "v_attempts").where("task = 'task2'").groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(F.col("status") != "ok").alias("parse_failures"))
    readable = F.count_if(F.col("parse_status") == "ok")
    s = answers(spark, sf).where("task = 'task2'").groupBy(*keys).agg(F.count("*").alias("n"), readable.alias("readable"), F.count_if("strict_text_overcommit").alias("strict_n"), F.count_if("text_overcommit").alias("broad_n"), r9(share(F.count_if("strict_text_overcommit"), readable)).alias("strict_rate"), r9(share(F.count_if(F.col("pred_modality") == F.col("source_modality")), F.count("*"))).alias("label_accuracy"))
    return s.join(fails, keys)


@query("snapshot_stability", ANSWERS + f", g AS (SELECT {CELLS}, item_id, count(*) AS k, count(DISTINCT pred_modality) AS labels FROM v_answers WHERE sample_kind = 'stochastic' GROUP BY {CELLS}, item_id) SELECT a.model, a.dataset, a.variant, count(*) AS n, count(*) FILTER ({STRICT}) AS strict_n, round(count(*) FILTER (({STRICT}) AND confidence >= 0.9) / nullif(count(*) FILTER ({STRICT}), 0), 9) AS high_conf_share, count(g.k) AS grouped_n, round(count(*) FILTER (labels = 1) / nullif(count(g.k), 0), 9) AS agreement FROM a LEFT JOIN g ON a.model = g.model AND a.dataset = g.dataset AND a.variant = g.variant AND a.item_id = g.item_id WHERE a.sample_kind = 'deterministic' GROUP BY 1, 2, 3")
def snapshot_stability(spark, sf):
    keys = CELLS.split(", ")
    a = answers(spark, sf)
    g = a.where("sample_kind = 'stochastic'").groupBy(*keys, "item_id").agg(F.count("*").alias("k"), F.count_distinct("pred_modality").alias("labels"))
    strict = F.col("strict_text_overcommit")
    j = a.where("sample_kind = 'deterministic'").select(*keys, "item_id", "strict_text_overcommit", "confidence").join(g, [*keys, "item_id"], "left")
    return j.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(strict).alias("strict_n"), r9(share(F.count_if(strict & (F.col("confidence") >= 0.9)), F.count_if(strict))).alias("high_conf_share"), F.count("k").alias("grouped_n"), r9(share(F.count_if(F.col("labels") == 1), F.count("k"))).alias("agreement"))


@query("per_model_modality", ctes("v_answers") + " SELECT m.model, t.l AS source_modality, count(a.item_id) AS n, count(*) FILTER (a.pred_ordinal > a.ordinal) AS n_over FROM (SELECT DISTINCT model FROM v_answers) m CROSS JOIN (VALUES ('mandatory'), ('recommended'), ('optional'), ('nice_to_have'), ('withdrawn')) AS t(l) LEFT JOIN v_answers a ON a.model = m.model AND a.source_modality = t.l GROUP BY 1, 2")
def per_model_modality(spark, sf):
    """Every model by every modality, those without a row included."""
    rows = frame(spark, sf, "v_answers")
    grid = rows.select("model").distinct().withColumn("source_modality", F.explode(F.array(*(F.lit(m) for m in (*MODALITIES, "withdrawn")))))
    got = rows.groupBy("model", "source_modality").agg(F.count("*").alias("n"), F.count_if(F.col("pred_ordinal") > F.col("ordinal")).alias("n_over"))
    return grid.join(got, ["model", "source_modality"], "left").select("model", "source_modality", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_over")))


def slices():
    """Named subsets of scored answers."""
    return {"task1": F.col("task") == "task1", "task2": F.col("task") == "task2", "task2_readable": (F.col("task") == "task2") & (F.col("parse_status") == "ok"), "task2_weak": (F.col("task") == "task2") & (F.col("source_modality") == "nice_to_have"), "task2_strict": (F.col("task") == "task2") & F.col("strict_text_overcommit")}


SLICE_SQL = {"task1": "task = 'task1'", "task2": "task = 'task2'", "task2_readable": f"task = 'task2' AND {READ}", "task2_weak": "task = 'task2' AND source_modality = 'nice_to_have'", "task2_strict": f"task = 'task2' AND {STRICT}"}


@query("rq_slices", ANSWERS + " " + " UNION ALL ".join(f"SELECT '{k}' AS slice, count(*) AS n, round(avg(confidence), 9) AS mean_confidence FROM a WHERE {v}" for k, v in SLICE_SQL.items()))
def rq_slices(spark, sf):
    """One pass over the answers for all slices."""
    names = slices()
    g = answers(spark, sf).agg(*(F.count_if(c).alias(f"n_{k}") for k, c in names.items()), *(F.avg(F.when(c, F.col("confidence"))).alias(f"c_{k}") for k, c in names.items()))
    return g.select(F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.col(f"n_{k}").alias("n"), r9(f"c_{k}").alias("mean_confidence")) for k in names))).alias("r")).select("r.*")


def rates():
    ok = F.col("parse_status") == "ok"
    return (Rate("strict", flag(F.col("strict_text_overcommit")), flag(ok)), Rate("broad", flag(F.col("text_overcommit")), flag(ok)), Rate("accuracy", flag(F.col("pred_modality") == F.col("source_modality")), F.lit(1)), Rate("unsupported", flag((F.col("decision") == "yes") & (F.col("confidence") >= 0.9) & (F.col("ordinal") < 3)), flag(F.col("ordinal") < 3)))


RQ = f"count(*) AS n, round(count(*) FILTER ({STRICT}) / nullif(count(*) FILTER ({READ}), 0), 9) AS strict, round(count(*) FILTER (coalesce(gen > ordinal, false)) / nullif(count(*) FILTER ({READ}), 0), 9) AS broad, round(count(*) FILTER (pred_modality = source_modality) / count(*), 9) AS accuracy, round(count(*) FILTER (decision = 'yes' AND confidence >= 0.9 AND ordinal < 3) / nullif(count(*) FILTER (ordinal < 3), 0), 9) AS unsupported"


def rq_columns(grouped):
    out = grouped.agg(F.count("*").alias("n"), *(s for r in rates() for s in r.sums()))
    return out, [r9(r.value()).alias(r.name) for r in rates()]


@query("rq_table", ANSWERS + f" SELECT model, {RQ} FROM a GROUP BY 1 UNION ALL SELECT 'all', {RQ} FROM a")
def rq_table(spark, sf):
    g, values = rq_columns(answers(spark, sf).rollup("model"))
    return g.select(F.coalesce("model", F.lit("all")).alias("model"), "n", *values)


@query("rq_grouping_sets", ANSWERS + f" SELECT coalesce(model, 'all') AS model, coalesce(dataset, 'all') AS dataset, coalesce(variant, 'all') AS variant, {RQ} FROM a GROUP BY GROUPING SETS ((model), (dataset, variant), ())")
def rq_grouping_sets(spark, sf):
    """Three kinds of rows and no interior ones: by model, by cell, and all."""
    g, values = rq_columns(answers(spark, sf).groupingSets([[F.col("model")], [F.col("dataset"), F.col("variant")], []], "model", "dataset", "variant"))
    return g.select(*(F.coalesce(c, F.lit("all")).alias(c) for c in ("model", "dataset", "variant")), "n", *values)


@query("headline_pooled_macro", ANSWERS + f", c AS (SELECT {CELLS}, count(*) FILTER ({STRICT}) AS s, count(*) FILTER ({READ}) AS r FROM a GROUP BY {CELLS}) SELECT dataset, CAST(sum(s) AS BIGINT) AS num, CAST(sum(r) AS BIGINT) AS den, round(sum(s) / sum(r), 9) AS pooled, round(avg(s / r), 9) AS macro, string_agg(model || '/' || variant, '|' ORDER BY model || '/' || variant) AS cells FROM c GROUP BY 1")
def headline_pooled_macro(spark, sf):
    strict = rates()[0]
    cells = answers(spark, sf).groupBy(*CELLS.split(", ")).agg(*strict.sums())
    return cells.groupBy("dataset").agg(F.sum("strict_num").alias("num"), F.sum("strict_den").alias("den"), r9(share(F.sum("strict_num"), F.sum("strict_den"))).alias("pooled"), r9(F.avg(strict.value())).alias("macro"), F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("/", "model", "variant")))).alias("cells"))


GRID = "(VALUES ('mandatory'), ('recommended'), ('optional'), ('nice_to_have')) AS "


@query("transitions", ANSWERS + f" SELECT s.l AS source_modality, t.l AS text_modality, count(a.kind) AS n, count(*) FILTER ({STRICT}) AS n_strict FROM {GRID} s(l) CROSS JOIN {GRID} t(l) LEFT JOIN a ON a.source_modality = s.l AND a.modality = t.l GROUP BY 1, 2")
def transitions(spark, sf):
    """A dense matrix: pairs that don't occur are there with zero."""
    labels = F.array(*map(F.lit, MODALITIES))
    grid = spark.range(1).select(F.explode(labels).alias("source_modality")).withColumn("text_modality", F.explode(labels))
    got = answers(spark, sf).groupBy("source_modality", F.col("t.modality").alias("text_modality")).agg(F.count("*").alias("n"), F.count_if("strict_text_overcommit").alias("n_strict"))
    return grid.join(got, ["source_modality", "text_modality"], "left").select("source_modality", "text_modality", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_strict")))


@query("transitions_rollup", ANSWERS + f" SELECT coalesce(model, 'all') AS model, coalesce(dataset, 'all') AS dataset, coalesce(variant, 'all') AS variant, count(*) AS n, count(*) FILTER ({STRICT}) AS n_strict, count(*) FILTER (modality = source_modality) AS n_same FROM a GROUP BY GROUPING SETS (({CELLS}), (model), (dataset, variant), ())")
def transitions_rollup(spark, sf):
    keys = [F.col(c) for c in CELLS.split(", ")]
    g = answers(spark, sf).groupingSets([keys, keys[:1], keys[1:], []], *CELLS.split(", ")).agg(F.count("*").alias("n"), F.count_if("strict_text_overcommit").alias("n_strict"), F.count_if(F.col("t.modality") == F.col("source_modality")).alias("n_same"))
    return g.select(*(F.coalesce(c, F.lit("all")).alias(c) for c in CELLS.split(", ")), "n", "n_strict", "n_same")


@query("confusion", ctes("v_answers") + " SELECT source_modality, " + ", ".join(f"count(*) FILTER (pred_modality = '{m}') AS {m}" for m in MODALITIES) + " FROM v_answers GROUP BY 1")
def confusion(spark, sf):
    return frame(spark, sf, "v_answers").groupBy("source_modality").pivot("pred_modality", list(MODALITIES)).count().na.fill(0)


@query("arm_rows", ANSWERS + f" SELECT variant AS arm, count(*) AS n, count(DISTINCT model) AS models, count(*) FILTER ({STRICT}) AS strict_n, round(avg(confidence), 9) AS mean_confidence FROM a GROUP BY 1")
def arm_rows(spark, sf):
    return answers(spark, sf).groupBy(F.col("variant").alias("arm")).agg(F.count("*").alias("n"), F.count_distinct("model").alias("models"), F.count_if("strict_text_overcommit").alias("strict_n"), r9(F.avg("confidence")).alias("mean_confidence"))


PAIRED = ANSWERS + ", x AS (SELECT model, item_id, count(*) FILTER (variant = 'must') AS na, count(*) FILTER (variant = 'shall') AS nb, max(confidence) FILTER (variant = 'must') AS ca, max(confidence) FILTER (variant = 'shall') AS cb, any_value(seed_id) AS seed_id FROM a GROUP BY 1, 2), p AS (SELECT * FROM x WHERE na = 1 AND nb = 1)"


def paired(spark, sf):
    """Items answered exactly once in either arm, with both confidences: pairs are made before anything is resampled."""
    a = frame(spark, sf, "v_answers")
    must = F.col("variant") == "must"
    g = a.groupBy("model", "item_id", "seed_id").agg(F.count_if(must).alias("na"), F.count_if(~must).alias("nb"), F.max(F.when(must, F.col("confidence"))).alias("ca"), F.max(F.when(~must, F.col("confidence"))).alias("cb"))
    return g.where("na = 1 AND nb = 1")


@query("arm_deltas", PAIRED + " SELECT model, count(*) AS pairs, round(avg(cb) - avg(ca), 9) + 0.0 AS delta FROM p GROUP BY 1")
def arm_deltas(spark, sf):
    return paired(spark, sf).groupBy("model").agg(F.count("*").alias("pairs"), r9(F.avg("cb") - F.avg("ca")).alias("delta"))


@query("phrasing_deltas", ANSWERS + ", b AS (SELECT seed_id, avg(confidence) AS base FROM a WHERE kind = 3 GROUP BY 1) SELECT kind, count(*) AS n, round(avg(confidence - base), 9) + 0.0 AS delta FROM a JOIN b USING (seed_id) WHERE kind IN (8, 11) GROUP BY 1")
def phrasing_deltas(spark, sf):
    a = frame(spark, sf, "v_answers")
    base = a.where("kind = 3").groupBy("seed_id").agg(F.avg("confidence").alias("base"))
    return a.where("kind IN (8, 11)").join(base, "seed_id").groupBy("kind").agg(F.count("*").alias("n"), r9(F.avg(F.col("confidence") - F.col("base"))).alias("delta"))


@query("prompt_sensitivity", ctes("v_answers") + " SELECT variant, round(count(*) FILTER (task = 'task1' AND decision = 'yes') / nullif(count(*) FILTER (task = 'task1'), 0), 9) AS yes_rate, count(*) FILTER (task = 'task1') AS n FROM v_answers GROUP BY 1")
def prompt_sensitivity(spark, sf):
    t1 = F.col("task") == "task1"
    return frame(spark, sf, "v_answers").groupBy("variant").agg(r9(share(F.count_if(t1 & (F.col("decision") == "yes")), F.count_if(t1))).alias("yes_rate"), F.count_if(t1).alias("n"))


@query("audit_coverage", ctes("v_answers") + ", s AS (SELECT model, item_id, max(CASE WHEN kind = 7 THEN 1 ELSE 0 END) AS unreadable FROM v_answers WHERE task = 'task2' GROUP BY 1, 2), t AS (SELECT model, item_id, count(*) AS k FROM v_answers WHERE task = 'task1' GROUP BY 1, 2) SELECT s.model, count(*) AS eligible, count(t.k) AS audited, count(*) FILTER (t.k IS NULL) AS missing, count(*) FILTER (t.k > 1) AS repeated, count(*) FILTER (unreadable = 1) AS unreadable FROM s LEFT JOIN t USING (model, item_id) GROUP BY 1")
def audit_coverage(spark, sf):
    a, key = frame(spark, sf, "v_answers"), ["model", "item_id"]
    s = a.where("task = 'task2'").groupBy(*key).agg(F.max(flag(F.col("kind") == 7)).alias("unreadable"))
    t = a.where("task = 'task1'").groupBy(*key).agg(F.count("*").alias("k"))
    return s.join(t, key, "left").groupBy("model").agg(F.count("*").alias("eligible"), F.count("k").alias("audited"), F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("k") > 1).alias("repeated"), F.count_if(F.col("unreadable") == 1).alias("unreadable"))


@query("cluster_diagnostics", SHARES + f", e AS (SELECT {ENTROPY} AS h, valid_n FROM m WHERE valid_n > 0) SELECT count(*) AS n, round(avg(CASE WHEN h > 0.9 THEN 1.0::DOUBLE ELSE 0 END), 9) AS dispersed_fraction, round(min(h), 9) AS min_h, round(quantile_cont(h, 0.5), 9) AS median_h, round(max(h), 9) AS max_h, count(DISTINCT round(h, 9)) AS distinct_scores FROM e")
def cluster_diagnostics(spark, sf):
    e = shares(spark, sf).where("valid_n > 0").select(scores.entropy().alias("h"))
    return e.agg(F.count("*").alias("n"), r9(F.avg(flag(F.col("h") > 0.9).cast("double"))).alias("dispersed_fraction"), r9(F.min("h")).alias("min_h"), r9(F.percentile("h", F.lit(0.5))).alias("median_h"), r9(F.max("h")).alias("max_h"), F.count_distinct(F.round("h", 9)).alias("distinct_scores"))


@query("cohort_accounting", ANSWERS + f", g AS (SELECT DISTINCT model, item_id FROM v_answers WHERE sample_kind = 'stochastic') SELECT count(*) AS rows_n, count(*) FILTER ({READ}) AS readable_n, count(*) FILTER (({READ}) AND g.item_id IS NOT NULL) AS joined_n, count(*) FILTER (({READ}) AND g.item_id IS NULL) AS no_group_n FROM a LEFT JOIN g USING (model, item_id) WHERE sample_kind = 'deterministic'")
def cohort_accounting(spark, sf):
    a, key = answers(spark, sf), ["model", "item_id"]
    g = a.where("sample_kind = 'stochastic'").select(*key).distinct().withColumn("has", F.lit(True))
    j = a.where("sample_kind = 'deterministic'").select(*key, "parse_status").join(g, key, "left")
    ok = F.col("parse_status") == "ok"
    return j.agg(F.count("*").alias("rows_n"), F.count_if(ok).alias("readable_n"), F.count_if(ok & F.col("has").isNotNull()).alias("joined_n"), F.count_if(ok & F.col("has").isNull()).alias("no_group_n"))


@query("recheck", ANSWERS + " SELECT count(*) AS n, count(*) FILTER (modality IS DISTINCT FROM pred_modality) AS mismatches FROM a")
def recheck(spark, sf):
    """The wording rules applied again to raw rows, against the stored label."""
    a = answers(spark, sf)
    return a.agg(F.count("*").alias("n"), F.count_if(~F.col("t.modality").eqNullSafe(F.col("pred_modality"))).alias("mismatches"))


@query("risk_topk", ctes("v_answers") + " SELECT item_id, model, pred_ordinal - ordinal AS jump, confidence, requirement, l_orderkey FROM v_answers WHERE pred_ordinal > ordinal AND confidence >= 0.8 ORDER BY pred_ordinal - ordinal DESC, confidence DESC, item_id, l_orderkey, model, requirement LIMIT 15")
def risk_topk(spark, sf):
    rows = frame(spark, sf, "v_answers").where("pred_ordinal > ordinal AND confidence >= 0.8").withColumn("jump", F.col("pred_ordinal") - F.col("ordinal"))
    return rows.orderBy(F.desc("jump"), F.desc("confidence"), "item_id", "l_orderkey", "model", "requirement").limit(15).select("item_id", "model", "jump", "confidence", "requirement", "l_orderkey")


@query("contrast_pick", ctes("v_scored") + ", b AS (SELECT doc_id, quality * 2 + toxic AS bucket, n_chars FROM v_scored) SELECT bucket, max_by(doc_id, (n_chars, doc_id)) AS longest, min_by(doc_id, (n_chars, doc_id)) AS shortest FROM b GROUP BY 1")
def contrast_pick(spark, sf):
    by = F.struct("n_chars", "doc_id")
    return frame(spark, sf, "v_scored").groupBy((F.col("quality") * 2 + F.col("toxic")).alias("bucket")).agg(F.max_by("doc_id", by).alias("longest"), F.min_by("doc_id", by).alias("shortest"))


@query("fold_summary", ctes("v_scored") + ", f AS (SELECT doc_id % 5 AS fold, avg(CAST(quality AS DOUBLE)) AS v FROM v_scored GROUP BY 1) SELECT count(*) AS folds, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd FROM f")
def fold_summary(spark, sf):
    f = frame(spark, sf, "v_scored").groupBy(F.col("doc_id") % 5).agg(F.avg(F.col("quality").cast("double")).alias("v"))
    return f.agg(F.count("*").alias("folds"), r9(F.avg("v")).alias("mean"), r9(F.stddev_samp("v")).alias("sd"))


#: Draws of every interval, and their seed.
DRAWS, SEED = 1000, "20260518"


def boot_sql(cluster: str, num: str, den: str, source: str) -> str:
    """The bootstrap for the oracle: the same md5 draws, one percentile interval."""
    return f""", c AS (SELECT {cluster} AS c, sum({num}) AS num, sum({den}) AS den FROM {source} GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, num, den FROM c), nn AS (SELECT count(*) AS n FROM k)
, w AS (SELECT b.range AS b, ('0x' || substr(md5('{SEED}:' || b.range || ':' || j.range), 1, 8))::BIGINT % (SELECT n FROM nn) AS i FROM range({DRAWS}) b, range((SELECT n FROM nn)) j)
, d AS (SELECT b, sum(num) / sum(den) AS rate FROM w JOIN k USING (i) GROUP BY 1 HAVING sum(den) > 0)"""


def interval(rows, cluster, num, den):
    """(rate, lo, hi): the point estimate and the 2.5 and 97.5 percentiles over draws of clusters."""
    clusters = checkpoint(resample.cluster_sums(rows, cluster, {"num": num, "den": den}))
    draws = resample.bootstrap_rates(clusters, "num", "den", DRAWS, SEED)
    ci = draws.agg(r9(F.percentile("rate", F.lit(0.025))).alias("lo"), r9(F.percentile("rate", F.lit(0.975))).alias("hi"))
    return clusters.agg(r9(share(F.sum("num"), F.sum("den"))).alias("rate")).join(ci)


CI = "SELECT round((SELECT sum(num) / sum(den) FROM c), 9) AS rate, round(quantile_cont(rate, 0.025), 9) AS lo, round(quantile_cont(rate, 0.975), 9) AS hi FROM d"
OVER = "CASE WHEN pred_ordinal > ordinal THEN 1 ELSE 0 END"


@query("bootstrap_rate", ctes("v_answers") + boot_sql("seed_id", OVER, "1", "v_answers") + CI)
def bootstrap_rate(spark, sf):
    return interval(frame(spark, sf, "v_answers"), "seed_id", flag(F.col("pred_ordinal") > F.col("ordinal")), F.lit(1))


@query("bootstrap_dual", ctes("v_answers") + boot_sql("batch_id", OVER, "1", "v_answers") + ", c2 AS (SELECT 1) SELECT 'request' AS cluster_field, lo, hi FROM (" + CI + ") UNION ALL SELECT 'seed', lo, hi FROM (" + ctes("v_answers") + boot_sql("seed_id", OVER, "1", "v_answers") + CI + ")")
def bootstrap_dual(spark, sf):
    a = frame(spark, sf, "v_answers")
    hit = flag(F.col("pred_ordinal") > F.col("ordinal"))
    request = interval(a, "batch_id", hit, F.lit(1)).select(F.lit("request").alias("cluster_field"), "lo", "hi")
    seed = interval(a, "seed_id", hit, F.lit(1)).select(F.lit("seed").alias("cluster_field"), "lo", "hi")
    return request.union(seed)


@query("bootstrap_delta", PAIRED + boot_sql("seed_id", "cb - ca", "1", "p") + " SELECT round((SELECT sum(num) / sum(den) FROM c), 9) + 0.0 AS rate, round(quantile_cont(rate, 0.025), 9) + 0.0 AS lo, round(quantile_cont(rate, 0.975), 9) + 0.0 AS hi FROM d")
def bootstrap_delta(spark, sf):
    """Both members of a pair move together; items of one arm only were left out before."""
    return interval(paired(spark, sf), "seed_id", F.col("cb") - F.col("ca"), F.lit(1))


@query("cluster_field", ctes("v_answers") + " SELECT model, CASE WHEN bool_and(batch_id <> 'B7') THEN 'request' WHEN bool_and(item_id <> '') THEN 'item' ELSE 'seed' END AS cluster_field FROM v_answers GROUP BY 1")
def cluster_field(spark, sf):
    have = F.nullif("batch_id", F.lit("B7"))
    return frame(spark, sf, "v_answers").groupBy("model").agg(F.when(F.bool_and(have.isNotNull()), "request").when(F.bool_and(F.col("item_id") != ""), "item").otherwise("seed").alias("cluster_field"))

