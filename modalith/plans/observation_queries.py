"""Identity, de-duplication, run selection, joins, set operations and planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from modalith.functions.stats import flag, r9, share
from modalith.operators import graph, observe
from modalith.operators import order as total
from modalith.operators.observe import IDENTITY
from modalith.plans.registry import query
from modalith.sources.views import ctes, frame

KEY = ", ".join(IDENTITY)
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus"]
LATEST = f"row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, " + ", ".join(f"{c} DESC" for c in ORDER) + ")"
OBS = ctes("v_attempts") + f", o AS (SELECT *, {LATEST} AS rn FROM v_attempts), obs AS (SELECT * FROM o WHERE rn = 1)"


def order():
    return [F.col(c) for c in ORDER]


def observations(spark, sf):
    return observe.dedupe_latest(frame(spark, sf, "v_attempts"), IDENTITY, F.col("status") == "ok", order())


@query("obs_identity", "SELECT coalesce(nullif(trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END), ''), 'legacy') AS profile_id, count(*) AS n FROM orders GROUP BY 1")
def obs_identity(spark, sf):
    x = F.when(F.col("o_orderkey") % 5 == 0, " ").when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    return frame(spark, sf, "orders").groupBy(observe.identity_part(x).alias("profile_id")).agg(F.count("*").alias("n"))


@query("dedupe_latest_ok", OBS + f" SELECT {KEY}, status, confidence, l_orderkey FROM obs")
def dedupe_latest_ok(spark, sf):
    return observations(spark, sf).select(*IDENTITY, "status", "confidence", "l_orderkey")


@query("attempt_ledger", OBS + " SELECT model, count(*) AS attempts, count(*) FILTER (rn = 1) AS observations, count(*) FILTER (rn > 1) AS superseded, count(*) FILTER (rn = 1 AND status <> 'ok') AS failed FROM o GROUP BY 1")
def attempt_ledger(spark, sf):
    rows = observe.ledger(frame(spark, sf, "v_attempts"), IDENTITY, F.col("status") == "ok", order())
    latest = F.col("is_latest")
    return rows.groupBy("model").agg(F.count("*").alias("attempts"), F.count_if(latest).alias("observations"), F.count_if(~latest).alias("superseded"), F.count_if(latest & (F.col("status") != "ok")).alias("failed"))


@query("pending_jobs", ctes("v_items", "v_attempts") + ", g AS (SELECT model, item_id FROM v_items CROSS JOIN (SELECT DISTINCT model FROM v_attempts)) SELECT model, count(*) AS pending FROM g WHERE NOT EXISTS (SELECT 1 FROM v_attempts a WHERE a.model = g.model AND a.item_id = g.item_id AND (a.status = 'ok' OR a.status = 'truncated')) GROUP BY 1")
def pending_jobs(spark, sf):
    """Planned jobs without a final answer: a refusal by the model is final, a transport error can be repeated."""
    attempts = frame(spark, sf, "v_attempts")
    models = sorted(attempts.agg(F.collect_set("model")).first()[0])  # a dimension: as many as were run
    planned = frame(spark, sf, "v_items").select("item_id", F.explode(F.array(*map(F.lit, models))).alias("model"))
    final = attempts.where(F.col("status").isin("ok", "truncated")).select("model", "item_id")
    return planned.join(final, ["model", "item_id"], "left_anti").groupBy("model").agg(F.count("*").alias("pending"))


@query("run_select", ctes("v_registry") + " SELECT model, dataset, variant, run_id, CAST(CAST(started_at AS DATE) AS STRING) AS started_on FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset, variant ORDER BY started_at DESC, run_id DESC) AS n FROM v_registry WHERE status = 'complete' AND observed_records >= expected_records AND run_name NOT LIKE 'smoke-%') WHERE n = 1")
def run_select(spark, sf):
    good = frame(spark, sf, "v_registry").where((F.col("status") == "complete") & (F.col("observed_records") >= F.col("expected_records")) & ~F.col("run_name").startswith("smoke-"))
    best = observe.latest_of(good.select("model", "dataset", "variant", "started_at", "run_id"), ["model", "dataset", "variant"], ["started_at", "run_id"])
    return best.select("model", "dataset", "variant", "run_id", F.col("started_at").cast("date").cast("string").alias("started_on"))


@query("audit_select", ctes("v_registry") + ", src AS (SELECT model, run_id FROM v_registry WHERE o_orderkey % 10 = 0), aud AS (SELECT *, regexp_extract(notes, 'source_run_id=([^;]*)', 1) AS src_id FROM v_registry WHERE o_orderkey % 10 <> 0) SELECT src.model, src.run_id, count(aud.run_id) AS n_audits, coalesce(max(aud.run_id), '') AS audit_run FROM src LEFT JOIN aud ON aud.src_id = src.run_id GROUP BY 1, 2")
def audit_select(spark, sf):
    reg = frame(spark, sf, "v_registry")
    src = reg.where("o_orderkey % 10 = 0").select("model", "run_id")
    aud = reg.where("o_orderkey % 10 <> 0").select(F.str_to_map("notes", F.lit(";"), F.lit("="))["source_run_id"].alias("run_id"), F.col("run_id").alias("audit"))
    return src.join(aud, "run_id", "left").groupBy("model", "run_id").agg(F.count("audit").alias("n_audits"), F.coalesce(F.max("audit"), F.lit("")).alias("audit_run"))


@query("registry_latest", ctes("v_registry") + " SELECT model, dataset, status, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY o_orderkey DESC) AS n FROM v_registry) WHERE n = 1")
def registry_latest(spark, sf):
    """Upsert by key: of a registry and later rows for it, the last row of each key stays."""
    reg = frame(spark, sf, "v_registry").select("model", "dataset", "o_orderkey", "status")
    old, new = reg.where("o_orderkey % 2 = 0"), reg.where("o_orderkey % 2 = 1")
    return observe.latest_of(old.unionByName(new), ["model", "dataset"], ["o_orderkey"]).select("model", "dataset", "status", "o_orderkey")


@query("registry_compat", ctes("v_registry") + " SELECT concat_ws(',', CASE WHEN status <> 'complete' THEN 'status' END, CASE WHEN observed_records < expected_records THEN 'coverage' END, CASE WHEN batch_order <> 'single' THEN 'order' END, CASE WHEN batch_size > 1 THEN 'size' END) AS issues, count(*) AS n FROM v_registry GROUP BY 1")
def registry_compat(spark, sf):
    checks = (("status", F.col("status") != "complete"), ("coverage", F.col("observed_records") < F.col("expected_records")), ("order", F.col("batch_order") != "single"), ("size", F.col("batch_size") > 1))
    return frame(spark, sf, "v_registry").groupBy(F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in checks)).alias("issues")).agg(F.count("*").alias("n"))


@query("arm_select", ctes("v_registry") + " SELECT model, batch_order, run_id FROM (SELECT *, row_number() OVER (PARTITION BY model, batch_order ORDER BY started_at DESC, run_id DESC) AS n FROM v_registry WHERE status = 'complete' AND observed_records = expected_records) WHERE n = 1")
def arm_select(spark, sf):
    good = frame(spark, sf, "v_registry").where("status = 'complete' AND observed_records = expected_records")
    return observe.latest_of(good.select("model", "batch_order", "started_at", "run_id"), ["model", "batch_order"], ["started_at", "run_id"]).select("model", "batch_order", "run_id")


@query("source_gaps", ctes("v_registry") + " SELECT DISTINCT r.model, r.dataset, r.variant FROM v_registry r WHERE NOT EXISTS (SELECT 1 FROM v_registry s WHERE s.model = r.model AND s.dataset = r.dataset AND s.variant = r.variant AND s.status = 'complete' AND s.started_at >= DATE '2001-10-01')")
def source_gaps(spark, sf):
    reg, cell = frame(spark, sf, "v_registry"), ["model", "dataset", "variant"]
    fresh = reg.where((F.col("status") == "complete") & (F.col("started_at") >= F.lit("2001-10-01").cast("timestamp_ntz")))
    return reg.select(*cell).distinct().join(fresh.select(*cell), cell, "left_anti")


@query("stale_semi", ctes("v_attempts", "v_items") + " SELECT count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM (SELECT EXISTS (SELECT 1 FROM v_items i WHERE i.item_id = a.item_id AND a.kind <> 3) AS kept FROM v_attempts a)")
def stale_semi(spark, sf):
    """Attempts whose recorded statement is still the item's."""
    items = frame(spark, sf, "v_items").select("item_id", "source_statement")
    one = items.groupBy("item_id").agg(F.min("source_statement").alias("source_statement"))  # an id may stand for several
    seen = frame(spark, sf, "v_attempts").select("item_id", "kind").join(one, "item_id", "left")
    seen = seen.withColumn("source_statement", F.when(F.col("kind") == 3, F.concat("source_statement", F.lit(" (old)"))).otherwise(F.col("source_statement")))
    n = seen.agg(F.count("*").alias("n"))
    k = seen.join(items, ["item_id", "source_statement"], "left_semi").agg(F.count("*").alias("kept"))
    return k.join(n).select("kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query("strata", ctes("v_answers") + " SELECT 'all' AS stratum, count(*) AS n FROM v_answers UNION ALL SELECT 'weak_intent', count(*) FROM v_answers WHERE source_modality = 'nice_to_have' UNION ALL SELECT 'modality_optional/high_conf', count(*) FROM v_answers WHERE source_modality = 'optional' AND confidence >= 0.8")
def strata(spark, sf):
    """Predicates by name; a / between names means both."""
    known = {"all": F.lit(True), "weak_intent": F.col("source_modality") == "nice_to_have", "modality_optional": F.col("source_modality") == "optional", "high_conf": F.col("confidence") >= 0.8}
    names = ["all", "weak_intent", "modality_optional/high_conf"]
    both = lambda s: known[s.split("/")[0]] & known[s.split("/")[-1]]
    g = frame(spark, sf, "v_answers").agg(*(F.count_if(both(n)).alias(n) for n in names))
    return g.select(F.explode(F.array(*(F.struct(F.lit(n).alias("stratum"), F.col(f"`{n}`").alias("n")) for n in names))).alias("r")).select("r.*")


@query("pilot_topn", ctes("v_seeds") + " SELECT seed_id FROM v_seeds ORDER BY seed_id LIMIT 25")
def pilot_topn(spark, sf):
    return frame(spark, sf, "v_seeds").select("seed_id").orderBy("seed_id").limit(25)


DET = "d AS (SELECT model, dataset, variant, item_id, max(confidence) AS confidence FROM v_answers WHERE sample_kind = 'deterministic' GROUP BY 1, 2, 3, 4), g AS (SELECT model, dataset, variant, item_id, count(*) AS n, count(DISTINCT pred_modality) AS labels FROM v_answers WHERE sample_kind = 'stochastic' GROUP BY 1, 2, 3, 4)"
CELL = ["model", "dataset", "variant", "item_id"]


def det_and_groups(spark, sf):
    a = frame(spark, sf, "v_answers")
    det = a.where("sample_kind = 'deterministic'").groupBy(*CELL).agg(F.max("confidence").alias("confidence"))
    return det, a.where("sample_kind = 'stochastic'").groupBy(*CELL).agg(F.count("*").alias("n"), F.count_distinct("pred_modality").alias("labels"))


@query("stochastic_join", ctes("v_answers") + ", " + DET + " SELECT d.model, count(*) AS n, CAST(sum(g.n) AS BIGINT) AS samples, round(avg(confidence), 9) AS mean_confidence FROM d JOIN g USING (model, dataset, variant, item_id) GROUP BY 1")
def stochastic_join(spark, sf):
    det, groups = det_and_groups(spark, sf)
    return det.join(groups, CELL).groupBy("model").agg(F.count("*").alias("n"), F.sum("n").alias("samples"), r9(F.avg("confidence")).alias("mean_confidence"))


@query("agreement", ctes("v_answers") + ", " + DET + " SELECT d.model, count(*) AS n, count(*) FILTER (g.n IS NULL) AS n_incomplete_excluded, count(*) FILTER (labels = 1) AS n_unanimous, round(count(*) FILTER (labels = 1) / nullif(count(g.n), 0), 9) AS unanimity FROM d LEFT JOIN g USING (model, dataset, variant, item_id) GROUP BY 1")
def agreement(spark, sf):
    det, groups = det_and_groups(spark, sf)
    j = det.join(groups, CELL, "left")
    return j.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("n").isNull()).alias("n_incomplete_excluded"), F.count_if(F.col("labels") == 1).alias("n_unanimous"), r9(share(F.count_if(F.col("labels") == 1), F.count("n"))).alias("unanimity"))


@query("audit_join", ctes("v_answers") + ", s AS (SELECT model, item_id FROM v_answers WHERE pred_ordinal > ordinal GROUP BY 1, 2), t AS (SELECT DISTINCT model, item_id FROM v_answers WHERE task = 'task1') SELECT s.model, count(*) AS strict_n, count(t.item_id) AS joined_n, count(*) - count(t.item_id) AS unaudited_n FROM s LEFT JOIN t USING (model, item_id) GROUP BY 1")
def audit_join(spark, sf):
    a = frame(spark, sf, "v_answers")
    strict = a.where("pred_ordinal > ordinal").select("model", "item_id").distinct()
    audited = a.where("task = 'task1'").select("model", "item_id").distinct()
    hit = strict.join(audited, ["model", "item_id"]).groupBy("model").agg(F.count("*").alias("joined_n"))
    return strict.groupBy("model").agg(F.count("*").alias("strict_n")).join(hit, "model", "left").select("model", "strict_n", F.coalesce("joined_n", F.lit(0)).alias("joined_n"), (F.col("strict_n") - F.coalesce("joined_n", F.lit(0))).alias("unaudited_n"))


@query("external_probe", "WITH o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, quality FROM labels) SELECT count(*) AS n_gold, count(l.doc_id) AS n_answered, count(*) - count(l.doc_id) AS n_missing, (SELECT count(*) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_extra, round(avg(CAST(l.quality AS DOUBLE)), 9) AS mean_quality FROM documents d LEFT JOIN o l ON l.doc_id = d.doc_id")
def external_probe(spark, sf):
    """External output by id; a third of its ids are strange to the gold side, which then misses them."""
    docs, out = frame(spark, sf, "documents"), frame(spark, sf, "labels").withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))
    joined = docs.select("doc_id").join(out.select("doc_id", "quality"), "doc_id", "left")
    extra = out.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_extra"))
    g = joined.agg(F.count("*").alias("n_gold"), F.count("quality").alias("n_answered"), F.count_if(F.col("quality").isNull()).alias("n_missing"), r9(F.avg(F.col("quality").cast("double"))).alias("mean_quality"))
    return g.join(extra)


@query("plan_reconcile", ctes("v_items", "v_attempts") + " SELECT count(*) FILTER (p IS NOT NULL AND o IS NOT NULL) AS both_n, count(*) FILTER (o IS NULL) AS planned_only, count(*) FILTER (p IS NULL) AS observed_only FROM (SELECT DISTINCT item_id AS p FROM v_items) x FULL JOIN (SELECT DISTINCT item_id AS o FROM v_attempts) y ON p = o")
def plan_reconcile(spark, sf):
    p, o = frame(spark, sf, "v_items").select(F.col("item_id").alias("p")).distinct(), frame(spark, sf, "v_attempts").select(F.col("item_id").alias("o")).distinct()
    return p.join(o, F.col("p") == F.col("o"), "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("o").isNotNull()).alias("both_n"), F.count_if(F.col("o").isNull()).alias("planned_only"), F.count_if(F.col("p").isNull()).alias("observed_only"))


def arms(spark, sf):
    a = frame(spark, sf, "v_answers").withColumn("eligible", F.col("kind") != 7)
    key = ["model", "item_id"]
    return [a.where(F.col("variant") == v).select(*key, "eligible") for v in ("must", "shall")], key


ARMS = ctes("v_answers") + """, x AS (SELECT model, item_id, count(*) FILTER (variant = 'must') AS na, count(*) FILTER (variant = 'shall') AS nb, bool_and(kind <> 7) AS ok FROM v_answers GROUP BY 1, 2)
, c AS (SELECT *, CASE WHEN na > 1 OR nb > 1 THEN 'duplicate' WHEN na = 0 OR nb = 0 THEN 'unmatched' WHEN NOT ok THEN 'ineligible' ELSE 'matched' END AS pair_class FROM x)"""


@query("exact_pairs", ARMS + " SELECT pair_class, count(*) AS n FROM c GROUP BY 1")
def exact_pairs(spark, sf):
    (left, right), key = arms(spark, sf)
    return observe.exact_pairs(left, right, key).groupBy("pair_class").agg(F.count("*").alias("n"))


@query("source_resolve", ctes("v_items", "v_seeds") + " SELECT CASE n WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS resolution, count(*) AS items FROM (SELECT i.item_id, count(*) AS n FROM v_items i JOIN v_items j ON i.source_statement = j.source_statement AND i.source_modality = j.source_modality GROUP BY 1) GROUP BY 1")
def source_resolve(spark, sf):
    """Items by (statement, modality); exactly one source must match. Sources are counted first, so the join has one
    row an item however often a statement occurs; rows that share an item id are one item."""
    items, key = frame(spark, sf, "v_items"), ["source_statement", "source_modality"]
    n = items.groupBy(*key).agg(F.count("*").alias("n"))
    found = items.join(n, key).groupBy("item_id").agg(F.sum("n").alias("n"))
    return found.groupBy(F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("resolution")).agg(F.count("*").alias("items"))


def request_pairs(spark, sf):
    """(model, item_id, capability, left_request, right_request): items answered once in either arm, with the requests
    that they were decided in."""
    must = F.col("variant") == "must"
    g = frame(spark, sf, "v_answers").groupBy("model", "item_id", F.col("seed_id").alias("capability")).agg(F.count_if(must).alias("na"), F.count_if(~must).alias("nb"), F.max(F.when(must, F.col("request_id"))).alias("left_request"), F.max(F.when(~must, F.col("request_id"))).alias("right_request"))
    return g.where("na = 1 AND nb = 1").drop("na", "nb")


@query("request_components")
def request_components(spark, sf):
    return graph.request_clusters(request_pairs(spark, sf), "left_request", "right_request", "capability").select("model", "item_id", "cluster")


@query("reconcile", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1) SELECT count(*) FILTER (a.n IS NOT DISTINCT FROM b.n) AS equal_n, count(*) FILTER (a.n IS DISTINCT FROM b.n) AS differ_n FROM a FULL JOIN b ON a.k = b.k")
def reconcile(spark, sf):
    o = frame(spark, sf, "orders")
    a = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"))
    b = o.where("o_orderkey % 50 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full_outer").agg(F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal_n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ_n"))


@query("run_matrix", ctes("v_registry", "v_attempts") + " SELECT r.model, count(DISTINCT r.run_id) AS runs, CAST(sum(a.n) AS BIGINT) AS raw_rows FROM v_registry r JOIN (SELECT model, dataset, count(*) AS n FROM v_attempts GROUP BY 1, 2) a ON a.model = r.model AND a.dataset = r.dataset GROUP BY 1")
def run_matrix(spark, sf):
    a = frame(spark, sf, "v_attempts").groupBy("model", "dataset").agg(F.count("*").alias("n"))
    return frame(spark, sf, "v_registry").join(a, ["model", "dataset"]).groupBy("model").agg(F.count_distinct("run_id").alias("runs"), F.sum("n").alias("raw_rows"))


@query("id_set_diff", "SELECT 'missing' AS side, count(*) AS n, coalesce(min(item_id), -1) AS first_id FROM (SELECT item_id FROM benchmark WHERE item_id % 5 <> 1 EXCEPT SELECT item_id FROM benchmark WHERE item_id % 3 <> 0) UNION ALL SELECT 'extra', count(*), coalesce(min(item_id), -1) FROM (SELECT item_id FROM benchmark WHERE item_id % 3 <> 0 EXCEPT SELECT item_id FROM benchmark WHERE item_id % 5 <> 1)")
def id_set_diff(spark, sf):
    b = frame(spark, sf, "benchmark")
    d = observe.id_difference(b.where("item_id % 5 <> 1"), b.where("item_id % 3 <> 0"), "item_id")
    return d.groupBy("side").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"))


@query("scan_union", ctes("v_attempts") + " SELECT run_id, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM v_attempts GROUP BY 1")
def scan_union(spark, sf):
    """A compacted half and a tail with fewer columns are one log."""
    a = frame(spark, sf, "v_attempts")
    log = a.where("l_orderkey % 3 > 0").unionByName(a.where("l_orderkey % 3 = 0").drop("latency_s"), allowMissingColumns=True)
    return log.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("raw_projection", ctes("v_attempts") + " SELECT run_id, model, confidence, count(*) AS n FROM v_attempts WHERE run_id IN ('R1-0', 'R2-3') GROUP BY 1, 2, 3")
def raw_projection(spark, sf):
    wanted, known = ["run_id", "model", "confidence", "no_such_column"], frame(spark, sf, "v_attempts")
    cols = [c for c in wanted if c in known.columns]
    return known.where(F.col("run_id").isin("R1-0", "R2-3")).select(*cols).groupBy(*cols).agg(F.count("*").alias("n"))


@query("capped_sample", "SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('20260518:' || p_partkey), p_partkey) AS k FROM part) WHERE k <= 5 ORDER BY md5('20260518:' || p_partkey), p_partkey LIMIT 12")
def capped_sample(spark, sf):
    from modalith.operators.resample import capped

    h = F.md5(F.concat_ws(":", F.lit("20260518"), F.col("p_partkey").cast("string")))
    return capped(frame(spark, sf, "part").select("p_partkey", "p_type"), "p_type", [h, F.col("p_partkey")], 5, 12)


@query("balanced_sample", ctes("v_items") + " SELECT source_modality, item_id FROM (SELECT *, row_number() OVER (PARTITION BY source_modality ORDER BY md5(item_id), item_id) AS k FROM v_items) WHERE k <= 8")
def balanced_sample(spark, sf):
    w = Window.partitionBy("source_modality").orderBy(F.md5("item_id"), "item_id")
    return frame(spark, sf, "v_items").withColumn("k", F.row_number().over(w)).where("k <= 8").select("source_modality", "item_id")


@query("blind_ids", "SELECT printf('EXT%04d', row_number() OVER (ORDER BY md5('7:' || item_id), item_id)) AS external_item_id, item_id FROM benchmark")
def blind_ids(spark, sf):
    rows = frame(spark, sf, "benchmark").select("item_id", F.md5(F.concat_ws(":", F.lit("7"), F.col("item_id").cast("string"))).alias("h"))
    return total.row_number(rows, ["h", "item_id"], "k").select(F.format_string("EXT%04d", F.col("k")).alias("external_item_id"), "item_id")


JOBS = ctes("v_items") + ", j AS (SELECT item_id, seed_id, source_modality, task, s.x AS sample, row_number() OVER (ORDER BY task, item_id, s.x) AS request_index FROM v_items CROSS JOIN (VALUES ('task1'), ('task2')) AS t(task) CROSS JOIN (VALUES (0), (1), (2)) AS s(x))"


def jobs(spark, sf):
    """Items by tasks by one deterministic and two sampled answers, numbered in a stable order."""
    items = frame(spark, sf, "v_items").select("item_id", "seed_id", "source_modality")
    grid = items.withColumn("task", F.explode(F.array(F.lit("task1"), F.lit("task2")))).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return total.row_number(grid, ["task", "item_id", "sample"], "request_index")


@query("job_plan", JOBS + " SELECT item_id, task, CAST(sample AS INT) AS sample, request_index, 1000 + request_index AS request_seed FROM j")
def job_plan(spark, sf):
    return jobs(spark, sf).select("item_id", "task", "sample", "request_index", (F.col("request_index") + 1000).alias("request_seed"))


@query("batch_grouped", JOBS + " SELECT CAST(floor((request_index - 1) / 4) AS BIGINT) AS batch, count(*) AS n, count(DISTINCT seed_id) AS seeds FROM j GROUP BY 1")
def batch_grouped(spark, sf):
    return jobs(spark, sf).groupBy(F.floor((F.col("request_index") - 1) / 4).alias("batch")).agg(F.count("*").alias("n"), F.count_distinct("seed_id").alias("seeds"))


SEPARATED = ctes("v_items") + """, i AS (SELECT item_id, seed_id, source_modality, ordinal, row_number() OVER (PARTITION BY seed_id ORDER BY ordinal DESC) - 1 AS m, dense_rank() OVER (ORDER BY md5(seed_id), seed_id) - 1 AS s FROM v_items)
, b AS (SELECT *, row_number() OVER (ORDER BY (m + s) % 4, s) - 1 AS pos FROM i), x AS (SELECT *, CAST(floor(pos / 4) AS BIGINT) AS batch FROM b)"""


def separated(spark, sf):
    """Batches in which no seed occurs twice: items sorted by rotated variant and then seed, cut into runs of four. The
    variant is the item's place in its seed, which may hold more than four items: seed ids repeat from a million parts on."""
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("ordinal"))) - 1
    items = frame(spark, sf, "v_items").select("item_id", "seed_id", "ordinal").withColumn("m", place)
    seeds = total.row_number(items.select("seed_id").distinct().withColumn("h", F.md5("seed_id")), ["h", "seed_id"], "s")
    turned = items.join(seeds.select("seed_id", F.col("s") - 1), "seed_id").toDF("seed_id", "item_id", "ordinal", "m", "s").withColumn("turn", (F.col("m") + F.col("s")) % 4)
    return total.row_number(turned, ["turn", "s", "m"], "pos").withColumn("batch", F.floor((F.col("pos") - 1) / 4))


@query("batch_separated", SEPARATED + " SELECT batch, count(*) AS n, count(DISTINCT seed_id) AS seeds, min(item_id) AS first_item FROM x GROUP BY 1")
def batch_separated(spark, sf):
    return separated(spark, sf).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("seed_id").alias("seeds"), F.min("item_id").alias("first_item"))


@query("batch_resume", SEPARATED + ", done AS (SELECT DISTINCT 'S' || lpad(CAST(l_partkey AS STRING), 6, '0') || '_' || CASE l_linenumber % 4 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'recommended' WHEN 2 THEN 'optional' ELSE 'nice_to_have' END AS item_id FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 = 0) SELECT batch, count(*) AS pending FROM x WHERE item_id NOT IN (SELECT item_id FROM done) GROUP BY 1")
def batch_resume(spark, sf):
    """Pending items keep the batch they were planned in: batches are cut before finished items are taken out."""
    done = frame(spark, sf, "v_attempts").where("l_returnflag = 'A' AND l_suppkey % 3 = 0").select("item_id")
    return separated(spark, sf).join(done, "item_id", "left_anti").groupBy("batch").agg(F.count("*").alias("pending"))


@query("batch_fallback", JOBS + ", r AS (SELECT request_index FROM j WHERE request_index % 7 <> 0 UNION ALL SELECT request_index FROM j WHERE request_index % 11 = 0 UNION ALL SELECT request_index + 1000000 FROM j WHERE request_index % 13 = 0) SELECT count(*) FILTER (n = 1) AS accepted, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n > 1) AS duplicate, (SELECT count(*) FROM r WHERE request_index NOT IN (SELECT request_index FROM j)) AS unknown FROM (SELECT j.request_index, count(r.request_index) AS n FROM j LEFT JOIN r USING (request_index) GROUP BY 1)")
def batch_fallback(spark, sf):
    """Answers of a batch go by request index, never by place; a missing or repeated index is fetched again."""
    j = jobs(spark, sf).select("request_index")
    r = j.where("request_index % 7 <> 0").union(j.where("request_index % 11 = 0")).union(j.where("request_index % 13 = 0").select(F.col("request_index") + 1000000))
    both = j.select("request_index", F.lit(1).alias("planned"), F.lit(0).alias("n")).union(r.select("request_index", F.lit(0), F.lit(1)))
    tasks = total.ranges(spark, 2 * (j.agg(F.max("request_index")).first()[0] or 0))
    each = both.repartition(tasks, "request_index").groupBy("request_index").agg(F.max("planned").alias("planned"), F.sum("n").alias("n"))
    known = lambda x: F.count_if((F.col("planned") == 1) & x)
    return each.agg(known(F.col("n") == 1).alias("accepted"), known(F.col("n") == 0).alias("missing"), known(F.col("n") > 1).alias("duplicate"), F.coalesce(F.sum(F.when(F.col("planned") == 0, F.col("n"))), F.lit(0)).alias("unknown"))


@query("arm_grid", "SELECT 'b' || s || '-' || o AS arm, s AS batch_size, o AS batch_order FROM (VALUES (1), (4), (8)) AS a(s) CROSS JOIN (VALUES ('grouped'), ('separated')) AS b(o) WHERE NOT (s = 1 AND o = 'separated')")
def arm_grid(spark, sf):
    sizes, orders = spark.createDataFrame([(1,), (4,), (8,)], "batch_size int"), spark.createDataFrame([("grouped",), ("separated",)], "batch_order string")
    grid = sizes.crossJoin(orders).where("NOT (batch_size = 1 AND batch_order = 'separated')")
    return grid.select(F.concat(F.lit("b"), F.col("batch_size"), F.lit("-"), F.col("batch_order")).alias("arm"), "batch_size", "batch_order")


@query("run_progress", ctes("v_items", "v_attempts") + " SELECT a.model, count(DISTINCT a.item_id) AS observed_items, (SELECT count(*) FROM v_items) AS planned_items, round(count(DISTINCT a.item_id) / (SELECT count(*) FROM v_items), 9) AS coverage FROM v_attempts a WHERE a.status = 'ok' AND a.item_id IN (SELECT item_id FROM v_items) GROUP BY 1")
def run_progress(spark, sf):
    items = frame(spark, sf, "v_items").select("item_id")
    seen = frame(spark, sf, "v_attempts").where("status = 'ok'").select("model", "item_id").distinct().join(items, "item_id", "left_semi")
    n = items.agg(F.count("*").alias("planned_items"))
    return seen.groupBy("model").agg(F.count("*").alias("observed_items")).join(n).select("model", "observed_items", "planned_items", r9(F.col("observed_items") / F.col("planned_items")).alias("coverage"))


@query("run_quality", ctes("v_attempts") + ", q AS (SELECT model, request_id, max(latency_s) AS latency, max(retries) AS retries FROM v_attempts GROUP BY 1, 2), st AS (SELECT model, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'truncated') AS n_truncated, count(*) FILTER (status NOT IN ('ok', 'truncated')) AS n_other FROM v_attempts GROUP BY 1) SELECT q.model, count(*) AS requests, CAST(sum(retries) AS BIGINT) AS retries, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, any_value(n_ok) AS n_ok, any_value(n_truncated) AS n_truncated, any_value(n_other) AS n_other FROM q JOIN st ON st.model = q.model GROUP BY 1")
def run_quality(spark, sf):
    """A batched request counts once, however many items it holds; percentiles are nearest rank."""
    a = frame(spark, sf, "v_attempts")
    q = a.groupBy("model", "request_id").agg(F.max("latency_s").alias("latency"), F.max("retries").alias("retries"))
    per = q.groupBy("model").agg(F.count("*").alias("requests"), F.sum("retries").alias("retries"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95"))
    st = a.groupBy("model").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "truncated").alias("n_truncated"), F.count_if(~F.col("status").isin("ok", "truncated")).alias("n_other"))
    return per.join(st, "model")


@query("status_histogram", ctes("v_attempts") + " SELECT status, count(*) AS n FROM v_attempts GROUP BY 1")
def status_histogram(spark, sf):
    return frame(spark, sf, "v_attempts").groupBy("status").agg(F.count("*").alias("n"))


@query("parse_gate", OBS + " SELECT model, count(*) AS n, round(count(*) FILTER (status <> 'ok') / count(*), 9) AS failure_rate, count(*) FILTER (status <> 'ok') > 0.02::DOUBLE * count(*) AS fails FROM obs GROUP BY 1")
def parse_gate(spark, sf):
    bad = F.avg(flag(F.col("status") != "ok").cast("double"))
    return observations(spark, sf).groupBy("model").agg(F.count("*").alias("n"), r9(bad).alias("failure_rate"), (bad > 0.02).alias("fails"))


@query("review_gate", "SELECT c_mktsegment AS template_id, count(DISTINCT c_nationkey) AS reviewers, bool_and(c_acctbal > -900) AS all_yes, count(DISTINCT c_nationkey) >= 2 AND bool_and(c_acctbal > -900) AS passes FROM customer GROUP BY 1")
def review_gate(spark, sf):
    yes = F.bool_and(F.col("c_acctbal") > -900)
    return frame(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("template_id")).agg(F.count_distinct("c_nationkey").alias("reviewers"), yes.alias("all_yes"), ((F.count_distinct("c_nationkey") >= 2) & yes).alias("passes"))


@query("grid_check", ctes("v_attempts") + " SELECT count(*) AS n_cells, count(DISTINCT model) * count(DISTINCT dataset) * count(DISTINCT variant) AS n_expected, count(*) = count(DISTINCT model) * count(DISTINCT dataset) * count(DISTINCT variant) AS complete FROM (SELECT DISTINCT model, dataset, variant FROM v_attempts)")
def grid_check(spark, sf):
    cells = frame(spark, sf, "v_attempts").select("model", "dataset", "variant").distinct()
    expected = F.count_distinct("model") * F.count_distinct("dataset") * F.count_distinct("variant")
    return cells.agg(F.count("*").alias("n_cells"), expected.alias("n_expected"), (F.count("*") == expected).alias("complete"))


@query("dedupe_embed", ctes("v_answers") + " SELECT source_modality, count(*) AS n, count(DISTINCT requirement) AS texts FROM v_answers GROUP BY 1")
def dedupe_embed(spark, sf):
    """Distinct texts get a key once and are joined back: what is costly runs on them only."""
    a = frame(spark, sf, "v_answers")
    keyed = a.select("requirement").distinct().withColumn("text_key", F.xxhash64("requirement"))
    return a.join(keyed, "requirement").groupBy("source_modality").agg(F.count("*").alias("n"), F.count_distinct("text_key").alias("texts"))


@query("macro_format", ctes("v_answers") + " SELECT model, printf('%.1f', 100.0 * count(*) FILTER (decision = 'yes') / count(*)) || '%' AS percent, CAST(count(*) AS STRING) AS total FROM v_answers GROUP BY 1")
def macro_format(spark, sf):
    p = F.count_if(F.col("decision") == "yes") * 100.0 / F.count("*")
    return frame(spark, sf, "v_answers").groupBy("model").agg(F.format_string("%.1f%%", p.cast("double")).alias("percent"), F.count("*").cast("string").alias("total"))


