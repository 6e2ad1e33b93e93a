"""Embedding analytics, probes, stream variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalith.functions.stats import r9
from modalith.operators import metrics, probes, resample, vectors
from modalith.plans.metric_queries import DRAWS, SEED
from modalith.plans.registry import query
from modalith.sources.session import checkpoint
from modalith.sources.views import ctes, frame
from modalith.streaming import log

DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _norm(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))"


@query("pairwise_cosine", ctes("v_vectors") + f" SELECT a.item, count(*) AS pairs, round(avg(1 - {DOT} / ({_norm('a')} * {_norm('b')})), 9) AS mean_distance FROM v_vectors a JOIN v_vectors b ON a.item = b.item AND a.vec_id < b.vec_id GROUP BY 1")
def pairwise_cosine(spark, sf):
    d = vectors.pair_distances(frame(spark, sf, "v_vectors"), "item", "vec_id", "embedding")
    return d.groupBy("item").agg(F.count("*").alias("pairs"), r9(F.avg("distance")).alias("mean_distance"))


@query("semantic_clusters")
def semantic_clusters(spark, sf):
    return vectors.semantic_clusters(frame(spark, sf, "v_vectors")).withColumn("semantic_uncertainty_score", vectors.semantic_score())


@query("semantic_grid")
def semantic_grid(spark, sf):
    """Scores for a grid of thresholds and weights from one distance matrix an item."""
    c = vectors.semantic_clusters(frame(spark, sf, "v_vectors"), vectors.THRESHOLDS)
    grid = c.withColumn("weight", F.explode(F.array(*(F.lit(w) for w in vectors.WEIGHTS))))
    return grid.groupBy("threshold", "weight").agg(F.count("*").alias("items"), r9(F.avg(vectors.semantic_score(F.col("weight")))).alias("mean_score"))


@query("sensitivity_grid", ctes("v_scored") + ", g AS (SELECT t.q AS setting, quality, CASE WHEN t.q = 1 THEN n_chars ELSE n_chars % (t.q * 100) END AS s FROM v_scored, (VALUES (1), (2), (3)) AS t(q)), r AS (SELECT setting, quality AS y, rank() OVER (PARTITION BY setting ORDER BY s) + (count(*) OVER (PARTITION BY setting, s) - 1) / 2.0::DOUBLE AS k FROM g), x AS (SELECT setting, (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auroc FROM r GROUP BY 1) SELECT CAST(setting AS INT) AS setting, round(auroc, 9) AS auroc, round(auroc - (SELECT auroc FROM x WHERE setting = 1), 9) + 0.0 AS delta FROM x")
def sensitivity_grid(spark, sf):
    """AUROC for each setting and its difference from the reference setting."""
    rows = frame(spark, sf, "v_scored").withColumn("setting", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    score = F.when(F.col("setting") == 1, F.col("n_chars")).otherwise(F.col("n_chars") % (F.col("setting") * 100))
    m = metrics.auroc(rows, ["setting"], F.col("quality"), score)
    ref = m.where("setting = 1").select(F.col("auroc").alias("ref"))
    return m.join(F.broadcast(ref)).select("setting", r9("auroc").alias("auroc"), r9(F.col("auroc") - F.col("ref")).alias("delta"))  # one row of reference


@query("centroids", ctes("v_vectors") + ", e AS (SELECT item, unnest(range(1, 65)) AS k, unnest(embedding) AS x FROM v_vectors), m AS (SELECT item, k, round(avg(CAST(x AS DOUBLE)), 9) + 0.0 AS m, count(*) AS n FROM e GROUP BY 1, 2) SELECT item, max(n) AS n, round(list_sum(list(m)), 6) AS total, max(m) FILTER (k = 1) AS first FROM m GROUP BY 1")
def centroids(spark, sf):
    c = vectors.centroids(frame(spark, sf, "v_vectors"), "item", "embedding")
    return c.select("item", "n", (F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"), F.col("centroid")[0].alias("first"))


@query("probe_labels", ctes("v_vectors") + " SELECT label, count(*) AS n, count(DISTINCT item) AS groups FROM v_vectors GROUP BY 1")
def probe_labels(spark, sf):
    return frame(spark, sf, "v_vectors").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("item").alias("groups"))


@query("probe_eligible", ctes("v_vectors") + ", l AS (SELECT label FROM v_vectors GROUP BY 1 HAVING count(DISTINCT item) >= 3) SELECT scope, count(*) AS n FROM (SELECT 'global' AS scope, vec_id FROM v_vectors WHERE label IN (SELECT label FROM l) UNION ALL SELECT 'label=3', vec_id FROM v_vectors WHERE label = 3) GROUP BY 1")
def probe_eligible(spark, sf):
    """Observations whose class has groups enough for folds, in the scopes `global` and `column=value`."""
    v = frame(spark, sf, "v_vectors")
    fit = v.groupBy("label").agg(F.count_distinct("item").alias("g")).where("g >= 3").select("label")
    whole = v.join(fit, "label", "left_semi").select(F.lit("global").alias("scope"))
    return whole.union(v.where("label = 3").select(F.lit("label=3").alias("scope"))).groupBy("scope").agg(F.count("*").alias("n"))


FOLD = "('0x' || substr(md5('0:' || item), 1, 8))::BIGINT % 3"


@query("group_folds", ctes("v_vectors") + f" SELECT {FOLD} AS fold, count(*) AS n, count(DISTINCT item) AS groups, 0::BIGINT AS split_groups FROM v_vectors GROUP BY 1")
def group_folds(spark, sf):
    v = frame(spark, sf, "v_vectors").withColumn("fold", vectors.group_fold(F.col("item"), 3))
    split = v.groupBy("item").agg(F.count_distinct("fold").alias("k")).where("k > 1").agg(F.count("*").alias("split_groups"))
    return v.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("item").alias("groups")).join(split)


@query("ovr_auroc", ctes("v_vectors") + ", r AS (SELECT c.k AS class, CASE WHEN label = c.k THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY c.k ORDER BY embedding[c.k + 1]) + (count(*) OVER (PARTITION BY c.k, embedding[c.k + 1]) - 1) / 2.0::DOUBLE AS q FROM v_vectors, (SELECT unnest(range(0, 10)) AS k) c), a AS (SELECT class, (sum(q) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auroc FROM r GROUP BY 1) SELECT count(auroc) AS classes, round(avg(auroc), 9) AS macro_auroc FROM a")
def ovr_auroc(spark, sf):
    rows = frame(spark, sf, "v_vectors").withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(9))))
    a = metrics.auroc(rows, ["class"], F.col("label") == F.col("class"), F.element_at("embedding", F.col("class") + 1))
    return a.agg(F.count("auroc").alias("classes"), r9(F.avg("auroc")).alias("macro_auroc"))


@query("avg_precision", ctes("v_scored") + ", b AS (SELECT lang, n_chars, sum(quality) AS pos, count(*) AS n FROM v_scored GROUP BY 1, 2), r AS (SELECT lang, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM b WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC)) SELECT lang, round(sum(pos * cp / cn) / sum(pos), 9) AS avg_precision FROM r GROUP BY 1")
def avg_precision(spark, sf):
    m = metrics.average_precision(frame(spark, sf, "v_scored"), ["lang"], F.col("quality"), F.col("n_chars"))
    return m.select("lang", r9("avg_precision").alias("avg_precision"))


@query("vector_union", ctes("v_vectors") + " SELECT len(embedding) AS width, count(*) AS n, count(DISTINCT vec_id % 3) AS runs FROM v_vectors GROUP BY 1")
def vector_union(spark, sf):
    """Runs stacked in one space; more than one width is an error of the caller's, shown as more than one row."""
    v = frame(spark, sf, "v_vectors")
    runs = [v.where(F.col("vec_id") % 3 == k).withColumn("run", F.lit(k)) for k in range(3)]
    stacked = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return stacked.groupBy(F.size("embedding").cast("long").alias("width")).agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"))


@query("char_ngrams", "WITH w AS (SELECT p_partkey, ' ' || unnest(string_split(lower(p_name), ' ')) || ' ' AS w FROM part), g AS (SELECT substr(w, CAST(i AS INT), CAST(n AS INT)) AS gram FROM w, (SELECT unnest(range(3, 6)) AS n) s, (SELECT unnest(range(1, 40)) AS i) p WHERE i + n - 1 <= length(w)) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def char_ngrams(spark, sf):
    g = frame(spark, sf, "part").select(F.explode(vectors.char_ngrams(F.col("p_name"))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


@query("tfidf_weights", """WITH w AS (SELECT p_partkey, ' ' || unnest(string_split(lower(p_name), ' ')) || ' ' AS w FROM part), g AS (SELECT p_partkey, substr(w, CAST(i AS INT), CAST(n AS INT)) AS gram, count(*) AS tf FROM w, (SELECT unnest(range(3, 6)) AS n) s, (SELECT unnest(range(1, 40)) AS i) p WHERE i + n - 1 <= length(w) GROUP BY 1, 2),
d AS (SELECT gram, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY 1), r AS (SELECT p_partkey, gram, tf * idf AS raw FROM g JOIN d USING (gram)), q AS (SELECT p_partkey, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY 1) SELECT p_partkey, count(*) AS grams, round(sum(raw / norm), 8) AS total, round(max(raw / norm), 8) AS top FROM r JOIN q USING (p_partkey) GROUP BY 1""")
def tfidf_weights(spark, sf):
    w = vectors.tfidf(frame(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")
    return w.groupBy("p_partkey").agg(F.count("*").alias("grams"), F.round(F.sum("weight"), 8).alias("total"), F.round(F.max("weight"), 8).alias("top"))


def boot_sql(rows: str, keys: str) -> str:
    """The bootstrap of AUROCs for the oracle, over a table (keys, c, y, score, s)."""
    return f""", sl AS ({rows}), k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS m FROM (SELECT DISTINCT {keys}, c FROM sl)), z AS (SELECT DISTINCT {keys}, m FROM k),
w AS (SELECT {keys}, b, i, count(*) AS w FROM (SELECT {keys}, b.range AS b, ('0x' || substr(md5('{SEED}:' || b.range || ':' || unnest(range(m))), 1, 8))::BIGINT % m AS i FROM z, range({DRAWS}) b) GROUP BY ALL),
t AS (SELECT {keys}, score, b, s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM sl JOIN k USING ({keys}, c) JOIN w USING ({keys}, i) GROUP BY ALL),
u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys}, score, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM t),
v AS (SELECT {keys}, score, b, sum(pos * (under + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM u GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0)"""


BOOT_SCORES = "SELECT lang, source AS c, quality AS y, 'length' AS score, CAST(n_chars AS DOUBLE) AS s FROM v_scored UNION ALL SELECT lang, source, quality, 'p', p FROM v_scored UNION ALL SELECT lang, source, quality, 'chars', length(source) FROM v_scored"


@query("auroc_bootstrap", ctes("v_scored") + boot_sql(BOOT_SCORES, "lang") + " SELECT lang, score, count(*) AS draws, round(quantile_cont(auroc, 0.025), 9) AS lo, round(quantile_cont(auroc, 0.975), 9) AS hi FROM v GROUP BY 1, 2")
def auroc_bootstrap(spark, sf):
    b = resample.bootstrap_auroc(frame(spark, sf, "v_scored"), ["lang"], "source", F.col("quality"), {"length": F.col("n_chars"), "p": F.col("p"), "chars": F.char_length("source")}, DRAWS, SEED)
    return b.groupBy("lang", "score").agg(F.count("*").alias("draws"), r9(F.percentile("auroc", F.lit(0.025))).alias("lo"), r9(F.percentile("auroc", F.lit(0.975))).alias("hi"))


def semantic_scores(spark, sf):
    """(slice, item, y, s_<threshold>_<weight>...) of items under all thirty settings, from one distance matrix an item."""
    c = vectors.semantic_clusters(frame(spark, sf, "v_vectors"), vectors.THRESHOLDS)
    values = [F.max(F.when(F.col("threshold") == t, vectors.semantic_score(w))).alias(setting(t, w)) for t in vectors.THRESHOLDS for w in vectors.WEIGHTS]
    labels = frame(spark, sf, "v_vectors").groupBy("item").agg((F.avg("label") < 4.5).cast("int").alias("y"))
    wide = c.groupBy("item").agg(*values).join(labels, "item")
    slices = F.filter(F.array(F.lit("all"), F.when(F.col("item") % 2 == 0, "even")), lambda x: x.isNotNull())
    return wide.withColumn("slice", F.explode(slices))


def setting(threshold: float, weight: float) -> str:
    return f"s_{round(threshold * 100)}_{round(weight * 100)}"


@query("sensitivity_run")
def sensitivity_run(spark, sf):
    """Thirty settings by slice: AUROC, its interval over items, the difference from the reference setting under the same
    draws, and whether the reference's own score comes out again."""
    rows = checkpoint(semantic_scores(spark, sf))
    names = {setting(t, w): (t, w) for t in vectors.THRESHOLDS for w in vectors.WEIGHTS}
    ref = setting(vectors.DISTANCE_THRESHOLD, vectors.DISPERSION_WEIGHT)
    long = rows.select("slice", "item", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("score"), F.col(k).alias("s")) for k in names))).alias("x")).select("slice", "item", "y", "x.*")
    point = metrics.auroc(long, ["slice", "score"], F.col("y"), F.col("s")).select("slice", "score", "auroc", "n")
    b = checkpoint(resample.bootstrap_auroc(rows, ["slice"], "item", F.col("y"), {k: F.col(k) for k in names}, DRAWS, SEED))
    base = lambda df, key: df.where(F.col("score") == ref).select(*key, F.col("auroc").alias("ref"))
    deltas = b.join(base(b, ["slice", "b"]), ["slice", "b"])
    ends = [r9(F.percentile(x, F.lit(q))).alias(k) for x, name in ((F.col("auroc"), "auroc"), (F.col("auroc") - F.col("ref"), "delta")) for q, k in ((0.025, f"{name}_lo"), (0.975, f"{name}_hi"))]
    ci = deltas.groupBy("slice", "score").agg(F.count("*").alias("draws"), *ends)
    own = vectors.semantic_clusters(frame(spark, sf, "v_vectors")).select("item", vectors.semantic_score().alias("own"))
    same = rows.join(own, "item").groupBy("slice").agg((F.max(F.abs(F.col(ref) - F.col("own"))) < 1e-12).alias("reproduced"))
    out = point.join(base(point, ["slice"]), "slice").join(ci, ["slice", "score"], "left").join(same, "slice")
    grid = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, list(v))])[F.col("score")]
    return out.select("slice", grid[0].alias("threshold"), grid[1].alias("weight"), "n", r9("auroc").alias("auroc"), r9(F.col("auroc") - F.col("ref")).alias("delta"), "draws", *(f"{x}_{e}" for x in ("auroc", "delta") for e in ("lo", "hi")), "reproduced")


def probe_rows(spark, sf):
    return frame(spark, sf, "v_vectors").withColumn("fold", vectors.group_fold(F.col("item"), probes.FOLDS))


def held_out(spark, sf):
    return probes.held_out(probe_rows(spark, sf), F.col("label") < 5, "fold", "item", vector="embedding")


@query("held_out_predictions")
def held_out_predictions(spark, sf):
    """Predictions of the logistic probe, each by a model that saw none of its group."""
    return held_out(spark, sf).select("vec_id", "item", "fold", "target", "prediction", F.transform("probabilities", lambda p: F.round(p, 6)).alias("probabilities"))


@query("probe_summary")
def probe_summary(spark, sf):
    """Folds' AUROC, their mean and deviation, and an interval over groups: in each draw the folds' AUROCs, drawn within
    the fold, count alike; a draw without all folds is undefined, and with under nine tenths defined there is none."""
    p = checkpoint(held_out(spark, sf).select("item", "fold", "target", F.element_at("probabilities", 2).alias("score")))
    folds = metrics.auroc(p, ["fold"], F.col("target"), F.col("score"))
    mean = folds.agg(F.count("*").alias("folds"), F.avg("auroc").alias("mean_auroc"), F.stddev_samp("auroc").alias("sd_auroc"))
    b = resample.bootstrap_auroc(p, ["fold"], "item", F.col("target"), {"probability": F.col("score")}, DRAWS, SEED)
    each = b.groupBy("b").agg(F.avg("auroc").alias("auroc"), F.count("*").alias("k")).where(F.col("k") == probes.FOLDS)
    ok = probes.enough(F.count("*"), DRAWS)
    ci = each.agg(F.count("*").alias("draws"), *(F.when(ok, F.percentile("auroc", F.lit(q))).alias(k) for q, k in ((0.025, "lo"), (0.975, "hi"))))
    return mean.join(ci)


@query("boosted_probe")
def boosted_probe(spark, sf):
    """The boosted probe with its budget chosen inside each training fold. Each tree is a chain of Spark jobs, so the
    registered query chooses among few trees; the operator's default budget is 300."""
    p = probes.held_out(probe_rows(spark, sf), F.col("label") < 5, "fold", "item", vector="embedding", kind="boosted", budgets=(2, 6))
    m = metrics.auroc(checkpoint(p.select("fold", "target", "budget", F.element_at("probabilities", 2).alias("s"))), ["fold", "budget"], F.col("target"), F.col("s"))
    return m.select("fold", "budget", "n", r9("auroc").alias("auroc"))


@query("text_probe")
def text_probe(spark, sf):
    """Part names told by their types' first letters, from hashed character n-grams whose weights are fitted in the fold."""
    rows = frame(spark, sf, "part").select("p_partkey", "p_name", "p_type").withColumn("fold", vectors.group_fold(F.col("p_name"), probes.FOLDS))
    p = probes.held_out(rows, F.col("p_name").contains("widget"), "fold", "p_name", text="p_name", components=16)
    return metrics.auroc(checkpoint(p.select("fold", "target", F.element_at("probabilities", 2).alias("s"))), ["fold"], F.col("target"), F.col("s")).select("fold", "n", r9("auroc").alias("auroc"))


@query("pca_projection")
def pca_projection(spark, sf):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = frame(spark, sf, "v_vectors").withColumn("x", array_to_vector(vectors.doubles(F.col("embedding"))))
    model = PCA(k=2, inputCol="x", outputCol="xy").fit(v)
    return model.transform(v).select("vec_id", "label", *(F.round(F.abs(vector_to_array("xy")[k]), 6).alias(f"abs_{c}") for k, c in enumerate("xy")))


@query("stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream(spark, sf):
    return log.run_counts(log.read_log(spark, sf, "events.parquet", frame(spark, sf, "events").schema), ["event_type"])


@query("stream_dedupe", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_dedupe(spark, sf):
    """Late rows supersede: the latest row of each key, kept up to date batch by batch."""
    rows = log.upsert_latest(log.read_log(spark, sf, "events.parquet", frame(spark, sf, "events").schema), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_id", "event_type", "value")


