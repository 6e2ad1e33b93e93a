"""What is written and read again: CSV, JSON lines, raw tables, compaction, score files, caches, report artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.functions.stats import r9
from modalith.operators import vectors
from modalith.plans.registry import query
from modalith.sources import artifacts, log_store, sinks
from modalith.sources.session import new_folder
from modalith.sources.views import ctes, frame

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@query("csv_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_round_trip(spark, sf):
    """Columns in their pinned order, all text when read."""
    path = new_folder(spark, "csv")
    sinks.write_csv(frame(spark, sf, "nation"), path, ["n_name", "n_nationkey"])
    return log_store.read_csv(spark, path, ["n_name", "n_nationkey"])


def event_lines(spark, sf, bad: bool):
    """Events as lines of JSON; every fiftieth is none if bad."""
    body = F.to_json(F.struct("event_id", "event_type", "value"))
    return frame(spark, sf, "events").select(F.when((F.col("event_id") % 50 == 0) & F.lit(bad), F.concat(F.lit("lost "), F.col("event_id"))).otherwise(body).alias("value"))


@query("jsonl_tolerant", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY 1 UNION ALL SELECT 'bad lines', count(*) FROM events WHERE event_id % 50 = 0")
def jsonl_tolerant(spark, sf):
    path = new_folder(spark, "jsonl")
    event_lines(spark, sf, True).write.text(path)
    rows, bad = log_store.read_jsonl(spark, path, EVENT)
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).union(bad.agg(F.lit("bad lines"), F.count("*")))


@query("jsonl_append", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def jsonl_append(spark, sf):
    """Two writers append to one log; each task's file is its own."""
    path, rows = new_folder(spark, "jsonl"), frame(spark, sf, "events").select("event_id", "event_type", "value")
    sinks.append(rows, path)
    sinks.append(rows, path)
    return log_store.read_jsonl(spark, path, EVENT)[0].groupBy("event_type").agg(F.count("*").alias("n"))


@query("prefilter_scan", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE event_type = 'click' GROUP BY 1")
def prefilter_scan(spark, sf):
    path = new_folder(spark, "jsonl")
    event_lines(spark, sf, False).write.text(path)
    rows = artifacts.prefiltered(spark, path, '"event_type":"click"', EVENT)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 6) + F.lit(0.0)).alias("total"))


@query("raw_table", "SELECT count(*) AS n, count(*) AS n_equal, count(*) FILTER (event_id % 3 = 0) AS n_null, count(*) FILTER (event_id % 3 = 1) AS n_absent, count(*) FILTER (event_id % 7 = 0) AS n_extra FROM events")
def raw_table(spark, sf):
    """Rows to a table and back: a null field stays null, an absent one absent, an unknown one is kept."""
    path, kind = new_folder(spark, "raw"), F.col("event_id") % 3
    pair = F.when(kind == 0, F.lit(',"event_type":null')).when(kind == 1, F.lit("")).otherwise(F.concat(F.lit(',"event_type":"'), "event_type", F.lit('"')))
    known = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), pair)
    rows = frame(spark, sf, "events").select(F.concat(known, F.lit("}")).alias("known"), F.concat(known, F.when(F.col("event_id") % 7 == 0, F.lit(',"odd":1}')).otherwise(F.lit("}"))).alias("body"))
    schema = T.StructType(EVENT.fields[:2])
    artifacts.rows_to_table(rows, "body", schema).write.parquet(path)
    table = spark.read.parquet(path)
    back = artifacts.table_to_rows(table, schema)
    same = back.join(rows.select(F.col("known").alias("body")), "body", "left_semi").agg(F.count("*").alias("n_equal"))
    absent = ~F.array_contains(artifacts.PRESENT, "event_type")
    counts = table.agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isNull() & ~absent).alias("n_null"), F.count_if(absent).alias("n_absent"), F.count("_extra").alias("n_extra"))
    return counts.join(same)


@query("compaction", "SELECT count(*) AS n, count(DISTINCT event_id) AS events, 0::BIGINT AS left_in_tail FROM events")
def compaction(spark, sf):
    tail, path = new_folder(spark, "tail"), new_folder(spark, "compacted")
    event_lines(spark, sf, False).write.text(tail)
    artifacts.compact_tail(spark, tail, path, EVENT)
    left = spark.read.text(tail).agg(F.count("*").alias("left_in_tail"))
    return log_store.read_log(spark, path, None, EVENT).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events")).join(left)


@query("two_trees", "SELECT CAST(event_id % 2 AS INT) AS tree, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def two_trees(spark, sf):
    """A full tree and a smoke tree, each row with the number of its own."""
    folder, rows = new_folder(spark, "trees"), frame(spark, sf, "events")
    for k, tree in enumerate(("full", "smoke")):
        rows.where(F.col("event_id") % 2 == k).write.parquet(f"{folder}/{tree}")
    read = log_store.read_trees(spark, [f"{folder}/full", f"{folder}/smoke", f"{folder}/absent"], log_store.read_parquet)
    return read.groupBy("tree", "event_type").agg(F.count("*").alias("n"))


@query("score_files", "SELECT 'm' || (user_id % 3) AS model, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def score_files(spark, sf):
    """Three runs' score files, all of one name, tagged by the manifest."""
    folder, rows = new_folder(spark, "scores"), frame(spark, sf, "events")
    for k in range(3):
        sinks.write_csv(rows.where(F.col("user_id") % 3 == k), f"{folder}/run{k}/uq_scores.csv", ["event_id", "value"])
    manifest = spark.createDataFrame([(f"{folder}/run{k}/uq_scores.csv", f"m{k}") for k in range(3)], "path string, model string")
    scores = log_store.read_scores(spark, manifest, ["event_id", "value"])
    return scores.groupBy("model").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("value").cast("double")), 6) + F.lit(0.0)).alias("total"))


def vector_samples(spark, sf):
    v = frame(spark, sf, "v_vectors")
    return v.select(F.col("vec_id").alias("embedding_index"), F.col("item").alias("item_id"), (F.col("vec_id") % 5).alias("sample_index"), F.lit("r1").alias("run_id"), F.lit("mlx:small").alias("backend"), "embedding")


@query("embedding_cache", ctes("v_vectors") + " SELECT item AS item_id, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 9) + 0.0 AS total FROM v_vectors GROUP BY 1")
def embedding_cache(spark, sf):
    path, rows = new_folder(spark, "cache"), vector_samples(spark, sf)
    rows.select("embedding_index", "item_id", "backend", "embedding").write.parquet(path)
    found = artifacts.read_embeddings(rows.select("embedding_index", "item_id", "sample_index", "run_id"), spark.read.parquet(path), "r1", "mlx:small")
    return found.groupBy("item_id").agg(F.count("*").alias("n"), r9(F.sum(F.element_at("embedding", 1).cast("double"))).alias("total"))


@query("semantic_cache", ctes("v_vectors") + " SELECT count(DISTINCT item) AS items, true AS reused, true AS equal FROM v_vectors")
def semantic_cache(spark, sf):
    """The second build of the same samples reads the first one's tables."""
    folder, rows = new_folder(spark, "semantic"), frame(spark, sf, "v_vectors").withColumnRenamed("item", "item_id")
    first, _ = artifacts.semantic_build(rows, folder, "mlx:small")
    again, there = artifacts.semantic_build(rows, folder, "mlx:small")
    other, new = artifacts.semantic_build(rows, folder, "mlx:large")
    same = sinks.digest(first) == sinks.digest(again) == sinks.digest(other)
    return again.agg(F.count("*").alias("items"), F.lit(there and not new).alias("reused"), F.lit(same).alias("equal"))


def macros(spark, sf, variant):
    a = frame(spark, sf, "v_answers").where(F.col("variant") == variant)
    share = F.count_if(F.col("decision") == "yes") / F.count("*")
    return a.groupBy(F.translate("model", "m012345678", "ZABCDEFGHI").alias("name")).agg(artifacts.number_text("percent", share).alias("value"))


@query("macro_diff", ctes("v_answers") + """, v AS (SELECT translate(model, 'm012345678', 'ZABCDEFGHI') AS name, variant, printf('%.1f', 100.0 * count(*) FILTER (decision = 'yes') / count(*)) || '\\%' AS value FROM v_answers GROUP BY 1, 2), o AS (SELECT * FROM v WHERE variant = 'must' AND name <> 'ZA'), n AS (SELECT * FROM v WHERE variant = 'shall' AND name <> 'ZB')
SELECT coalesce(o.name, n.name) AS name, o.value AS before, n.value AS after, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.value = n.value THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.name = n.name""")
def macro_diff(spark, sf):
    """Macros of two report runs, written as TeX and read again."""
    read = []
    for variant, without in (("must", "ZA"), ("shall", "ZB")):
        path = new_folder(spark, "macros")
        artifacts.macro_lines(macros(spark, sf, variant).where(F.col("name") != without)).write.text(path)
        read.append(artifacts.read_macros(spark.read.text(path)))
    return artifacts.macro_diff(*read)


@query("number_formats", ctes("v_answers") + r""", g AS (SELECT source_modality, avg(confidence) AS x, count(*) AS n FROM v_answers GROUP BY 1) SELECT source_modality, printf('%.1f', 100 * x) || '\%' AS percent, printf('%.3f', x) AS auroc, format('{:,}', n) AS n, '[' || printf('%.1f', 100 * (x - 0.1::DOUBLE)) || '\%, ' || printf('%.1f', 100 * (x + 0.1::DOUBLE)) || '\%]' AS ci FROM g""")
def number_formats(spark, sf):
    g = frame(spark, sf, "v_answers").groupBy("source_modality").agg(F.avg("confidence").alias("x"), F.count("*").alias("n"))
    text, x = artifacts.number_text, F.col("x")
    return g.select("source_modality", text("percent", x).alias("percent"), text("auroc", x).alias("auroc"), text("count", F.col("n")).alias("n"), text("ci", x - 0.1, x + 0.1).alias("ci"))


@query("artifact_table", "SELECT CAST(count(*) AS BIGINT) AS n, max(r_name) AS last_name FROM region")
def artifact_table(spark, sf):
    path = new_folder(spark, "artifact")
    sinks.write_csv(frame(spark, sf, "region"), path, ["r_regionkey", "r_name"])
    return artifacts.read_artifact(spark, path, ["r_name", "r_regionkey"]).agg(F.count("*").alias("n"), F.max("r_name").alias("last_name"))


@query("markdown_report", "SELECT '| ' || r_name || ' | ' || r_regionkey || ' |' AS line FROM region UNION ALL SELECT '| r_name | r_regionkey |' UNION ALL SELECT '| --- | --- |'")
def markdown_report(spark, sf):
    text = sinks.markdown(frame(spark, sf, "region").select("r_name", "r_regionkey"))
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query("reviewed_table", "SELECT * FROM (VALUES (0, false), (1, false), (2, true)) AS t(step, differs)")
def reviewed_table(spark, sf):
    """A reviewed table is left alone, and what differs is written beside it."""
    folder, rows = new_folder(spark, "reviewed"), frame(spark, sf, "region").select("r_regionkey", "r_name")
    steps = [rows, rows.orderBy(F.desc("r_regionkey")), rows.withColumn("r_name", F.lower("r_name"))]
    return spark.createDataFrame([(k, sinks.write_if_changed(x, f"{folder}/table", f"{folder}/candidate")) for k, x in enumerate(steps)], "step int, differs boolean")


@query("provenance", "SELECT true AS verified, true AS tampering_found, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n")
def provenance(spark, sf):
    tables = {t: frame(spark, sf, t) for t in ("region", "nation")}
    text = sinks.manifest(tables)
    sinks.verify(text, tables)
    try:
        sinks.verify(text, tables | {"region": tables["region"].withColumn("r_name", F.lower("r_name"))})
        found = False
    except RuntimeError:
        found = True
    return tables["region"].select("r_name").union(tables["nation"].select("n_name")).agg(F.lit(True).alias("verified"), F.lit(found).alias("tampering_found"), F.count("*").alias("n"))


@query("requirement_document", "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS document, CAST(p_partkey AS VARCHAR) AS requirement_id, CASE p_size % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'O' ELSE '' END AS marker, CASE WHEN p_size % 3 = 2 THEN 0 ELSE 1 END AS marker_count, 'Parts > ' || p_type AS section, p_name AS text, coalesce(CAST(lag(p_partkey) OVER (PARTITION BY floor(p_partkey / 50) ORDER BY p_partkey) AS VARCHAR), '') AS before FROM part")
def requirement_document(spark, sf):
    """Documents of fifty requirements in XML: marker, section path, and the neighbour before in document order."""
    size = F.col("p_size") % 3
    marker = F.when(size == 0, F.lit(' marker="M"')).when(size == 1, F.lit(' marker="O"')).otherwise(F.lit(""))
    quoted = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    node = F.concat(F.lit('<req id="'), F.col("p_partkey").cast("string"), F.lit('"'), marker, F.lit("><section>Parts</section><section>"), quoted("p_type"), F.lit("</section><text_body>  "), quoted("p_name"), F.lit("</text_body></req>"))
    parts = frame(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("document")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", node.alias("x")))).alias("nodes"))
    documents = parts.select("document", F.concat(F.lit("<doc>"), F.array_join("nodes.x", ""), F.lit("</doc>")).alias("xml"))
    rows = log_store.requirements_of(documents, "xml", ["document"])
    w = Window.partitionBy("document").orderBy(F.col("requirement_id").cast("long"))
    return rows.withColumn("before", F.coalesce(F.lag("requirement_id").over(w), F.lit("")))


@query("probe_width", ctes("v_vectors") + " SELECT item, 8::BIGINT AS width, round(max(CAST(embedding[1] AS DOUBLE)), 9) + 0.0 AS top FROM v_vectors GROUP BY 1")
def probe_width(spark, sf):
    """Vectors brought to one width: cut, or filled with zeros."""
    short = vectors.padded(F.slice(vectors.doubles(F.col("embedding")), 1, 3), 8)
    rows = frame(spark, sf, "v_vectors").select("item", short.alias("x"))
    return rows.groupBy("item").agg(F.max(F.size("x")).cast("long").alias("width"), r9(F.max(F.element_at("x", 1))).alias("top"))
