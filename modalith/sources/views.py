"""Derived relations over the driver's tables, as SQL that Spark and DuckDB read alike.

Each view names the tables and views it reads in braces. frame() resolves them to DataFrames for Spark; ctes() to common
table expressions for an oracle. So both engines start from one definition, and only the operators differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Label order, strongest first; ordinal strength 3 to 0.
MODALITIES = ("mandatory", "recommended", "optional", "nice_to_have")

_MODALITY = "CASE {x} WHEN 0 THEN 'mandatory' WHEN 1 THEN 'recommended' WHEN 2 THEN 'optional' ELSE 'nice_to_have' END"


def _label(x: str) -> str:
    return _MODALITY.replace("{x}", x)


VIEWS = {
    "v_seeds": """
SELECT 'S' || lpad(CAST(p_partkey AS STRING), 6, '0') AS seed_id, p_partkey, p_size, lower(p_type) AS source_corpus,
  CASE p_size % 4 WHEN 0 THEN 'export ' WHEN 1 THEN 'archive ' WHEN 2 THEN 'list ' ELSE 'print ' END || p_name AS capability,
  CASE p_size % 6 WHEN 0 THEN 'The system shall ' WHEN 1 THEN '''The system shall be able to ' WHEN 2 THEN '"The application must '
    WHEN 3 THEN 'The software should not ' WHEN 4 THEN 'Users may list and then ' ELSE 'The ' || lower(p_type) || ' tool will ' END
    || CASE p_size % 4 WHEN 0 THEN 'export ' WHEN 1 THEN 'archive ' WHEN 2 THEN 'list ' ELSE 'print ' END || p_name
    || CASE p_size % 6 WHEN 1 THEN ' every day.''' WHEN 2 THEN ' as a file."' ELSE '.' END AS original_requirement
FROM {part}""",
    "v_templates": """
SELECT * FROM (VALUES ('mandatory', 'The system MUST ', 3, 1), ('recommended', 'The system SHOULD ', 2, 0), ('optional', 'The system MAY ', 1, 0),
  ('nice_to_have', 'It would be useful if the system could ', 0, 0)) AS t(source_modality, opening, ordinal, gold_yes)""",
    "v_items": """
SELECT seed_id || '_' || source_modality AS item_id, seed_id, source_modality, opening || capability || '.' AS source_statement,
  'The system MUST ' || capability || '.' AS candidate_requirement, capability, ordinal, gold_yes
FROM {v_seeds} CROSS JOIN {v_templates}""",
    "v_attempts": f"""
SELECT 'm' || CAST(l_suppkey % 9 AS STRING) AS model, CASE l_orderkey % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END AS dataset,
  CASE WHEN l_orderkey % 4 >= 2 THEN 'shall' ELSE 'must' END AS variant, CASE WHEN l_orderkey % 3 = 0 THEN 'task1' ELSE 'task2' END AS task,
  'S' || lpad(CAST(l_partkey AS STRING), 6, '0') AS seed_id, {_label('l_linenumber % 4')} AS source_modality, 3 - l_linenumber % 4 AS ordinal,
  'S' || lpad(CAST(l_partkey AS STRING), 6, '0') || '_' || {_label('l_linenumber % 4')} AS item_id,
  CASE WHEN l_linenumber <= 4 THEN 'deterministic' ELSE 'stochastic' END AS sample_kind, l_linenumber % 5 AS sample_index,
  CASE WHEN l_returnflag = 'R' THEN CASE l_linestatus WHEN 'O' THEN 'invalid_json' ELSE 'truncated' END ELSE 'ok' END AS status,
  round(1 - l_tax * 6, 4) + 0.0 AS confidence, l_quantity / 10 AS latency_s, l_linenumber % 3 AS retries, 'B' || CAST(l_orderkey % 500 AS STRING) AS batch_id,
  'Q' || CAST(l_orderkey AS STRING) AS request_id, (l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 12 AS kind, 'R' || CAST(l_suppkey % 9 AS STRING) || '-' || CAST(l_orderkey % 5 AS STRING) AS run_id,
  l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_suppkey, l_quantity, l_tax, l_discount, l_returnflag, l_linestatus
FROM {{lineitem}}""",
    "v_answers": f"""
SELECT *, CASE kind
  WHEN 0 THEN 'The system MUST export report ' WHEN 1 THEN 'The system should export report ' WHEN 2 THEN 'The system may export report '
  WHEN 3 THEN 'It would be useful if the system could export report ' WHEN 4 THEN 'The system must not export report ' WHEN 5 THEN 'The system cannot export report '
  WHEN 6 THEN 'The system exports report ' WHEN 7 THEN 'Reports of kind ' WHEN 8 THEN 'It would be nice if the system must export report '
  WHEN 9 THEN 'Users may not delete records; the system must export report ' WHEN 10 THEN 'Never should the system export report ' ELSE 'It is desirable that the system exports report ' END
  || CAST(l_partkey AS STRING) || '.' AS requirement,
  CASE WHEN kind < 8 THEN source_modality ELSE {_label('(l_partkey + kind) % 4')} END AS pred_modality,
  CASE WHEN kind < 8 THEN ordinal ELSE 3 - (l_partkey + kind) % 4 END AS pred_ordinal,
  CASE WHEN (l_partkey + kind) % 5 = 0 THEN 'yes' ELSE 'no' END AS decision
FROM {{v_attempts}} WHERE status = 'ok'""",
    "v_observed": f"""
SELECT *, CASE WHEN status <> 'ok' THEN NULL WHEN kind < 8 THEN source_modality ELSE {_label('(l_partkey + kind) % 4')} END AS label FROM {{v_attempts}}""",
    "v_samples": """
SELECT event_id AS sample_id, 'I' || lpad(CAST(user_id AS STRING), 5, '0') AS item_id, user_id % 3 AS model_no, event_type, value, ts, props,
  CASE event_type WHEN 'view' THEN 'mandatory' WHEN 'click' THEN 'recommended' WHEN 'signup' THEN 'optional' WHEN 'purchase' THEN 'nice_to_have' END AS label
FROM {events}""",
    "v_scored": """
SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, l.quality, l.toxic, CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1500) AS p, CASE WHEN CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1500) >= 0.5 THEN 1 ELSE 0 END AS y_pred
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v_vectors": "SELECT vec_id, CAST(floor(vec_id / 5) AS BIGINT) AS item, embedding, label FROM {embeddings}",
    "v_registry": """
SELECT 'run-' || lpad(CAST(o_orderkey AS STRING), 7, '0') AS run_id, 'm' || CAST(o_custkey % 9 AS STRING) AS model, CASE o_orderkey % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END AS dataset,
  CASE WHEN o_orderkey % 4 >= 2 THEN 'shall' ELSE 'must' END AS variant, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'partial' END AS status,
  o_orderdate AS started_at, 100 + o_custkey % 50 AS expected_records, 100 + o_custkey % 50 - o_orderkey % 3 AS observed_records, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'grouped' WHEN '2' THEN 'separated' ELSE 'single' END AS batch_order,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 4 ELSE 1 END AS batch_size, o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'smoke-' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'full-' ELSE 'full-shall-' END END || CAST(o_orderkey AS STRING) AS run_name,
  'source_run_id=run-' || lpad(CAST(o_orderkey - o_orderkey % 10 AS STRING), 7, '0') || ';cell=' || CAST(o_orderkey % 4 AS STRING) AS notes
FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    names = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    read = {n: frame(spark, sf_dir, n) for n in names}
    if name == "v_items":  # parts are few bytes in one split, and each makes items that are costly to read
        read["v_seeds"] = read["v_seeds"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(VIEWS[name], **read)


def ctes(*names: str) -> str:
    """WITH clause that defines views and what they read, for an oracle; ends with a comma's place left open."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
            add(n)
        done[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())
