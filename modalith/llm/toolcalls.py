"""Tool-call linking: calls and results joined by identifier, ordered topologically, validated against schemas, and
serialised as canonical JSON. DataFrame expressions only.

Messages hold calls as JSON: {"tool_calls": [{"id", "name", "arguments": {...}}]}, and results as
{"tool_call_id": ..., "content": ...}. A call depends on each call that its arguments name as {"$ref": id} or in
an `after` field. A topological level is found by pointer doubling along chains and by Kahn's rounds where a call has
several needs, all calls at once; calls on or behind a cycle keep none.

Null texts and texts that aren't such JSON hold no call. A conversation without calls has no rows, and counts of 0. Where an
identifier occurs twice in a conversation, the call that comes first holds it and later ones are counted as
duplicates; of several results the first counts. Results without a call are orphans. Null conversation ids form one
conversation. Empty tables give empty results; other columns are ignored, so their names can't clash. Texts of any
length are serialised whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modalith.llm.runtime import materialize

#: For each tool its fields: (name, variant type, required).
SCHEMAS = {"reply": (("after", "STRING", False), ("prompt", "STRING", True), ("turn", "BIGINT", True))}
MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, content string"


def messages_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, m) with m the parsed message, null where text isn't one."""
    looks = F.trim("text").startswith("{") & (F.contains(F.col("text"), F.lit("tool_call")))
    return rows.select("conv_id", "turn", "role", "text", F.when(looks, F.from_json("text", MESSAGE)).alias("m"))


def explicit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, place, id, name, arguments) and results (conv_id, turn, id, content) in the texts."""
    m = messages_of(rows)
    calls = m.where("m.tool_calls is not null").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("place", "c")).select("conv_id", "turn", "place", "c.id", "c.name", "c.arguments")
    results = m.where("m.tool_call_id is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("id"), F.coalesce("m.content", F.lit("")).alias("content"))
    return calls, results


def dialogue(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain dialogue as calls of the tool `reply`: a user's turn asks for the next turn of the assistant, and comes
    after the user's turn two before it. Turns that are explicit messages are left to explicit()."""
    m = messages_of(rows).where("m.tool_calls is null and m.tool_call_id is null")
    name = lambda t: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), t.cast("string"))
    turn = F.col("turn")
    arguments = F.to_json(F.struct(F.when(turn >= 2, name(turn - 2)).alias("after"), F.coalesce("text", F.lit("")).alias("prompt"), turn.alias("turn")))
    calls = m.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("place"), name(turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = m.where("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def problems(name: Column, v: Column, schemas: dict = SCHEMAS) -> Column:
    """What is wrong with a call's arguments (a variant): an array of strings, empty if nothing is."""
    out = F.when(v.isNull(), F.array(F.lit("not an object"))).otherwise(F.array(F.lit("unknown tool")))
    for tool, fields in schemas.items():
        checks = []
        for field, kind, required in fields:
            value = F.try_variant_get(v, f"$.{field}", "variant")
            missing = F.when(value.isNull(), F.lit(f"missing {field}")) if required else F.when(F.lit(False), F.lit(""))
            checks.append(F.coalesce(missing, F.when(value.isNotNull() & (F.schema_of_variant(value) != kind), F.lit(f"type of {field}"))))
        names = F.json_object_keys(F.to_json(v))
        extra = F.transform(F.array_except(names, F.array(*(F.lit(f[0]) for f in fields))), lambda x: F.concat(F.lit("unexpected "), x))
        found = F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>")))
        out = F.when(v.isNotNull() & (name == tool), found).otherwise(out)
    return out


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, id, level) of the calls that aren't on or behind a cycle: 0 without needs, else one more than the
    highest that it needs. needs: (conv_id, id, need), distinct, each need a call of the same conversation.

    Calls with one need are chains: pointers are doubled until each has its head, a call with no need or with
    several, so a chain takes logarithmically many rounds. Calls with several needs go by Kahn's rounds over heads,
    as long as a round settles any; what is left then is on or behind a cycle."""
    key = ["conv_id", "id"]
    count = needs.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("need"))
    nodes = materialize(calls.select(*key).join(count, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"), "need"))
    kind = nodes.select("conv_id", F.col("id").alias("need"), F.col("n").alias("m"))
    # a call's head is null where it is a call without needs
    jumped = nodes.where("n = 1").join(kind, ["conv_id", "need"]).select(*key, F.when(F.col("m") > 0, F.col("need")).alias("head"), F.lit(1).alias("d"), (F.col("m") == 1).alias("open"))
    jumped = materialize(jumped)
    done, left = jumped.where("not open"), jumped.where("open")
    longest, reach = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0, 1
    # a path of more steps than a conversation has calls is on a cycle
    while reach <= longest and not left.isEmpty():
        ahead = done.union(left).select("conv_id", F.col("id").alias("head"), F.col("head").alias("far"), F.col("d").alias("more"), F.col("open").alias("on"))
        jumped = materialize(left.join(ahead, ["conv_id", "head"]).select(*key, F.col("far").alias("head"), (F.col("d") + F.col("more")).alias("d"), F.col("on").alias("open")))
        done, left, reach = done.union(jumped.where("not open")), jumped.where("open"), 2 * reach
    settled = nodes.where("n = 0").select(*key, F.lit(0).alias("level")).union(done.where("head is null").select(*key, F.col("d").alias("level")))
    if nodes.where("n > 1").isEmpty():
        return settled

    through = done.select("conv_id", F.col("id").alias("need"), "head", "d", F.lit(True).alias("chained"))
    several = needs.join(nodes.where("n > 1").select(*key), key, "left_semi")
    edges = several.join(kind, ["conv_id", "need"]).join(through, ["conv_id", "need"], "left")
    head = F.when(F.col("m") == 0, F.lit(None)).when(F.col("chained"), F.col("head")).otherwise(F.col("need"))
    waits = edges.select(*key, head.alias("head"), (F.coalesce("d", F.lit(0)) + 1).alias("d"))
    waits = materialize(waits.select(*key, "head", "d", F.when(F.col("head").isNull(), F.col("d")).alias("v")))
    parts: list[DataFrame] = []
    while True:
        ready = materialize(waits.groupBy(*key).agg(F.count_if(F.col("v").isNull()).alias("k"), F.max("v").alias("level")).where("k = 0").select(*key, "level"))
        if ready.isEmpty():
            break
        parts.append(ready)
        if len(parts) == 32:  # plans stay small
            parts = [materialize(reduce(DataFrame.union, parts))]
        told = ready.select("conv_id", F.col("id").alias("head"), F.col("level").alias("l"))
        waits = waits.join(ready.select(*key), key, "left_anti").join(told, ["conv_id", "head"], "left")
        waits = materialize(waits.select(*key, "head", "d", F.coalesce("v", F.col("l") + F.col("d")).alias("v")))
    if not parts:
        return settled
    found = materialize(reduce(DataFrame.union, parts))
    behind = done.join(found.select("conv_id", F.col("id").alias("head"), F.col("level").alias("l")), ["conv_id", "head"])
    return settled.union(found).union(behind.select(*key, (F.col("l") + F.col("d")).alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> tuple[DataFrame, DataFrame]:
    """Calls with their results, and the results that have none.

    calls: (conv_id, turn, place, id, name, arguments); results: (conv_id, turn, id, content). Returns
    (conv_id, turn, place, id, name, kind, level, linked, n_results, problems, json) twice: of the calls, whose kind is
    call or duplicate, and of the orphans, one row an identifier. Null conversations are -2**63."""
    conv = F.coalesce(F.col("conv_id"), F.lit(-(2**63)))
    calls = calls.withColumn("conv_id", conv)
    results = results.withColumn("conv_id", conv)
    first = Window.partitionBy("conv_id", "id").orderBy("turn", "place", "name", "arguments")
    calls = materialize(calls.withColumn("duplicate", F.row_number().over(first) > 1))
    held = calls.where("not duplicate and id is not null")
    answer = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    v = F.try_parse_json("arguments")
    parsed = held.withColumn("v", v)
    refs = F.array_compact(F.array(F.try_variant_get("v", "$.after", "string")))
    refs = F.array_union(refs, F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"\\]+)"'), 1))
    needs = parsed.select("conv_id", "id", F.explode(refs).alias("need"))
    # only needs that are calls of the same conversation bind
    needs = needs.join(held.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi").distinct()
    level = levels(held, needs)
    out = parsed.join(level, ["conv_id", "id"], "left").join(answer, ["conv_id", "id"], "left")
    out = out.withColumn("problems", problems(F.col("name"), F.col("v"), schemas))
    quoted = lambda c: F.to_json(F.to_variant_object(F.array(c)))  # noqa: E731  ["..."], as a JSON string of its own
    inner = lambda c: F.substring(quoted(c), F.lit(2), F.char_length(quoted(c)) - 2)
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("v"), F.lit("null")), F.lit(',"id":'), inner(F.col("id")), F.lit(',"name":'), F.coalesce(inner(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(F.when(F.col("r").isNotNull(), inner(F.col("r.content"))), F.lit("null")), F.lit("}"),
    )
    none = F.array().cast("array<string>")
    rows = out.select("conv_id", "turn", "place", "id", "name", F.lit("call").alias("kind"), F.col("level").cast("long").alias("level"), F.col("r").isNotNull().alias("linked"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "problems", body.alias("json"))
    twice = calls.where("duplicate or id is null").select("conv_id", "turn", "place", "id", "name", F.lit("duplicate"), F.lit(None).cast("long"), F.lit(False), F.lit(0).cast("long"), none, F.lit(None).cast("string"))
    lost = answer.join(held.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
    told = F.concat(F.lit('{"content":'), inner(F.col("r.content")), F.lit(',"tool_call_id":'), F.coalesce(inner(F.col("id")), F.lit("null")), F.lit("}"))
    orphans = lost.select("conv_id", "r.turn", F.lit(0).alias("place"), "id", F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("kind"), F.lit(None).cast("long").alias("level"), F.lit(False).alias("linked"), "n_results", none.alias("problems"), told.alias("json"))
    return rows.union(twice), orphans


def _linked(rows: DataFrame, schemas: dict) -> tuple[DataFrame, DataFrame]:
    told, asked = explicit(rows), dialogue(rows)
    calls, results = (a.unionByName(b) for a, b in zip(told, asked))
    return link(calls, results, schemas)


def tool_calls(rows: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row for each call, duplicate and orphan: (conv_id, turn, place, id, name, kind, level, linked, n_results,
    problems, json), in topological order within a conversation and then by turn. A range sort: a conversation of any
    length is as many tasks as it needs, and nothing is gathered by conversation."""
    linked, orphans = _linked(rows, schemas)
    out = linked.union(orphans).withColumn("problems", F.array_join("problems", ";"))
    out = out.orderBy("conv_id", F.col("level").asc_nulls_last(), "turn", "place", "kind", "id")
    return out.withColumn("conv_id", F.nullif("conv_id", F.lit(-(2**63))))


def conversations(rows: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row for each conversation: (conv_id, n_turns, n_calls, n_linked, n_orphans, n_invalid, n_duplicates,
    max_level), from counts that are combined before they are shuffled."""
    linked, orphans = _linked(rows, schemas)
    turns = rows.groupBy(F.coalesce(F.col("conv_id"), F.lit(-(2**63))).alias("conv_id")).agg(F.count("*").alias("n_turns"))
    call = F.col("kind") == "call"
    per = linked.groupBy("conv_id").agg(F.count_if(call).alias("n_calls"), F.count_if("linked").alias("n_linked"), F.count_if(F.size("problems") > 0).alias("n_invalid"), F.count_if(~call).alias("n_duplicates"), F.max("level").alias("max_level"))
    out = turns.join(per, "conv_id", "left").join(orphans.groupBy("conv_id").agg(F.sum("n_results").alias("n_orphans")), "conv_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.nullif("conv_id", F.lit(-(2**63))).alias("conv_id"), "n_turns", n("n_calls"), n("n_linked"), n("n_orphans"), n("n_invalid"), n("n_duplicates"), "max_level")


ORACLE = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text) AS k FROM conversations),
calls AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, text FROM t WHERE role = 'user' AND k = 1),
res AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS id, min(turn) AS turn, min(text) AS content, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY 1, 2),
lv AS (SELECT a.conv_id, a.id, a.turn, a.text, count(b.turn) FILTER (b.turn < a.turn AND (a.turn - b.turn) % 2 = 0 AND NOT EXISTS (
   SELECT 1 FROM range(b.turn, a.turn, 2) r(x) WHERE x > b.turn AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = a.conv_id AND c.turn = x))) AS level
   FROM calls a JOIN calls b ON a.conv_id = b.conv_id GROUP BY 1, 2, 3, 4),
j AS (SELECT lv.conv_id, lv.turn, lv.id, level, res.id IS NOT NULL AS linked, coalesce(res.n, 0) AS n_results,
   '{"arguments":{' || CASE WHEN lv.turn >= 2 THEN '"after":' || to_json(lv.conv_id || ':' || (lv.turn - 2))::VARCHAR || ',' ELSE '' END || '"prompt":' || to_json(lv.text)::VARCHAR || ',"turn":' || lv.turn ||
   '},"id":' || to_json(lv.id)::VARCHAR || ',"name":"reply","result":' || coalesce(to_json(res.content)::VARCHAR, 'null') || '}' AS body
   FROM lv LEFT JOIN res ON res.conv_id = lv.conv_id AND res.id = lv.id)
SELECT conv_id, turn, 0 AS place, id, 'reply' AS name, 'call' AS kind, level, linked, n_results, '' AS problems, body AS json FROM j
UNION ALL SELECT conv_id, turn, 0, conv_id || ':' || turn, 'reply', 'duplicate', NULL, false, 0, '', NULL FROM t WHERE role = 'user' AND k > 1
UNION ALL SELECT res.conv_id, res.turn, 0, res.id, NULL, 'orphan', NULL, false, res.n, '', '{"content":' || to_json(res.content)::VARCHAR || ',"tool_call_id":' || to_json(res.id)::VARCHAR || '}' FROM res LEFT JOIN calls ON calls.conv_id = res.conv_id AND calls.id = res.id WHERE calls.id IS NULL
"""
