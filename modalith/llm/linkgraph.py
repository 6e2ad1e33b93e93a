"""URL filters: rules by host and path, and for the rest trust and distrust propagated over the graph of hosts.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and goes
against them, since a host answers for what it links to. Both are personalised PageRank, by power iteration over
host edges aggregated beforehand. A host whose distrust exceeds `ratio` times its trust is blocked, any other
allowed. Hosts that no seed reaches have neither and are allowed.

Null urls and urls without :// have an empty host and path, fit no rule and are allowed. Null pages have no links.
Rows with equal ids are judged each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalith.llm.runtime import fits, materialize

#: (verdict, rule); a rule is a host, then a path from its first slash on.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A host with one of these first labels and the host without it are taken to link to each other.
MIRRORS = ("www", "m", "blog")
DAMPING, ROUNDS, RATIO = 0.85, 20, 1.0
#: The table of hosts is broadcast up to so many rows (some MB), and joined by a shuffle beyond.
BROADCAST_HOSTS = 100_000
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/"'\s>?#]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = split_rule(rule)
        fits_it = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits_it, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, html_col: str, mirrors=MIRRORS) -> DataFrame:
    """(src, dst, n) between different hosts, from (host, html): one row a pair, pre-combined before the shuffle."""
    linked = pages.where(F.contains(F.col(html_col), F.lit("//"))).select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1))).alias("dst"))
    linked = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    base = F.regexp_extract("host", r"^(?:" + "|".join(mirrors) + r")\.(.+\..+)$", 1)
    pairs = pages.select("host").where("host <> ''").distinct().select("host", base.alias("base")).where("base <> ''")
    mirrored = pairs.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("base").alias("dst")), F.struct(F.col("base").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst")
    return linked.where("src <> '' and dst <> '' and src <> dst").union(mirrored).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, good, bad): personalised PageRank of either
    kind, each of total 1 where it has a seed. Mass at hosts without edges returns to the seeds: that only scales
    the solution, so it is left out of the rounds and made good at the end."""
    out_n = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    weighed = edges.join(out_n, "src").join(in_n, "dst")
    forward = weighed.select("src", "dst", (F.col("n") / F.col("out_n")).alias("w_trust"), F.lit(0.0).alias("w_distrust"))
    back = weighed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("w_trust"), (F.col("n") / F.col("in_n")).alias("w_distrust"))
    flow = materialize(forward.union(back))
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()  # two numbers
    hosts = seeds.select("host").union(flow.select("dst")).distinct()
    share = lambda c, t: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(t)) if t else F.lit(0.0)
    start = materialize(hosts.join(seeds, "host", "left").select("host", share("good", total.g).alias("s_trust"), share("bad", total.b).alias("s_distrust")))
    rank = start.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    for i in range(rounds):
        sent = flow.join(rank, flow["src"] == rank["host"]).groupBy("dst").agg(F.sum(F.col("trust") * F.col("w_trust")).alias("t"), F.sum(F.col("distrust") * F.col("w_distrust")).alias("d"))
        step = lambda s, x: (1 - damping) * F.col(s) + damping * F.coalesce(F.col(x), F.lit(0.0))
        rank = start.join(sent, start["host"] == sent["dst"], "left").select("host", step("s_trust", "t").alias("trust"), step("s_distrust", "d").alias("distrust"))
        if i % 5 == 4:
            rank = materialize(rank)
    mass = rank.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()  # two numbers
    scaled = lambda c, m: F.round(F.col(c) / F.lit(m), 12) if m else F.lit(0.0)
    return rank.select("host", scaled("trust", mass.t).alias("trust"), scaled("distrust", mass.d).alias("distrust"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, ratio: float = RATIO) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    seeds = rows.where("host <> ''").groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("good"), F.count_if(F.col("fit.verdict") == "block").alias("bad"))
    ranks = materialize(propagate(materialize(host_edges(rows, "html")), materialize(seeds)))
    side = F.broadcast(ranks) if fits(ranks, BROADCAST_HOSTS) else ranks
    by_graph = F.when(F.col("distrust") > ratio * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    out = rows.drop("html").join(side, "host", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def oracle(rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The same for DuckDB, with a common table expression for each round."""
    found_rule, found_verdict = "NULL", "NULL"
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = split_rule(rule)
        test = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        found_rule, found_verdict = f"CASE WHEN {test} THEN '{rule}' ELSE {found_rule} END", f"CASE WHEN {test} THEN '{verdict}' ELSE {found_verdict} END"
    link = LINK.replace("'", "''")
    steps = ""
    for i in range(rounds):
        steps += f""",
r{i + 1} AS MATERIALIZED (SELECT s.host, {1 - damping!r} * s_trust + {damping!r} * coalesce(t, 0) AS trust, {1 - damping!r} * s_distrust + {damping!r} * coalesce(d, 0) AS distrust
  FROM start s LEFT JOIN (SELECT dst, sum(trust * w_trust) AS t, sum(distrust * w_distrust) AS d FROM flow JOIN r{i} ON src = host GROUP BY dst) x ON x.dst = s.host)"""
    return f"""
WITH p0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{HOST}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PATH}', 1), '') AS path, html FROM pages),
p AS MATERIALIZED (SELECT *, {found_rule} AS rule, {found_verdict} AS fit FROM p0),
links AS (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '{link}', 1))), '{UPPER}', '{LOWER}') AS dst FROM p WHERE contains(html, '//')),
based AS (SELECT host, regexp_extract(host, '^(?:{"|".join(MIRRORS)})\\.(.+\\..+)$', 1) AS base FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
pairs AS (SELECT src, dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst UNION ALL SELECT host, base FROM based WHERE base <> '' UNION ALL SELECT base, host FROM based WHERE base <> ''),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM pairs GROUP BY 1, 2),
w AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS f, n / sum(n) OVER (PARTITION BY dst) AS b FROM edges),
flow AS MATERIALIZED (SELECT src, dst, f AS w_trust, 0.0::DOUBLE AS w_distrust FROM w UNION ALL SELECT dst, src, 0.0::DOUBLE, b FROM w),
seeds AS MATERIALIZED (SELECT host, count(*) FILTER (fit = 'allow') AS good, count(*) FILTER (fit = 'block') AS bad FROM p WHERE host <> '' GROUP BY 1),
hosts AS (SELECT host FROM seeds UNION SELECT dst FROM flow),
tot AS (SELECT sum(good)::DOUBLE AS g, sum(bad)::DOUBLE AS b FROM seeds),
start AS MATERIALIZED (SELECT h.host, CASE WHEN g > 0 THEN coalesce(good, 0) / g ELSE 0.0::DOUBLE END AS s_trust, CASE WHEN b > 0 THEN coalesce(bad, 0) / b ELSE 0.0::DOUBLE END AS s_distrust FROM hosts h LEFT JOIN seeds s ON s.host = h.host, tot),
r0 AS (SELECT host, s_trust AS trust, s_distrust AS distrust FROM start){steps},
mass AS (SELECT sum(trust) AS mt, sum(distrust) AS md FROM r{rounds}),
ranks AS (SELECT host, round(CASE WHEN mt > 0 THEN trust / mt ELSE 0 END, 12) AS trust, round(CASE WHEN md > 0 THEN distrust / md ELSE 0 END, 12) AS distrust FROM r{rounds}, mass)
SELECT page_id, p.host, path, rule, coalesce(fit, CASE WHEN distrust > {RATIO!r}::DOUBLE * trust THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM p LEFT JOIN ranks ON ranks.host = p.host"""
