import json
import math
import random
import time
from collections import Counter
from html.parser import HTMLParser
from itertools import pairwise

import duckdb
import pytest
from pyspark.sql import types as T

from modalith.llm import htmltext, linkgraph, toolcalls
from modalith.llm.queries import ORACLES, QUERIES, op2_html

SF = "/root/testdata/sf0.001"

CASES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>one\n two<p>three &lt;x&gt; <b>bold</b>!</article><footer>f</footer></body></html>", "A & B\none two\nthree <x> bold!"),
    ('<body><div class="ad">buy</div><main><p>kept<script>var t="</p>";</script> on</p><div id="comments"><p>reader</p></div></main><aside>s</aside>', "kept on"),
    ('<div role="navigation">x</div><div itemprop="articleBody">body<br>next<form>f<input></form></div><div class="cookie-notice">c</div>', "body next"),
    ("<article><p>unclosed <b>bold<p>second<ul><li>a<li>b</ul><header>h</header>tail", "unclosed bold\nsecond\na\nb\ntail"),
    ("<!-- <p>no</p> --><article>1 < 2 &nbsp; ok<p hidden>no</p></article>", "1 < 2 ok"),
    (None, ""),
    ("", ""),
    ("plain text only", "plain text only"),
    ("<article></article><p>outside</p>", "outside"),
    ("<script>never closed <p>x", ""),
]


def test_blocks():
    for page, want in CASES:
        assert "\n".join(htmltext.blocks_of(page)[0]) == want, page


class Article(HTMLParser):
    """The blocks of a page's <article>, read by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_is_the_articles_blocks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = op2_html(spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for r in pages.itertuples():
        parser = Article()
        parser.feed(r.html)
        parser.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert (got.loc[r.page_id].text, got.loc[r.page_id].n_chars, got.loc[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize("unit", ["<a", "<a ", '<a "', "<div>", "<b>", "</p>", "<div></x>", "<p><b>", "<!-", "<![CDATA[", "&amp", "<script>", "<ul><li>", "<"])
def test_malformed_pages_take_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        htmltext.blocks_of(unit * n + "x" + ">" * (n % 2))
        return time.process_time() - began

    few, many = min(seconds(4000) for _ in range(3)), min(seconds(40_000) for _ in range(2))
    assert many < 0.1 or many < 40 * few


def brute_runs(bodies, tokens, share):
    """Texts of the distinct bodies of one host without windows of tokens that enough of them hold."""
    streams = [[(i, w) for i, b in enumerate(blocks) for w in b.split(" ")] for blocks in bodies]
    windows = [{tuple(w for _, w in s[k : k + tokens]) for k in range(len(s) - tokens + 1)} for s in streams]
    seen = Counter(w for ws in windows for w in ws)
    least = max(2, math.ceil(len(bodies) * share))
    out = []
    for s in streams:
        gone = {k + j for k in range(len(s) - tokens + 1) if seen[tuple(w for _, w in s[k : k + tokens])] >= least for j in range(tokens)}
        lines = {}
        for k, (i, w) in enumerate(s):
            if k not in gone:
                lines.setdefault(i, []).append(w)
        out.append("\n".join(" ".join(x) for x in lines.values()))
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.6])
def test_runs_of_a_host_against_counting_every_window(spark, share):
    draw = random.Random(9)
    common = [[f"c{k}{j}" for j in range(draw.randint(4, 50))] for k in range(6)]
    bodies = []
    for i in range(20):
        blocks = []
        for _ in range(draw.randint(1, 9)):
            words = list(draw.choice(common)) if draw.random() < 0.6 else [f"u{i}{draw.randrange(9)}" for _ in range(draw.randint(1, 20))]
            if draw.random() < 0.3:
                words[draw.randrange(len(words))] = f"odd{i}"
            blocks.append(" ".join(words))
        if blocks not in bodies:
            bodies.append(blocks)
    rows = [(h, i, b) for h in ("x", "y") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "host string, body long, blocks array<string>")
    want = brute_runs(bodies, 8, share)
    got = {(r.host, r.body): r.unique for r in htmltext.unique_runs(df, 8, share, 12).collect()}
    assert got == {(h, i): want[i] for h in ("x", "y") for i in range(len(bodies))}
    assert share > 0.2 or any(w != "\n".join(b) for w, b in zip(want, bodies))


def test_boilerplate_of_a_host_goes_where_no_article_is_marked(spark):
    menu = "Home News Sport Weather Travel Money Arts Video Contact Imprint"
    say = lambda i: f"<div>{menu}</div><div>page number {i} says {' '.join(f'w{i}x{k}' for k in range(12))}</div>"
    rows = [(i, f"http://a.example/{i}", say(i)) for i in range(5)]
    rows += [(9, "http://b.example/1", f"<div>{menu}</div>"), (10, "http://a.example/3?utm=1", rows[3][2]), (None, "http://a.example/3", rows[3][2]), (11, None, None), (11, None, say(3))]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("host", T.LongType())])
    out = htmltext.extract(spark.createDataFrame([(*r, "clash", 1) for r in rows], schema))
    got = {r.url or r.text[:4]: r.text for r in out.collect()}
    assert len(got) == len(rows) - 1 and out.count() == len(rows)
    for i in range(5):
        assert menu not in got[f"http://a.example/{i}"] and f"w{i}x11" in got[f"http://a.example/{i}"]
    # the same page under two addresses is one page, so it doesn't lose its own words
    assert got["http://a.example/3?utm=1"] == got["http://a.example/3"] and got["http://b.example/1"] == menu
    assert got[""] == "" and got["Home"] == f"{menu}\npage number 3 says " + " ".join(f"w3x{k}" for k in range(12))
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0


def test_rules_and_hosts(spark):
    urls = [("https://WWW.Ex.example.com/en/8/x?q#f", "block", "com/en/"), ("http://example.com/en/7", "allow", "example.com/en/7"), ("http://a.example.com/en/71", "allow", "example.com/en/7"), ("http://x.net/de/8", "allow", "net/de/"), ("http://x.example.net/de/81?x", "block", "example.net/de/8"), ("http://org/es/?a", "block", "org/es/"), ("http://xorg/es/", "allow", None), ("http://x.org#/es/", "block", None), ("no scheme", "allow", None), (None, "allow", None), ("://h/p?a", "allow", None)]
    df = spark.createDataFrame([(i, u, None) for i, (u, _, _) in enumerate(urls)] + [(99, "http://x.org/es/1", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in linkgraph.judge(df).collect()}
    for i, (_, verdict, rule) in enumerate(urls):
        assert (got[i].verdict, got[i].rule) == (verdict, rule), urls[i]
    assert (got[0].host, got[0].path) == ("www.ex.example.com", "/en/8/x")
    assert (got[10].host, got[10].path) == ("h", "/p") and (got[8].host, got[8].path) == ("", "")


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    a = lambda *hosts: "".join(f'<a class=x href="http://{h}/z">l</a>' for h in hosts)
    rows = [(1, "http://good.net/de/1", a("friend.x", "friend.x")), (2, "http://friend.x/1", a("far.x")), (3, "http://bad.org/es/1", ""), (4, "http://feeder.x/1", a("bad.org")), (5, "http://far.x/1", None), (6, "http://lone.x/1", None)]
    got = {r.page_id: r for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4].verdict == "block" and got[4].distrust > 0 and got[2].trust > got[5].trust > 0
    assert [got[i].verdict for i in (2, 5, 6)] == ["allow"] * 3
    assert linkgraph.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", ["op3_urls", "op4_toolcalls"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()[list(got.columns)]
    key = [c for c in ("page_id", "conv_id", "turn", "id", "kind", "json") if c in got.columns]
    assert name != "op4_toolcalls" or got.conv_id.is_monotonic_increasing
    a, b = (x.sort_values(key).reset_index(drop=True).astype(object).where(lambda d: d.notna(), None) for x in (got, want))
    assert a.equals(b)


def test_calls_are_linked_ordered_and_validated(spark):
    call = lambda i, name="reply", **k: {"id": i, "name": name, "arguments": k}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("b", prompt="p", turn=1, after="a"), call("a", turn=0, prompt='q"\\'), call("a", prompt="again", turn=9)]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "ra"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("c", prompt={"$ref": "b"}, turn="x", more=1), call("d", "other")]})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("x", prompt="", turn=0, after="y"), call("y", prompt="", turn=0, after="x")]})),
        (3, 0, "system", None),
        (None, 0, "user", "hi"),
        (None, 1, "assistant", None),
    ]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.StringType()), T.StructField("json", T.LongType())])
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    got = {r.conv_id: r for r in toolcalls.conversations(df).collect()}
    one = got[1]
    assert (one.n_calls, one.n_linked, one.n_orphans, one.n_invalid, one.n_duplicates, one.max_level) == (4, 1, 1, 2, 1, 2)
    every = toolcalls.tool_calls(df).collect()
    first = [r for r in every if r.conv_id == 1]
    assert [(r.id, r.kind) for r in first if r.level is not None] == [("d", "call"), ("a", "call"), ("b", "call"), ("c", "call")] or [r.id for r in first if r.level is not None][-2:] == ["b", "c"]
    assert {(r.id, r.problems) for r in first if r.problems} == {("c", "type of prompt;type of turn;unexpected more"), ("d", "unknown tool")}
    assert [(r.id, r.kind) for r in first if r.kind != "call"] == [("a", "duplicate"), ("zz", "orphan")]
    made = {r.id: json.loads(r.json) for r in first if r.kind == "call"}
    assert {k: c["result"] for k, c in made.items()} == {"a": "ra", "b": None, "c": None, "d": None}
    assert made["a"]["arguments"] == {"prompt": 'q"\\', "turn": 0}
    for c in made.values():
        assert all(x < y for x, y in pairwise(c)) and all(x < y for x, y in pairwise(c["arguments"]))
    assert got[2].n_calls == 2 and got[2].max_level is None and {r.level for r in every if r.conv_id == 2} == {None}
    assert got[3].n_calls == 0 and not [r for r in every if r.conv_id == 3] and got[None].n_linked == 1
    assert toolcalls.conversations(df.limit(0)).count() == toolcalls.tool_calls(df.limit(0)).count() == 0
