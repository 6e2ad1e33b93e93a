"""Main text of web pages.

A page is read as a stream of tags and text and cut into blocks. Markup tells most of what is not the article:
menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles, by element,
role and class. Where a page marks its article (article, main, or an article body), that is the text.

For pages that don't, the suffix array of their host decides: the token streams of its pages, sorted by suffix. It is
kept in pieces, one for each host and first `tokens` tokens, since suffixes that share fewer don't matter; in a piece,
sorted suffixes and the length that each shares with its neighbour give the long repeated substrings. What such
substrings cover, on a substantial share of the host's distinct pages, is boilerplate, and the unique runs stay.
Pages with equal blocks are one page, so an article under several addresses doesn't count against itself. A substring
is left to its first token's piece, so a host with a third of all pages is as many pieces as it has prefixes, and equal
suffixes are counted together before a piece is sorted.

Null and empty pages give an empty text. Pages of any length are read whole, in time linear in their length also where
they are malformed: a tag that isn't closed within LONGEST_TAG characters ends at the next >, and without one it is
text. Repeated rows are extracted alike. Empty tables give empty results; other columns are ignored, so their names
can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modalith.llm.linkgraph import host_of
from modalith.llm.runtime import lean, materialize, small_batches

#: Tokens that a substring must have to count as repeated, the share of a host's distinct pages that must have it, and
#: the tokens up to which a suffix is compared; a longer substring is found as overlapping ones.
TOKENS, SHARE, CONTEXT = 8, 0.2, 32
#: Elements whose content is never text of the article.
DROPPED = frozenset("nav header footer aside form button select datalist menu dialog iframe object noscript template svg math canvas audio video head title".split())
#: Elements whose content is not markup; it ends at their own end tag only.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the key is closed by the start of one of these.
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id values that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login comment comments reply replies disqus discussion respond share sharing social related recommended widget toolbar pagination pager".split())
TAG = re.compile(r"<[/!?]?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*+>", re.S)
OPENS = re.compile(r"<[/!?]?[a-zA-Z]|<[!?]")
LONGEST_TAG = 4096
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
SKIP, OPEN, MAIN = 0, 1, 2
CLOSERS = frozenset().union(*CLOSED_BY.values())


def pieces_of(page: str):
    """The page as a stream of tags, comments and text. Each step moves on, and none looks further than what it takes,
    but for one search of the page's last > a step would repeat."""
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = size if end < 0 else end + 3
        elif at > last:
            end = size  # nothing closes a tag any more
        elif m := TAG.match(page, at, min(size, at + LONGEST_TAG)):
            end = m.end()
        elif OPENS.match(page, at):
            end = page.find(">", at) + 1
        else:
            end = at + 1  # a lone <
        end = (yield page[at:end], end) or end
        at = end


def zone_of(name: str, tag: str) -> int:
    """SKIP, MAIN, or OPEN for an element that says nothing, from its name and attributes."""
    if name in DROPPED:
        return SKIP
    found = MAIN if name in ("article", "main") else OPEN
    if "=" not in tag and "hidden" not in tag:
        return found
    for m in ATTRIBUTE.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES or key == "style" and "display:none" in value.replace(" ", ""):
            return SKIP
        if key in ("class", "id") and found != MAIN and not MARKS.isdisjoint(WORDS.split(value)):
            return SKIP
        if key == "role" and value == "main" or key == "itemprop" and value == "articlebody":
            found = MAIN
    return found


def blocks_of(page: str | None) -> tuple[list[str], bool]:
    """Blocks of the article, and whether the page marks it; else the blocks that nothing rules out."""
    page = page or ""
    main: list[str] = []
    open_: list[str] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, zone before it, depth of skipping before it
    depth: Counter = Counter()  # how many of each name are open
    zone, skipping, marked = OPEN, 0, False

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                (main if zone == MAIN else open_).append(text)

    stream = pieces_of(page)
    jump = None
    while True:
        try:
            tag, at = stream.send(jump)
        except StopIteration:
            break
        jump = None
        named = NAME.match(tag) if tag[0] == "<" else None
        if named is None or at == len(page) and tag[-1] != ">":
            if not skipping and not OPENS.match(tag):
                held.append(tag)
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if not depth[name]:
                if name == "p" and not skipping:
                    flush()
                continue
            if name in BLOCKS and not skipping:
                flush()
            while True:
                last, zone_before, skip_before = stack.pop()
                depth[last] -= 1
                if not skip_before and skipping or zone_before != zone:
                    flush()
                    zone = zone_before
                skipping = skip_before
                if last == name:
                    break
            continue
        if name == "br":
            if not skipping:
                held.append(" ")
            continue
        if name in BLOCKS and not skipping:
            flush()
        if name in VOID or tag.endswith("/>") and name in ("path", "circle", "rect"):
            continue
        for k in range(len(stack) - 1, -1, -1) if name in CLOSERS else ():
            if name in CLOSED_BY.get(stack[k][0], ()):
                while len(stack) > k:
                    gone, zone_before, skip_before = stack.pop()
                    depth[gone] -= 1
                    if zone_before != zone:
                        flush()
                        zone = zone_before
                    skipping = skip_before
                break
            if stack[k][0] in BLOCKS:
                break
        if name in RAW:
            end = RAW_ENDS[name].search(page, at)
            jump = end.end() if end else len(page)
            continue
        kind = zone_of(name, tag)
        if kind == SKIP or kind == MAIN and not skipping and zone != MAIN:
            flush()
        stack.append((name, zone, skipping))
        depth[name] += 1
        if kind == SKIP:
            skipping += 1
        elif kind == MAIN and not skipping:
            zone, marked = MAIN, True
    flush()
    return (main, True) if marked and main else (open_, False)


def parsed(pages: DataFrame) -> DataFrame:
    """(id, url, host, n, blocks, marked) of pages (id, url, host, n, html); n is a key of the row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [blocks_of(p) for p in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([m or not x for x, m in found])], names=["id", "url", "host", "n", "blocks", "marked"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(lean(run), f"id {kind}, url string, host string, n long, blocks array<string>, marked boolean")


def shared_length(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def repeated_lengths(suffixes: list[list[str]], pages: list[int], least: int, tokens: int) -> list[int]:
    """For each of the sorted distinct suffixes of a piece the length of the longest of its prefixes, `tokens` or more,
    that suffixes with `least` or more pages in all share; 0 if there is none. pages: of each suffix, where a page with
    several suffixes in the piece counts for its first one only. So no page counts twice in an interval; the interval of
    the whole piece has all its pages, and windows further on have pieces of their own.

    The common-prefix intervals of the array by a stack scan: an interval's pages are those of its suffixes."""
    best = [0] * len(suffixes)
    stack: list[tuple[int, int, int]] = []  # length, first suffix, pages so far

    def close(length: int, first: int, count: int, end: int) -> None:
        if length >= tokens and count >= least:
            for k in range(first, end):  # intervals nest no deeper than a suffix is long
                best[k] = max(best[k], length)

    for i, s in enumerate(suffixes):
        common = shared_length(suffixes[i - 1], s) if i else 0
        first, count, inner = i, 0, False
        while stack and stack[-1][0] > common:
            inner = True
            length, first, more = stack.pop()
            count += more
            close(length, first, count, i)
        if stack and stack[-1][0] == common:
            stack[-1] = (common, stack[-1][1], stack[-1][2] + count)
        elif inner:
            stack.append((common, first, count))
        stack.append((len(s), i, pages[i]))
    count, end = 0, len(suffixes)
    while stack:
        length, first, more = stack.pop()
        count += more
        close(length, first, count, end)
    return best


def unique_runs(pages: DataFrame, tokens: int = TOKENS, share: float = SHARE, context: int = CONTEXT) -> DataFrame:
    """(host, body, text): distinct bodies (host, body, blocks) of the hosts' pages without what repeats on `share` of
    them, two at least."""
    words = F.flatten(F.transform("blocks", lambda b, i: F.transform(F.split(b, " "), lambda w: F.struct(i.alias("block"), w.alias("word")))))
    bodies = materialize(pages.select("host", "body", words.alias("ws")))
    sizes = bodies.groupBy("host").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * share)).cast("long").alias("least")).where("least >= 2")

    starts = F.transform(F.sequence(F.lit(1), F.size("ws") - tokens + 1), lambda i: F.struct((i - 1).alias("pos"), F.transform(F.slice("ws", i, context), lambda w: w["word"]).alias("suffix")))
    suffixes = bodies.where(F.size("ws") >= tokens).select("host", "body", F.explode(starts).alias("s")).select("host", "body", "s.pos", "s.suffix")
    suffixes = materialize(suffixes.withColumns({"piece": F.xxhash64("host", F.slice("suffix", 1, tokens)), "key": F.xxhash64("suffix")}))
    # what every page has, such as a menu, is one row with its number of pages before a piece is sorted
    place = F.row_number().over(Window.partitionBy("piece", "host", "body").orderBy("pos"))  # a page's own repeats
    counted = suffixes.withColumn("one", F.when(place == 1, 1).otherwise(0)).groupBy("host", "piece", "key").agg(F.sum("one").alias("pages"), F.first("suffix").alias("suffix"))
    several = suffixes.groupBy("piece").agg(F.min("body").alias("a"), F.max("body").alias("z")).where("a <> z").select("piece")
    rows = counted.join(several, "piece", "left_semi").join(sizes, "host").select("piece", "key", "suffix", "pages", "least")

    def scan(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def done():
            lengths = repeated_lengths([r[2] for r in held], [r[3] for r in held], held[0][4], tokens)
            return [(r[0], r[1], n) for r, n in zip(held, lengths) if n]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["piece", "key", "length"])

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and held[0][0] != row[0]:
                    out += done()
                    held = []
                held.append(row)
            yield batch(out)
        if held:
            yield batch(done())

    found = rows.repartition("piece").sortWithinPartitions("piece", "suffix").mapInArrow(lean(scan), "piece long, key long, length long")
    covered = suffixes.join(found, ["piece", "key"]).groupBy("host", "body").agg(F.collect_list(F.struct("pos", "length")).alias("spans"))

    def strip(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for ws, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                keep = [True] * len(ws)
                for s in spans or ():
                    for k in range(s["pos"], min(len(ws), s["pos"] + s["length"])):
                        keep[k] = False
                lines: dict[int, list[str]] = {}
                for w, k in zip(ws, keep):
                    if k:
                        lines.setdefault(w["block"], []).append(w["word"])
                texts.append("\n".join(" ".join(line) for line in lines.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["host", "body", "unique"])

    return bodies.join(covered, ["host", "body"], "left").select("host", "body", "ws", "spans").mapInArrow(lean(strip), "host string, body long, unique string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tokens: int = TOKENS, share: float = SHARE) -> DataFrame:
    """(id, url, text, n_chars) for every row. Each page is parsed once."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.monotonically_increasing_id().alias("n"), F.col(html_col).alias("html"))
    found = materialize(parsed(rows)).withColumn("text", F.array_join("blocks", "\n"))
    undecided = found.where("not marked").withColumn("body", F.xxhash64("blocks"))
    out = found.where("marked").select("id", "url", "text")
    if not undecided.isEmpty():
        bodies = undecided.groupBy("host", "body").agg(F.first("blocks").alias("blocks"))
        runs = unique_runs(bodies, tokens, share)
        out = out.union(undecided.join(runs, ["host", "body"]).select("id", "url", F.col("unique").alias("text")))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
