"""Repeated byte strings across documents, from enhanced suffix arrays over content-defined anchors.

Texts are UTF-8 bytes. Every window of `length` bytes picks an anchor: the leftmost of its `gram`-byte substrings
with the least hash. Equal windows pick the same place, wherever they stand, so a string can repeat only where its
anchor's gram does. The suffixes that start at the anchors of one gram are one suffix array, independent of all
others. Its common-prefix interval tree is walked bottom-up on a stack; at each interval (a right extension shared
by all its suffixes) the left extensions are kept sorted and merged small into large, so that each occurrence meets
the neighbour with which it shares most on the left. Left and right extension together of at least `length` bytes
make a repeat. So all occurrences of a repeat are found, not just neighbours in the array.

What is done before that keeps groups small without dropping anything: grams that occur once are set aside;
occurrences whose whole context occurs twice are settled by counting, with one of them kept as a partner for the
rest; and a gram with more than `most` different contexts is split by ranges of window starts, each range keyed by
the bytes that all its windows share, until the parts are small or settled. So no task gets an unbounded group.

Null texts are empty. Texts shorter than `length` lose nothing. Repeated ids are told apart by a row number within
the id, since the rows of an id are ordered by text. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.runtime import forget, is_key, lean, materialize, numbered, release, small_batches, with_row_key

LENGTH = 400
#: Passages of 50 words: so many bytes at five a word, the space included.
PASSAGE = 250
GRAM = 32
MOST = 8192
CHUNK = 1 << 19
_POS = (1 << 24) - 1
ANCHORS = "doc long, lo int, hi int, a int, key long, cx long"


def gram_hashes(data, gram: int):
    """A 64-bit hash of the `gram` bytes (a power of two) that start at each place."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
        n, factor = 1, 0xD6E8FEB86659FD93
        while n < gram:
            h = h[:-n] * np.uint64(factor) + h[n:]
            factor = factor * factor + 2 * n & (1 << 64) - 1 | 1
            n *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def least_places(h, width: int):
    """For each window of `width` hashes the place of its least, the leftmost among equals (of 40 bits of hash)."""
    import numpy as np

    n = len(h)
    v = h & np.uint64(~_POS & (1 << 64) - 1) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return (np.minimum(back[:last], ahead[width - 1 : width - 1 + last]) & np.uint64(_POS)).astype(np.int64)


def anchor_runs(data, offsets, length: int, gram: int):
    """Runs of window starts with one anchor: arrays (document index, lo, hi, anchor, key); places in data.

    data: bytes of several documents end to end; offsets: where each begins, and the end of the last."""
    import numpy as np

    out = []
    n_docs = len(offsets) - 1
    i = 0
    while i < n_docs:
        j = i + 1
        while j < n_docs and offsets[j + 1] - offsets[i] <= CHUNK:
            j += 1
        begin, end = int(offsets[i]), int(offsets[j])
        # a document beyond the chunk size is taken in pieces that overlap by a window
        for at in range(begin, max(begin + 1, end - length + 1), 8 * CHUNK):
            stop = min(end, at + 8 * CHUNK + length - 1) if end - begin > CHUNK else end
            if stop - at < length:
                continue
            part = data[at:stop]
            h = gram_hashes(part, gram)
            place = least_places(h, length - gram + 1)
            edge = np.zeros(len(place) + 1, dtype=np.int32)
            starts, ends = np.maximum(offsets[i:j], at) - at, np.minimum(offsets[i + 1 : j + 1], stop) - at - length + 1
            long = ends > starts
            np.add.at(edge, starts[long], 1)
            np.add.at(edge, np.minimum(ends[long], len(place)), -1)
            where = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if len(where):
                a = place[where]
                first = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(where) != 1)])
                final = np.r_[first[1:] - 1, len(where) - 1]
                out.append((where[first] + at, where[final] + at, a[first] + at, h[a[first]]))
        i = j
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z.astype(np.uint64)
    lo, hi, a, key = (np.concatenate(x) for x in zip(*out))
    # a run that was cut where two pieces of a long document meet is one run
    glue = np.flatnonzero((a[1:] == a[:-1]) & (lo[1:] == hi[:-1] + 1))
    for k in glue[::-1]:
        hi[k] = hi[k + 1]
    keep = np.ones(len(a), dtype=bool)
    keep[glue + 1] = False
    lo, hi, a, key = lo[keep], hi[keep], a[keep], key[keep]
    return np.searchsorted(offsets, lo, side="right") - 1, lo, hi, a, key


def _bytes_of(column):
    """(bytes as a numpy array, offsets) of an Arrow column of texts; null is empty."""
    import numpy as np
    import pyarrow as pa

    c = column.cast(pa.large_binary())
    if c.null_count:
        c = c.fill_null(b"")
    offsets = np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """ANCHORS of (doc, text): a row for each run; places within the text; cx hashes the whole context."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            data, offsets = _bytes_of(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            doc, lo, hi, a, key = anchor_runs(data, offsets, length, gram)
            view, one = memoryview(data), xxhash.xxh3_64_intdigest
            cx = np.fromiter((one(view[s : e + length]) for s, e in zip(lo.tolist(), hi.tolist())), dtype=np.uint64, count=len(lo))
            base = offsets[doc] if len(doc) else lo
            cols = [ids[doc].astype(np.int64), *((x - base).astype(np.int32) for x in (lo, hi, a)), key.view(np.int64), cx.view(np.int64)]
            table = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "lo", "hi", "a", "key", "cx"])
            for k in range(0, table.num_rows, 50_000):
                yield table.slice(k, 50_000)

    return docs.mapInArrow(lean(run), ANCHORS)


def shared_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n  # the first `low` bytes agree, the first `high` don't
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def extents(contexts: list[tuple[bytes, int]], length: int, groups: list | None = None) -> list[tuple[int, int]]:
    """For each (context, place of the anchor in it), how far left and right of the anchor it is covered by strings
    of `length` bytes that another context shares: (0, 0) if by none. groups: gets the maximal repeats through the
    anchor as (left, right, members), each with at least `length` bytes and all its occurrences.

    The suffix array of the contexts from the anchor on, its common-prefix intervals from a stack scan, and at
    each interval the members by their left contexts read backwards."""
    m = len(contexts)
    right = [c[p:] for c, p in contexts]
    left = [c[:p][::-1] for c, p in contexts]
    reach = [[0, 0] for _ in range(m)]
    if m < 2:
        return [(0, 0)] * m

    order = sorted(range(m), key=right.__getitem__)
    by_left = sorted(range(m), key=left.__getitem__)
    rank = [0] * m
    for k, x in enumerate(by_left):
        rank[x] = k

    def meet(x: int, y: int, r: int) -> None:
        shared = shared_prefix(left[x], left[y])
        if shared + r >= length:
            for z in (reach[x], reach[y]):
                z[0], z[1] = max(z[0], shared), max(z[1], r)

    def merge(into: list[int], other: list[int], r: int) -> list[int]:
        """The members of both as ranks by left context; every pair of new neighbours meets."""
        if len(into) < len(other):
            into, other = other, into
        for k in other:
            at = bisect_left(into, k)
            if at:
                meet(by_left[into[at - 1]], by_left[k], r)
            if at < len(into):
                meet(by_left[into[at]], by_left[k], r)
            into.insert(at, k)
        return into

    def closed(members: list[int], r: int) -> None:
        """Report the classes of an interval by left extension: those of at least `length` bytes whose occurrences
        differ on the left (or end there) and on the right."""
        if groups is None or len(members) < 2:
            return
        common = [shared_prefix(left[by_left[s]], left[by_left[t]]) for s, t in zip(members, members[1:])]
        levels = sorted({c for c in common if c + r >= length})
        for c in levels:
            run = [members[0]]
            for s, t in zip(common + [-1], members[1:] + [None]):
                if s >= c:
                    run.append(t)
                    continue
                if len(run) > 1:
                    who = [by_left[k] for k in run]
                    ends = {right[x][r : r + 1] or (x,) for x in who}
                    before = {left[x][c : c + 1] or (x,) for x in who}
                    if len(ends) > 1 and len(before) > 1:
                        groups.append((c, r, sorted(who)))
                run = [t]

    stack: list[tuple[int, list[int]]] = []
    last = [rank[order[0]]]
    for x, y in zip(order, order[1:]):
        h = shared_prefix(right[x], right[y])
        while stack and stack[-1][0] > h:
            r, members = stack.pop()
            last = merge(members, last, r)
            closed(last, r)
        if stack and stack[-1][0] == h:
            stack[-1] = (h, merge(stack[-1][1], last, h))
        else:
            stack.append((h, last))
        last = [rank[y]]
    while stack:
        r, members = stack.pop()
        last = merge(members, last, r)
        closed(last, r)
    return [(a, b) for a, b in reach]


def _grouped(batches, columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of a stream that is sorted by its first column, group by group."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns)):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_arrays(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi) covered, from (key, doc, a, p, n, ctx): each key's contexts are one suffix array. Rows with
    n > 1 are partners only."""

    def run(batches):
        import pyarrow as pa

        out: tuple[list, list, list] = ([], [], [])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["doc", "lo", "hi"])
            for x in out:
                x.clear()
            return batch

        for rows in _grouped(batches, ["key", "doc", "a", "p", "n", "ctx"]):
            found = extents([(r[5], r[3]) for r in rows], length)
            for (_, doc, a, _, n, _), (back, on) in zip(rows, found):
                if n == 1 and back + on >= length:
                    for x, v in zip(out, (doc, a - back, a + on)):
                        x.append(v)
            if len(out[0]) >= 20_000:
                yield flush()
        yield flush()

    sorted_rows = contexts.repartition("key").sortWithinPartitions("key", "doc", "a")
    return sorted_rows.mapInArrow(lean(run), "doc long, lo int, hi int")


def _split(hot: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Settle contexts of grams with too many: (covered intervals, contexts for arrays).

    hot: (key, doc, a, p, n, ctx). Window starts relative to the anchor lie in [gram - length, 0]. A range [u, v]
    of them is halved at each step. All its windows share the bytes from v to u + length, so only contexts with
    equal bytes there can match in it; within the range's own context, equal ones settle each other."""
    spark = hot.sparkSession
    rows = hot.withColumns({"u": F.lit(gram - length), "v": F.lit(0)})
    covered = spark.createDataFrame([], "doc long, lo int, hi int")
    arrays = spark.createDataFrame([], hot.schema)
    while True:
        mid = F.floor((F.col("u") + F.col("v")) / 2).cast("int")
        halves = F.array(F.struct(F.col("u"), mid.alias("v")), F.struct((mid + 1).alias("u"), F.col("v")))
        rows = rows.withColumn("r", F.explode(halves)).withColumns({"u": F.col("r.u"), "v": F.col("r.v")}).drop("r").where("u <= v")
        # the part of the context that the range's windows in this row span
        first = F.greatest(-F.col("p"), F.col("u"))
        final = F.least(F.length("ctx") - F.col("p") - length, F.col("v"))
        rows = rows.where(first <= final)
        shared = F.substring("ctx", F.col("p") + F.col("v") + 1, F.col("u") - F.col("v") + length)
        rows = rows.withColumn("key", F.xxhash64("key", "u", "v", shared))
        rows = rows.withColumn("ctx", F.substring("ctx", F.col("p") + first + 1, final - first + length)).withColumn("p", -first)
        rows = materialize(rows.withColumn("cx", F.xxhash64("ctx", "p")))
        alike = rows.groupBy("key", "cx").agg(F.sum("n").alias("total"), F.min(F.struct("doc", "a")).alias("one"))
        alike = materialize(alike)
        many = alike.groupBy("key").agg(F.count("*").alias("d")).where("d > 1")
        joined = rows.join(alike, ["key", "cx"])
        settled = joined.where("total > 1 and n = 1").select("doc", (F.col("a") - F.col("p")).cast("int").alias("lo"), (F.col("a") - F.col("p") + F.length("ctx")).cast("int").alias("hi"))
        covered = covered.union(settled)
        rest = joined.where("doc = one.doc and a = one.a").join(many, "key").withColumn("n", F.col("total")).drop("cx", "total", "one")
        rest = materialize(rest)
        arrays = arrays.union(rest.where(F.col("d") <= most).select(arrays.columns))
        rows = rest.where((F.col("d") > most) & (F.col("u") < F.col("v"))).drop("d")
        if rows.isEmpty():
            return covered, arrays


def covered_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, list[DataFrame]]:
    """((doc, lo, hi), tables): bytes lo to hi of document doc are covered by strings of `length` bytes that also
    start elsewhere. Intervals of a document may overlap. docs: (doc long, text), doc unique. tables are those that
    the plan reads; they can go when it has run."""
    small_batches(docs.sparkSession)
    runs = materialize(anchors(docs, length, gram))
    alike = materialize(runs.groupBy("key", "cx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "lo", "hi", "a")).alias("one")))
    copies = runs.join(alike.where("n > 1").select("key", "cx"), ["key", "cx"], "left_semi").select("doc", "lo", (F.col("hi") + length).alias("hi"))
    whole = materialize(copies, runs)

    many = alike.groupBy("key").agg(F.count("*").alias("d")).where("d > 1")
    reps = alike.join(many, "key").groupBy(F.col("one.doc").alias("doc")).agg(F.collect_list(F.struct("one.lo", "one.hi", "one.a", "key", "n", "d")).alias("runs"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = _bytes_of(b.column(1))
            out: list[tuple] = []
            for doc, base, runs_of in zip(b.column(0).to_pylist(), offsets.tolist(), b.column(2).to_pylist()):
                for r in runs_of:
                    out.append((r["key"], doc, r["a"], r["a"] - r["lo"], r["n"], data[base + r["lo"] : base + r["hi"] + length].tobytes(), r["d"]))
            for k in range(0, len(out), 5_000):
                part = out[k : k + 5_000]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), kinds)], names=["key", "doc", "a", "p", "n", "ctx", "d"])

    contexts = docs.join(reps, "doc").select("doc", "text", "runs").mapInArrow(lean(cut), "key long, doc long, a int, p int, n long, ctx binary, d long")
    hot_keys = many.where(F.col("d") > most)
    if hot_keys.isEmpty():
        return whole.union(_in_arrays(contexts.drop("d"), length)), [alike, whole]
    contexts = materialize(contexts, alike)
    covered, arrays = _split(contexts.where(F.col("d") > most).drop("d"), length, gram, most)
    return whole.union(covered).union(_in_arrays(contexts.where(F.col("d") <= most).drop("d").union(arrays), length)), [contexts, whole]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching intervals."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    pieces, last = [], 0
    for lo, hi in runs:
        pieces.append(text[last:lo])
        last = hi
    return b"".join([*pieces, text[last:]])


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(doc, spans array<struct<lo, hi>>), a table of its own: the covered intervals of each document that has any."""
    found, tables = covered_intervals(docs, length, gram, most)
    found = materialize(found.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    forget(*tables)
    release(docs.sparkSession)
    return found


def spans_within(docs: DataFrame, outer: DataFrame, length: int, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """As spans(docs, length), from the spans `outer` of a smaller length: a repeated string of `length` bytes is
    repeated in all its shorter parts too, so it lies within a run of the outer spans that is at least as long. Only
    such runs are searched, as texts of their own."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for doc, text, found in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(doc, lo, raw[lo:hi]) for lo, hi in merged([(s["lo"], s["hi"]) for s in found]) if hi - lo >= length]
            for k in range(0, len(out), 1_000):
                part = out[k : k + 1_000]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), [pa.int64(), pa.int32(), pa.binary()])], names=["whole", "at", "text"])

    pieces = docs.join(outer, "doc").select("doc", "text", "spans").mapInArrow(lean(cut), "whole long, at int, text binary")
    pieces = materialize(pieces.withColumn("doc", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    found, tables = covered_intervals(pieces.select("doc", "text"), length, gram, most)
    place = pieces.select("doc", "whole", "at")
    found = found.join(place, "doc").groupBy("whole").agg(F.collect_list(F.struct((F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi"))).alias("spans"))
    found = materialize(found.withColumnRenamed("whole", "doc"), *tables, pieces)
    release(docs.sparkSession)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, passage: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row: kept is the text without each byte that a
    repeated string of `length` bytes covers, all its occurrences alike. kept drops what is left of a character
    that a removed run cuts; the digest is of the remaining bytes as they are.

    With `passage`, a length below `length`, the rows also have without_passages, the text without repeats of so
    many bytes; then the longer ones are searched within the shorter ones' runs."""
    rows, _ = numbered(docs, id_col, text_col)
    base = rows.select("doc", "text")
    if passage is None:
        found = spans(base, length, gram, most).withColumn("short", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    else:
        short = spans(base, passage, gram, most)
        found = spans_within(base, short, length, gram, most)
        found = short.withColumnRenamed("spans", "short").join(found, "doc", "left").select("doc", "spans", "short")
    more = passage is not None

    def run(batches):
        import pyarrow as pa

        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "without_passages"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out: list[list] = [[] for _ in kinds]
                for text, found, short in zip(part.column(1).cast(pa.large_binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    text = text or b""
                    runs = merged([(s["lo"], s["hi"]) for s in found or ()])
                    rest = without(text, runs)
                    bare = without(text, merged([(s["lo"], s["hi"]) for s in short or ()])).decode("utf-8", "ignore") if more else None
                    for x, v in zip(out, (len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"), bare)):
                        x.append(v)
                columns = [part.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))]
                yield pa.RecordBatch.from_arrays(columns[: 6 + more], names=names[: 6 + more])

    kind = rows.schema["id"].dataType.simpleString()
    joined = rows.join(found, "doc", "left").select("id", "text", "spans", "short")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string" + ", without_passages string" * more
    return joined.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(repeat, length, doc, start): the maximal repeats of at least `length` bytes with every occurrence, cut to the
    context of the anchor through which they were found (so a longer repeat appears as a chain of overlapping
    ones). A gram's contexts must fit in a task."""
    rows, _ = numbered(docs, id_col, text_col)
    runs = materialize(anchors(rows.select("doc", "text"), length, gram))
    many = runs.groupBy("key").agg(F.count("*").alias("d")).where("d > 1")
    reps = runs.join(many, "key").groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "a", "key")).alias("runs"))
    cuts = F.transform("runs", lambda r: F.struct(r["key"].alias("key"), r["a"].alias("a"), (r["a"] - r["lo"]).alias("p"), F.substring(F.encode("text", "UTF-8"), r["lo"] + 1, r["hi"] - r["lo"] + length).alias("ctx")))
    contexts = rows.join(reps, "doc").select("id", F.explode(cuts).alias("c")).select("c.key", F.col("id").cast("long").alias("doc"), "c.a", "c.p", "c.ctx")

    def run(batches):
        import pyarrow as pa

        for rows_of in _grouped(batches, ["key", "doc", "a", "p", "ctx"]):
            groups: list = []
            extents([(r[4], r[3]) for r in rows_of], length, groups)
            out = [(f"{rows_of[0][0]:x}-{k}", back + on, rows_of[x][1], rows_of[x][2] - back) for k, (back, on, who) in enumerate(groups) for x in who]
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["repeat", "length", "doc", "start"])

    return contexts.repartition("key").sortWithinPartitions("key", "doc", "a").mapInArrow(lean(run), "repeat string, length long, doc long, start long")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = PASSAGE) -> DataFrame:
    """docs with each repeated passage removed from the text and its number of characters brought up to date.

    The rows themselves meet their spans, by id where ids are a key and else by a number given to each row."""
    if not is_key(docs, id_col):
        return strip_repeats(with_row_key(docs), "__row", text_col, chars_col, length).select(*docs.columns)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = spans(base, length).withColumnsRenamed({"spans": "__spans", "doc": "__doc"})
    rows = docs.join(found, docs[id_col] == found["__doc"], "left").drop("__doc")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = []
            for text, found in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if found:
                    text = without(text.encode("utf-8"), merged([(s["lo"], s["hi"]) for s in found])).decode("utf-8", "ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "__text"])

    rows = rows.mapInArrow(lean(run), f"{schema}, __text string")
    changed = F.col("__spans").isNotNull()
    return rows.select(*(F.col("__text").alias(c) if c == text_col else F.when(changed, F.char_length("__text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"`{c}`") for c in docs.columns))
