"""Near-duplicate documents by BagMinHash over the multiset of word shingles.

A document is the multiset of its `width`-word shingles (lower case; one shingle of all words where there are fewer).
Its signature has `bands * rows` slots. Each shingle runs Poisson processes over its weight axis, cut into dyadic
intervals [0,1), [1,2), [2,4), ... with rates equal to their lengths; a point counts if it lies below the
shingle's multiplicity. Points arrive by time, each in a slot drawn at random, and a slot keeps its first. Two
documents agree in a slot with the probability of their weighted Jaccard similarity. Only points up to the time by
which all slots are filled are made, so a document costs about slots * (ln slots + 6) points whatever its length.

Equal bands make candidates, and a candidate counts only if the multisets themselves overlap by `threshold` or
more. With 40 bands of 5 slots a pair at 0.8 is missed with probability 1.3e-7. Classes are the connected components
of the links. A text is verified against the least members of its buckets, the least of these first; buckets whose
members are then still of several classes are joined into families, and within a family the members outside its largest
class are compared with all by blocks of signatures. So a link between any two members of a bucket is found, no
pairs are listed, and a group of copies costs a pair a copy.

Equal texts are one class from the start and only one of them is compared. Null texts and texts without words are
each their own class. Rows with equal ids are compared like any others. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.runtime import connected_components, fits, is_key, lean, materialize, numbered, small_batches, with_row_key

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 5
#: Pairs are broadcast up to so many rows (some 20 MB), and joined by a shuffle beyond.
BROADCAST_PAIRS = 300_000
#: Members of one center that are verified by one task at most.
FAN = 512
#: A block of a family holds about so many members, and bags of about so many bytes.
BLOCK = 2048
BLOCK_BYTES = 64 << 20
_MEMO = 200_000
_words: dict[str, int] = {}


def _word_hashes(words: list[str]):
    """A 64-bit hash of each word, from a bounded memo."""
    import numpy as np
    import xxhash

    memo = _words
    if len(memo) > _MEMO:
        memo.clear()
    try:
        found = [memo[w] for w in words]
    except KeyError:
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        found = [memo[w] for w in words]
    return np.array(found, dtype=np.uint64)


def _mix(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int):
    import numpy as np

    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _word_hashes(words)
    k = min(width, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return _mix(out + np.uint64(k))


def signatures(docs: list, slots: int):
    """BagMinHash signatures of multisets: docs holds an array of shingle hashes for each document, with repeats.

    Returns uint64[documents, slots], the identity of the point that came first in each slot."""
    import numpy as np

    out = np.zeros((len(docs), slots), dtype=np.uint64)
    todo, slack = np.array([i for i, d in enumerate(docs) if len(d)], dtype=np.int64), 6.0
    while len(todo):
        sizes = np.array([len(docs[i]) for i in todo])
        which = np.repeat(np.arange(len(todo)), sizes)
        h = np.concatenate([docs[i] for i in todo])
        order = np.lexsort((h, which))
        which, h = which[order], h[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (which[1:] != which[:-1])])
        weight = np.diff(np.r_[first, len(h)])
        which, h = which[first], h[first]
        until = slots / sizes * (math.log(slots) + slack)
        # a process for each shingle and each dyadic interval that begins below its weight
        parts, level = [], 0
        doc, sh, w = which, h, weight
        while len(sh):
            low = 0 if level == 0 else 1 << (level - 1)
            parts.append((doc, _mix(sh + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)), w, np.full(len(sh), low), np.full(len(sh), max(1, low), dtype=np.float64)))
            level += 1
            more = w > (1 << (level - 1))
            doc, sh, w = doc[more], sh[more], w[more]
        doc, seed, w, low, rate = (np.concatenate(x) for x in zip(*parts))
        time, limit = np.zeros(len(seed)), until[doc]
        soonest = np.full(len(todo) * slots, np.inf)
        points = []
        step = 0
        while len(seed):
            step += 1
            draw = _mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            on = time <= limit
            doc, seed, w, low, rate, limit, time, draw = (x[on] for x in (doc, seed, w, low, rate, limit, time, draw))
            other = _mix(draw)
            place = doc * slots + (other % np.uint64(slots)).astype(np.int64)
            # where the point lies in its interval, in whole units of weight
            unit = low + ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
            below = unit < w
            place, at = place[below], time[below]
            np.minimum.at(soonest, place, at)
            points.append((place, at, draw[below]))
        place, at, ident = (np.concatenate(x) for x in zip(*points))
        won = at == soonest[place]
        flat = np.zeros(len(todo) * slots, dtype=np.uint64)
        flat[place[won]] = ident[won]
        filled = np.isfinite(soonest).reshape(len(todo), slots).all(axis=1)
        out[todo[filled]] = flat.reshape(len(todo), slots)[filled]
        todo, slack = todo[~filled], slack * 2
    return out


def band_keys(sig, bands: int, rows: int):
    """A 64-bit key of each band, the band's number included."""
    import numpy as np

    cut = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return key.view(np.int64)


def weighted_jaccard(x: Counter, y: Counter) -> float:
    both = sum(min(n, y[k]) for k, n in x.items() if k in y)
    total = x.total() + y.total() - both
    return both / total if total else 0.0


def _shingles(text: str | None, width: int) -> Counter:
    return Counter(shingle_hashes(text, width).tolist())


def bag_of(hashes):
    """A multiset as a sorted array of distinct numbers: the k-th repeat of a shingle is a number of its own, so the
    overlap of two multisets is the size of a set intersection."""
    import numpy as np

    h = np.sort(hashes)
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
    repeat = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
    with np.errstate(over="ignore"):
        return np.sort(np.where(repeat > 0, _mix(h + repeat.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), h))


def _sign(texts: DataFrame, width: int, bands: int, rows: int, with_signature: bool) -> DataFrame:
    """(id, keys array<long>[, sig binary, bag binary]) of each text that has words."""
    slots = bands * rows

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, texts_of = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(texts_of):
                stop, size = at, 0
                while stop < len(texts_of) and stop - at < 128 and size < 1 << 20:
                    size += len(texts_of[stop] or "")
                    stop += 1
                docs = [shingle_hashes(t, width) for t in texts_of[at:stop]]
                some = np.array([i for i, d in enumerate(docs) if len(d)], dtype=np.int64)
                sig = signatures([docs[i] for i in some], slots)
                keys = band_keys(sig, bands, rows)
                cols = [ids.slice(at, stop - at).take(pa.array(some)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))]
                names = ["id", "keys"]
                if with_signature:
                    small = sig.astype(np.uint32)
                    cols.append(pa.array([row.tobytes() for row in small], pa.binary()))
                    cols.append(pa.array([bag_of(docs[i]).tobytes() for i in some], pa.binary()))
                    names += ["sig", "bag"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = stop

    return texts.select("id", "text").mapInArrow(lean(run), "id long, keys array<long>" + (", sig binary, bag binary" if with_signature else ""))


def _verified(texts: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (u, v), u < v, of texts (id, text) whose multisets overlap by the threshold.

    The text of u stands before those of its partners, which come in portions of at most FAN, so a center with
    any number of partners is many tasks and each text is read once a portion."""
    fan = pairs.groupBy("u").agg(F.count("*").alias("n"))
    dealt = pairs.join(fan, "u").withColumn("portion", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / FAN).cast("long")))
    own = dealt.select("u", "portion").distinct().select(F.col("u").alias("id"), "u", "portion", F.lit(0).alias("kind"))
    sides = materialize(dealt.select(F.col("v").alias("id"), "u", "portion", F.lit(1).alias("kind")).union(own))
    rows = texts.join(F.broadcast(sides) if fits(sides, BROADCAST_PAIRS) else sides, "id").select("u", "portion", "kind", "id", "text")

    def run(batches):
        import pyarrow as pa

        center: tuple = ()
        bag: Counter = Counter()
        for b in batches:
            found: list[tuple[int, int]] = []
            for u, portion, kind, v, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                own_bag = _shingles(text, width)
                if kind == 0:
                    center, bag = (u, portion), own_bag
                elif center == (u, portion) and weighted_jaccard(bag, own_bag) >= threshold:
                    found.append((u, v))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return rows.repartition("u", "portion").sortWithinPartitions("u", "portion", "kind", "id").mapInArrow(lean(run), "u long, v long")


def _families(opened: DataFrame) -> DataFrame:
    """(family, id, class, rest, n_rest, n_all) of the members (id, center, class) of open buckets.

    Members of such buckets that hang together are one family, so that a text stands in one family however many
    of its buckets are open. rest: whether it is outside the family's largest class."""
    families = connected_components(opened.select(F.col("id").alias("u"), F.col("center").alias("v"))).withColumnRenamed("component", "family")
    members = materialize(opened.select("id", "class").distinct().join(families, "id"))
    classes = members.groupBy("family", "class").agg(F.count("*").alias("n"))
    heads = classes.groupBy("family").agg(F.max_by("class", F.struct("n", "class")).alias("head"), F.max("n").alias("n_head"), F.sum("n").alias("n_all"))
    out = members.join(heads, "family").withColumn("rest", F.col("class") != F.col("head"))
    return out.select("family", "id", "class", "rest", (F.col("n_all") - F.col("n_head")).alias("n_rest"), "n_all").where("n_rest > 0")


def _block_links(rows: DataFrame, slots: int, least: float, threshold: float, block: int) -> DataFrame:
    """Links (u, v) between classes of a family, at least one member outside its largest class; enough of them to
    connect all classes that any link connects. rows: (family, id, class, rest, n_rest, n_all, sig, bag).

    The rest in blocks meet all members in blocks; a block pair is one group, of bounded size: blocks are dealt by
    their number of members and by the bytes of their bags. Within it a pair whose signatures agree in a share of at
    least `least` is verified by its multisets, the most alike first,
    unless links found before connect its classes already."""
    size = F.length("bag")
    weight = rows.groupBy("family").agg(F.sum(F.when(F.col("rest"), size)).alias("rest_bytes"), F.sum(size).alias("all_bytes"))
    rows = rows.join(F.broadcast(weight) if fits(weight, BROADCAST_PAIRS) else weight, "family")
    rest_blocks, all_blocks = (F.ceil(F.greatest(F.col(f"n_{k}") / block, F.col(f"{k}_bytes") / BLOCK_BYTES)).cast("int") for k in ("rest", "all"))
    place = lambda n: F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    left = rows.where("rest").withColumn("i", place(rest_blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), all_blocks - 1))).withColumn("side", F.lit(0))
    right = rows.withColumn("j", place(all_blocks)).withColumn("i", F.explode(F.sequence(F.lit(0), rest_blocks - 1))).withColumn("side", F.lit(1))
    cols = ["family", "i", "j", "side", "id", "class", "sig", "bag"]

    def compare(table):
        import numpy as np
        import pyarrow as pa

        side, ids, cls = (np.asarray(table.column(c).to_pylist(), dtype=np.int64) for c in ("side", "id", "class"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(len(ids), slots)
        bags = [np.frombuffer(x, dtype=np.uint64) for x in table.column("bag").to_pylist()]
        everyone = np.flatnonzero(side == 1)
        columns, theirs = np.ascontiguousarray(sig[everyone].T), cls[everyone]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = c = root.get(root[c], root[c])
            return c

        us, vs = [], []
        for r in np.flatnonzero(side == 0):
            same = np.zeros(len(everyone), dtype=np.uint16)
            for k in range(slots):
                same += columns[k] == sig[r, k]
            close = np.flatnonzero((same >= least * slots) & (theirs != cls[r]))
            for k in everyone[close[np.argsort(same[close], kind="stable")[::-1]]]:
                mine, other = find(int(cls[r])), find(int(cls[k]))
                if mine == other:
                    continue
                x, y = bags[r], bags[k]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both):
                    root[max(mine, other)] = min(mine, other)
                    us.append(ids[r])
                    vs.append(ids[k])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return left.select(cols).union(right.select(cols)).groupBy("family", "i", "j").applyInArrow(compare, "u long, v long")


def links(texts: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Classes (id, component) of the texts (id long, text) that are linked to another; ids are unique.

    Every text is first verified against the least center of its buckets, one pair a text; then texts that are in
    another class than a center of theirs against the other centers; what is still open goes to the families."""
    signed = _sign(texts, width, bands, rows, with_signature=False)
    buckets = materialize(signed.select("id", F.explode("keys").alias("bucket")))
    several = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1")
    members = materialize(buckets.join(several, "bucket"))
    pairs = materialize(members.where("id <> center").groupBy(F.col("id").alias("v")).agg(F.min("center").alias("u")).select("u", "v"))
    edges = materialize(_verified(texts, pairs, width, threshold))
    classes = materialize(connected_components(edges))

    opened = materialize(_open(members, classes))
    more = opened.where("id <> center and class <> head").select(F.col("center").alias("u"), F.col("id").alias("v")).distinct()
    more = materialize(more.join(pairs, ["u", "v"], "left_anti"))
    edges = materialize(edges.union(_verified(texts, more, width, threshold)))
    classes = materialize(connected_components(edges))

    # with two members nothing but their pair was open
    opened = materialize(_open(members.where("n > 2"), classes).where("id <> center"))
    if opened.isEmpty():
        return classes
    family = materialize(_families(opened))
    wanted = family.select("id")
    wanted = texts.join(F.broadcast(wanted) if fits(wanted, BROADCAST_PAIRS) else wanted, "id", "left_semi")
    again = materialize(_sign(wanted, width, bands, rows, with_signature=True))
    # five standard deviations of the estimate at the threshold
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (bands * rows))
    return connected_components(edges.union(_block_links(family.join(again.select("id", "sig", "bag"), "id"), bands * rows, least, threshold, block)))


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, id, center, class, head) of the buckets whose members are of several classes; head is the center's."""
    named = members.select("bucket", "id", "center").join(classes.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    several = named.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("z"), F.min_by("class", "id").alias("head")).where("a <> z").select("bucket", "head")
    return named.join(several, "bucket").select("bucket", "id", "center", "class", "head")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, class_id, kept) for every row: the class's least id, and whether the row is the one that stays."""
    small_batches(docs.sparkSession)
    base, unique = numbered(docs, id_col, text_col)
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\s\p{Z}]")
    keyed = base.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text"), "words": has_words})
    hashed = materialize(keyed.drop("text"))
    key = ["k1", "k2"]
    copies = materialize(hashed.where("words").groupBy(key).agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    side = F.broadcast(copies) if fits(copies, BROADCAST_PAIRS) else copies
    texts = keyed.where("words").join(side, key, "left").where("rep is null or rep = doc").select(F.col("doc").alias("id"), "text")
    classes = links(texts, width, threshold, bands, rows, block).withColumnsRenamed({"id": "rep", "component": "class"})
    placed = hashed.where("words").join(side, key, "left").select("doc", "id", F.coalesce("rep", "doc").alias("rep"))
    placed = placed.join(classes, "rep", "left").select("doc", "id", F.coalesce("class", "rep").alias("class"))
    alone = hashed.where("not words").select("doc", "id", F.col("doc").alias("class"))
    placed = placed.union(alone)
    if unique:
        return placed.select(F.col("id").alias(id_col), F.col("class").alias("class_id"), (F.col("doc") == F.col("class")).alias("kept"))
    placed = materialize(placed)
    first = placed.groupBy("class").agg(F.min(F.struct("id", "doc")).alias("first"))
    return placed.join(first, "class").select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), (F.col("doc") == F.col("first.doc")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, exactly one of each class: that with the least id, null first, and of rows with one
    id that with the least hash of its text. Rows without words are classes of their own."""
    if is_key(docs, id_col):
        near = materialize(near_duplicates(docs, id_col, text_col))
        gone = near.where("not kept").select(F.col(id_col).alias("__gone"))
        side = F.broadcast(gone) if fits(gone, BROADCAST_PAIRS) else gone
        return docs.join(side, docs[id_col] == side["__gone"], "left_anti")
    rows = with_row_key(docs)
    near = near_duplicates(rows, "__row", text_col).select("__row", "class_id")
    named = rows.select("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), "__row").alias("first"))
    stay = materialize(near.join(named, "__row").groupBy("class_id").agg(F.min("first").alias("first"))).select(F.col("first.__row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").select(*docs.columns)
