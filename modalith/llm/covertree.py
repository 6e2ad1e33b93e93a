"""Exact threshold pairs of embeddings by cosine, from a dual traversal of cover trees.

Unit vectors within a cosine of each other lie within a Euclidean distance, so a pair of tree nodes whose centers are
further apart than that distance plus both covering radii holds no link, and is pruned with all below it. Nodes are
nested: each level's centers cover their members within half the radius of the level above. A tree grows only where the
traversal looks into it, and where a sample says that the next level would rule out little, all pairs below are
compared at once.

The top level is distributed. Centers drawn from the table by hash (at most PIVOTS, a bounded sample) take the
vectors nearest to them; a center with many vectors is dealt into blocks of bounded size. Block summaries (center,
radius) meet in pages by an equi-join, and only pairs of blocks within reach are traversed, each pair in one task
of bounded size. A task reports, for each vector, how many it links to and a spanning star of what it found; no
pair list leaves it. Equal vectors are one weighted vector from the start, so copies cost nothing.

Vectors that are null, empty, zero or hold null or non-finite components, or whose id is null, link with nothing and stay
their own component; vectors of different lengths don't link. Rows with equal ids are counted each, and share a component.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.runtime import connected_components, lean, materialize, small_batches

THRESHOLD = 0.9
PIVOTS = 1024
#: A block holds vectors of about so many bytes, and at least and at most so many. Each block goes to every block within
#: reach, so larger ones are shipped less often.
BLOCK_BYTES, FEWEST, MOST = 8 << 20, 1024, 16384
PAGE = 1024
LEAF = 64
#: Centers that are tried at once when a level is built.
BATCH = 256
#: Added to bounds, so that rounding never prunes a link; links themselves are decided by the cosine alone.
SLACK = 1e-6


class Node:
    """A node of a cover tree over rows of a matrix: center row, covering radius, members; children when it has grown."""

    __slots__ = ("center", "radius", "members", "children")

    def __init__(self, x, members, center: int) -> None:
        import numpy as np

        far = np.sqrt(np.maximum(0.0, 2 - 2 * (x[members] @ x[center])))
        self.center, self.members, self.radius, self.children = center, members, float(far.max()) if len(members) else 0.0, None

    def is_leaf(self) -> bool:
        return len(self.members) <= LEAF or self.radius < 1e-3


def build(x) -> Node:
    """The root of a cover tree over the unit rows of x; it grows where it is looked into."""
    import numpy as np

    return Node(x, np.arange(len(x)), 0)


def grown(x, node: Node) -> list[Node]:
    """The children of a node: a net at half its radius, each member with the first center that covers it."""
    import numpy as np

    if node.children is not None:
        return node.children
    reach = node.radius / 2
    bound = 1 - reach * reach / 2
    left, children = node.members, []
    first: int | None = node.center
    while len(left):
        # a batch of centers: one matrix product, then the greedy choice among them
        batch = left[:BATCH]
        if first is not None:
            batch, first = np.array([first]), None
        near = x[left] @ x[batch].T >= bound
        chosen = []
        among = x[batch] @ x[batch].T >= bound
        free = np.ones(len(batch), dtype=bool)
        for k in range(len(batch)):
            if free[k]:
                chosen.append(k)
                free[among[k]] = False
        near = near[:, chosen]
        near[np.isin(left, batch[chosen]), :] = batch[chosen][None, :] == left[np.isin(left, batch[chosen])][:, None]
        taken = near.any(axis=1)
        owner = near.argmax(axis=1)
        inside, whose = left[taken], owner[taken]
        order = np.argsort(whose, kind="stable")
        cuts = np.searchsorted(whose[order], np.arange(len(chosen) + 1))
        children += [(int(batch[c]), inside[order[cuts[i] : cuts[i + 1]]]) for i, c in enumerate(chosen)]
        left = left[~taken]
    node.children = [Node(x, m, c) for c, m in children]
    return node.children


def prunes(x, y, a: Node, b: Node, reach: float) -> bool:
    """Whether looking into two nodes can rule out pairs for less than comparing them all, by a sample of either: their
    members must gather round centers at a radius at which the usual pair is out of reach. Vectors that are spread
    evenly don't; each would be a center of its own. What is found is the same either way."""
    import numpy as np

    p, q = (n.members[:: max(1, len(n.members) // 64)][:64] for n in (a, b))
    radius = (float(np.median(np.sqrt(np.maximum(0.0, 2 - 2 * (x[p] @ y[q].T))))) - reach) / 2
    if radius <= 0:
        return False
    bound = 1 - radius * radius / 2
    for z, m in ((x, p), (y, q)):
        near, free, centers = z[m] @ z[m].T >= bound, np.ones(len(m), dtype=bool), 0
        for k in range(len(m)):
            if free[k]:
                centers += 1
                free &= ~near[k]
        if 2 * centers > len(m):
            return False
    return True


def direct(x, y, a, b, threshold: float, meet, same: bool) -> None:
    """All pairs of the rows a of x and b of y, by products in single precision and the close ones again in double."""
    import numpy as np

    y32 = y[b].astype(np.float32).T
    low = np.float32(threshold - 1e-5 - 1.2e-7 * x.shape[1])  # below what single precision can make of the threshold
    for at in range(0, len(a), 512):
        p = a[at : at + 512]
        i, j = np.nonzero(x[p].astype(np.float32) @ y32 >= low)
        if same:
            i, j = i[p[i] < b[j]], j[p[i] < b[j]]
        hit = np.einsum("ij,ij->i", x[p[i]], y[b[j]]) >= threshold
        i, j = i[hit], j[hit]
        if len(i):
            rows, r = np.unique(i, return_inverse=True)
            cols, c = np.unique(j, return_inverse=True)
            mask = np.zeros((len(rows), len(cols)), dtype=bool)
            mask[r, c] = True
            meet(p[rows], b[cols], mask)


def _components(mask):
    """Spanning stars of a bipartite mask: lists (rows, columns) of each component with a link."""
    import numpy as np

    open_rows = mask.any(axis=1)
    while open_rows.any():
        rows = np.zeros(len(mask), dtype=bool)
        rows[np.argmax(open_rows)] = True
        while True:
            cols = mask[rows].any(axis=0)
            grown = mask[:, cols].any(axis=1)
            if (grown == rows).all():
                break
            rows = grown
        yield np.flatnonzero(rows), np.flatnonzero(cols)
        open_rows &= ~rows


def traverse(x, y, a: Node, b: Node, threshold: float, meet, same: bool = False) -> None:
    """Walk pairs of nodes of trees over x and y; meet(rows of x, rows of y, mask) gets the links of what isn't pruned.

    same: both are one tree; then each unordered pair is met once, and the diagonal is left out."""
    import numpy as np

    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a.is_leaf() and b.is_leaf() or not prunes(x, y, a, b, reach):
            direct(x, y, a.members, b.members, threshold, meet, same and a is b)
            continue
        if same and a is b:
            left = right = grown(x, a)
        else:
            # children of the wider node, or of both
            left = grown(x, a) if not a.is_leaf() and (a.radius >= b.radius / 2 or b.is_leaf()) else [a]
            right = grown(y, b) if not b.is_leaf() and (b.radius >= a.radius / 2 or a.is_leaf()) else [b]
        cx, cy = x[[n.center for n in left]], y[[n.center for n in right]]
        rx, ry = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        for at in range(0, len(left), 1024):
            gap = np.sqrt(np.maximum(0.0, 2 - 2 * (cx[at : at + 1024] @ cy.T)))
            i, j = np.nonzero(gap <= rx[at : at + 1024, None] + ry[None, :] + reach)
            i = i + at
            if same and a is b:
                i, j = i[i <= j], j[i <= j]
            stack.extend((left[k], right[m]) for k, m in zip(i.tolist(), j.tolist()))


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v binary, d): the doubles of v at length 1, and their number. v is null for rows that can't link."""
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            column = b.column(1)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            there = column.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            out: list[bytes | None] = []
            for k in range(b.num_rows):
                v = values[offsets[k] : offsets[k + 1]]
                big = np.abs(v).max() if there[k] and len(v) and np.isfinite(v).all() else 0.0  # a null component is NaN here
                if big > 0:
                    v = v / big  # first, so that squares neither overflow nor vanish
                    out.append((v / math.sqrt(float(v @ v)) + 0.0).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array([len(v) // 8 if v else 0 for v in out], pa.int32())], names=["id", "v", "d"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, v binary, d int")


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    small_batches(vectors.sparkSession)
    rows = materialize(unit_vectors(vectors, id_col, vector_col))
    # equal vectors become one, with their number and least id
    one = materialize(rows.where("v is not null").groupBy("v", "d").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("n")))
    shared_ids = not one.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    one = materialize((_keyed(one) if shared_ids else one).withColumn("h", F.xxhash64("rep")))
    total = one.count()
    counts = rows.select("id").withColumn("component_id", F.col("id")).withColumn("n_links", F.lit(0).cast("long"))
    if total == 0:
        return counts.select(F.col("id").alias(id_col), "n_links", "component_id", F.lit(True).alias("kept"))
    if block is None:
        block = max(FEWEST, min(MOST, BLOCK_BYTES // (8 * one.agg(F.max("d").alias("d")).first().d)))
    n_pivots = max(1, min(pivots, total // block))
    # the sample of centers: the least hashes, a number with a bound
    chosen = [bytes(r.v) for r in one.orderBy("h", "rep").limit(n_pivots).select("v").collect()]

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        sample = {len(c): np.array([np.frombuffer(d) for d in chosen if len(d) == len(c)]) for c in chosen}
        for b in batches:
            cells = []
            vs = b.column(1).to_pylist()
            for at in range(0, len(vs), 4096):
                part = vs[at : at + 4096]
                width = {len(v) for v in part}
                if len(width) == 1 and (w := width.pop()) in sample:
                    cells += (np.frombuffer(b"".join(part)).reshape(len(part), -1) @ sample[w].T).argmax(axis=1).tolist()
                else:
                    cells += [int((np.frombuffer(v) @ sample[len(v)].T).argmax()) if len(v) in sample else -1 for v in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.int32())], names=["rep", "cell"])

    cells = one.select("rep", "v").mapInArrow(lean(nearest), "rep long, cell int")
    placed = materialize(one.join(cells, "rep"))
    sizes = placed.groupBy("cell", "d").agg(F.ceil(F.count("*") / (block * 0.9)).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["cell", "d"]).withColumn("block", F.concat_ws("-", "d", "cell", F.pmod("h", F.col("blocks").cast("long"))))

    def pack(table):
        import numpy as np
        import pyarrow as pa

        x = np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(table.num_rows, -1)
        mean = x.mean(axis=0)
        k = int((x @ mean).argmax())
        far = float(np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x[k]))).max())
        ids = np.array(table.column("rep").to_pylist(), dtype=np.int64)
        n = np.array(table.column("n").to_pylist(), dtype=np.int64)
        return pa.table({"block": table.column("block").slice(0, 1), "d": pa.array([x.shape[1]], pa.int32()), "center": pa.array([x[k].tolist()], pa.list_(pa.float64())), "radius": pa.array([far]), "ids": pa.array([ids.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    blocks = materialize(placed.select("block", "rep", "n", "v").groupBy("block").applyInArrow(pack, "block string, d int, center array<double>, radius double, ids binary, n binary, x binary"))
    n_blocks = blocks.count()
    pages = max(1, -(-n_blocks // PAGE))
    summary = blocks.select("block", "d", "center", "radius", F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int").alias("page"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    book = summary.groupBy("page", "d").agg(F.collect_list(F.struct("block", "center", "radius")).alias("sums"))
    asks = summary.drop("page").withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))

    def within(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out: tuple[list, list] = ([], [])
            for own, center, radius, sums in zip(*(b.column(c).to_pylist() for c in ("block", "center", "radius", "sums"))):
                gap = np.sqrt(np.maximum(0.0, 2 - 2 * (np.array([s["center"] for s in sums]) @ np.array(center))))
                for s, g in zip(sums, gap):
                    if own <= s["block"] and g <= radius + s["radius"] + reach:
                        out[0].append(own)
                        out[1].append(s["block"])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["left", "right"])

    pairs = materialize(asks.join(book, ["page", "d"]).select("block", "center", "radius", "sums").mapInArrow(lean(within), "left string, right string"))
    body = blocks.select("block", "ids", "n", "x", "d")
    first = body.toDF("left", "ids1", "n1", "x1", "d")
    second = body.drop("d").toDF("right", "ids2", "n2", "x2")
    # a pair of blocks is a group of its own, so that a worker holds two blocks at a time
    tasks = pairs.join(first, "left").join(second, "right").groupBy("left", "right")

    def pair_up(table):
        import numpy as np
        import pyarrow as pa

        every: list[tuple] = []
        for b in table.to_batches():
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                load = lambda i: (np.frombuffer(row[f"ids{i}"], dtype=np.int64), np.frombuffer(row[f"n{i}"], dtype=np.int64), np.frombuffer(row[f"x{i}"], dtype=np.float64).reshape(-1, row["d"]))
                same = row["left"] == row["right"]
                ids1, n1, x = load(1)
                ids2, n2, y = (ids1, n1, x) if same else load(2)
                more1 = np.zeros(len(ids1), dtype=np.int64)
                more2 = more1 if same else np.zeros(len(ids2), dtype=np.int64)
                root: dict[int, int] = {}

                def find(v: int, root=root) -> int:
                    while root.get(v, v) != v:
                        root[v] = v = root.get(root[v], root[v])
                    return v

                def meet(p, q, mask, more1=more1, more2=more2, n1=n1, n2=n2, ids1=ids1, ids2=ids2, root=root, find=find):
                    more1[p] += mask @ n2[q]
                    more2[q] += mask.T @ n1[p]
                    for rows_of, cols in _components(mask):
                        tops = {find(int(v)) for v in (*ids1[p[rows_of]], *ids2[q[cols]])}
                        least = min(tops)
                        for v in tops:
                            root[v] = least

                tree = build(x)
                traverse(x, y, tree, tree if same else build(y), threshold, meet, same)
                out = [(int(v), int(c), None) for ids, more in ([(ids1, more1)] if same else [(ids1, more1), (ids2, more2)]) for v, c in zip(ids, more) if c]
                # a spanning star: each vector that links to another once, with its least
                every += out + [(v, 0, u) for v in list(root) if (u := find(v)) != v]
        return pa.table([pa.array([o[i] for o in every], pa.int64()) for i in range(3)], names=["rep", "more", "with"])

    found = materialize(tasks.applyInArrow(pair_up, "rep long, more long, with long"))
    more = found.groupBy("rep").agg(F.sum("more").alias("more"))
    components = connected_components(found.where("`with` is not null").select(F.col("rep").alias("u"), F.col("with").alias("v")))
    state = one.select("rep", "v", F.col("n") - 1).toDF("rep", "v", "own").join(more, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    state = state.select("v", (F.col("own") + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(state, "v", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    if shared_ids:
        out = materialize(out)
        least = out.groupBy("component_id").agg(F.min("id").alias("least"))
        out = out.join(least, "component_id", "left").select("id", "n_links", F.coalesce("least", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _keyed(one: DataFrame) -> DataFrame:
    """Where an id has several vectors, the others get keys of their own below all ids."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("rep").orderBy("v"))
    return one.withColumn("k", place).select(F.when(F.col("k") > 1, -F.abs(F.xxhash64("rep", "v")) - 1).otherwise(F.col("rep")).alias("rep"), "v", "d", "n")
