"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct five-word shingles; documents are linked
when 100 * |intersection| >= 85 * |union| (by default), and each connected
component has the smallest id in it.

1. Rows with equal sets are one node (grouped by a digest of the whole set).
2. The forest: each of ``trees`` signature orders sorts all nodes by its own
   ``depth`` minhashes, range-partitioned by the whole signature, so that a
   dense region spreads over tasks like any other. Candidates are neighbours in
   an order, up to ``near`` apart, that share a prefix of at least ``least``
   minhashes. Up to ``depth`` the depth adapts by itself: what lies between two
   documents in an order shares at least their common prefix, so sparse regions
   pair at a short prefix and dense ones only at a long one. The last rows of
   each task meet the first of the next in a small second pass. Where more than
   ``near`` rows share all ``depth`` minhashes, step 6 compares the others.
3. A 2-bit sketch of further minhashes drops pairs whose estimate lies five
   standard deviations below the threshold.
4. Links are confirmed on full sets, in rounds, as in Boruvka's minimum
   spanning tree. First every node's best candidate, and once more between the
   components of these. Then the orders are gone through again for the
   candidates between components only, so a family of near copies, one component
   by then, gives none; in each round every component tests its best untested
   pairs (1, 16, 256 ... of them), tested pairs and pairs within a component drop
   out, and what is linked is contracted. Every candidate is tested or its ends
   are connected.
5. Components of the links, over the components of the round before, by
   smallest-neighbour contraction with pointer jumping.
6. A dense region is the rows of one order that share all ``depth`` minhashes,
   if there are more than ``near``. Where steps 1 to 5 leave one in several
   components, its whole sets are compared with each other, all pairs whose
   ends are not connected yet, in pairs of blocks that bound a task's memory. So
   every two documents with an equal signature in an order are compared or
   connected, however many rows have it; the work in a region grows with the
   number of pairs that no link connects.

Defined results: null, empty and blank texts have an empty set, are linked with
nothing and stay; texts under five words are one shingle; ties go to the
smaller id; rows with a null doc_id come last in an order drawn from their
text; repeated rows share an empty-distance link; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rightsize.llm.common import Tables, doc_key, mix, packed, rolling, slices, split_words, tidy, unpacked, word_hashes

BASE = 0xC2B2AE3D27D4EB4F
SKETCH = 128  # minhashes kept as two bits each
FEW_ORDERS = 4  # of the second look for each node's best pair


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, A-Z lower-cased, texts end to end and each sorted; and their bounds."""
    words, of, counts = split_words(pc.ascii_lower(texts))
    n = len(texts)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    one, _ = word_hashes(words)
    h = mix(rolling(one, size, BASE))
    start = np.flatnonzero(of[: max(len(of) - size + 1, 0)] == of[size - 1 :]) if len(of) >= size else np.empty(0, np.int64)
    values, rows = h[start], of[start]
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([mix(rolling(one[first[i] : first[i] + counts[i]], int(counts[i]), BASE), int(counts[i]))[0] for i in short], np.uint64)
        values, rows = np.concatenate([values, whole]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]) if len(values) else np.empty(0, bool)
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=n))]).astype(np.int64)


NODES = "key long, doc_id long, n_shingles long, set binary, forest binary, sketch binary"


def _signatures(size: int, trees: int, depth: int):
    total = max(trees * depth, SKETCH)

    def run(batches):
        factors = mix(np.arange(total, dtype=np.uint64), 11) | np.uint64(1)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, bounds = shingle_sets(part["text"], size)
                full = np.flatnonzero(np.diff(bounds))
                sig = np.zeros((total, part.num_rows), np.uint32)
                if len(full):
                    at = bounds[full]
                    for t in range(total):
                        least = np.minimum.reduceat((values * factors[t]) >> np.uint64(20), at)
                        sig[t, full] = (mix(least) >> np.uint64(32)).astype(np.uint32)
                rows = np.ascontiguousarray(sig.T)
                two = (rows[:, :SKETCH] & np.uint32(3)).astype(np.uint8).reshape(len(rows), -1, 4)
                two = two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["doc_id"], pa.array(np.diff(bounds)), pa.array([hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.array([r.astype(">u4").tobytes() for r in rows[:, : trees * depth]], pa.binary()), pa.array([r.tobytes() for r in two], pa.binary())],
                    names=["key", "doc_id", "n_shingles", "set", "forest", "sketch"],
                )

    return tidy(run)


PAIRS = "a long, b long, agree int, edge int, tree int, prefix binary, node long, sketch binary, comp long, la long, lb long"
_PAIRS = [(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in PAIRS.split(", ")]


def _pair_rows(**columns) -> pa.RecordBatch:
    """A batch of ``PAIRS``; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _PAIRS], names=[c for c, _ in _PAIRS])


def _neighbours(depth: int, near: int, least: int, enough: int, best: bool):
    """Candidate pairs of a sorted partition between rows of different ``comp``,
    its first and last rows (edge 0 and 1), and the rows of its dense regions
    (edge 2, with the prefix they share). With ``best``, only each row's
    (``node``'s) pair of best agreement."""

    def agreeing(tree, prefix, two, comp, skip):
        """(i, i + d, agreement) of rows up to ``near`` apart that share ``least`` minhashes."""
        n = len(tree)
        sig = np.frombuffer(b"".join(prefix), np.uint8).reshape(n, depth, 4)
        for d in range(1, min(near, n - 1) + 1):
            lead = (sig[d:, :least] == sig[:-d, :least]).all(axis=(1, 2)) & (tree[d:] == tree[:-d]) & (comp[d:] != comp[:-d])
            lead[: max(skip - d, 0)] = False  # pairs of rows that an earlier batch held
            i = np.flatnonzero(lead)
            x = two[i] ^ two[i + d]
            agree = (SKETCH - np.unpackbits((x | x >> 1) & 0x55, axis=1).sum(axis=1)).astype(np.int32)
            yield i[agree >= enough], i[agree >= enough] + d, agree[agree >= enough]

    def ordered(node, comp, i, j, /, **more):
        i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        return _pair_rows(a=node[i], b=node[j], la=comp[i], lb=comp[j], **more)

    def pairs(tree, prefix, node, sketch, comp, skip=0):
        n = len(node)
        two = np.frombuffer(b"".join(sketch), np.uint8).reshape(n, -1)
        top, partner = np.full(n, -1, np.int32), np.zeros(n, np.int64)
        for i, j, agree in agreeing(tree, prefix, two, comp, skip):
            if best:
                for own, other in ((i, j), (j, i)):
                    better = agree > top[own]
                    top[own[better]], partner[own[better]] = agree[better], other[better]
            elif len(i):
                yield ordered(node, comp, i, j, agree=agree)
        if best and (top >= 0).any():
            i = np.flatnonzero(top >= 0)
            yield ordered(node, comp, i, partner[i], agree=top[i], node=node[i])

    def dense(tree, prefix):
        n = len(tree)
        sig = np.frombuffer(b"".join(prefix), np.uint8).reshape(n, 4 * depth)
        i = np.flatnonzero((sig[near:] == sig[:-near]).all(axis=1) & (tree[near:] == tree[:-near])) if n > near else np.empty(0, np.int64)
        return np.unique((i[:, None] + np.arange(near + 1)).ravel())

    def edge(cols, side, rows):
        tree, prefix, node, sketch, comp = (c[rows] for c in cols)
        return _pair_rows(edge=[side] * len(tree), tree=tree, prefix=list(prefix), node=node, sketch=list(sketch), comp=comp)

    def run(batches):
        tail = None
        for batch in batches:
            cols = np.asarray(batch["tree"]), batch["prefix"].to_pylist(), np.asarray(batch["node"]), batch["sketch"].to_pylist(), np.asarray(batch["comp"])
            if not len(cols[0]):
                continue
            skip = 0
            if tail is None:
                yield edge(cols, 0, slice(0, near))
            else:
                skip = len(tail[0])
                cols = tuple(np.concatenate([t, c]) if isinstance(c, np.ndarray) else t + c for t, c in zip(tail, cols))
            yield from pairs(*cols, skip)
            many = dense(*cols[:2]).tolist() if best else []
            for at in range(0, len(many), 4096):
                some = many[at : at + 4096]
                yield edge((cols[0][some], [cols[1][i] for i in some], cols[2][some], [None] * len(some), cols[4][some]), 2, slice(None))
            tail = tuple(c[-near:] for c in cols)
        if tail is not None:
            yield edge(tail, 1, slice(0, near))

    return tidy(run)


def _confirm(size: int, percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                va, ba = shingle_sets(part["text_a"], size)
                vb, bb = shingle_sets(part["text_b"], size)
                keep = []
                for i in range(part.num_rows):
                    x, y = va[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part[c].filter(keep) for c in ("a", "b", "la", "lb")], names=["a", "b", "la", "lb"])

    return tidy(run)


DENSE_ROWS, DENSE_SHINGLES = 1024, 1 << 20  # of a block, about


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, bounds = shingle_sets(part["text"], size)
                yield pa.RecordBatch.from_arrays([part["key"], pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["node", "shingles"])

    return tidy(run)


def overlaps(x: list[np.ndarray], y: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """The sizes of the intersections of all sets ``x`` with all sets ``y``, exact,
    by products of ``most`` columns: one column for each value that both sides hold."""
    out = np.zeros((len(x), len(y)), np.int64)
    flat = [np.concatenate(s) for s in (x, y)]
    of = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    both = np.intersect1d(*flat)
    cells = []
    for values, row in zip(flat, of):
        at = np.searchsorted(both, values)
        has = at < len(both)
        has[has] = both[at[has]] == values[has]
        order = np.argsort(at[has], kind="stable")
        cells.append((at[has][order], row[has][order]))
    for start in range(0, len(both), most):
        sides = []
        for (at, row), n in zip(cells, out.shape):
            a, b = np.searchsorted(at, [start, start + most])
            one = np.zeros((n, min(most, len(both) - start)), np.float32)
            one[row[a:b], at[a:b] - start] = 1
            sides.append(one)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _compare(percent: int):
    """(a, b) of all rows of two blocks that links between them connect: b is the smallest node."""

    def run(table):
        side, node, comp = (np.asarray(table[c]) for c in ("side", "node", "component"))
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == side.max()))
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.array([len(s) for s in sets])
        both = overlaps([sets[i] for i in left], [sets[i] for i in right])
        link = (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (comp[left][:, None] != comp[right])
        label, changed = node.copy(), True
        i, j = np.nonzero(link)
        i, j = left[i], right[j]
        while changed:
            before = label.copy()
            np.minimum.at(label, i, before[j])
            np.minimum.at(label, j, label[i])
            changed = (label != before).any()
        moved = label != node
        return pa.table({"a": pa.array(node[moved]), "b": pa.array(label[moved])})

    return run


def dense_links(members: DataFrame, nodes: DataFrame, text: DataFrame, done: DataFrame, size: int, percent: int, tables: Tables) -> DataFrame | None:
    """Edges (a, b) that connect what is linked inside the regions of
    ``members(region, node)`` beyond the components ``done``; None without any.
    Components of more rows than a block have blocks of their own, which are not
    compared with each other; all other rows of a region share its blocks."""
    own = done.select("node", F.col("least").alias("component"))
    members = members.join(own.hint("merge"), "node").join(nodes.select("node", "n_shingles").hint("merge"), "node")
    members = tables.save(members, "dense-members")
    by_comp = members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    by_comp = tables.save(by_comp, "dense-components")
    mixed = by_comp.groupBy("region").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("region")
    by_comp = by_comp.join(mixed.hint("merge"), "region").withColumn("large", F.when(F.col("n") > DENSE_ROWS, F.col("component")))
    parts = by_comp.groupBy("region", "large").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / DENSE_ROWS, F.col("shingles") / DENSE_SHINGLES)).cast("long")
    upto = F.sum("blocks").over(Window.partitionBy("region").orderBy("large").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("blocks", blocks).withColumn("first", upto - F.col("blocks")).withColumn("total", F.sum("blocks").over(Window.partitionBy("region")))
    parts = tables.save(parts.select("region", "large", "blocks", "first", "total"), "dense-parts")
    if parts.isEmpty():
        return None
    where = by_comp.select("region", "component", "large").alias("c").join(parts.alias("p"), F.expr("c.region = p.region and c.large <=> p.large")).select("c.region", "component", "p.large", "blocks", "first", "total")
    placed = members.join(where.hint("merge"), ["region", "component"]).withColumn("x", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1))).filter("large is null or y < first or y >= first + blocks")
    placed = placed.select("region", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), F.when(F.col("x") > F.col("y"), 1).otherwise(0).alias("side"), "node", "component")
    placed = tables.save(placed, "dense-placed")
    ends = placed.select(F.col("node").alias("key")).distinct()
    sets = text.join(ends.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("key", "text").mapInArrow(_sets(size), "node long, shingles binary")
    sets = tables.save(sets, "dense-sets")
    full = placed.join(sets.hint("merge"), "node").select("region", "lo", "hi", "side", "node", "component", "shingles")
    return tables.save(full.groupBy("region", "lo", "hi").applyInArrow(_compare(percent), "a long, b long").distinct(), "dense-links")


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, least) of every node of ``edges(a, b)``: the smallest node it can
    reach. Every round hooks each root to the least root next to it and then
    halves the paths; rounds grow with the logarithm of a component's width.
    Sums and minima are combined before the shuffle, so a node with very many
    edges is no hot key; tables are written each round and the last one dropped."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    state = tables.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least")), f"{name}-0")
    turn = 0
    while True:
        # follow the chain one step more: least(least(node))
        up = state.select(F.col("node").alias("least"), F.col("least").alias("upper"))
        jumped = state.join(up, "least", "left").select("node", F.coalesce("upper", "least").alias("least"))
        # the least label among a node's neighbours, given to the node's root too
        label = state.select(F.col("node").alias("b"), F.col("least").alias("other"))
        seen = both.join(label, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooks = state.join(seen, "node").filter("other < least").select(F.explode(F.array("node", "least")).alias("node"), "other")
        new = jumped.union(hooks.select("node", F.col("other").alias("least"))).groupBy("node").agg(F.min("least").alias("least"))
        after = tables.save(new, f"{name}-{turn + 1}")
        change = after.join(state.withColumnRenamed("least", "before"), "node", "left").filter("before is null or before <> least").isEmpty()
        tables.drop(f"{name}-{turn}")
        state, turn = after, turn + 1
        if change:
            return state


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, trees: int = 16, depth: int = 8, near: int = 8, least: int = 3) -> DataFrame:
    """key, doc_id, n_shingles, component (a key), component_id (a doc_id), kept
    for every row of ``docs(doc_id, text)``."""
    tables = Tables(docs.sparkSession)
    text = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = tables.save(text.mapInArrow(_signatures(size, trees, depth), NODES), "sets")
    # equal sets are one node, named by its smallest key
    node_of = rows.filter("n_shingles > 0").groupBy("set").agg(F.min("key").alias("node"), F.min_by("forest", "key").alias("forest"), F.min_by("sketch", "key").alias("sketch"), F.min("n_shingles").alias("n_shingles"))
    nodes = tables.save(node_of, "nodes")
    p = percent / 100
    agree = p + (1 - p) / 4  # share of equal two-bit minhashes at the threshold
    enough = int(SKETCH * agree - 5 * (SKETCH * agree * (1 - agree)) ** 0.5)
    columns = ["tree", "prefix", "node", "sketch", "comp"]

    def neighbours(done: DataFrame | None, best: bool, orders: int, name: str) -> DataFrame:
        """``PAIRS`` of the first ``orders`` orders between the components ``done`` (at first, each node is one)."""
        labelled = nodes.withColumn("comp", F.col("node")) if done is None else nodes.join(done.withColumnRenamed("least", "comp").hint("merge"), "node")
        prefixes = F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda t: F.substring("forest", t * (4 * depth) + 1, F.lit(4 * depth)))
        order = labelled.select("node", "sketch", "comp", F.posexplode(prefixes).alias("tree", "prefix"))
        order = order.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node").select(columns)
        run = _neighbours(depth, near, least, enough, best)
        found = tables.save(order.mapInArrow(run, PAIRS), name)
        # where one task's last rows meet the next one's first: near * 2 rows a task
        edges = found.filter("edge < 2").select(columns).distinct()
        edges = edges.repartitionByRange("tree").sortWithinPartitions("tree", "prefix", "node").select(columns)
        met = tables.save(edges.mapInArrow(run, PAIRS).filter("edge is null or edge = 2"), f"{name}-met")
        return found.filter("edge is null or edge = 2").union(met)

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b, la, lb), as distinct (a, b) of the components they connect."""
        ends = some.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        # the ends grow with the corpus: never broadcast them
        texts = tables.save(text.join(ends.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("key", "text"), f"texts-{name}")
        a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
        both = some.select("a", "b", "la", "lb").join(a.hint("merge"), "a").join(b.hint("merge"), "b")
        links = both.select("a", "b", "la", "lb", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long, la long, lb long")
        links = tables.save(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), f"links-{name}")
        tables.drop(f"texts-{name}")
        return links

    def moved(done: DataFrame, move: DataFrame) -> DataFrame:
        to = move.select(F.col("node").alias("least"), F.col("least").alias("to"))
        return done.join(to, "least", "left").select("node", F.coalesce("to", "least").alias("least"))

    # first each node's best pair over all orders, then over a few between the components of the first
    done = nodes.select("node", F.col("node").alias("least"))
    tested, dense = None, None
    for turn, orders in enumerate((trees, min(trees, FEW_ORDERS))):
        found = neighbours(done if turn else None, True, orders, f"forest-{turn}")
        if not turn:
            dense = tables.save(found.filter("edge = 2").select(F.xxhash64("tree", "prefix").alias("region"), "node").distinct(), "dense")
        best = found.filter("edge is null").groupBy("node").agg(F.max_by(F.struct("a", "b", "la", "lb"), F.struct("agree", -F.col("a"), -F.col("b"))).alias("p")).select("p.*").distinct()
        best = tables.save(best, f"best-{turn}")
        tables.drop(f"forest-{turn}")
        tested = best if tested is None else tested.union(best)
        links = confirmed(best, f"best-{turn}")
        if not links.isEmpty():
            done = tables.save(moved(done, components(links, tables, f"near-{turn}")), f"done-{turn}")
    # then all pairs between what is not connected yet, the best of each component first
    found = neighbours(done, False, trees, "rest").filter("edge is null").select("a", "b", "agree", "la", "lb", F.lit(0).alias("tested"))
    again = tested.select("a", "b", F.lit(0).alias("agree"), F.lit(None).cast("long").alias("la"), F.lit(None).cast("long").alias("lb"), F.lit(1).alias("tested"))
    open_ = found.union(again).groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("agree", "la", "lb", "tested")))
    open_ = tables.save(open_.filter("tested = 0").drop("tested"), "open-0")
    tables.drop("rest")
    turn = 0
    while not open_.isEmpty():
        each = open_.select(F.col("la").alias("own"), "*").union(open_.select(F.col("lb").alias("own"), "*"))
        rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("agree"), "a", "b"))
        # the limit is taken on both sides of the exchange, so a component with very many pairs ships few
        picked = each.withColumn("rank", rank).filter(F.col("rank") <= 16**turn).select("a", "b", *(F.lit(None).cast(t).alias(c) for c, t in (("agree", "int"), ("la", "long"), ("lb", "long"))), F.lit(1).alias("picked"))
        marked = open_.withColumn("picked", F.lit(0)).union(picked).groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("agree", "la", "lb", "picked")))
        marked = tables.save(marked, f"ranked-{turn}")
        joined = confirmed(marked.filter("picked = 1"), f"open-{turn}")
        left = marked.filter("picked = 0").drop("picked")
        if not joined.isEmpty():
            move = components(joined, tables, f"moved-{turn}")
            done = tables.save(moved(done, move), f"joined-{turn}")
            for x in ("la", "lb"):
                to = move.select(F.col("node").alias(x), F.col("least").alias("to"))
                left = left.join(to, x, "left").withColumn(x, F.coalesce("to", x)).drop("to")
        turn += 1
        open_ = tables.save(left.filter("la <> lb").select("a", "b", "agree", "la", "lb"), f"open-{turn}")
        tables.drop(f"open-{turn - 1}")
    last = None if dense.isEmpty() else dense_links(dense, nodes, text, done, size, percent, tables)
    if last is not None and not last.isEmpty():
        la, lb = (done.select(F.col("node").alias(x), F.col("least").alias(f"l{x}")) for x in "ab")
        last = last.join(la.hint("merge"), "a").join(lb.hint("merge"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        done = moved(done, components(tables.save(last, "dense-joined"), tables, "whole"))
    labels = nodes.select("set", "node").join(done, "node", "left").select("set", F.coalesce("least", "node").alias("component"))
    out = rows.select("key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set")).alias("set")).join(labels, "set", "left")
    out = out.withColumn("component", F.coalesce("component", "key"))
    # a key in the place of a null doc_id stays out of component_id
    ids = F.when(F.col("component") == F.col("key"), F.col("doc_id")).otherwise(F.when(F.col("component") < 2**62, F.col("component")))
    return out.select("key", "doc_id", "n_shingles", "component", ids.alias("component_id"), (F.col("component") == F.col("key")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component of links at
    ``percent``, with all their columns."""
    kept = near_duplicates(docs, percent=percent).filter("kept").select("key").distinct()
    return unpacked(packed(docs).join(kept, "key", "left_semi"), docs.columns)
