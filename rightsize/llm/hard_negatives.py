"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

1. Layout: every row gets the place of its vector on a Hilbert curve through
   all dimensions (widest first, 4 bits each, around the mean). The candidates
   are range-partitioned and sorted by it and written as Parquet, ``block`` rows
   a block; equal vectors are dealt by id, so a frequent one fills many blocks.
2. Zone maps: least and greatest component of each dimension, a block. Interval
   arithmetic bounds the scores an anchor can have in it: for each dimension
   the lesser and the greater of anchor x least and anchor x greatest.
3. Anchors are read ``chunk`` at a time, in order of the curve, and broadcast
   with their windows of scores. Zone maps alone choose the blocks that any of
   the chunk's windows can reach; the others are not read. In a task the bounds
   choose again, anchor by anchor, against the window and the worst score kept
   so far; only the anchors left are scored against a block's rows.
4. A task keeps the first ``k`` of each window; ranks are taken over all tasks.
   The first pass finds each anchor's positives (window: all, same label), the
   second the negatives of each positive's window (other labels).

Scores are exact: in double precision where no sum can pass 2**53, else in
64-bit integers (a score must fit them).

Defined results: rows with a null id, label or vector, with a null component
or with another length than the most common one take no part; rows of one id
are one, the least by label and vector; ties go to the smaller id; an anchor
without positives, or whose windows are empty, has no rows; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rightsize.llm.common import Tables

BITS = 4
LEAST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
OUT = "anchor long, window int, positive long, positive_score long, id long, score long"


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place on the Hilbert curve of each row of ``cells`` (n x dimensions,
    values below 2**bits), as bytes that sort like it; all points at once, by
    undoing the curve's reflections and swaps bit by bit, then a Gray code."""
    x = np.ascontiguousarray(cells.T.astype(np.uint16))
    bit = 1 << (bits - 1)
    while bit > 1:
        low = np.uint16(bit - 1)
        for i in range(len(x)):
            hit = (x[i] & bit) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low).astype(np.uint16)
            x[0] ^= np.where(hit, low, swap).astype(np.uint16)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint16)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0).astype(np.uint16)
        bit >>= 1
    x ^= turn
    planes = [(x >> np.uint16(b)) & np.uint16(1) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).astype(np.uint8), axis=0).T
    return [row.tobytes() for row in np.ascontiguousarray(packed)]


# ---- inside Python workers ---------------------------------------------------

def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.int64).reshape(n, -1)


def _moments(batches):
    """Count, sums and sums of squares of a partition's components."""
    n, one, two = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch["vector"], batch.num_rows).astype(float)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([one.tolist()]), pa.array([two.tolist()])], names=["n", "one", "two"])


def _places(mean, scale, order):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part["vector"], part.num_rows)
                cells = np.clip((x - mean) / scale * (1 << (BITS - 2)) + (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([*(part[n] for n in ("id", "label", "vector", "asks")), pa.array(hilbert(cells[:, order]), pa.binary())], names=["id", "label", "vector", "asks", "place"])

    return run


def _cut(block: int):
    """Rows of a partition with the number of their block in it."""

    def run(batches):
        seen = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((seen + np.arange(batch.num_rows)) // block)], names=[*batch.schema.names, "block"])
            seen += batch.num_rows

    return run


def _runs(batch):
    """Runs of rows of one block."""
    block = np.asarray(batch["block"])
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        yield int(block[a]), batch.slice(a, b - a)


def _zones(batches):
    for batch in batches:
        rows = [(k, x.min(axis=0).tolist(), x.max(axis=0).tolist()) for k, part in _runs(batch) for x in [_matrix(part["vector"], part.num_rows)]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["block", "least", "most"])


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of each anchor with a vector
    between ``least`` and ``most`` in every dimension."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ least + down @ most, up @ most + down @ least


def _choose(asked):
    """Zone maps -> the blocks that the window of any anchor can reach."""

    def run(batches):
        a, low, high = (asked.value[k] for k in ("vector", "low", "high"))
        for batch in batches:
            keep = []
            for i, (least, most) in enumerate(zip(batch["least"].to_pylist(), batch["most"].to_pylist())):
                under, over = bounds(a, np.array(least, a.dtype), np.array(most, a.dtype))
                keep.append(bool(((over[:, None] >= low) & (under[:, None] <= high)).any()))
            yield pa.RecordBatch.from_arrays([batch["part"].filter(pa.array(keep)), batch["block"].filter(pa.array(keep))], names=["part", "block"])

    return run


def _sweep(asked, k: int, same: bool, at_once: int = 256):
    """Candidates -> a task's first ``k`` rows of every anchor's windows."""

    def run(batches):
        q = asked.value
        a, low, high, label, own = (q[n] for n in ("vector", "low", "high", "label", "id"))
        n, w = low.shape
        score, ident = np.full((n * w, k), LEAST, np.int64), np.full((n * w, k), GREATEST, np.int64)

        def take(group, s, i):
            """Merge found (window of an anchor, score, id) into the kept ones."""
            changed = np.unique(group)
            group = np.concatenate([group, np.repeat(changed, k)])
            s, i = np.concatenate([s, score[changed].ravel()]), np.concatenate([i, ident[changed].ravel()])
            order = np.lexsort((i, -s.astype(np.float64) if a.dtype == np.float64 else ~s, group))
            group, s, i = group[order], s[order], i[order]
            rank = np.arange(len(group)) - np.repeat(np.searchsorted(group, changed), np.diff(np.searchsorted(group, np.append(changed, n * w))))
            first = rank < k
            score[group[first], rank[first]], ident[group[first], rank[first]] = s[first], i[first]

        for batch in batches:
            for _, part in _runs(batch):
                x = _matrix(part["vector"], part.num_rows).astype(a.dtype)
                ids, labels = np.asarray(part["id"]), np.asarray(part["label"])
                under, over = bounds(a, x.min(axis=0), x.max(axis=0))
                floor = np.maximum(low, score[:, -1].reshape(n, w))
                reach = np.flatnonzero(((over[:, None] >= floor) & (under[:, None] <= high)).any(axis=1))
                for at in range(0, len(reach), at_once):
                    some = reach[at : at + at_once]
                    s = (a[some] @ x.T).astype(np.int64)
                    fits = (labels == label[some, None]) == same
                    if same:
                        fits &= ids != own[some, None]
                    found = []
                    for j in range(w):
                        r, c = np.nonzero(fits & (s >= floor[some, j, None]) & (s <= high[some, j, None]))
                        found.append((some[r] * w + j, s[r, c], ids[c]))
                    found = [np.concatenate(f) for f in zip(*found)]
                    if len(found[0]):
                        take(*found)
        kept = np.flatnonzero(ident.ravel() != GREATEST)
        group = kept // k
        columns = [own[group // w], (group % w).astype(np.int32), q["positive"].ravel()[group], q["positive_score"].ravel()[group], ident.ravel()[kept], score.ravel()[kept]]
        for at in range(0, len(kept), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65536]) for c in columns], names=["anchor", "window", "positive", "positive_score", "id", "score"])

    return run


# ---- the jobs ----------------------------------------------------------------

def usable(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, vector of longs, asks) that take part, one an id."""
    read = rows.filter("id is not null and label is not null and vector is not null").filter(F.forall("vector", lambda x: x.isNotNull()))
    return read.groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("r")).select("id", "r.*")


def _chunks(tables: Tables, blocks: DataFrame, chunk: int):
    """Conditions that cut the anchors into runs of the curve of about ``chunk`` rows."""
    sizes = blocks.filter("asks").groupBy("part").count().orderBy("part").toArrow().to_pydict()
    run, held = [], 0
    for part, n in zip(sizes["part"], sizes["count"]):
        if n > 2 * chunk:
            pieces = -(-n // chunk)
            for i in range(pieces):
                yield (F.col("part") == part) & (F.pmod(F.xxhash64("id"), F.lit(pieces)) == i)
            continue
        if run and held + n > chunk:
            yield F.col("part").isin(run)
            run, held = [], 0
        run, held = [*run, part], held + n
    if run:
        yield F.col("part").isin(run)


def mine(rows: DataFrame, k: int = 10, positives: int = 5, low: int = 30, high: int = 90, block: int = 512, chunk: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for every row with ``asks`` and each of its ``positives``
    best rows of the same label, the ``k`` best rows of other labels whose score
    lies between ``low`` and ``high`` per cent of the positive's. ``rows`` has
    id long, label, vector array<long> and asks boolean; the score is the inner
    product. ``block`` and ``chunk`` do not change the result."""
    spark = rows.sparkSession
    tables = Tables(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    read = tables.save(usable(rows.select("id", F.col("label").cast("long"), "vector", "asks")), "rows")
    shape = read.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not shape or not shape[0]["n"]:
        return spark.createDataFrame([], schema)
    read = read.filter(F.size("vector") == shape[0]["n"])
    sums = read.select("vector").mapInArrow(_moments, "n long, one array<double>, two array<double>").toArrow().to_pydict()
    n = sum(sums["n"])
    mean = np.sum(sums["one"], axis=0) / n
    scale = np.sqrt(np.maximum(np.sum(sums["two"], axis=0) / n - mean * mean, 0)) + 1e-9
    order = np.argsort(-scale, kind="stable")
    placed = read.mapInArrow(_places(mean, scale, order), "id long, label long, vector array<long>, asks boolean, place binary")
    dealt = placed.repartitionByRange("place", "id").sortWithinPartitions("place", "id").drop("place")
    cut = dealt.mapInArrow(_cut(block), "id long, label long, vector array<long>, asks boolean, block long")
    blocks = tables.save(cut.withColumn("part", F.spark_partition_id()), "blocks", by="part")
    zones = tables.save(blocks.select("part", "block", "vector").mapInArrow(_with_part(_zones), "block long, least array<long>, most array<long>, part int"), "zones")
    found, most = [], zones.agg(F.max(F.greatest(F.abs(F.array_min("least")), F.abs(F.array_max("most"))))).first()[0]
    exact = np.float64 if float(most) ** 2 * shape[0]["n"] < 2**53 else np.int64

    def windows(asked: dict, k: int, same: bool, name: str) -> DataFrame:
        value = spark.sparkContext.broadcast(asked)
        chosen = zones.mapInArrow(_choose(value), "part int, block long").distinct()
        near = blocks.join(chosen, ["part", "block"], "left_semi").select("block", "id", "label", "vector")
        out = tables.save(near.mapInArrow(_sweep(value, k, same), OUT), name)
        value.destroy()
        first = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
        return out.withColumn("rank", first).filter(F.col("rank") <= k)

    for turn, run in enumerate(_chunks(tables, blocks, chunk)):
        held = blocks.filter("asks").filter(run).select("id", "label", "vector").orderBy("id").toArrow()
        if not held.num_rows:
            continue
        ids = np.asarray(held["id"])
        asked = {"id": ids, "label": np.asarray(held["label"]), "vector": np.stack(held["vector"].to_numpy()).astype(exact)}
        every = {"low": np.full((len(ids), 1), LEAST), "high": np.full((len(ids), 1), GREATEST), "positive": np.zeros((len(ids), 1), np.int64), "positive_score": np.zeros((len(ids), 1), np.int64)}
        got = windows(asked | every, positives, True, f"positives-{turn}").select("anchor", "rank", "id", "score").toArrow()
        at, j = np.searchsorted(ids, np.asarray(got["anchor"])), np.asarray(got["rank"]) - 1
        own = {"low": np.full((len(ids), positives), GREATEST), "high": np.full((len(ids), positives), LEAST), "positive": np.zeros((len(ids), positives), np.int64), "positive_score": np.zeros((len(ids), positives), np.int64)}
        score = got["score"].to_pylist()
        own["positive"][at, j], own["positive_score"][at, j] = np.asarray(got["id"]), score
        # integers, so a bound in per cent is the next whole score inside; Python's own, which do not overflow
        own["low"][at, j], own["high"][at, j] = [-(-low * s // 100) for s in score], [high * s // 100 for s in score]
        found.append(windows(asked | own, k, False, f"negatives-{turn}"))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _with_part(inner):
    """``inner`` for a partition's rows of each ``part``."""

    def run(batches):
        for batch in batches:
            part = np.asarray(batch["part"])
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                for out in inner([batch.slice(a, b - a)]):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, part[a], np.int32))], names=[*out.schema.names, "part"])

    return run


def scaled(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", factor: int = 256) -> DataFrame:
    """``rows`` for ``mine``: components as floor(factor * component), non-finite ones null."""
    read = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.transform("vector", lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x * F.lit(float(factor)))).cast("long"))
    return read.withColumn("vector", whole).withColumn("asks", asks)
