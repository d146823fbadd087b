"""Suffix-array dedup over bytes: a distributed merge sort of suffixes that
never compares a known common prefix twice.

A byte goes when a ``window``-byte string covering it also starts earlier
(smaller key, or same document and earlier place). Equal windows have their
anchor (the least ``gram``-byte hash inside, leftmost of equals) at the same
offset, so it is enough to sort the suffixes that begin at anchors, about one
in ``(window - gram) / 2`` bytes, each with the bytes its windows reach to the
right and to the left of it.

1. Duplicate detection before the exchange: suffixes whose first ``gram`` bytes
   are unique in the corpus (a merged sketch never underestimates) stay where
   they are; only the others are exchanged.
2. Each partition sorts its suffixes into a run. Of suffixes that agree in all
   their bytes only the earliest goes on, the others are covered by it; a text
   with a million copies sends one suffix for each run and anchor.
3. Runs are front-coded (length of the prefix shared with the one before, then
   the rest) and exchanged by ranges of their first ``gram`` bytes, with
   splitters from a sample that only balances the ranges.
4. Each range merges its runs with a loser tree that keeps, for each suffix,
   the prefix it shares with the last winner: a longer shared prefix wins
   without a comparison, and equal ones are compared from there on.
5. Suffixes that share ``gram`` bytes or more come out next to each other; the
   windows around them are compared byte by byte, earliest document first. A
   gram with more than ``GROUP`` surroundings is no task's own: its windows are
   dealt by a 128-bit digest and grouped.

Defined results: null and empty texts have no bytes; texts shorter than the
window are kept; repeated rows of one document (same doc_id, same text) are one
document; null doc_ids come last, in an order drawn from their text; other
columns are not read; an empty table gives no rows. One task holds the suffixes
of a range, and for one gram the distinct surroundings it occurs in.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rightsize.llm import sketch
from rightsize.llm.common import Tables, anchors, doc_key, mix, raw_bytes, rolling, slices, tidy

BASE = 0x9FB21C651E98DF25
SLICE = 1 << 20


def _anchored(batch: pa.RecordBatch, window: int, gram: int):
    """Bytes, document bounds, gram hashes; per anchor: its place, its row, the first and last start of its windows."""
    data, bounds = raw_bytes(batch["text"])
    if len(data) < window:
        return None
    grams = rolling(mix(np.arange(256, dtype=np.uint64))[data], gram, BASE)
    at = anchors(grams, window - gram + 1)
    of = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    start = np.flatnonzero(of[: len(of) - window + 1] == of[window - 1 :])
    if not len(start):
        return None
    at = at[start]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = start[np.append(new[1:], len(start)) - 1]
    return data, bounds, grams, at[new], of[start[new]], start[new], last


def _sketch_partition(window, gram, bits, depth):
    def items(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if (w := _anchored(part, window, gram)) is not None:
                    yield w[2][w[3]]

    return tidy(lambda batches: sketch.count_cells(items(batches), bits, depth))


def _repeated(batch, window, gram, bits, depth, merged):
    """The anchors of a slice whose grams repeat: (bytes, row, place, first, last)."""
    if (w := _anchored(batch, window, gram)) is None:
        return None
    data, bounds, grams, at, of, first, last = w
    hit = sketch.often(merged.value, grams[at], bits, depth)
    return data, bounds, at[hit], of[hit], first[hit], last[hit]


def _sample_partition(window, gram, bits, depth, merged):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if (w := _repeated(part, window, gram, bits, depth, merged)) is not None:
                    raw = w[0].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + gram] for a in w[2][::8].tolist()], pa.binary())], names=["head"])

    return tidy(run)


RUN = "range int, lcp binary, size binary, right binary, key binary, place binary, rest binary, c_key binary, c_start binary, c_n binary"


def _front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each string, and of the prefix it shares with the one before."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    lcp = np.zeros(len(keys), np.int64)
    wide = int(size.max())
    for at in range(0, len(keys) - 1, 1 << 14):
        part = np.array(keys[at : at + (1 << 14) + 1], f"S{wide}").view(np.uint8).reshape(-1, wide)
        other = part[1:] != part[:-1]
        n = np.where(other.any(axis=1), other.argmax(axis=1), wide)
        lcp[at + 1 : at + len(part)] = np.minimum(n, np.minimum(size[at + 1 : at + len(part)], size[at : at + len(part) - 1]))
    return size, lcp


HOLD = 24 << 20  # bytes of a run in the making, about
OBJECTS = 300  # bytes of a held suffix or record besides its text


def _runs(window, gram, bits, depth, merged, splitters, hold=None):
    """Sorted, front-coded runs of a partition's anchored suffixes, a row for
    each range; a run is cut when its suffixes and the records of covered ones
    take about ``hold`` bytes."""
    hold = hold or HOLD

    def write(first: dict, covered: list):
        order = sorted(first)
        ranges = [bisect_right(splitters.value, s[0][:gram]) for s in order]
        cover: dict[int, list] = {}
        for r, *c in covered:
            cover.setdefault(r, []).append(c)
        cuts = [i for i in range(len(order)) if not i or ranges[i] != ranges[i - 1]] + [len(order)]
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            part = order[a:b]
            keys = [k for k, _ in part]
            size, lcp = _front_coded(keys)
            who = np.array([first[s] for s in part], np.int64).reshape(-1, 2)
            c = np.array(cover.get(ranges[a], []), np.int64).reshape(-1, 3)
            rows.append((ranges[a], lcp.astype(np.uint16).tobytes(), size.astype(np.uint16).tobytes(), np.array([r for _, r in part], np.uint16).tobytes(), who[:, 0].tobytes(), who[:, 1].astype(np.int32).tobytes(), b"".join([k[n:] for k, n in zip(keys, lcp.tolist())]), c[:, 0].tobytes(), c[:, 1].astype(np.int32).tobytes(), c[:, 2].astype(np.int32).tobytes()))
        for at in range(0, len(rows), 64):
            cols = list(zip(*rows[at : at + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=[f.split()[0] for f in RUN.split(", ")])

    def run(batches):
        first: dict[tuple[bytes, int], tuple[int, int]] = {}  # (right bytes + reversed left bytes, how many are right): earliest (key, place)
        covered: list[tuple] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if (w := _repeated(part, window, gram, bits, depth, merged)) is None:
                    continue
                raw, bounds, at, of, lo, hi = w[0].tobytes(), w[1], w[2], w[3], w[4], w[5]
                key = np.asarray(part["key"])[of]
                for a, b, c, k, p in zip(at.tolist(), lo.tolist(), hi.tolist(), key.tolist(), (at - bounds[of]).tolist()):
                    s = (raw[a : c + window] + raw[b:a][::-1], c + window - a)
                    old = first.setdefault(s, (k, p))
                    if old == (k, p):
                        held += len(s[0]) + OBJECTS
                    else:
                        held += OBJECTS
                        if (k, p) < old:
                            first[s] = (k, p)
                            old, k, p = (k, p), *old
                        r, left = bisect_right(splitters.value, s[0][:gram]), a - b
                        covered.append((r, k, p - left, left + s[1] - window + 1))
                    if held > hold:
                        yield from write(first, covered)
                        first, covered, held = {}, [], 0
        if first:
            yield from write(first, covered)

    return tidy(run)


def _decode(row):
    """The suffixes of a front-coded run: (bytes, shared with the one before, how many are right, key, place)."""
    lcp, size, right = (np.frombuffer(row[c], np.uint16).tolist() for c in ("lcp", "size", "right"))
    key, place = np.frombuffer(row["key"], np.int64).tolist(), np.frombuffer(row["place"], np.int32).tolist()
    rest, at, s = row["rest"], 0, b""
    for n, m, r, k, p in zip(lcp, size, right, key, place):
        s = s[:n] + rest[at : (at := at + m - n)]
        yield s, n, r, k, p


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings known to share ``known`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge_runs(runs: list):
    """Merge front-coded sorted runs, each an iterator of (string, shared with
    the one before, ...), with a loser tree; yields the same tuples, shared now
    with the one before in the merged order."""
    k = 1
    while k < len(runs):
        k *= 2
    its = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    head = [next(it, None) for it in its]
    lcp = [0] * k  # what each head shares with the last string that left the tree

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp is now what it shares with the winner."""
        if head[a] is None:
            return b, a
        if head[b] is None or lcp[a] > lcp[b]:
            return a, b
        if lcp[a] < lcp[b]:
            return b, a
        s, t = head[a][0], head[b][0]
        n = _shared(s, t, lcp[a])
        if s[n : n + 1] <= t[n : n + 1]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    losers, level = [0] * k, list(range(k))
    node = k
    while node > 1:
        node //= 2
        won = []
        for i in range(node):
            w, losers[node + i] = play(level[2 * i], level[2 * i + 1])
            won.append(w)
        level = won
    winner = level[0]
    while head[winner] is not None:
        s = head[winner]
        yield (s[0], lcp[winner], *s[2:])
        head[winner] = s = next(its[winner], None)
        lcp[winner] = s[1] if s else 0
        i = (winner + k) // 2
        while i:
            winner, losers[i] = play(winner, losers[i])
            i //= 2


def _covered(group: list, window: int):
    """(key, first start, number of starts) of the windows in a group of
    suffixes with one gram that start earlier elsewhere in the group."""
    first: dict = {}
    for s, _, right, key, place in group:
        who, at = (key, place), (s, right)
        old = first.setdefault(at, who)
        if old != who:
            if who < old:
                first[at], who = who, old
            left = len(s) - right
            yield who[0], who[1] - left, left + right - window + 1
    if len(first) == 1:
        return
    rows = sorted((key, place, s[right:][::-1] + s[:right], len(s) - right, right) for (s, right), (key, place) in first.items())
    for off in range(min(window - r for *_, r in rows), max(r for *_, r, _ in rows) + 1):
        seen = set()  # windows whose anchor is ``off`` bytes behind their start
        for key, place, context, left, right in rows:
            if window - right <= off <= left:
                w = context[left - off : left - off + window]
                if w in seen:
                    yield key, place - off, 1
                else:
                    seen.add(w)


GROUP = 20_000  # surroundings of one gram that a task compares itself


def _windows(group: list, window: int):
    """(key, start, digest) of every window around the gram of a group of suffixes."""
    for s, _, right, key, place in group:
        context, left = s[right:][::-1] + s[:right], len(s) - right
        for off in range(window - right, left + 1):
            yield key, place - off, hashlib.blake2b(context[left - off : left - off + window], digest_size=16).digest()


def _merge_range(window, gram):
    """Covered windows of a range as (key, first start, number of starts); the
    windows of a gram with more than ``GROUP`` surroundings as (key, start, digest)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out, hashed = [[], [], []], [[], [], []]

        def close(group, spilled):
            to, found = (hashed, _windows(group, window)) if spilled else (out, _covered(group, window) if len(group) > 1 else ())
            for c in found:
                for x, y in zip(to, c):
                    x.append(y)

        group, spilled = [], False
        for s in merge_runs([_decode(r) for r in rows]):
            if s[1] < gram and (group or spilled):
                close(group, spilled)
                group, spilled = [], False
            group.append(s)
            if len(group) >= GROUP:
                close(group, True)
                group, spilled = [], True
        close(group, spilled)
        arrays = [np.concatenate([*(np.frombuffer(r[c], t) for r in rows), np.array(x, t), np.array(h, t)]) for c, t, x, h in zip(("c_key", "c_start", "c_n"), (np.int64, np.int32, np.int32), out, (*hashed[:2], [1] * len(hashed[0])))]
        digest = [None] * (len(arrays[0]) - len(hashed[2])) + hashed[2]
        return pa.table([*(pa.array(x) for x in arrays), pa.array(digest, pa.binary())], names=["key", "start", "n", "digest"])

    return run


KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"


def _remove(window):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = raw_bytes(part["text"])
                spans = part["spans"]
                rows = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
                codes = np.asarray(spans.flatten())
                change = np.zeros(len(data) + 1, np.int32)
                if len(codes):
                    start = bounds[rows] + (codes >> 24)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + (codes & 0xFFFFFF) + window - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[bounds] = True  # a span ends with its document
                begins = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1]])[: len(gone)] | gone & edge[:-1])
                ends = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]])[: len(gone)] | edge[1:])) + 1
                of = np.searchsorted(bounds, begins, side="right") - 1
                total = np.concatenate([[0], np.cumsum(gone)])[bounds]
                left, cut = data[~gone].tobytes(), (bounds - total).tolist()
                found = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(spans)))]).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(begins - bounds[of]), pa.array(ends - begins)], names=["start", "length"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(bounds)), pa.array(np.diff(total).astype(np.int64)), pa.ListArray.from_arrays(pa.array(found), struct), pa.array([left[a:b] for a, b in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return tidy(run)


def _splitters(spark: SparkSession, read: DataFrame, sampler, ranges: int, apart: int) -> list[bytes]:
    """At most ``ranges - 1`` grams that cut a sample of the suffixes evenly.
    Texts are drawn by the bytes of all texts, so that about 200 suffixes a range
    are seen, whatever the texts' lengths; every eighth anchor of a text, one in
    ``apart`` bytes, is looked at."""
    total = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    sample = read.select("text").sample(min(1.0, 200 * ranges * 8 * apart / max(total, 1)), seed=7)
    heads = sorted(bytes(r["head"]) for r in sample.mapInArrow(sampler, "head binary").toLocalIterator())
    return sorted({heads[len(heads) * i // ranges] for i in range(1, ranges)}) if heads else []


def remove_repeated_bytes(docs: DataFrame, window: int = 100, gram: int = 32, bits: int = 28, depth: int = 1) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs) and kept (the
    remaining bytes) of every row of ``docs(doc_id, text)``. The sketch takes
    ``depth * 2**bits / 8`` bytes of broadcast (32 MB by default)."""
    spark = docs.sparkSession
    read = docs.select(doc_key().alias("key"), "text").filter("text is not null")
    cells = read.select("text").mapInArrow(_sketch_partition(window, gram, bits, depth), "cell long, n byte")
    merged = sketch.merge(cells, bits, depth)
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(_splitters(spark, read, _sample_partition(window, gram, bits, depth, merged), ranges, (window - gram) // 2))
    runs = read.mapInArrow(_runs(window, gram, bits, depth, merged, cuts), RUN)
    found = Tables(spark).save(runs.groupBy("range").applyInArrow(_merge_range(window, gram), "key long, start int, n int, digest binary"), "covered")
    # windows around a frequent gram meet by their digest, wherever they lie
    hashed = found.filter("digest is not null").select("digest", "key", "start")
    first = hashed.groupBy("digest").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = hashed.join(first, "digest").filter(F.struct("key", "start") != F.col("first")).select("key", "start", F.lit(1).alias("n"))
    covered = found.filter("digest is null").select("key", "start", "n").union(again)
    spans = covered.groupBy("key").agg(F.collect_list(F.col("start").cast("long") * 2**24 + F.col("n")).alias("spans"))
    whole = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return whole.join(spans, "key", "left").mapInArrow(_remove(window), KEPT)
