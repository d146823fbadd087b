"""Conversation prefix trie by vertical bitmaps.

1. Forks: every conversation is rebuilt as the first turns of its group's first
   conversation and its own turns after them (``rebuild``). From there on a turn
   is a 128-bit digest of (role, text) and the text's length in bytes.
2. Shards: conversations in order of id, ``width`` of them a shard. A shard's
   index maps (position, turn) to the bitset of the conversations that have the
   turn there. A depth-first walk starts from the bitset of all: a child is the
   parent's bitset intersected with the posting of the next turn of its least
   conversation; what is left without that child gives the next one. So there
   is one intersection a node. A node's popcount is its members in the shard,
   its intersection with the bitset of conversations of that length its end
   list. Sums over a shard's subtrees follow from the walk's order.
3. Across shards a node is named by a 128-bit digest of its turns. A node that
   one shard holds has its whole subtree there. The others are the top of the
   trie: popcounts and weighted bytes add up over shards; bytes and leaves of
   distinct nodes are summed over their subtrees by doubling (round i adds what
   the descendants 2**i levels down have summed), log2(depth) rounds.
4. End lists of a shared node are digested in one pass in order of shards.

Defined results: a null conv_id takes no part; rows of equal turn are ordered
by role, then by the text's digest, and all stay, repeated ones too; a null
turn comes first, null role or text is empty; other columns are not read; an
empty table has no node, not even a root. One conversation's digests (some 100
bytes a turn) are held by one task, its texts are not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rightsize.llm.common import Tables

EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "k0 long, k1 long, p0 long, p1 long, depth long, conv long, parent long, n_convs long, n_bytes long, n_children long, bytes_all long, bytes_once long, leaves long, ids binary, ids_sha256 string, up array<long>"


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, turn digest, n_bytes of the text), one row a turn."""
    empty = F.lit("")
    read = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("at"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).filter("conv is not null")
    whole = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    slim = read.select("conv", "at", "role", F.substring(F.unhex(whole), 1, 16).alias("turn"), F.octet_length("text").cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "role", "turn", "n_bytes")
    return slim.select("conv", F.row_number().over(order).cast("long").alias("pos"), "turn", "n_bytes")


def rebuild(turns: DataFrame, tables: Tables, base: Column, head: Column, most: int, reach: int) -> DataFrame:
    """(conv, pos, turn, n_bytes) of the rebuilt conversations, and for each
    conversation a mark, a row of position 0 without a turn. ``base`` and
    ``head`` are columns over ``conv``: whose first turns it takes, and how many
    (``most`` at most); bases lie within ``reach`` of their conversations."""
    turns = tables.save(turns, "turns")
    info = turns.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", base.alias("base"), head.alias("head"))
    has = info.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    info = info.join(has, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0).cast("long"))))
    info = tables.save(info.select("conv", "n", "base", "head", "taken"), "info")
    own = turns.join(info, "conv").filter("pos > head").select("conv", (F.col("taken") + F.col("pos") - F.col("head")).alias("pos"), "turn", "n_bytes")
    near = F.explode(F.sequence(F.col("conv") - reach, F.col("conv") + reach))
    lent = turns.filter(F.col("pos") <= most).select(F.col("conv").alias("base"), near.alias("conv"), "pos", "turn", "n_bytes")
    lent = lent.join(info, ["conv", "base"]).filter("pos <= head").select("conv", "pos", "turn", "n_bytes")
    marks = info.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("n_bytes"))
    return own.unionByName(lent).unionByName(marks)


# ---- inside Python workers ---------------------------------------------------

def members(bits: int, ids: list) -> list:
    out = []
    while bits:
        low = bits & -bits
        out.append(ids[low.bit_length() - 1])
        bits ^= low
    return out


def shard_trie(ids: list, paths: list, sizes: list) -> list[tuple]:
    """The nodes (rows of ``NODE``) of the trie of one shard: ascending
    conversation ids, their turn digests and their texts' sizes."""
    postings: dict = {}
    ended: dict = {}
    for slot, path in enumerate(paths):
        bit = 1 << slot
        for at, turn in enumerate(path):
            postings[at, turn] = postings.get((at, turn), 0) | bit
        ended[len(path)] = ended.get(len(path), 0) | bit
    nodes, line, todo = [], [], [(-1, b"", (1 << len(ids)) - 1, 0)]
    while todo:
        parent, turn, held, depth = todo.pop()
        least = (held & -held).bit_length() - 1
        above = nodes[parent] if depth else None
        key = hashlib.blake2b((above["key"] if depth else b"") + turn, digest_size=16).digest()
        del line[depth:]
        line.append(key)
        ends = held & ended.get(depth, 0)
        here, n_bytes = len(nodes), sizes[least][depth - 1] if depth else 0
        up = [line[depth - (1 << i)] for i in range(depth.bit_length())] if depth else []
        n = held.bit_count()
        nodes.append({"key": key, "above": parent, "up": up, "depth": depth, "conv": ids[least], "n": n, "n_bytes": n_bytes, "children": 0, "all": n * n_bytes, "once": n_bytes, "leaves": 0, "ends": members(ends, ids)})
        rest = held & ~ends
        while rest:
            slot = (rest & -rest).bit_length() - 1
            child = held & postings[depth, paths[slot][depth]]
            rest &= ~child
            nodes[here]["children"] += 1
            todo.append((here, paths[slot][depth], child, depth + 1))
    for node in reversed(nodes):
        node["leaves"] = node["leaves"] or 1
        if node["depth"]:
            above = nodes[node["above"]]
            for total in ("all", "once", "leaves"):
                above[total] += node[total]
    longs = lambda key: (int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True))
    out = []
    for x in nodes:
        above = nodes[x["above"]] if x["depth"] else None
        ids_le = np.array(x["ends"], np.int64).tobytes() if x["ends"] else None
        sha = hashlib.sha256(",".join(map(str, x["ends"])).encode()).hexdigest() if x["ends"] else None
        p = longs(above["key"]) if above else (None, None)
        out.append((*longs(x["key"]), *p, x["depth"], x["conv"], above["conv"] if above else None, x["n"], x["n_bytes"], x["children"], x["all"], x["once"], x["leaves"], ids_le, sha, [v for k in x["up"] for v in longs(k)]))
    return out


_TYPES = [pa.int64()] * 13 + [pa.binary(), pa.string(), pa.list_(pa.int64())]
_NAMES = [c.split()[0] for c in NODE.split(", ")]


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _shards(width: int, most: int):
    def run(batches):
        ids, paths, sizes, held = [], [], [], 0
        for batch in batches:
            for conv, turn, n_bytes in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "n_bytes"))):
                if turn is None:
                    if len(ids) == width or held >= most:
                        rows = shard_trie(ids, paths, sizes)
                        for at in range(0, len(rows), 8192):
                            yield _batch(rows[at : at + 8192])
                        ids, paths, sizes, held = [], [], [], 0
                    ids.append(conv)
                    paths.append([])
                    sizes.append([])
                else:
                    paths[-1].append(turn)
                    sizes[-1].append(n_bytes)
                    held += 1
        if ids:
            rows = shard_trie(ids, paths, sizes)
            for at in range(0, len(rows), 8192):
                yield _batch(rows[at : at + 8192])

    return run


def _digest_ends(batches):
    """Rows (k0, k1, ids) in order of key and shard: the digest of each key's whole list."""
    key, state, first = None, None, True
    for batch in batches:
        done = []
        for k0, k1, ids in zip(batch["k0"].to_pylist(), batch["k1"].to_pylist(), batch["ids"]):
            if (k0, k1) != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state, first = (k0, k1), hashlib.sha256(), True
            text = ",".join(map(str, np.frombuffer(ids.as_buffer(), np.int64).tolist()))
            state.update((text if first else "," + text).encode())
            first = False
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["k0", "k1", "sha"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["k0", "k1", "sha"])


# ---- across shards -----------------------------------------------------------

def prefix_trie(rebuilt: DataFrame, tables: Tables, width: int = 2048, most: int = 200_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256: one row a node of the trie of all conversations
    in ``rebuilt`` (rows as ``rebuild`` returns them). A shard ends after
    ``width`` conversations or ``most`` turns; neither changes the result."""
    rows = tables.save(rebuilt, "rebuilt")
    sharded = rows.repartitionByRange("conv").sortWithinPartitions("conv", "pos").select("conv", "turn", "n_bytes")
    nodes = tables.save(sharded.mapInArrow(_shards(width, most), NODE), "nodes")
    merged = nodes.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("shards"), F.min("conv").alias("s_conv"), F.sum("n_convs").alias("s_convs"), F.sum("bytes_all").alias("s_all"))
    shared = tables.save(merged.filter("shards > 1").drop("shards"), "shared")
    above = shared.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("s_conv").alias("p_conv"))
    placed = nodes.join(shared, ["k0", "k1"], "left").join(above, ["p0", "p1"], "left")
    alone, top = placed.filter("s_conv is null"), placed.filter("s_conv is not null")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = alone.select(F.col("conv").alias("conv_id"), "depth", F.coalesce("p_conv", "parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("bytes_all") - F.col("bytes_once")).alias("saved_tokens"), F.coalesce("ids_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    # each shared node once, with the children that one shard holds whole
    zero = F.lit(0).cast("long")
    hanging = alone.filter("p_conv is not null").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.sum("bytes_once").alias("h_once"), F.sum("leaves").alias("h_leaves"), F.count(F.lit(1)).alias("h_n"))
    first = top.filter("conv = s_conv").select("k0", "k1", "p0", "p1", "depth", "s_conv", "p_conv", "s_convs", "s_all", "n_bytes", "up")
    below = first.filter("depth > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count(F.lit(1)).alias("b_n"))
    first = first.join(hanging, ["k0", "k1"], "left").join(below, ["k0", "k1"], "left").withColumn("n_children", F.coalesce("h_n", zero) + F.coalesce("b_n", zero))
    first = tables.save(first.select("k0", "k1", "depth", "s_conv", "p_conv", "s_convs", "s_all", "up", "n_children", (F.col("n_bytes") + F.coalesce("h_once", zero)).alias("once"), F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("h_leaves", zero)).cast("long").alias("leaves")), "top")
    deepest = first.agg(F.max("depth")).first()[0] or 0
    for i in range(int(deepest).bit_length()):
        far = lambda j: F.get("up", F.lit(2 * i + j))  # noqa: E731, B023
        gain = first.filter(F.size("up") > 2 * i).groupBy(far(0).alias("k0"), far(1).alias("k1")).agg(F.sum("once").alias("g_once"), F.sum("leaves").alias("g_leaves"))
        grown = first.join(gain, ["k0", "k1"], "left")
        first = tables.save(grown.withColumn("once", F.col("once") + F.coalesce("g_once", zero)).withColumn("leaves", F.col("leaves") + F.coalesce("g_leaves", zero)).drop("g_once", "g_leaves"), f"top-{i}")
    lists = top.filter("ids is not null").select("k0", "k1", "conv", "ids").repartition("k0", "k1").sortWithinPartitions("k0", "k1", "conv").select("k0", "k1", "ids")
    sha = lists.mapInArrow(_digest_ends, "k0 long, k1 long, sha string")
    whole = first.join(sha, ["k0", "k1"], "left").select(F.col("s_conv").alias("conv_id"), "depth", F.col("p_conv").alias("parent_conv_id"), F.col("s_convs").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), (F.col("s_all") - F.col("once")).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))
    return own.select(out).unionByName(whole.select(out))


def forked_trie(conversations: DataFrame, group: int = 5, lent: int = 8, **shards) -> DataFrame:
    """The trie of the conversations of which each takes its first
    ``crc32(id) % (lent + 1)`` turns from the first of its group of ``group`` ids."""
    tables = Tables(conversations.sparkSession)
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % F.lit(lent + 1)
    rebuilt = rebuild(turns_of(conversations), tables, conv - conv % group, head.cast("long"), lent, group - 1)
    return prefix_trie(rebuilt, tables, **shards)
