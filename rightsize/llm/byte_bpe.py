"""Byte-level BPE encoding and decoding.

1. Every text is cut into words by the tokenizer's pattern; the words' counts
   over the whole corpus choose the most frequent ones, ``table`` at most.
2. Spark higher-order functions encode each of these distinct words once: an
   ``aggregate`` folds the ranked merges over the word's array of bytes (as hex
   strings, so that joining two pieces is ``concat``), looking pairs up in a
   literal rank map. The map is an array of small maps by hash, for a lookup in
   a map literal is a linear search.
3. The table of words and ids, bounded by ``table`` words of ``LONGEST`` bytes,
   is broadcast; a second pass cuts the texts again and strings the ids
   together. A word outside the table is merged by the same rule in the task.
4. Decoding looks the ids' pieces up in a literal array and concatenates them.

Ids are those of the rank file, without special tokens. Defined results: a null
text is an empty one, with no ids; words of any length are merged (in n log n);
other columns are not read; repeated rows are encoded each; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rightsize.llm.common import Tables, raw_bytes, release, slices, tidy

LONGEST = 64
BUCKETS = 8192
#: Of a task: bytes of text cut at a time, and words outside the table whose ids are kept for reuse.
SLICE, KNOWN = 1 << 20, 50_000
#: Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's pieces: base64 and rank a line. The file lies beside the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def char_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    import regex

    kinds = (LETTER, regex.compile(r"\p{L}+")), (NUMBER, regex.compile(r"\p{N}+"))
    out = np.zeros(0x110000, np.uint8)
    for at in range(0, 0x110000, 0x10000):
        points = range(at, at + 0x10000) if at else (*range(0xD800), *range(0xE000, 0x10000))
        text = "".join(map(chr, points))
        for kind, pattern in kinds:
            for m in pattern.finditer(text):
                out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[WHITE] = SPACE
    out[0xD800:0xE000] = OTHER
    return out


def cut(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the pattern's matches begin, and the number of
    them in each text: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. The matches tile the text: runs of a
    class, with a blank before one drawn into it, the last white space before
    other text on its own, and contractions cut off where an apostrophe begins
    a run."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    if data.max() < 128:
        at, points = None, data
    else:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes[points]
    text_start = np.zeros(len(points) + 1, bool)
    text_start[bounds if at is None else np.searchsorted(at, bounds)] = True
    start = text_start.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~text_start[1:-1]) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 32
    quote = np.flatnonzero((points == 39) & start[:-1])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~text_start[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & ~short & ~text_start[np.minimum(quote + 2, len(points))] & ((one == ord("l")) & (two == ord("l")) | ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[np.minimum(quote[long] + 3, len(points))] = True
    begins = np.flatnonzero(start[:-1])
    if at is not None:
        begins = at[begins]
    return begins, np.diff(np.searchsorted(begins, bounds))


def words_of(texts: pa.Array, classes: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, coded by their distinct ones, and the number of words of each text."""
    data, bounds = raw_bytes(texts)
    begins, counts = cut(data, bounds, classes)
    offsets = np.append(begins, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return words.dictionary_encode(), counts


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: always join the pair of least rank, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= LONGEST:
        parts = [word[i : i + 1] for i in range(len(word))]
        near = [ranks.get(a + b, LAST) for a, b in zip(parts, parts[1:])]
        while near and (least := min(near)) < LAST:
            i = near.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], LAST)
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], LAST)
        return [ranks[p] for p in parts]
    end = list(range(1, len(word) + 1))  # of the part that begins here; 0: joined to one before
    before = list(range(-1, len(word) - 1))
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2], LAST)) < LAST]
    heapq.heapify(heap)
    while heap:
        r, i, to = heapq.heappop(heap)
        j = end[i]
        if not j or j >= len(word) or not end[j] or end[j] != to:
            continue
        end[i], end[j] = to, 0
        if to < len(word):
            before[to] = i
            if (r := ranks.get(word[i : end[to]], LAST)) < LAST:
                heapq.heappush(heap, (r, i, end[to]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : to], LAST)) < LAST:
            heapq.heappush(heap, (r, before[i], to))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


LAST = 1 << 62  # behind every rank


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that join to a piece: an open hash table of codes
    ``a * 2**32 + b`` (empty: -1) and the joined ids."""
    left, value = array("q"), array("i")
    for w, r in ranks.items():
        for i in range(1, len(w)):
            if (a := ranks.get(w[:i])) is not None and (b := ranks.get(w[i:])) is not None:
                left.append((a << 32) + b)
                value.append(r)
    todo, value = np.array(left, np.int64), np.array(value, np.int32)
    codes, joined = np.full(1 << (2 * len(todo)).bit_length(), -1, np.int64), np.zeros(1 << (2 * len(todo)).bit_length(), np.int32)
    at = _slot(todo, len(codes))
    while len(todo):
        free = np.flatnonzero(codes[at] < 0)
        _, one = np.unique(at[free], return_index=True)
        put = free[one]
        codes[at[put]], joined[at[put]] = todo[put], value[put]
        left = np.ones(len(todo), bool)
        left[put] = False
        todo, value, at = todo[left], value[left], (at[left] + 1) % len(codes)
    return codes, joined


def _slot(code: np.ndarray, size: int) -> np.ndarray:
    h = code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def merge_many(words: list[bytes], pairs: tuple[np.ndarray, np.ndarray], single: np.ndarray) -> list[bytes]:
    """``merge`` of many words of like length, none of them a piece, in step:
    each round joins every word's least pair, the leftmost of equals. Returns
    the ids' little-endian bytes."""
    codes, joined = pairs
    none = np.iinfo(np.int32).max

    def rank(a, b):
        out = np.full(a.shape, none, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        code = (a.ravel()[todo].astype(np.int64) << 32) + b.ravel()[todo]
        at = _slot(code, len(codes))
        while len(todo):
            there = codes[at]
            hit = there == code
            out.ravel()[todo[hit]] = joined[at[hit]]
            on = ~hit & (there >= 0)
            todo, code, at = todo[on], code[on], (at[on] + 1) % len(codes)
        return out

    size = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(size.max())
    ids = np.full((len(words), wide + 1), -1, np.int32)
    column = np.arange(wide + 1)
    ids[column < size[:, None]] = single[np.frombuffer(b"".join(words), np.uint8)]
    near = rank(ids[:, :-1], ids[:, 1:])
    live = np.arange(len(words))
    while True:
        i = near[live].argmin(axis=1)
        least = near[live, i]
        some = least < none
        live, i, least = live[some], i[some], least[some]
        if not len(live):
            break
        size[live] -= 1
        shift = column[:-1] + (column[:-1] > i[:, None])
        part = np.take_along_axis(ids[live], shift, axis=1)
        rows = np.arange(len(live))
        part[rows, i] = least
        ids[live, :-1] = part
        ids[live, -1] = -1
        part = ids[live]
        pairs_near = np.take_along_axis(np.concatenate([near[live], np.full((len(live), 1), none, np.int32)], axis=1), shift, axis=1)
        pairs_near[rows, i] = rank(part[rows, i], part[rows, i + 1])
        left = i > 0
        pairs_near[rows[left], i[left] - 1] = rank(part[rows[left], i[left] - 1], part[rows[left], i[left]])
        near[live] = pairs_near
    raw = ids[column < size[:, None]].astype("<i4").tobytes()
    ends = (np.cumsum(size) * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _count_partition(classes):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                coded, _ = words_of(part["text"], classes.value)
                times = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(times.astype(np.int64))], names=["word", "n"])

    return tidy(run)


def _literal(value, schema: str) -> Column:
    """A nested literal: Catalyst folds from_json of a literal into one."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def rank_table(ranks: dict[bytes, int]) -> Column:
    """A literal array of maps, by CRC, of hex pieces to ranks."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        maps[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return _literal(maps, "array<map<string,int>>")


def rank_in(table: Column, piece: Column) -> Column:
    """The rank of a hex piece (null: none)."""
    return F.element_at(F.element_at(table, (F.crc32(piece) % BUCKETS + 1).cast("int")), piece)


def fold_merges(word: Column, table: Column) -> Column:
    """Ids of a binary word: a fold of ranked merges over its bytes. The table
    is bound to a lambda's variable, so that the plan holds it once and not at
    each of its uses."""
    return F.element_at(F.transform(F.array(table), lambda bound: _fold(word, lambda piece: rank_in(bound, piece))), 1)


def _fold(word: Column, rank) -> Column:
    text = F.hex(word)
    count = F.octet_length(word)
    bytes_ = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, i * 2 + 1, F.lit(2)))

    def step(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))

        def join(near: Column) -> Column:
            i = F.array_position(near, F.array_min(near)).cast("int")
            joined = F.concat(F.slice(parts, F.lit(1), i - 1), F.array(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.slice(parts, i + 2, F.size(parts)))
            return F.when(F.array_min(near).isNull(), parts).otherwise(joined)

        return F.when(F.size(parts) < 2, parts).otherwise(F.element_at(F.transform(F.array(pairs), join), 1))

    merged = F.aggregate(F.sequence(F.lit(1), count), bytes_, lambda parts, _: step(parts))
    return F.when(rank(text).isNotNull(), F.array(rank(text))).otherwise(F.transform(merged, rank))


ENCODED = "doc_id long, n_tokens long, ids array<int>, ids_le binary"


def _encode_partition(classes, ranks, pairs, table):
    def run(batches):
        known: dict[bytes, bytes] = {}
        pieces = ranks.value
        given = table.value
        single = np.array([pieces[bytes([i])] for i in range(256)], np.int32)

        def learn(words: list[bytes]):
            short: dict[int, list] = {}
            for w in words:
                if w in pieces or len(w) > LONGEST:
                    known[w] = np.array(merge(w, pieces), "<i4").tobytes()
                else:
                    short.setdefault(len(w) // 8, []).append(w)
            for like in short.values():
                for at in range(0, len(like), 16384):
                    known.update(zip(like[at : at + 16384], merge_many(like[at : at + 16384], pairs.value, single)))

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                coded, counts = words_of(part["text"], classes.value)
                words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
                if len(known) > KNOWN:
                    known.clear()
                learn([w for w in words if w not in given and w not in known])
                codes = [given.get(w) or known[w] for w in words]
                size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
                flat = np.frombuffer(b"".join(codes), np.int32)
                place = np.cumsum(size) - size
                index = np.asarray(coded.indices)
                n = size[index]
                ends = np.cumsum(n)
                ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(place[index] - (ends - n), n)]
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(bounds)), lists, raw], names=["doc_id", "n_tokens", "ids", "ids_le"])

    return tidy(run)


def most_frequent(counts: DataFrame, table: int) -> DataFrame:
    """The words of ``counts(word, n)`` whose count is over the least level that
    leaves at most ``table`` of them. Levels are counts to ten significant bits,
    so a histogram of some thousand rows finds it and no task sorts the words."""
    over = F.greatest(F.length(F.bin("n")) - 10, F.lit(0)).cast("int")
    level = F.expr("shiftleft(shiftright(n, over), over)")
    held = counts.withColumn("over", over).withColumn("level", level)
    least, taken = 0, 0
    for row in sorted(held.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        taken += row["count"]
        if taken > table:
            least = row["level"]
            break
    return held.filter(F.col("level") > least).select("word")


def encode(docs: DataFrame, path: str, table: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids and ids_le (little-endian unsigned 32-bit) of every
    row of ``docs(doc_id, text)``, by the rank file at ``path``. At most
    ``table`` words are held in the broadcast table."""
    spark = docs.sparkSession
    ranks = read_ranks(path)
    classes = spark.sparkContext.broadcast(char_classes())
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = read.select("text").mapInArrow(_count_partition(classes), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tables = Tables(spark)
    counts = tables.save(counts.filter(F.octet_length("word") <= LONGEST), "counts")
    # spread over tasks: the fold costs far more than the row
    words = tables.save(most_frequent(counts, table), "words").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables.drop("counts")
    release(spark)  # what follows is the largest plan of all
    # the driver keeps the text of every plan it ran, which would hold the rank map several times over
    limit = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100000")
    try:
        folded = words.select("word", fold_merges(F.col("word"), rank_table(ranks)).alias("ids")).toArrow().combine_chunks()
    finally:
        spark.conf.set(limit, before)
    coded = {}
    for part in folded.to_batches():
        raw, ends = part["ids"].flatten().to_numpy().astype("<i4").tobytes(), np.cumsum(part["ids"].value_lengths().to_numpy()) * 4
        coded.update(zip(part["word"].to_numpy(zero_copy_only=False).tolist(), (raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist()))))
    del folded
    pa.default_memory_pool().release_unused()
    release(spark)  # the fold's plan and its rank map
    share = spark.sparkContext.broadcast
    return read.mapInArrow(_encode_partition(classes, share(ranks), share(pair_table(ranks)), share(coded)), ENCODED)


def decode(ids: Column, path: str) -> Column:
    """The bytes that an array of ids stands for (null for an id that is none)."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece.hex()
    table = _literal(pieces, "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))
