"""Substring dedup over words: count-min prefilter, then exact grouping.

A window is ``window`` consecutive words of one document. Every word covered
by a window that also starts in a document with a smaller key is removed.

1. Each partition sketches its windows, merged into one count-min sketch. A
   window is sketched by the ``gram`` words at its anchor (the least gram hash
   inside it): neighbouring windows share their anchor, so the sketch holds
   about one item for ``(window - gram) / 2`` words, and the estimate of a
   window, its anchor's, is never below the window's count.
2. A second pass keeps the windows estimated to repeat. Each partition first
   groups its own: copies within the partition are decided there, so that only
   the first document of each window and partition is shuffled, however many
   copies there are. The rest is grouped exactly, by 96 bits of two independent
   window hashes, to find each window's first document.
3. The covered positions go back to their documents.

Defined results: null or empty texts have no words and keep an empty text;
texts shorter than the window keep all their words; repeated rows of one
document (same doc_id, same text) are one document; null doc_ids come last,
in an order drawn from their text; columns other than doc_id and text are not
read, so any names may occur; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rightsize.llm import sketch
from rightsize.llm.common import anchors, doc_key, mix, rolling, slices, split_words, word_hashes

BASES = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _windows(batch: pa.RecordBatch, window: int, gram: int):
    """(hash 1, hash 2, anchor gram, anchor place, document row, place) of each window of a slice."""
    words, of, counts = split_words(batch["text"])
    if len(words) < window:
        return None
    one, two = word_hashes(words)
    grams = rolling(one, gram, BASES[0])
    at = anchors(grams, window - gram + 1)
    start = np.flatnonzero(of[: len(of) - window + 1] == of[window - 1 :])
    if not len(start):
        return None
    first = np.concatenate([[0], np.cumsum(counts)])[of[start]]
    at = at[start]
    return rolling(one, window, BASES[0]), rolling(two, window, BASES[1]), grams, at, of[start], start, first


def _sketch_partition(window, gram, bits, depth):
    def items(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                if (w := _windows(part, window, gram)) is not None:
                    yield w[2][np.unique(w[3])]

    return lambda batches: sketch.count_cells(items(batches), bits, depth)


SCHEMA = "h1 long, h2 int, key long, place int, n int, done boolean"


def _candidates(window, gram, bits, depth, merged):
    hold = 1 << 20

    def group(held):
        """Decide within the partition what can be decided there."""
        h1, h2, key, place = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h1, kind="stable")
        h1, h2, key, place = h1[order], h2[order], key[order], place[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        starts = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(key))))
        later = key > least
        k, p = key[later], place[later]
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        run = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)])) if len(k) else np.empty(0, int)
        n = np.diff(np.append(run, len(k)))
        k, p = k[run], p[run]
        lead = ~later
        out = (
            np.concatenate([h1[lead].view(np.int64), mix(k.view(np.uint64) ^ mix(p.astype(np.uint64))).view(np.int64)]),
            np.concatenate([(h2[lead] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.zeros(len(k), np.int32)]),
            np.concatenate([key[lead], k]), np.concatenate([place[lead], p]).astype(np.int32),
            np.concatenate([np.ones(lead.sum(), np.int32), n.astype(np.int32)]), np.concatenate([np.zeros(lead.sum(), bool), np.ones(len(k), bool)]),
        )
        for at in range(0, len(out[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in out], names=["h1", "h2", "key", "place", "n", "done"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                if (w := _windows(part, window, gram)) is None:
                    continue
                h1, h2, grams, at, of, start, first = w
                places, back = np.unique(at, return_inverse=True)
                hit = sketch.often(merged.value, grams[places], bits, depth)[back]
                start, of, first = start[hit], of[hit], first[hit]
                if len(start):
                    held.append((h1[start], h2[start], np.asarray(part["key"])[of], start - first))
                    size += len(start)
                if size > hold:
                    yield from group(held)
                    held, size = [], 0
        if size:
            yield from group(held)

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _remove(window):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, of, counts = split_words(part["text"])
                ends = np.cumsum(counts)
                firsts = ends - counts
                change = np.zeros(len(words) + 1, np.int32)
                spans = part["spans"]
                rows = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
                codes = np.asarray(spans.flatten())
                if len(codes):
                    start = firsts[rows] + (codes >> 24)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + (codes & 0xFFFFFF) + window - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed = np.bincount(of[gone], minlength=len(counts))
                left = words.filter(pa.array(~gone)).to_numpy(zero_copy_only=False).tolist()
                to = np.cumsum(counts - removed).tolist()
                texts = [" ".join(left[a:b]) for a, b in zip([0, *to], to)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeated_passages(docs: DataFrame, window: int = 50, gram: int = 25, bits: int = 26, depth: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)
    of every row of ``docs(doc_id, text)``. ``bits`` and ``depth`` size the
    sketch: ``depth * 2**bits / 8`` bytes are broadcast (16 MB by default)."""
    read = docs.select(doc_key().alias("key"), "text")
    cells = read.select("text").mapInArrow(_sketch_partition(window, gram, bits, depth), "cell long, n byte")
    merged = sketch.merge(cells, bits, depth)
    found = read.filter("text is not null").mapInArrow(_candidates(window, gram, bits, depth, merged), SCHEMA)
    same = Window.partitionBy("h1", "h2", "done")
    covered = found.withColumn("least", F.min("key").over(same)).filter("done or least < key")
    spans = covered.groupBy("key").agg(F.collect_list(F.col("place").cast("long") * 2**24 + F.col("n")).alias("spans"))
    whole = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = whole.join(spans, "key", "left")
    return joined.mapInArrow(_remove(window), KEPT)
