"""Count-min prefilter shared by the two substring operators.

Each partition counts its hashed items in ``depth`` rows of ``2**bits`` cells
and emits the cells it touched, once each; the sketches are merged by summing
equal cells after a shuffle by block of cells. An item's estimate is the least of its
cells, never below its true count. Only one bit per cell is needed afterwards
("counted twice or more"), so what is broadcast is ``depth * 2**bits / 8``
bytes however large the corpus is; a corpus beyond the sketch's capacity makes
the filter pass more, never less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rightsize.llm.common import mix, take_bits


def cells_of(items: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """depth x len(items) cell numbers."""
    mask = np.uint64(2**bits - 1)
    return np.stack([(mix(items, salt + 1) & mask) + np.uint64(salt << bits) for salt in range(depth)])


def count_cells(parts, bits: int, depth: int):
    """A partition's sketch, as Arrow batches (cell, n), from iterated arrays of items."""
    held, size = [], 0

    def flush():
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(cell), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + (1 << 16)].astype(np.int64)), pa.array(np.minimum(n[at : at + (1 << 16)], 2).astype(np.int8))], names=["cell", "n"])

    for items in parts:
        held.append(cells_of(items, bits, depth).ravel())
        size += len(held[-1])
        if size > 4 << 20:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def merge(cells: DataFrame, bits: int, depth: int) -> Broadcast:
    """The merged sketches as a broadcast bit for each cell: counted twice or more."""
    spark = cells.sparkSession
    # dealt by block once: both aggregations run within it
    dealt = cells.select("n", (F.col("cell") + 1).alias("cell")).withColumn("block", F.bitmap_bucket_number("cell")).repartition("block")
    often = dealt.groupBy("block", "cell").agg(F.sum("n").alias("n")).filter("n >= 2")
    blocks = often.groupBy("block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = np.zeros(max(4096, (depth << bits) // 8), np.uint8)
    for row in blocks.collect():  # at most depth * 2**bits / 32768 rows of 4 KB
        block = np.frombuffer(bytes(row["bits"]), np.uint8)
        at = (row["block"] - 1) * 4096
        out[at : at + len(block)] = block[: len(out) - at]
    return spark.sparkContext.broadcast(out)


def often(sketch: np.ndarray, items: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Whether each item's estimated count is two or more."""
    hit = np.ones(len(items), bool)
    for row in cells_of(items, bits, depth):
        hit &= take_bits(sketch, row).astype(bool)
    return hit
