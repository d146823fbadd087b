"""Shared helpers: document keys, tables in the shared folder, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, and those ignored by exact dedup.
SPACES = " \t\n\x0b\x0c\r"
#: A null doc_id sorts behind every document that has one.
LAST = 2**63 - 1


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The long that names a document: its doc_id; for a null doc_id a value
    near the largest long, drawn from the text, so that such documents come
    last and differ from each other. Rows with equal key must have equal text."""
    by_text = F.lit(LAST) - F.shiftrightunsigned(F.xxhash64(F.col(text)), 2)
    return F.coalesce(F.col(doc_id).cast("long"), by_text)


def packed(docs: DataFrame) -> DataFrame:
    """(key, row): every row of ``docs`` as a struct beside its key, so that no
    column of it can clash with one of ours."""
    return docs.select(doc_key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


class Tables:
    """Intermediate tables, written as Parquet below ``spark.checkpoint.dir``.

    They cut the lineage of loops and survive lost executors. Without that
    setting a local session gets a folder of its own; a cluster is refused,
    since its executors share no other folder that we know of."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="llm-tables-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.saved = 0

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written once, in a folder a value of ``by`` if given, and read back."""
        write = df.write.option("compression", "zstd")
        (write.partitionBy(by) if by else write).parquet(f"{self.base}/{name}")
        self.saved += 1
        if self.saved % 6 == 0:  # loops write many small tables, a query each
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table of ours that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage and give the memory back. Spark frees
    the broadcasts, shuffles and generated classes of ended queries only after a
    collection, and a driver that runs many short queries may see none for long.
    Python goes first, as its objects hold plans in the JVM."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Have the driver's JVM return freed native blocks, as ``jcmd`` does with
    ``System.trim_native_heap``, and what it says ("" without that command).
    Every exchange of a query runs on threads of its own, and glibc keeps what
    they freed: some 180 MB after two passes of the pipeline over sf0.01."""
    jvm = spark._jvm
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # another JVM or C library
        return ""


# ---- inside Python workers ---------------------------------------------------

def tidy(run):
    """A partition function that leaves its worker as it found it. Workers live
    on from task to task, and a task's functions, with the tables they have
    cached, form reference cycles that a worker may not collect for many tasks."""

    def each(batches):
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc keeps freed blocks otherwise
                libc.malloc_trim(0)

    return each


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Zero-copy runs of rows with about ``most`` bytes of ``column`` each (one
    row at least), so that memory follows the slice and not the batch."""
    lens = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lens)
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + most
        to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, the index of each
    word's text, and the number of words of each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    counts = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    full = np.asarray(pc.binary_length(words).to_numpy(zero_copy_only=False)) > 0
    if not full.all():
        words, of = words.filter(pa.array(full)), of[full]
    return words, of, np.bincount(of, minlength=len(texts))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end (null: none), and where each text begins and ends."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word: polynomials of its bytes,
    finalised with its length; words over 512 bytes, whose polynomials could be
    made to meet, by halves of a BLAKE2b digest."""
    data, ends = raw_bytes(words)
    size = np.diff(ends)
    long = np.flatnonzero(size > 512)
    out = []
    for turn, base in enumerate((0xD1342543DE82EF95, 0xAF251AF3B0F025B5)):
        up, down = powers(base, len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        values = mix(np.arange(256, dtype=np.uint64), 7 + turn)[data]
        values *= up[: len(data)]
        np.cumsum(values, out=sums[1:])
        h = mix((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]] + mix(size.astype(np.uint64)))
        for i in long.tolist():
            digest = hashlib.blake2b(data[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest()
            h[i] = int.from_bytes(digest[8 * turn : 8 * turn + 8], "little")
        out.append(h)
    return out[0], out[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 steps)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a worker


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers modulo 2**64 of an odd base, and their inverses."""
    if len(_POWERS.get(base, ((),))[0]) < n:
        made = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(n, b, np.uint64)
            x[:1] = 1
            made.append(np.multiply.accumulate(x, out=x))
        _POWERS[base] = made[0], made[1]
    up, down = _POWERS[base]
    return up[:n], down[:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every ``width`` consecutive values;
    ``values`` must be hashes themselves, ``base`` odd."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(base, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up, out=sums[1:])
    m = n - width + 1
    return (sums[width:] - sums[:m]) * down[:m]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = np.minimum(values[: span - width], values[width - span :])
    return values


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of its least gram, the
    leftmost of equals. It depends on the run's content alone, so equal runs
    have their anchor at the same offset: a repeated window implies a repeated
    gram at its anchor."""
    n = len(grams) - width + 1
    out = np.empty(max(n, 0), np.int64)
    step = 1 << 20
    for at in range(0, n, step):  # 24 low bits hold the place within the step
        part = mix(grams[at : at + step + width - 1]) & np.uint64(0xFFFFFFFFFF000000)
        part |= np.arange(len(part), dtype=np.uint64)
        least = sliding_min(part, width)
        out[at : at + len(least)] = (least & np.uint64(0xFFFFFF)).astype(np.int64) + at
    return out


def take_bits(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
