"""WARC archives in Zstandard: one frame per record, the dictionary in a leading
skippable frame.

Writing: payload digests decide which record is the response of each group of
equal payloads (its smallest page_id) and which revisit it; a group is one row
on the counted side of that join, however large it is. Each task then writes
its records to an archive in a shared folder, under a temporary name until it
is whole, so a task that is run again leaves no half archive behind; archives
are cut at ``part_bytes`` of payload. A dictionary is trained on the first
payloads of the archive.

Reading: an archive begins with a skippable frame (magic 0x184D2A5D) that holds
the dictionary; then follows a frame per record. Each is decoded on its own and
its record checked: version line, mandatory headers, Content-Length against the
frame's content, block digest and, for a response, payload digest. A damaged
record raises. Memory is one record and one chunk of the file.

Defined results: a null html is an empty payload; a null url leaves out
WARC-Target-URI, line breaks in a url are percent-encoded; rows with a null
page_id count as the largest and their records name no page; of repeated rows
one is the response; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rightsize.llm.common import LAST, Tables

MAGIC = 0x184D2A5D  # fixed value: the skippable frame of a dictionary
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, size: int, digest: str, first, revisit: bool) -> bytes:
    """The record of a page: an HTTP response, or a revisit of page ``first`` without the payload."""
    who = "urn:page:" + ("" if page_id is None else str(page_id))
    headers = [("WARC-Record-ID", f"<{who}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{'' if first is None else first}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records, empty if they are too few or too alike."""
    try:
        return zstandard.train_dictionary(32 << 10, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """An archive under a temporary name; ``close`` gives it its own."""

    def __init__(self, folder: str, name: str, samples: list[bytes]):
        self.store, base = open_folder(folder)
        self.path, self.part = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part, compression=None)
        raw = train(samples)
        self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        given = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
        self.frame = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **given)
        self.records = 0

    def add(self, rec: bytes) -> None:
        self.out.write(self.frame.compress(rec))
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


MANIFEST = "archive string, records long"


def _write_partition(folder: str, part_bytes: int, train_bytes: int = 4 << 20):
    def run(batches):
        held, size, count, name, out, total = [], 0, 0, uuid.uuid4().hex, None, 0

        def finish(out):
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([out.path.rsplit("/", 1)[1]]), pa.array([out.records])], names=["archive", "records"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    payload = (r["html"] or "").encode()
                    rec = page_record(r["page_id"], r["url"], payload, len(payload), sha1_base32(payload), r["first"], r["revisit"])
                    total += len(rec)
                    if out is None:
                        held.append(rec)
                        size += len(rec)
                        if size < train_bytes:
                            continue
                        out = Writer(folder, f"{name}-{count}.warc.zst", held)
                        for rec in held:
                            out.add(rec)
                        held, size = [], 0
                    else:
                        out.add(rec)
                    if total >= part_bytes:
                        yield finish(out)
                        out, total, count = None, 0, count + 1
        if held:
            out = Writer(folder, f"{name}-{count}.warc.zst", held)
            for rec in held:
                out.add(rec)
        if out is not None:
            yield finish(out)

    return run


def write_archives(pages: DataFrame, folder: str, tables: Tables, least: int = 0, part_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` to archives in
    ``folder``; returns the manifest (archive, records) of the whole ones.
    Payloads of ``least`` bytes or more that are equal are stored once."""
    html = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(html) >= least, F.sha2(html.cast("binary"), 256)).alias("sha"))
    # a row number breaks ties between rows repeated in full, so that one of them is the response
    named = tables.save(read.withColumn("row", F.monotonically_increasing_id()), "pages")
    rank = F.struct(F.coalesce("page_id", F.lit(LAST)).alias("id"), F.col("row"))
    first = named.filter("sha is not null").groupBy("sha").agg(F.min(rank).alias("least_rank"))
    marked = named.join(first, "sha", "left").withColumn("lead", F.col("sha").isNull() | (F.col("row") == F.col("least_rank.row")))
    first_id = F.when(F.col("least_rank.id") < LAST, F.col("least_rank.id"))
    out = marked.select("page_id", "url", "html", first_id.alias("first"), (~F.col("lead")).alias("revisit"))
    return out.mapInArrow(_write_partition(folder, part_bytes), MANIFEST)


def frames(stream, chunk: int = 1 << 20):
    """(dictionary, iterator of decoded frames) of an archive's byte stream."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("archive shorter than the dictionary's frame header")
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise ValueError(f"archive begins with {magic:#x}, not with a dictionary frame")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary's frame is cut short")
    given = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    decoder = zstandard.ZstdDecompressor(**given)

    def decoded():
        rest = b""
        while rest or (rest := stream.read(chunk)):
            one, parts = decoder.decompressobj(), []
            while not one.eof:
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else stream.read(chunk)
                if not rest and not one.eof:
                    raise ValueError("the last frame is cut short")
            yield b"".join(parts)

    return raw, decoded()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises where it does not hold together."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record without {name}")
    size = headers["content-length"]
    if not size.isdigit() or int(size) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} but {len(rest) - 4} bytes")
    block = rest[:-4]
    if headers.get("warc-block-digest", "").removeprefix("sha1:") not in ("", sha1_base32(block)):
        raise ValueError("the block's digest is wrong")
    return headers, block


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _page(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(n) if (n := headers.get(name, "").strip("<>").removeprefix("urn:page:")) else None
    _, _, payload = block.partition(b"\r\n\r\n")
    kind, digest, size = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} is not the one its headers tell of")
    url = headers.get("warc-target-uri")
    url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return number("warc-record-id"), url, size, digest, kind, number("warc-refers-to"), payload if kind == "response" else None


def _read_partition(folder: str):
    def run(batches):
        names = [f.split()[0] for f in READ.split(", ")]
        store, base = open_folder(folder)
        for batch in batches:
            for name, records in zip(batch["archive"].to_pylist(), batch["records"].to_pylist()):
                count, held, size = 0, [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in frames(stream)[1]:
                        held.append(_page(*parse(data)))
                        count, size = count + 1, size + len(data)
                        if size > 4 << 20:
                            yield _batch(held, names)
                            held, size = [], 0
                if count != records:
                    raise ValueError(f"{name} holds {count} records, its manifest says {records}")
                if held:
                    yield _batch(held, names)

    def _batch(rows, names):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    payload (null for revisits) of every record of the manifest's archives, one
    archive a task."""
    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive")
    return spread.mapInArrow(_read_partition(folder), READ)


def archive_folder(spark: SparkSession) -> tuple[Tables, str]:
    """A new folder for archives below the shared one, made on its file system."""
    tables = Tables(spark)
    folder = f"{tables.base}/archives"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return tables, folder


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` written to archives and read back."""
    tables, folder = archive_folder(pages.sparkSession)
    manifest = tables.save(write_archives(pages, folder, tables, least), "manifest")
    return read_archives(manifest, folder)
