"""Archives, conversations and vectors."""

import hashlib
import base64
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from rightsize.llm import chat_format, hash_index, suffix_dedup, warc
from rightsize.llm.queries import CONTROL, QUERIES

SF = "/root/testdata/sf0.001"


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y%", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\n" * 50000), (6, "u", "WARC/1.1\r\n\r\n"), (None, "n", "<p>x</p>"), (7, "u", "same"), (7, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows)
    for page, url, html in rows:
        body = (html or "").encode()
        got = [r for r in out if r.page_id == page]
        assert all((r.url, r.payload_bytes, r.payload_digest) == (url, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) for r in got)
        assert all(bytes(r.payload) == body for r in got if r.record_type == "response")
    kind = {r.page_id: (r.record_type, r.refers_to) for r in out}
    assert kind[1] == ("response", None) and kind[2] == kind[None] == ("revisit", 1) and kind[3] == ("response", None) and kind[4] == ("revisit", 3)
    assert sorted(r.record_type for r in out if r.page_id == 7) == ["response", "revisit"]
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_damaged_records_raise():
    good = warc.page_record(1, "u", b"body", 4, warc.sha1_base32(b"body"), None, False)
    assert warc._page(*warc.parse(good))[2:5] == (4, warc.sha1_base32(b"body"), "response")
    for bad in (good[:-1], good.replace(b"body", b"bodz"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date: ", b"WARC-Dote: ")):
        with pytest.raises(ValueError):
            warc._page(*warc.parse(bad))


def test_events_fold(spark):
    log = [
        (1, 0, 0, 0, "start", "user", None), (1, 0, 0, 1, "delta", None, "he"), (1, 0, 0, 2, "delta", None, "y"), (1, 0, 0, 9, "edit", None, "hello"),
        (1, 1, 0, 3, "start", "assistant", None), (1, 1, 0, 4, "delta", None, "bad"), (1, 1, 0, 5, "regenerate", None, None), (1, 1, 0, 7, "delta", None, "ood"), (1, 1, 0, 6, "delta", None, "g"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.final_messages(events).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good")}
    assert chat_format.final_messages(events.limit(0)).collect() == []


def test_format_is_reversible(spark):
    rng = random.Random(5)
    texts = ["", None, CONTROL, "\\", "\\l", "\\\\n\n</turn>\n<turn>", *("".join(rng.choice("\\<ln/turn>\n é") for _ in range(30)) for _ in range(40))]
    rows = [(i // 4 if i else None, i, "assistant" if i % 2 else "us\\er\n<", t, "x") for i, t in enumerate(texts)] + [(3, 12, "us\\er\n<", "twice", "x"), (3, 12, "us\\er\n<", "twice", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")
    out = {r.conv_id: r for r in chat_format.digests(chat_format.render(chat_format.final_messages(chat_format.as_events(conv)))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r, x or "") for k, t, r, x, _ in rows if k == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        got = out[c]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (len(turns), brute.sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), brute.sha(loss))


def exact_neighbours(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([list(r.embedding) for r in rows], float)
    out = QUERIES["op9_nearest_neighbours"](spark, SF).collect()
    hits = 0
    asked = ids[ids % 100 == 0]
    for q in asked:
        got = [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])]
        want = exact_neighbours(ids, x, q)
        hits += len({v for v, _ in got} & {v for v, _ in want})
        assert got == sorted(got, key=lambda g: (g[1], g[0])) and len(got) == len(want)
        for v, s in got:
            assert s == pytest.approx(np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum()), rel=1e-12)
    assert hits >= 0.9 * 10 * len(asked)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8)], "c") for i in range(60)]
    rows += [(100 + i, [1.0] * 8, "c") for i in range(40)] + [(200, None, "c"), (201, [0.0] * 8, "c"), (202, [1.0, None] + [0.0] * 6, "c"), (203, [float("nan")] * 8, "c"), (204, [1.0] * 7, "c"), (None, [2.0] * 8, "c"), (300, [-0.0] + [1.0] * 7, "c"), (300, [-0.0] + [1.0] * 7, "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string")
    out = hash_index.search(vectors, F.col("id") % 20 == 0, enough=100).collect()
    good = [(i, v) for i, v, _ in rows[:100]] + [(300, rows[-1][1])]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    for q in [i for i in ids if i % 20 == 0]:
        got = [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])]
        assert got == [(v, pytest.approx(s)) for v, s in exact_neighbours(ids, x, q)]
    assert {r.query_id for r in out} == {int(i) for i in ids if i % 20 == 0}
    assert hash_index.search(vectors.limit(0), F.col("id") % 20 == 0).collect() == []


def test_neighbours_probe_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    own = rng.integers(-(2**63), 2**63, size=(700, 4)).view(np.uint64)
    own[5], own[6] = own[4], ~own[4]
    q = np.concatenate([own[:20], rng.integers(-(2**63), 2**63, size=(20, 4)).view(np.uint64)])
    r = np.array([0, 1, 31, 32, 33, 63, 64, 96, 100, 110, 120, 128, 129, 150, 200, 224, 255, 256, 256, 0] * 2, np.int32)
    apart = np.bitwise_count(q[:, None] ^ own).sum(axis=2, dtype=int)
    got = {int(i): rows.tolist() for now, found in hash_index.within(own, q, r, at_once=3) for i, rows in zip(now, found)}
    assert got == {i: np.flatnonzero(apart[i] <= r[i]).tolist() for i in range(40)}
    # of each shard the nearest, ties by id, and how many there are
    x, y = rng.integers(0, 3, size=(700, 5)).astype(float), rng.integers(0, 3, size=(40, 5)).astype(float)
    asked = SimpleNamespace(value={"query": np.arange(1000, 1040), "q": q, "r": r, "y": y})
    ids = rng.permutation(700)
    columns = [pa.array(ids), pa.array(x.tolist(), pa.list_(pa.float64())), *(pa.array(c) for c in np.ascontiguousarray(own.view(np.int64).T))]
    whole = pa.RecordBatch.from_arrays(columns, names=["id", "vector", "c0", "c1", "c2", "c3"])
    batches = [whole.slice(a, b - a) for a, b in ((0, 0), (0, 300), (300, 301), (301, 700))]
    for shard in (64, 130, 700, 10_000):
        out = [row for b in hash_index._probe_partition(asked, 3, shard)(iter(batches)) for row in b.to_pylist()]
        want = []
        for at in range(0, 700, shard):
            for i in range(40):
                rows = [j for j in range(at, min(at + shard, 700)) if apart[i, j] <= r[i]]
                near = sorted((float(np.sqrt(((x[j] - y[i]) ** 2).sum())), int(ids[j])) for j in rows)
                want += [(1000 + i, j, s, 0 if turn else len(rows)) for turn, (s, j) in enumerate(near[:3])]
        assert sorted(tuple(o.values()) for o in out) == sorted(want)


def test_neighbours_probes_are_not_broadcast(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    default = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")  # its 400 queries have some 50 MB of probes
    try:
        out = hash_index.search(vectors, F.col("id") % 10 == 0, block=150, shard=512).collect()
        assert hash_index.search(vectors, F.col("id") < 0).collect() == []
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", default)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out}
    hits = 0
    for q in range(0, 4000, 10):
        want, own = exact_neighbours(np.arange(4000), x, q), [got[q, i] for i in range(1, 11)]
        hits += len({v for v, _ in want} & {v for v, _ in own})
        assert all(s == pytest.approx(np.sqrt(((x[v] - x[q]) ** 2).sum())) for v, s in own)
    assert len(got) == 4000 and hits >= 0.95 * 4000


def test_loser_tree_merges_and_shares():
    rng = random.Random(4)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    coded = [[(s, common(s, r[i - 1]) if i else 0, k) for i, s in enumerate(r)] for k, r in enumerate(runs)]
    out = list(suffix_dedup.merge_runs(coded))
    assert [s for s, *_ in out] == sorted(s for r in runs for s in r)
    assert all(n == common(a, b) for (a, *_), (b, n, *_) in zip(out, out[1:]))
