"""Hard negatives, URL filter and prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rightsize.llm import hard_negatives as H
from rightsize.llm import prefix_trie, url_filter
from rightsize.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.001"


# ---- hard negatives ----------------------------------------------------------

def negatives(rows, asks, k=10, positives=5, low=30, high=90):
    """rows: id -> (label, integer vector)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    for a in filter(asks, rows):
        order = sorted(((-dot(a, b), b) for b in rows if b != a))
        for ps, p in [(-s, b) for s, b in order if rows[b][0] == rows[a][0]][:positives]:
            found = [(b, -s) for s, b in order if rows[b][0] != rows[a][0] and low * ps <= 100 * -s <= high * ps][:k]
            out += [(a, p, r + 1, b, ps, s) for r, (b, s) in enumerate(found)]
    return sorted(out)


def test_hilbert_steps_are_unit_steps():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = H.hilbert(cells, 3)
    order = sorted(range(len(cells)), key=lambda i: keys[i])
    assert len(set(keys)) == 512 and np.abs(np.diff(cells[order], axis=0)).sum(axis=1).max() == 1


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-9, 9, (20, 6)), rng.integers(-9, 9, (30, 6))
    under, over = H.bounds(a, x.min(axis=0), x.max(axis=0))
    s = a @ x.T
    assert (under <= s.min(axis=1)).all() and (over >= s.max(axis=1)).all()


def test_unreachable_blocks_are_not_chosen():
    import pyarrow as pa

    zones = pa.RecordBatch.from_pydict({"part": [0, 0], "block": [0, 1], "least": [[0, 0], [5, 5]], "most": [[1, 1], [9, 9]]})

    class Asked:
        value = {"vector": np.array([[1.0, 1.0]]), "low": np.array([[8]]), "high": np.array([[12]])}

    assert [b["block"].to_pylist() for b in H._choose(Asked)([zones])] == [[1]]


@pytest.mark.parametrize("block,chunk", [(512, 16384), (7, 2)])
def test_negatives_of_odd_rows(spark, block, chunk):
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.randint(-9, 9) for _ in range(5)], i % 4 == 0, 1) for i in range(60)]
    rows += [(100 + i, 1 if i % 2 else 2, [4, 4, 4, 4, 4], i < 3, 1) for i in range(40)]
    good = {i: (k, v) for i, k, v, *_ in rows}
    asks = {i for i, _, _, a, _ in rows if a}
    odd = [(200, None, [1] * 5, True, 1), (201, 1, None, True, 1), (202, 1, [1, None, 1, 1, 1], True, 1), (203, 1, [1] * 4, True, 1), (None, 1, [1] * 5, True, 1), (0, 7, [99] * 5, True, 1), rows[3]]
    table = spark.createDataFrame(rows + odd, "id long, label int, vector array<long>, asks boolean, part int")
    got = sorted(tuple(r) for r in H.mine(table, block=block, chunk=chunk).collect())
    assert got == negatives(good, lambda i: i in asks)


def test_large_scores_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.randint(-(2**29), 2**29) for _ in range(3)], i < 6) for i in range(40)]
    got = sorted(tuple(r) for r in H.mine(spark.createDataFrame(rows, "id long, label int, vector array<long>, asks boolean"), block=8).collect())
    assert got == negatives({i: (k, v) for i, k, v, _ in rows}, lambda i: i < 6)


def test_negatives_of_an_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.mine(H.scaled(table, F.col("id") % 100 == 0)).collect() == []
    one = spark.createDataFrame([(0, [1.0, float("nan")], 1), (100, [1.0, 0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert H.mine(H.scaled(one, F.col("id") % 100 == 0)).collect() == []


def test_negatives_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    own = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256.0 * x)) for x in r.embedding]) for r in rows}
    got = sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, SF).collect())
    assert got == negatives(own, lambda i: i % 100 == 0) and got


# ---- URL filter --------------------------------------------------------------

def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = [None, "", "no scheme", "http://", "://x", "HTTP://WWW.EXAMPLE.COM/en/x", "http://example.com", "http://example.com/", "http://notexample.com/en/", "http://a.net/es/1?u=://b.com/", "http://a.net/ES/1", "x://net/fr/", "http://com/", "http://a.com:80/en/", "http://a..com/", "http://ÉCOLE.com/é", "http://h.org/a\nb#c", "http://example.com?/en/", "http://" + "a." * 2000 + "net/fr/" + "x" * 300_000]


def test_rules_and_parts(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "clash"), (3, "http://", "clash")]
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect()
    assert len(out) == len(rows)
    for i, url, _ in rows:
        host, path = parts(url)
        rule = rule_of(host, path)
        for r in (r for r in out if r.page_id == i):
            assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
            assert r.verdict == (rule[1] if rule else "block" if r.score >= 0.5 else "allow") and 0 <= r.score <= 1
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, RULES).collect() == []


def test_longest_rule_wins_and_block_of_equals():
    rules = {"com": [("/", "allow"), ("/a/b/c/d/e", "block")], "x.com": [("/", "block"), ("/", "allow")]}
    assert url_filter.fitting_rule("x.com", "/q", rules) == ("x.com/", "block")
    assert url_filter.fitting_rule("x.com", "/a/b/c/d/e/f", rules) == ("com/a/b/c/d/e", "block")
    assert url_filter.fitting_rule("y.org", "/", rules) is None


def test_grams_do_not_cross_urls():
    import pyarrow as pa

    hosts, paths = ["ab.com", "", "é.org"], ["/x", "", "/y"]
    url, bucket, value = url_filter.grams(pa.array(hosts), pa.array(paths))
    for i, (h, p) in enumerate(zip(hosts, paths)):
        _, alone, v = url_filter.grams(pa.array([h]), pa.array([p]))
        assert sorted(bucket[url == i]) == sorted(alone) and np.allclose(sorted(value[url == i]), sorted(v))
        assert not len(v) or np.isclose((v * v).sum(), 1)


def test_learned_verdicts(spark):
    """Held out: hosts of the pages; the words of the table's blocked hosts are the truth."""
    bad = ("adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets")
    out = url_filter.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), []).collect()
    right = sum((r.verdict == "block") == any(b in r.host for b in bad) for r in out)
    assert right >= 0.98 * len(out)
    again = spark.createDataFrame([("allow", "http://good.test/"), ("block", "http://evil.test/")] * 2, "verdict string, url string")
    probe = spark.createDataFrame([(1, "http://evil.test/a"), (2, "http://good.test/a")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(probe, [], again).orderBy("page_id").collect()] == ["block", "allow"]
    with pytest.raises(ValueError):
        url_filter.judge_urls(probe, [], again, most=3)


# ---- prefix trie -------------------------------------------------------------

def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda k: k[:3])] for c, v in own.items()}
    new = {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    held, kids, out = defaultdict(list), defaultdict(list), {}
    for c, s in new.items():
        for d in range(len(s) + 1):
            held[tuple(s[:d])].append(c)
    for p in held:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(held, key=len, reverse=True):
        saved = (len(held[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(out[k][6] for k in kids[p])
        ends = ",".join(str(c) for c in held[p] if len(new[c]) == len(p))
        out[p] = (held[p][0], len(p), held[p[:-1]][0] if p else None, len(held[p]), len(kids[p]), sum(out[k][5] for k in kids[p]) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talk(spark):
    """Copies across shards, turnless conversations, a long one, nulls, gaps, repeats, clashes."""
    rng = random.Random(6)
    rows = []
    for c in [*range(40), 60, 61, 64, 303, *range(500, 515)]:
        for t in range(rng.randint(1, 10)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "é", "b" * 50, None, ""]), 1, "k"))
    long = [(t, "user", f"t{t % 3}") for t in range(90)]
    rows += [(c, t, r, x, 1, "k") for c in (700, 750, 800, 805) for t, r, x in long]
    rows += [(900, None, "user", "first", 1, "k"), (900, 0, "user", "second", 1, "k"), (900, 1, None, "x" * 200_000, 1, "k"), (900, 1, None, "x" * 200_000, 1, "k"), (None, 0, "user", "no id", 1, "k")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, k0 string")


@pytest.mark.parametrize("shard", [{}, {"width": 1}, {"width": 4}, {"most": 30}])
def test_trie(talk, shard):
    want = trie([(r.conv_id, r.turn, r.role, r.text) for r in talk.collect()])
    assert told(prefix_trie.forked_trie(talk, **shard)) == want
    assert max(w[1] for w in want) >= 90 and max(w[3] for w in want if w[1] > 40) > 1


def test_trie_query_and_empty_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert told(QUERIES["op13_prefix_trie"](spark, SF)) == trie([(r.conv_id, r.turn, r.role, r.text) for r in rows])
    assert prefix_trie.forked_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
