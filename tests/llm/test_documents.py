"""Operators over documents against brute force, on whole small tables and on
a fixture of nulls, empty and long texts, ties, repeats and clashing names."""

import random

import base64
import hashlib

import numpy as np
import pytest

import brute
from rightsize.llm import byte_bpe, exact_dedup, language_id, minhash_forest, mixing, suffix_dedup, substring_dedup
from rightsize.llm.queries import QUERIES, bpe_path

SF = "/root/testdata/sf0.001"


def hard_texts() -> list:
    rng = random.Random(3)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = say(60), say(6000)
    texts = [None, "", " \t\n", "a", "A", "one two three", "one  two\nthree", "a " * 400, "ab" * 900, "ab" * 900 + "c", long, long, long + " end", passage, say(40) + " " + passage + " " + say(40), say(30) + "\n" + passage, "x" * 5000, "日本語 " * 80, "<turn> </turn> \\ # ###"]
    base = say(200).split()
    for i in range(12):
        copy = list(base)
        copy[i * 7] = f"changed{i}"
        texts.append(" ".join(copy))
    return texts


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 1, "k", "g") for i, t in enumerate(hard_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, spans string, `group` string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(params=["hard", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_passages(docs):
    out = {d: (n, m, brute.sha(t)) for d, (n, m, t) in by_id(substring_dedup.remove_repeated_passages(docs, bits=20), "n_words", "n_removed", "kept_text").items()}
    assert out == brute.passages(pairs(docs))


def test_a_full_sketch_loses_nothing(hard):
    out = by_id(substring_dedup.remove_repeated_passages(hard, bits=4, depth=1), "n_words", "n_removed")
    assert out == {d: x[:2] for d, x in brute.passages(pairs(hard)).items()}


def test_exact(docs):
    assert by_id(exact_dedup.equal_texts(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.equal(pairs(docs))


def test_exact_texts_like_a_group_name(spark):
    rows = list(enumerate(["!" * 100] * 2 + [f"1-{k << 33}" for k in range(10) for _ in range(2)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(exact_dedup.equal_texts(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.equal(rows)


def test_bytes(docs):
    out = {d: (n, m, len(s), brute.sha(bytes(k))) for d, (n, m, s, k) in by_id(suffix_dedup.remove_repeated_bytes(docs, bits=20), "n_bytes", "n_removed", "spans", "kept").items()}
    assert out == brute.byte_runs(pairs(docs))


def test_bytes_of_a_frequent_gram_and_short_runs(docs, monkeypatch):
    """Windows grouped by digest, runs of a few suffixes: the same bytes go."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    monkeypatch.setattr(suffix_dedup, "HOLD", 4000)
    out = {d: (n, m, len(s), brute.sha(bytes(k))) for d, (n, m, s, k) in by_id(suffix_dedup.remove_repeated_bytes(docs, bits=20), "n_bytes", "n_removed", "spans", "kept").items()}
    assert out == brute.byte_runs(pairs(docs))


def test_a_string_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 50)
    rng = random.Random(11)
    common = "this one line of exactly so many bytes"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(80)) + common + "".join(rng.choice("abcdefgh ") for _ in range(i % 3 * 40))) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {d: (n, m, len(s), brute.sha(bytes(k))) for d, (n, m, s, k) in by_id(suffix_dedup.remove_repeated_bytes(docs, bits=20), "n_bytes", "n_removed", "spans", "kept").items()}
    assert out == brute.byte_runs(rows)


def test_near(docs):
    assert by_id(minhash_forest.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute.near(pairs(docs))


def family(n: int, shared: int = 1000, own: int = 100) -> list:
    """Texts on one template whose pairs lie just below the threshold, but for text i and i + n: those are linked."""
    base = [f"t{i}" for i in range(shared + 4)]
    tail = lambda k, *names: [f"{name}o{j}" for name in names for j in range(own * k // 2)]
    return [" ".join(base + tail(2, f"d{i}")) for i in range(n)] + [" ".join(base + tail(1, f"d{i}", f"e{i}")) for i in range(n)]


def test_near_in_a_dense_region(spark, monkeypatch):
    rows = list(enumerate(family(120)))
    want = brute.near(rows)
    assert sum(x[2] for x in want.values()) == 120
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (1024, 16):
        monkeypatch.setattr(minhash_forest, "DENSE_ROWS", block)
        assert by_id(minhash_forest.near_duplicates(docs, percent=85), "n_shingles", "component_id", "kept") == want


def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline as P

    rows = []
    for i in range(20):  # one of 55 words replaced: 46 of 56 shingles, 0.82
        words = [f"p{i}w{j}" for j in range(55)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:20] + ["other"] + words[21:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d for d, x in brute.near(rows, percent=80).items() if x[2]}
    assert len(want) == 20 and len({d for d, x in brute.near(rows).items() if x[2]}) == 40
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, SF).collect()} == want


def test_overlaps():
    rng = np.random.default_rng(5)
    x, y = ([np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64)) for _ in range(n)] for n in (30, 20))
    assert minhash_forest.overlaps(x, y, most=7).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_bpe_matches_tiktoken(docs):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(bpe_path())
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = by_id(byte_bpe.encode(docs, bpe_path(), table=500).withColumn("back", byte_bpe.decode(byte_bpe.F.col("ids"), bpe_path())), "n_tokens", "ids", "ids_le", "back")
    for d, t in pairs(docs):
        ids = want.encode_ordinary(t or "")
        n, got, raw, back = out[d]
        assert (n, list(got), bytes(raw), bytes(back)) == (len(ids), ids, np.array(ids, "<u4").tobytes(), (t or "").encode())


def test_merges_agree():
    ranks = byte_bpe.read_ranks(bpe_path())
    rng = random.Random(1)
    words = [w for w in (bytes(rng.choice("aehtonisr é'TH9".encode()) for _ in range(rng.randint(2, 60))) for _ in range(500)) if w not in ranks]
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    assert byte_bpe.merge_many(words, byte_bpe.pair_table(ranks), single) == [np.array(byte_bpe.merge(w, ranks), "<i4").tobytes() for w in words]


def test_language(spark, hard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = language_id.identify(docs).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and 0.2 < len(held) / len(out) < 0.3
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    edge = by_id(language_id.identify(hard), "lang_pred", "score")
    assert edge[0] == edge[1] == edge[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in edge.values())


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows} and len(rows) == docs.count()
    size = {d: len(brute.WORD.findall(t or "")) for d, t in pairs(docs)}
    assert {r.doc_id: r.size for r in rows} == size
    sources = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sources.setdefault(r.source, [r.source_size, r.target, 0, 0])
        sources[r.source][2] += r.taken
        sources[r.source][3] = max(sources[r.source][3], r.size)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    total, open_, goal = sum(s[0] for s in sources.values()), dict.fromkeys(names), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    while open_:
        c = (total - sum(goal.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if c * weight[s] > 3 * sources[s][0]]
        if not over:
            goal |= {s: c * weight[s] for s in open_}
            break
        for s in over:
            goal[s] = 3.0 * sources[s][0]
            del open_[s]
    for s, (_, target, taken, largest) in sources.items():
        assert target == pytest.approx(goal[s]) and abs(taken - target) <= largest


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (None, "other " + text), (2, None)], "doc_id long, text string")
    exact = exact_dedup.equal_texts(docs).collect()
    assert len(exact) == 6 and sum(r.kept for r in exact) == 3
    assert len(substring_dedup.remove_repeated_passages(docs, bits=12).collect()) == 6
    assert len(suffix_dedup.remove_repeated_bytes(docs, bits=12).collect()) == 6
    assert len(minhash_forest.near_duplicates(docs).collect()) == 6
    assert len(mixing.mix(docs.selectExpr("*", "cast(null as string) as source")).collect()) == 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for f in (lambda d: substring_dedup.remove_repeated_passages(d, bits=12), lambda d: suffix_dedup.remove_repeated_bytes(d, bits=12), exact_dedup.equal_texts, minhash_forest.near_duplicates, mixing.mix, language_id.identify, lambda d: byte_bpe.encode(d, bpe_path())):
        assert f(docs).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, []
    for name, stage in P.STAGES:
        now = stage(spark, now, SF)
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now)
    for out in seen[:-1]:
        assert out.columns == docs.columns
    known = pairs(seen[0])
    assert len(known) >= 0.95 * docs.count()
    kept = {k[0] for k in pairs(seen[1])}
    assert kept == {d for d, x in brute.equal(known).items() if x[2]}
    kept = {k[0] for k in pairs(seen[2])}
    assert kept == {d for d, x in brute.near(pairs(seen[1]), percent=80).items() if x[2]}
    assert {k[0] for k in pairs(seen[3])} <= kept and seen[4].count() == seen[3].count()
    text = dict(known)
    for r in seen[4].collect():
        assert r.decoded_sha256 == brute.sha(text[r.doc_id])


def test_every_query_is_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("n", [200, 800])
def test_a_family_of_near_copies_makes_few_pairs(spark, monkeypatch, n):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(k, " ".join(base[:at] + [f"o{k}"] + base[at + 1 :])) for k in range(n) for at in [rng.randrange(150)]]
    made = {}

    def save(self, df, name, by=None, real=minhash_forest.Tables.save):
        out = real(self, df, name, by)
        made[name] = out.count()
        return out

    monkeypatch.setattr(minhash_forest.Tables, "save", save)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in minhash_forest.near_duplicates(docs, percent=85).collect()} == {0}
    tested = sum(v for k, v in made.items() if k.startswith("best")) + made.get("ranked-0", 0)
    assert tested <= 3 * n and sum(v for k, v in made.items() if k.startswith("links")) <= 2 * n
    assert sum(v for k, v in made.items() if k.startswith("open")) <= n


def test_most_frequent_words(spark):
    rng = random.Random(8)
    rows = [(f"w{i}".encode(), rng.choice([1, 1, 2, 3, 40, 5000, 5001, 10**12])) for i in range(400)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for table in (0, 1, 60, 150, 399, 400, 1000):
        got = {bytes(r.word) for r in byte_bpe.most_frequent(counts, table).collect()}
        least = min((n for w, n in rows if w in got), default=None)
        assert len(got) <= table and (table < 400 or len(got) == 400)
        assert least is None or {w for w, n in rows if n >= least + 8} <= got
    assert byte_bpe.most_frequent(counts.limit(0), 5).collect() == []
