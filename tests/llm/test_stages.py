"""Pipeline stages on nulls, repeated rows, empty tables and clashing column names."""

import platform

import pytest

import brute
import corpus_pipeline as P
from rightsize.llm import common, exact_dedup, language_id, minhash_forest, mixing

SCHEMA = ("doc_id long, text string, lang string, source string, key long, row string, n long, turn long, copies long, kept boolean,"
          " text_sha256 string, __key long, __n long, __kept boolean, __copies long, __copy long, score double, lang_pred string, component long")
SAY = {"en": "the quick brown fox jumps over the lazy dog and runs away from the hunter number ", "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg vom jäger nummer "}


def rows():
    out = []
    for i in range(24):
        lang = "en" if i % 2 else "de"
        words = SAY[lang].split()
        turned = " ".join(words[i % 7 :] + words[: i % 7] + [f"z{i}"] * 3)
        out.append((i, turned, lang, f"s{i % 2}"))
    out += [(100, out[3][1] + "  ", "en", "s1"), (3, out[3][1], "en", "s1"), (3, out[3][1], "en", "s1"), (7, "a different text under a used number", "en", None),
            (None, "no number at all but letters", None, None), (None, None, None, None), (101, None, None, "s0"), (102, "", "en", "s0"), (103, " \t\n", "en", "s0"), (104, "12345 67", "en", "s0")]
    return [(*r, 1, "r", 2, 3, 4, True, "x", 5, 6, False, 7, 8, 0.5, "p", 9) for r in out]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def told(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


STAGES = [language_id.keep_known, exact_dedup.keep_one, lambda d: minhash_forest.keep_one(d, percent=80), mixing.repeat_documents]


@pytest.mark.parametrize("stage", range(4))
def test_columns_pass_and_empty_tables_stay_empty(spark, odd, stage):
    out = STAGES[stage](odd)
    assert out.dtypes == odd.dtypes
    assert {tuple(r)[4:] for r in out.collect()} == {rows()[0][4:]}
    assert STAGES[stage](odd.limit(0)).collect() == []


def test_known_languages_stay(odd):
    kept = told(language_id.keep_known(odd))
    assert {d for d, _ in kept} >= set(range(24)) and not {d for d, _ in kept} & {101, 102, 103, 104}
    assert all(t and any(c.isalpha() for c in t) for _, t in kept)


def test_one_of_each_equal_text_stays(odd):
    kept = told(exact_dedup.keep_one(odd))
    text = {r[0]: r[1] for r in rows()[:24]}
    assert (100, text[3] + "  ") in kept and not any(d == 3 for d, _ in kept)      # the longest original
    assert (7, text[7]) in kept and (7, "a different text under a used number") in kept
    blank = [k for k in kept if not (k[1] or "").strip()]
    assert blank == [(103, " \t\n")] and len(kept) == 24 - 1 + 1 + 1 + 1 + 1 + 1


def test_near_copies_go(odd):
    kept = told(minhash_forest.keep_one(odd, percent=80))
    alone = [(d, t) for d, t in ((r[0], r[1]) for r in rows()) if d is not None and d not in (3, 7)]
    want = {d for d, x in brute.near(alone, percent=80).items() if x[2]}
    assert {d for d, _ in kept if d is not None and d not in (3, 7, 100)} == want - {100}


def test_the_mix_repeats_whole_rows(odd):
    given, made = told(odd), told(mixing.repeat_documents(odd))
    assert set(made) <= set(given) and all(made.count(x) <= 3 * given.count(x) for x in set(made))


def test_stages_of_the_pipeline_in_order(spark, odd):
    now = odd
    for _, stage in P.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, "").collect(), odd.schema)
        assert now.dtypes == odd.dtypes and now.count()
    last = P.STAGES[-1][1](spark, now, "").collect()
    assert sorted(r.decoded_sha256 for r in last) == sorted(brute.sha(r.text) for r in now.collect())


def test_the_driver_gives_memory_back_every_few_tables(spark, monkeypatch):
    said, trim = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: said.append(trim(s)))
    tables = common.Tables(spark)
    for i in range(6):
        assert tables.save(spark.range(i), f"t{i}").count() == i
    assert len(said) == 1
    if platform.libc_ver()[0] == "glibc":
        assert "Trim native heap" in said[0]
