"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import bpe, decontaminate, importance, language, line_dedup, quality_rules, simhash, substrings, token_store, url_filter

PATH = public_tokenizers.path(bpe.VOCABULARY)
LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [(1, "a b c\nd e f\ng h i\nj"), (1, "a b c\nd e f\ng h i\nj"), (2, None), (3, ""), (4, LONG), (5, f"x y {PASSAGE} z"), (6, f"{PASSAGE} w"), (None, PASSAGE), (7, " \t\n "), (8, "a b c\nd e f\ng h i\nk"), (9, "Über <|endoftext|> it's x 你好!")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("lang", "fp", "h", "ids", "body", "spans", "n_removed", "score", "kept", "words", "chunks")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_simhash(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == by[3].fp == by[7].fp == 0 and by[7].component_id == 2
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs, bucket_rows=1).where("component_id = 2").count() == 3


def test_bpe_and_store(spark, docs, tmp_path):
    library = Tokenizer.from_file(PATH)
    want = sorted(((d is not None, d or 0), tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in ROWS)
    ints = lambda b: tuple(int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4))
    got = bpe.encode(docs, PATH).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), ints(r.ids)) for r in got) == want
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(t or "" for _, t in ROWS)
    token_store.write_store(docs, str(tmp_path / "s"), PATH)
    back = sorted(token_store.read_store(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), ints(r.ids)[:-1]) for r in back) == want
    place = 0
    for r in back:
        assert r.start == place and ints(r.ids)[-1] == 0
        place += r.n_tokens
    token_store.write_store(docs.where("false"), str(tmp_path / "e"), PATH)
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "A, b"), (5, "word7 word8 word9 word10 word11 word12"), (None, PASSAGE)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(5, 1), (6, 1), (None, 1), (1, 4), (8, 4), (4, 5)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [2, 3, 7, 9]
    assert decontaminate.leaks(docs, items.where("false")).count() == 0 and decontaminate.leaks(docs.where("false"), items).count() == 0


def test_substrings(spark, docs):
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    assert (got[6].n_words, got[6].n_removed, got[6].kept) == (61, 60, "w") and got[5].n_removed == got[None].n_removed == 0
    assert [(s["first"], s["after"]) for s in got[6].removed] == [(0, 60)]
    assert got[2].n_words == got[3].n_words == 0 and got[4].kept == LONG
    assert substrings.dedup_substrings(docs).count() == len(ROWS) and substrings.dedup_substrings(docs.where("false")).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/7?x"), (2, "https://x.com/en/"), (3, None), (4, "no scheme"), (None, "http://notcom/en/"), (1, "http://b.net/de/8#f"), (5, "http://deep.a.example.net/de/8")], "page_id long, url string")
    rules = spark.createDataFrame([(h, p, v) for v, h, p in url_filter.RULES] + [(None, "/", "block")], "host string, path string, verdict string")
    for ranges in (None, 4):
        got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, ranges=ranges).collect())
        assert got == [(0, "notcom", "/en/", None, "allow"), (1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (1, "b.net", "/de/8", "net/de/", "block"), (2, "x.com", "/en/", "com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "deep.a.example.net", "/de/8", "example.net/de/8", "block")]
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_fixed_rules_are_the_contracts(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://www.example.com/en/7", "http://B.net/de/5", "http://m.example.net/de/8", "http://m.example.net/de/7", "http://c.org/es/", "http://c.org/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.op5_url_filter(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(urls))] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]


def test_language(spark, docs):
    two = spark.createDataFrame([(i, t, lang) for i in range(40) for t, lang in ((f"the cat sat on the mat {i}", "en"), (f"der Hund und die Katze {i}", "de"))], "doc_id long, text string, lang string")
    model = language.fit(two)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[7].lang_pred == "und" and got[2].rejected and 0 <= got[4].score <= 1
    said = {r.text: r.lang_pred for r in language.identify(two, model).collect()}
    assert said["the cat sat on the mat 1"] == "en" and said["der Hund und die Katze 1"] == "de"
    assert language.fit(two.where("false")) is None and language.identify(docs, None).where("rejected").count() == len(ROWS)
    assert language.keep_identified(docs.select("doc_id", "text", "lang").where("false")).count() == 0


def test_importance(spark, docs, labels):
    got = importance.resample(docs, labels, keep=0.5).collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) >= round(0.5 * len(ROWS))
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert all(r.kept == (r.gumbel_key >= keys[round(0.5 * len(ROWS)) - 1]) for r in got)
    assert importance.resample(docs.where("false"), labels).count() == 0 and importance.resample(docs, labels.where("false")).count() == len(ROWS)


def test_ratios_of_chance():
    raw = np.array([2, 1000, 1000, 1000, 0])
    target = np.array([1, 300, 0, 500, 0])
    got = importance.log_ratios(target, raw)
    assert got[0] == got[1] == got[4] == 0  # too rare, as expected, never seen
    assert got[2] < -3 and 0 < got[3] < np.log(500 / 267)
    assert not importance.log_ratios(np.zeros(5, int), raw).any() and not importance.log_ratios(raw, raw).any()


def test_quality_rules(spark, docs, labels):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert got[4].n_words == 30_000 and got[4].n_repeat_words == 0 and got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert quality_rules.quality_rules(docs.where("false"), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.where("false")).where("kept").count() >= 3
    assert quality_rules.repeated_words(b"a b c a b c d".split()) == (6, 4)
    assert quality_rules.statistics("ä # b\nx\n\nx\nx".encode())[:5] == (6, 6, 1, 2, 0)


def test_line_dedup(spark, docs):
    got = sorted(((r.doc_id or 0), r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).where("doc_id in (1, 2, 3, 8)").collect())
    assert [g for g in got if g[0] == 8] == [(8, "k", 4, 3)] and [g for g in got if g[0] == 2] == [(2, None, 0, 0)]
    assert all(g[3] == 0 for g in got if g[0] == 1) and line_dedup.dedup_lines(docs).count() == len(ROWS)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0
    assert hashlib.sha256(LONG.encode()).digest() in {hashlib.sha256((r.text or "").encode()).digest() for r in line_dedup.dedup_lines(docs).collect()}


def test_leaks_of_long_and_repeated_items_and_nameless_rows(spark):
    long = " ".join(f"q{i}" for i in range(4000))
    docs = spark.createDataFrame([(None, f"row {i} {PASSAGE}") for i in range(60)] + [(7, long), (7, f"x {PASSAGE}"), (8, f"{long} {PASSAGE}")], SCHEMA)
    items = spark.createDataFrame([(i, " ".join(PASSAGE.split()[i % 20 : i % 20 + 30])) for i in range(40)] + [(50, long), (50, "short"), (51, long[: len(long) // 2])], "item_id long, text string")
    for most in (0, decontaminate.BROADCAST_BYTES):
        got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.leaks(docs, items, most=most).collect()}
        assert {k for k, _ in got} == {None, 7, 8} and all(got[d, i] == (26, 26) for d in (None, 7, 8) for i in range(40))
        assert got[7, 50] == got[8, 50] == (3996, 3996) and (None, 50) not in got and (None, 51) not in got and (7, 51) in got
