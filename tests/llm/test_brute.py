"""The registered queries over the smallest tables against brute force, the library or SQL; tampered stores; clashing names."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import bpe, decontaminate, importance, language, line_dedup, quality_rules, registry, simhash, texts, token_store, trees
from tidegauge.llm.components import connected_components
from tidegauge.llm.scratch import Scratch

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.VOCABULARY)
SPACE = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids():
    library = Tokenizer.from_file(PATH)
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4")


def run(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


def words(text):
    return text.translate(dict.fromkeys(map(ord, SPACE), " ")).split(" ") and [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]


def test_op1_against_all_pairs(spark, docs):
    prints = {}
    for i, text in docs.items():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op1_simhash")} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(1 << 62, size=3)]
    values = {b ^ sum(1 << int(k) for k in rng.choice(62, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5) for _ in range(20)}
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    scratch = Scratch(spark, "test")
    got = []
    for rows in (2, 8, 4096):
        member = connected_components(simhash.fingerprint_links(scratch.save(fps, f"fps{rows}"), scratch, 3, rows), Scratch(spark, "test"))
        groups = defaultdict(set)
        for r in member.collect():
            groups[r.root].add(r.node)
        got.append(sorted(map(sorted, groups.values())))
    left, want = set(values), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            group.add(x := todo.pop())
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        want.append(sorted(map(simhash.signed, group)))
    assert got[0] == got[1] == got[2] == sorted(g for g in want if len(g) > 1)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 500), (300, 301), (301, 300), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    for part in (10, 1000):
        got = {r.node: r.root for r in connected_components(df, Scratch(spark, "test"), part).collect()}
        assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}


def test_op2_and_op10_against_the_library(spark, docs, ids):
    place = 0
    got = {r.doc_id: r for r in run(spark, "op2_token_store")}
    for i in sorted(docs):
        want = np.append(ids(docs[i]), 0).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (place, len(want), zlib.crc32(want.tobytes()))
        place += len(want)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert {tuple(r) for r in run(spark, "op10_bpe")} == {(i, len(x), sha(x.tobytes()), sha(t.encode())) for i, t in docs.items() for x in [ids(t)]}


ODD = ["", "a b  c\n\n d", "<|endoftext|> it's x 你好!", "don't 'hello' we'll  ", "x<|endoftext|><|endoftext|>y", "\t\n", "é.ü3 12ab#$%'s", " " * 3000 + "x", "a" * 3000, "你好" * 500 + "  \n \n x", "ok \x1c zz", "　　 a", "I'LL it'S 3's '' ' 'tis", "áb ½ ² ①", "x\n", " 's", "!'s .'s", "word" * 80 + " x"]


def test_encoders_on_odd_texts_and_equal_hashes(ids, monkeypatch):
    want = [ids(t).tobytes() for t in ODD]
    for kind in (bpe.WordEncoder, bpe.BoundaryEncoder):
        own = kind(PATH)
        assert own.encode(ODD) == want and own.encode(ODD[::-1]) == want[::-1]
    monkeypatch.setattr(texts, "_mixed", lambda h: h & np.uint64(7 << 61))  # nearly all fragments get the same hash
    assert bpe.WordEncoder(PATH).encode(ODD * 2) == want * 2


class Counted:
    """The library, with the number of texts that it was given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_new_fragments_reach_the_library_in_few_texts(ids):
    own = bpe.WordEncoder(PATH)
    own.library = counted = Counted(own.library)
    found = [f" wo{k:x}rd" for k in range(0xAAAA, 0xAFFF) if f"{k:x}".isalpha()] + ["\nünd", "\tstraße", " 你好", " 'tis", " $$", " 12", "  two", " <|", "endoftext", "|>", " s", "'s", " end \n"]
    text = "".join(found[:-6])  # all of them would hold the added token
    assert own.encode([text, *found]) == [ids(t).tobytes() for t in [text, *found]]
    assert counted.texts < len(found) / 10
    counted.texts = 0
    own.encode([text])
    assert not counted.texts


def test_joined_fragments_are_told_apart_or_encoded_alone(ids):
    own = bpe.WordEncoder(PATH)
    for raw in ([b" a", b" bc", b",", b" d"], [b" a", b" \xff", b" b"], [b"<|", b"endoftext", b"|>"], [b" x"]):
        want = [ids(x.decode("utf-8", "replace")) for x in raw]
        got, n = own.encode_new(b"".join(raw), np.cumsum([len(x) for x in raw]), False)
        assert got.tolist() == np.concatenate(want).tolist() and n.tolist() == list(map(len, want))
    own.width[:] = 1  # the tokens' bytes no longer end where fragments do
    assert own.encode(["some words here"]) == [ids("some words here").tobytes()]


def test_full_memory_keeps_what_was_met_again(ids, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 100)
    for kind in (bpe.WordEncoder, bpe.BoundaryEncoder):
        own, often = kind(PATH), [f" often{c}" for c in "abcdefghij"]
        for k in range(40):
            batch = ["".join(often + [f" once{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "klmnopqrst"])]
            assert own.encode(batch) == [ids(t).tobytes() for t in batch]
            assert own.memory.n <= 120
            if k > 1:
                raw = b"".join(x.encode() for x in often)
                hashes = texts.ByteWords(np.frombuffer(raw, np.uint8)).hashes(np.arange(10) * 7, np.full(10, 7))
                assert (own.memory.find(hashes) >= 0).all()
        monkeypatch.setattr(own.memory, "again", np.ones_like(own.memory.again))
        assert own.memory.lean().n in (0, own.memory.n)


def test_tampered_stores_are_found(spark, tmp_path, docs):
    rows = [(i, t) for i, t in docs.items()] + [(i + 1000, t) for i, t in docs.items()]  # each chunk is shared
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), PATH)
    stored, manifest = (spark.read.parquet(str(tmp_path / "s" / x)).toPandas() for x in ("documents", "manifest"))
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == len(rows)

    def refused(name, documents=None, lines=None, root=None):
        for part, table, like in (("documents", documents, stored), ("manifest", lines, manifest)):
            (tmp_path / name / part).mkdir(parents=True)
            (like if table is None else table).to_parquet(tmp_path / name / part / "part.parquet", coerce_timestamps="us")
        with pytest.raises(Exception, match="match"):
            token_store.read_store(spark, str(tmp_path / name), root).collect()

    refused("removed", stored.drop(index=3))
    refused("first_id", lines=manifest.assign(first_id=manifest.first_id + 1))
    refused("renamed", stored.assign(doc_id=stored.doc_id + 1))
    changed = stored.copy()
    k = next(k for k in range(len(stored)) if len(stored.ids[k]) > 40)
    changed.at[k, "ids"] = bytes(40) + stored.ids[k][40:]
    refused("changed", changed)
    refused("other corpus", root=bytes(32))


def test_wide_ids_are_stored_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "w"), PATH, end_id=70_000)
    rows = token_store.read_store(spark, str(tmp_path / "w")).orderBy("start").collect()
    assert [int.from_bytes(r.ids[-4:], "little") for r in rows] == [70_000] * 3 and [len(r.ids) for r in rows] == [12, 12, 4]


def test_op4_against_all_windows(spark, docs):
    split = {i: words(t) for i, t in docs.items()}
    least = {}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            least.setdefault(tuple(split[i][k : k + 50]), i)
    for r in run(spark, "op4_substrings"):
        w, gone = split[r.doc_id], set()
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < r.doc_id:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op6_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = run(spark, "op6_language")
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in held} and len(held) > 20
    known = [r for r in held if lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) >= 0.95 * len(known) and all(0 <= r.score <= 1 for r in rows)


def test_language_learns_nothing_from_held_out_rows_and_needs_letters(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    a, b = (language.fit(x.where(~language.held_out())) for x in (docs, other))
    assert a.languages == b.languages and np.array_equal(a.centres, b.centres)
    odd = spark.createDataFrame([(1, "½ ² ① ٣ 12"), (2, "漢"), (None, "...")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, a).collect()}
    assert got[1] == got[None] == "und" and got[2] in a.languages
    same = spark.createDataFrame([(None, "the cat sat on the mat", "en")] * 3000 + [(None, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    assert language.fit(same, per_language=5).languages == ["de", "en"]  # a key of all rows, and texts that repeat


def test_op7_ratios_and_keys(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    buckets = {i: importance.ngram_buckets(t.encode()) for i, t in docs.items()}
    raw, target = (np.bincount(np.concatenate([buckets[i] for i in of if i in buckets]), minlength=importance.BUCKETS) for of in (docs, good))
    ratios = importance.log_ratios(target, raw)
    rows = run(spark, "op7_importance")
    for r in rows:
        assert abs(r.log_ratio - ratios[buckets[r.doc_id]].sum()) < 1e-6
    kept = [r.gumbel_key for r in rows if r.kept]
    assert kept and min(kept) > max([r.gumbel_key for r in rows if not r.kept], default=-np.inf)


def test_op8_counts(spark, docs):
    for r in run(spark, "op8_quality_rules"):
        text = docs[r.doc_id]
        w = words(text)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_trees_split_and_keep_their_order():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = (rng.random(4000) < np.where(x[:, 0] > 0.5, 0.9, 0.2) * np.where(x[:, 1] > 0.7, 0.3, 1.0)).astype(float)
    forest = trees.fit(x, y, [1, -1, 0])
    assert (forest.feature >= 0).sum() > 50
    test = rng.random((500, 3))
    p = forest.scores(test)
    assert p[test[:, 0] > 0.5].mean() > 0.5 > p[test[:, 0] < 0.5].mean()
    for feature, sign in ((0, 1), (1, -1)):
        moved = np.repeat(test[:50, None], 40, axis=1)
        moved[:, :, feature] = np.linspace(0, 1, 40)
        steps = np.diff(forest.scores(moved.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all() and np.abs(steps).max() > 0.01

    def walk(row):  # node by node
        total = forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] + (row[forest.feature[at]] > forest.cut[at])
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p, [walk(r) for r in test])


def test_labels_of_one_key_stay_bounded(spark):
    stats = quality_rules.document_stats(spark.createDataFrame([(1, "a " * 60 + " ".join(map(str, range(200))))] * 30 + [(2, " ".join(map(str, range(300))))], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1)] * 500 + [(2, 0)], "doc_id long, quality int")
    assert quality_rules.fit_rules(stats, labels) is not None


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = db.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    by = [c for c in ("doc_id", "page_id", "item_id", "vec_id", "conv_id") if c in got]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True)[sorted(got)], want.sort_values(by, ignore_index=True)[sorted(want)], check_dtype=False)


def test_any_column_names(spark):
    clash = ["starts", "_doc", "_body", "_text", "_hit", "_own", "_own_hit", "body", "_gone", "lang_pred"]
    line = "a b c d e f g"
    rows = [(1, f"{line}\nx y\nz"), (2, f"{line}\nx y\nz\nu"), (2, "k l m n o p q r"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in clash])
    for item, kept in ((line, 2), ("none of these words", 4)):
        assert decontaminate.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == kept
    items = spark.createDataFrame([(1, line)], "item_id long, text string")
    assert decontaminate.leaks(docs, items, most=0).count() == decontaminate.leaks(docs, items).count() == 2  # both plans
    out = line_dedup.shortened(docs)
    assert out.columns == docs.columns and {(r.doc_id, r.text, r.starts) for r in out.collect()} == {(1, rows[0][1], "starts"), (2, "u", "starts"), (2, rows[2][1], "starts"), (3, None, "starts")}
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs.union(docs)).count() == 3  # rows 1 and 2 share 6 of 7 shingles
    assert [r.lang_pred for r in language.identify(docs, None).collect()] == ["und"] * 4
