"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pyarrow as pa

from tidegauge.llm import decontaminate, simhash
from tidegauge.llm.similar import parities, shingle_sets, similar_groups

WIDTH, PART = 5, 0.8


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))} if words else set()


def brute(texts):
    """The root of each text: connected by all pairs of a Jaccard similarity of at least PART."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= PART:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def texts():
    """Families of 14 texts that share a long passage, with pairs on both sides of PART; strays, copies and empty texts."""
    rnd, out = random.Random(7), [None, "", " \n ", "one two", "One  two", "one two three"]
    for family in range(6):
        base = [f"w{family}x{i}" for i in range(80)]
        for k in range(14):
            words = base.copy()
            for at in rnd.sample(range(80), k % 4):
                words[at] = f"n{rnd.random()}"
            out.append(" ".join(words + [f"tail{family}x{k}x{i}" for i in range(rnd.choice((0, 0, 5, 12)))]))
    out += [out[10], out[40].upper()]
    return out


def test_groups_are_those_of_all_pairs(spark):
    rows = texts()
    want = brute(rows)
    assert 20 < len(set(want)) < len(rows) - 20
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for reach in (8, 2):
        least, got = {}, {r.doc_id: r.root for r in similar_groups(docs, WIDTH, PART, reach=reach).collect()}
        for i in sorted(got):
            least.setdefault(got[i], i)
        assert [least[got[i]] for i in range(len(rows))] == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want))
    assert simhash.keep_one(docs.where("false")).count() == 0


def blocks(count):
    """Texts of ten out of thirty common passages in any order, some of them near copies: any two share many shingles."""
    rnd, out = random.Random(11), []
    passages = [" ".join(f"p{k}x{i}" for i in range(20)) for k in range(30)]
    while len(out) < count:
        words = " ".join(rnd.sample(passages, 10)).split()
        out.append(" ".join(words))
        if len(out) % 10 == 0:
            words[rnd.randrange(200)] = "changed"
            out.append(" ".join(words))
    return out[:count]


def test_buckets_cut_anywhere_and_tiles_lose_no_link(spark):
    rows = blocks(400) + texts()
    want = brute(rows)
    assert len(set(want)) < len(rows) - 60
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for reach, tile in ((8, 512), (2, 16)):
            least, got = {}, {r.doc_id: r.root for r in similar_groups(docs, WIDTH, PART, reach=reach, tile=tile).collect()}
            for i in sorted(got):
                least.setdefault(got[i], i)
            assert [least[got[i]] for i in range(len(rows))] == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pairs_far_apart_in_bits_are_found(spark):
    rnd, rows = random.Random(3), []
    while len(rows) < 20:  # pairs just above PART whose fingerprints differ in more than 10 bits
        base = [f"v{rnd.random()}" for _ in range(104)]
        other = base.copy()
        other[30] = other[70] = "x"
        a, b = " ".join(base), " ".join(other)
        fa, fb = (simhash.fingerprint(t.encode(), WIDTH) for t in (a, b))
        if (fa ^ fb).bit_count() > 10:
            rows += [a, b]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(0, 20, 2))


def test_clean_texts_under_a_shared_doc_id_stay(spark):
    item, clean = "a b c d e f g h", ["k l m n o p q", "r s t u v w x"]
    rows = [(None, f"{item} i"), (None, clean[0]), (1, f"{item} j"), (1, clean[1]), (1, clean[1]), (2, clean[1]), (None, clean[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    tuples = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert tuples(decontaminate.without_leaks(docs, items)) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    assert tuples(simhash.keep_one(docs)) == sorted([(None, f"{item} i"), (None, clean[0]), (1, f"{item} j"), (1, clean[1]), (None, None)], key=str)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 65, 300, 3000):
        x = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for part in (0.0, 0.2, 0.9):
            y = np.unique(np.concatenate([x[rng.random(len(x)) >= part], rng.integers(1 << 62, size=int(part * n))]))
            a, b = parities(x), parities(y)
            size = min(len(a), len(b))
            a, b = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_shingle_sets_do_not_cross_texts():
    rows = ["a b c d e", "F g", None, "", " \n", "a b c d e f g h", "x", "A  b\tC d\ne"]
    sets = shingle_sets(pa.array(rows), WIDTH)
    assert [len(s) for s in sets] == [1, 1, 0, 0, 0, 4, 1, 1]
    assert sets[0][0] == sets[7][0] and sets[0][0] in sets[5]
