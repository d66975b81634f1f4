"""The pipeline at the smallest size, stage by stage."""

import random
from collections import Counter

import corpus_pipeline

WORDS = [f"w{k}" for k in range(500)]
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas(), docs.schema)
        assert docs.columns == columns, name
        assert 0.8 * rows < docs.count() <= rows, name
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_stages_on_empty_nameless_and_clashing_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(40).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "'x' starts", "'y' _hit")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns and 0 < out.count() <= 40, name
        assert stage(spark, docs.where("false"), FOLDER).count() == 0, name


def test_near_dedup_takes_candidates_by_fingerprint_and_completes_them(spark, monkeypatch):
    from tidegauge.llm import simhash, similar

    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=60 + rng.randrange(200))) for _ in range(40)]
    for t in texts[:30]:  # copies with a few other words
        w = t.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    monkeypatch.setattr(simhash, "similar_groups", lambda *a, **k: seen.append(k["alike"].collect()) or similar.similar_groups(*a, **k))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else {()} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert kept == set(root) and len(kept) < len(texts) - 15
    by_fingerprint = Counter(r.token for r in seen[0])
    assert sum(by_fingerprint.values()) == len(set(texts)) and max(by_fingerprint.values()) > 1


def test_scratch_tables_are_freed_by_their_own_thread_also_on_failure(spark):
    import threading
    from pathlib import Path

    import pytest

    from tidegauge.llm.scratch import Scratch, freed

    made, inside, go = {}, threading.Event(), threading.Event()

    def other():
        with freed():
            made["other"] = Scratch(spark, "other")
            made["other"].save(spark.range(3), "t")
            inside.set()
            go.wait(60)
            made["rows"] = spark.read.parquet(made["other"].path("t")).count()

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with pytest.raises(ZeroDivisionError), freed():
        mine = Scratch(spark, "mine")
        mine.save(spark.range(2), "t")
        with freed():
            inner = Scratch(spark, "inner")
            inner.save(spark.range(1), "t")
        assert not Path(inner.root).exists() and Path(mine.root).exists()
        raise ZeroDivisionError
    assert not Path(mine.root).exists() and Path(made["other"].root).exists()
    go.set()
    thread.join()
    assert made["rows"] == 3 and not Path(made["other"].root).exists()
