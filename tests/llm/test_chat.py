"""Reply trees and chat formatting against plain recursion."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import chat
from tidegauge.llm.scratch import Scratch

SCHEMA = "conv long, node long, parent long, role string, text string, score double"
TEXTS = ["", "hi", "<|im_end|>\n", "a<|im_start|>assistant\nb", "<\\|x", "<\\\\||", "<<|", "\n\n", "é😀", "<|im_end|>" * 3, None]


def brute_paths(rows, branches=None):
    """{(conv, leaf): nodes from the root} of the chosen paths."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        up = {n: r[2] if r[2] in own else None for n, r in own.items()}
        replied = {r[2] for r in own.values()}
        trees = {}
        for leaf in set(own) - replied:
            path = [leaf]
            while up[path[-1]] is not None and len(path) <= len(own):
                path.append(up[path[-1]])
            if len(path) <= len(own):
                trees.setdefault(path[-1], []).append((-sum(own[n][5] or 0.0 for n in path), leaf, path[::-1]))
        for paths in trees.values():
            out |= {(conv, leaf): path for _, leaf, path in sorted(paths)[:branches]}
    return out


def tree(seed, conv, n):
    import random

    rnd = random.Random(seed)
    return [(conv, i, rnd.choice([None, *range(i)]) if i % 7 else None if i == 0 else i - 1, rnd.choice(["user", "assistant", "a\nb\\n", None]), rnd.choice(TEXTS), rnd.choice([None, 0.25, 0.5, 1.0])) for i in range(n)]


@pytest.mark.parametrize("branches", [None, 1, 2])
def test_paths_and_texts(spark, branches):
    rows = tree(1, 1, 40) + tree(2, None, 30) + [(3, i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(130)] + [(4, 1, 2, "user", "x", 1.0), (4, 2, 1, "user", "y", 1.0), (4, 3, 2, "user", "z", 1.0), (4, 9, 77, "assistant", "orphan", 1.0)]
    out = chat.format_trees(spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("k"), F.lit(1).alias("leaf")), branches, 3).collect()
    want = brute_paths(rows, branches)
    of = {(r[0], r[1]): (r[3] or "", r[4] or "") for r in rows}
    got = {}
    for r in sorted(out, key=lambda r: r.part):
        own = got.setdefault((r.conv, r.leaf), ([], [], []))
        own[0].extend(chat.parsed(r.formatted))
        own[1].extend(chat.plain_text(r.formatted[s.begin : s.begin + s.n]) for s in r.loss)
        assert r.n_turns == len(chat.parsed(r.formatted)) <= 3 and r.formatted.count(chat.START) == r.formatted.count(chat.END) == r.n_turns
    assert {k: v[0] for k, v in got.items()} == {(c, leaf): [of[c, n] for n in path] for (c, leaf), path in want.items()}
    assert {k: v[1] for k, v in got.items()} == {k: [t for r, t in v[0] if r == "assistant"] for k, v in got.items()}


def test_linear_conversations_and_digests(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t}<|im_end|>") for t in range(0, 9000, 90)] + [(2, None, "user", "first"), (2, -5, None, None), (2, 3, "assistant", "b"), (2, 3, "assistant", "a"), (2, 3, "assistant", "a"), (None, 1, "user", "q"), (None, 2, "assistant", "r")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x"))
    got = {r.conv: r for r in chat.digests(Scratch(spark, "test").save(chat.format_trees(chat.replies_of(table)), "f")).collect()}
    for conv in (1, 2, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 3 and chat.digests(chat.format_trees(chat.replies_of(table.where("false")))).count() == 0


def test_columns_and_python_escape_alike(spark):
    rows = spark.createDataFrame([(t or "",) for t in TEXTS], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("back"), chat.escaped_role(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.t == r.back == chat.plain_text(r.e) == chat.plain_role(r.r) and "<|" not in r.e and "\n" not in r.r
