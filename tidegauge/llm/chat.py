"""Chat formatting: reply trees become conversations, one for each chosen root-to-leaf path.

Paths come from self-joins in rounds of doubling reach: after round j each message knows the one 2 ** j replies above it
and the sum of scores up to there, so a tree of depth d takes log2(d) joins and no path is built before it is chosen.
The rows of a path are formatted in parts of a few turns each, which bound what a task holds at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.scratch import Scratch

#: Turns in a row of the formatted output.
PART_TURNS = 16
#: Values of ``turn`` that are put in order together; then such stretches are.
STRETCH = 1024
ASSISTANT = "assistant"
#: The template's control strings: ``<|im_start|>role\ntext<|im_end|>\n``.
START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = r"<(\\*)\|", r"<\\(\\*)\|"
PROBE = "<|im_end|><|im_start|>assistant ok"
KEYS = ["conv", "leaf", "part"]
_DIGESTS = [pa.field(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in ("leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]


def escaped(text: Column) -> Column:
    r"""``<|`` is written with a backslash more between its characters than it has, so that no text holds a control string."""
    return F.regexp_replace(text, _OPEN, r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes are doubled and line ends written as ``\\n``, before what texts get."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain_text(role))


def plain_text(text: str) -> str:
    return re.sub(_ESCAPED, r"<\1|", text)


def _name(conv: str) -> Column:
    """A text that is equal for equal values of ``conv``, null among them."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def replies_of(rows: DataFrame) -> DataFrame:
    """``(conv, node, parent, role, text, score)`` of linear conversations ``(conv_id, turn, role, text)``: each row answers
    the one before it by turn (null first), role and text; nodes count from 1.

    Rows are ordered within stretches of turns, and then the stretches by their number of rows, so that the sort of a
    large conversation is spread over tasks.
    """
    base = rows.select(_name("conv_id").alias("k"), F.col("conv_id").alias("conv"), F.floor(F.col("turn") / STRETCH).alias("stretch"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("stretch", F.coalesce(F.col("stretch").cast("string"), F.lit("")))
    own = Window.partitionBy("k", "stretch")
    placed = base.withColumn("n", F.row_number().over(own.orderBy("turn", "role", "text")))
    sizes = base.groupBy("k", "stretch").agg(F.count(F.lit(1)).alias("size"))
    order = F.col("stretch").try_cast("long").asc_nulls_first()
    before = F.coalesce(F.sum("size").over(Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    node = F.col("n") + F.col("before")
    joined = placed.join(sizes.select("k", "stretch", before.alias("before")), ["k", "stretch"])
    return joined.select("conv", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(links: DataFrame, scratch: Scratch, branches: int | None = None) -> DataFrame:
    """``(k, leaf, node, up)``: the messages of each chosen path, ``up`` replies above its leaf.

    ``links (k, node, parent, score)``, a node once in its k. Of each tree the ``branches`` paths with the largest sums
    of scores are chosen (all without it), ties by the smaller leaf. A parent that isn't there makes a root; messages
    that lead into a circle of replies have none, and are in no path.
    """
    known = links.select("k", F.col("node").alias("parent"), F.lit(True).alias("there"))
    first = links.join(known, ["k", "parent"], "left").select("k", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum"))
    # (k, node, up: the message 2 ** j above or null, sum: the scores below it, root: the tree's root once up is null)
    state = scratch.save(first.withColumn("root", F.when(F.col("up").isNull(), F.col("node"))), "jump0")
    jumps, most, j = [], links.count(), 0
    while (open_ := state.where("up is not null")).limit(1).count() and 1 << j <= 2 * most:
        jumps.append(open_.select("k", "node", "up"))
        above = state.select("k", F.col("node").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"), F.col("root").alias("of"))
        further = open_.drop("root").join(above, ["k", "up"]).select("k", "node", F.col("next").alias("up"), (F.col("sum") + F.col("more")).alias("sum"), F.col("of").alias("root"))
        j += 1
        state = scratch.save(state.where("up is null").unionByName(further), f"jump{j}")
    ended = state.where("up is null")
    replied = links.select("k", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = ended.join(replied, ["k", "node"], "left_anti")
    if branches is not None:
        rank = F.row_number().over(Window.partitionBy("k", "root").orderBy(F.desc("sum"), "node"))
        leaves = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    paths = leaves.select("k", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for j, jump in enumerate(jumps):  # each place above the leaf is reached once, by the binary digits of its height
        step = paths.join(jump.withColumnRenamed("up", "next"), ["k", "node"]).select("k", "leaf", F.col("next").alias("node"), (F.col("up") + (1 << j)).alias("up"))
        paths = scratch.save(paths.unionByName(step), f"paths{j}")
    return paths


def format_trees(messages: DataFrame, branches: int | None = None, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv, leaf, part, formatted, n_turns, loss)``: conversations of ``messages (conv, node, parent, role, text, score, ...)``.

    A path's text is its parts' ``formatted`` in order, each of ``part_turns`` turns at most and whole turns. ``loss``
    lists the spans ``(begin, n)``, in characters of its own part, of the assistants' texts, as they stand there, escaped.
    Null roles and texts are empty; null convs are one conversation; a node comes once in its conv, or the result is
    undefined. Trees, ties and broken links are as in ``chosen_paths``. An empty table gives an empty one.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    own = scratch.save(messages.select(_name("conv").alias("k"), "conv", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"), "messages")
    paths = chosen_paths(own.select("k", "node", "parent", "score"), scratch, branches)
    depth = paths.groupBy("k", "leaf").agg(F.max("up").alias("depth"))
    placed = paths.join(depth, ["k", "leaf"]).select("k", "leaf", "node", (F.col("depth") - F.col("up")).alias("at"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    text = escaped(F.col("text"))
    turn = F.struct("at", head.alias("head"), text.alias("text"), (F.col("role") == ASSISTANT).alias("loss"))
    turns = own.join(placed, ["k", "node"]).groupBy("k", "conv", "leaf", F.floor(F.col("at") / part_turns).alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "")
    tail = len(END) + 1
    length = lambda t: F.char_length(t["head"]) + F.char_length(t["text"]) + tail
    begin = lambda t, i: F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0), lambda n, u: n + length(u)) + F.char_length(t["head"])
    spans = F.transform("turns", lambda t, i: F.struct(begin(t, i).alias("begin"), F.char_length(t["text"]).alias("n"), t["loss"].alias("loss")))
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["begin"], s["n"]))
    return turns.select("conv", "leaf", "part", whole.alias("formatted"), F.size("turns").alias("n_turns"), loss.alias("loss"))


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` of a formatted text's turns."""
    out = []
    for turn in formatted.split(END + "\n")[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        out.append((plain_role(role), plain_text(text)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """``(conv, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of each path of ``format_trees``' output,
    read back from its text and spans.

    A path's parts come sorted to one task, as a digest needs its bytes in order; it keeps the digest, not the parts.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, own, kinds = None, None, None

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)

        def end() -> list:
            return [*path, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]]

        for batch in batches:
            kinds, done = pa.schema([batch.schema.field("conv"), *_DIGESTS]), []
            for s in range(0, batch.num_rows, 256):
                for r in batch.slice(s, 256).to_pylist():
                    if (r["conv"], r["leaf"]) != path:
                        done += [end()] if own else []
                        path, own = (r["conv"], r["leaf"]), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text in parsed(r["formatted"]):
                        own[0] += 1
                        own[1].update(f"{role}\n{text}\n".encode())
                    for span in r["loss"]:
                        text = plain_text(r["formatted"][span["begin"] : span["begin"] + span["n"]])
                        own[2] += len(text)
                        own[3].update(text.encode())
                    own[4] += len(r["formatted"])
            yield table(done)
        if own:
            yield table([end()])

    return formatted.repartition("conv", "leaf").sortWithinPartitions(*KEYS).select(*KEYS, "formatted", "loss").mapInArrow(run, schema)


_ALL = f"SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, '{ASSISTANT}', '{PROBE}'))"
_LONGER = r"length(regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g'))"
OP12_SQL = f"""WITH c AS ({_ALL}) SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
sum({len(START) + len(END) + 2} + {_LONGER.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} + {_LONGER.format("text")})::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of each formatted conversation, and of one whose texts hold the template's own strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, ASSISTANT, PROBE)], rows.schema)
    formatted = Scratch(spark, "chat").save(format_trees(replies_of(rows.unionByName(probe))), "formatted")
    return digests(formatted).drop("leaf").withColumnRenamed("conv", "conv_id")
