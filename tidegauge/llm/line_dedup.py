"""Removal of repeated lines by overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import apart

WINDOW = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, body, at, h1, h2)``: two independent 64-bit hashes of each run of ``width`` lines that aren't spaces alone; ``at`` counts from 0."""
    part = lambda i: [F.get(F.col("lines"), i + k) for k in range(width)]
    marked = lambda i: F.struct(
        i.alias("at"), F.xxhash64(*part(i)).alias("h1"), F.xxhash64(F.lit(width), *reversed(part(i))).alias("h2"), (F.trim(F.concat(*part(i))) != "").alias("visible")
    )
    rows = docs.select("doc_id", _body(), F.split("text", "\n").alias("lines")).where(F.size("lines") >= width)
    return rows.select("doc_id", "body", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - width), marked))).where("visible").drop("visible")


def _body() -> Column:
    """Tells rows with the same doc_id and different texts apart."""
    return F.xxhash64("text").alias("body")


def repeated_lines(docs: DataFrame, scratch: Scratch, width: int = WINDOW) -> DataFrame:
    """``(doc_id, body, starts)``: for each text with any, the starts of windows whose lines occur earlier, by (doc_id, place)."""
    windows = scratch.save(_windows(docs.where("doc_id is not null and text is not null"), width), "windows")
    place = F.struct("doc_id", "at", "body")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first.hint("merge"), ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "body").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs (doc_id, text, ...)`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_removed`` added last.

    Lines are split at ``\\n`` and compared exactly, up to collisions of two 64-bit hashes. Of each run of ``width`` lines that occurs more than once in all
    of ``docs``, the first by (doc_id, line) stays; the lines of all others are removed, wherever such windows overlap.
    Windows are judged on the input; one of spaces alone doesn't count; a text of fewer lines has none.

    Null texts stay null, with 0 lines; rows without a doc_id stay as they are; rows that repeat both doc_id and text
    count once and are treated alike. An empty table gives an empty one. Columns of ``docs`` named n_lines or n_removed
    are replaced; any others stay. A text of any length is one value in one task; a window may occur any number of times.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    mine = apart(docs)
    found = scratch.save(repeated_lines(docs, scratch, width), "found").select(F.col("doc_id").alias(mine("doc")), F.col("body").alias(mine("body")), F.col("starts").alias(mine("starts"))).hint("merge")
    kept = docs.drop("n_lines", "n_removed").columns
    joined = docs.select(*kept).join(found, (F.col("doc_id") == F.col(mine("doc"))) & (F.xxhash64("text") == F.col(mine("body"))), "left")
    lines, n = F.split("text", "\n"), F.size(F.split("text", "\n"))
    covered = F.array_distinct(F.flatten(F.transform(mine("starts"), lambda s: F.sequence(s, s + width - 1))))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), n - 1), covered))
    text = F.when(F.col(mine("starts")).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"), "n_removed": F.coalesce(F.size(covered), F.lit(0)).cast("long"), mine("text"): text})
    out = out.withColumn("n_removed", F.when(F.col(mine("starts")).isNull(), 0).otherwise(F.col("n_removed")).cast("long"))
    return out.select(*[F.col(mine("text")).alias("text") if c == "text" else F.col(c) for c in kept], "n_lines", "n_removed")


def shortened(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with repeated lines taken out; ``n_chars``, if there is one, follows the text."""
    out = dedup_lines(docs, width)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated lines, and how many it had and lost."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP9_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
     line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
     three AS (SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
     ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
                FROM three WHERE c IS NOT NULL AND trim(a || b || c) <> ''),
     gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1),
     kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
              FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
