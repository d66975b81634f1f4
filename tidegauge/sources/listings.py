"""Columnar text listings, whose columns are told by blanks alone, and fixed-width reports that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.labels import matched

#: Characters whose blanks one number tells.
_WORD = 60


def read_lines(spark: SparkSession, glob: str) -> DataFrame:
    """``(listing, n, line)`` of text files: n orders the lines of a file, the header first."""
    rows = spark.read.text(glob)
    return rows.select(F.col("_metadata.file_path").alias("listing"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("n"), F.col("value").alias("line"))


def bounds(lines: DataFrame, gap: int = 2) -> DataFrame:
    """``(listing, starts, names)``: where each column begins, from 0, and what the first line that isn't blank says there.

    Columns are apart where at least ``gap`` characters are blank in every line of the listing. The lines are reduced to
    a bit for a blank, and these are joined by AND, in each task first.
    """
    text = lines.where(F.trim("line") != "").select("listing", F.rtrim("line").alias("line"))
    word = F.explode(F.sequence(F.lit(0), F.floor((F.char_length("line") - 1) / _WORD).cast("int"))).alias("word")
    piece = F.rpad(F.substring("line", F.col("word") * _WORD + 1, F.lit(_WORD)), _WORD, " ")
    mask = F.conv(F.translate(F.regexp_replace(piece, "[^ ]", "0"), " ", "1"), 2, 10).cast("long")
    masks = text.select("listing", "line", word).select("listing", "word", mask.alias("mask")).groupBy("listing", "word").agg(F.bit_and("mask").alias("mask"))
    words = masks.groupBy("listing").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))  # a word for 60 characters of width
    blank = F.array_join(F.transform("words", lambda w: F.lpad(F.bin(w["mask"]), _WORD, "0")), "")
    # Gaps as one mark each, of their length, so that columns keep their places.
    marked = words.select("listing", blank.alias("blank"))
    at = F.transform(F.sequence(F.lit(1), F.char_length("blank")), lambda i: F.when((F.substring("blank", i, F.lit(1)) == "0") & ((F.substring("blank", F.greatest(i - gap, F.lit(1)), F.least(i - 1, F.lit(gap))) == F.lit("1" * gap)) | (F.instr("blank", F.lit("0")) == i)), i - 1))
    starts = marked.select("listing", F.filter(at, lambda i: i.isNotNull()).alias("starts"))
    first = lines.where(F.trim("line") != "").groupBy("listing").agg(F.min_by("line", "n").alias("header"))
    return matched(starts, first, ["listing"]).select("listing", "starts", _cut(F.col("header"), F.col("starts")).alias("names"))


def _cut(line: Column, starts: Column) -> Column:
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.greatest(F.char_length(line), F.get(starts, i)))
    return F.transform(starts, lambda s, i: F.rtrim(F.substring(line, s + 1, end(i) - s)))


def cells(lines: DataFrame, gap: int = 2) -> DataFrame:
    """``(listing, n, cells)`` of the lines ``(listing, n, line)`` below each listing's first: ``cells`` are pairs ``(name, value)`` by column.

    A cell may hold single blanks, and be empty where other lines have something. Blank lines are left out; a listing
    of its first line alone has no rows. Characters left of the first column belong to it.
    """
    head = lines.where(F.trim("line") != "").groupBy("listing").agg(F.min("n").alias("first"))
    rows = matched(lines.where(F.trim("line") != ""), head, ["listing"]).where("n > first").drop("first")
    found = matched(rows, bounds(lines, gap), ["listing"])
    pairs = F.transform(F.arrays_zip("names", _cut(F.col("line"), F.col("starts")).alias("values")), lambda x: F.struct(x["names"].alias("name"), x["values"].alias("value")))
    return found.select("listing", "n", pairs.alias("cells"))


def cell(name: str) -> Column:
    """The value of the first column of that name; null if there is none."""
    return F.get(F.filter("cells", lambda c: c["name"] == name), F.lit(0))["value"]


def report(rows: DataFrame, columns: list[str], order: list[str | Column], gap: int = 2) -> DataFrame:
    """``(line)`` sorted: a header and a row a line, each column as wide as its longest value. Nulls are empty; line ends and tabs in
    values are blanks; a row whose values are all empty is a lone dash, as ``cells`` leaves blank lines out."""
    text = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\n\r\t", "   ") for c in columns]
    own = rows.select(*order, F.array(*text).alias("_v"))
    widths = own.agg(*[F.max(F.char_length(F.col("_v")[i])).alias(f"w{i}") for i in range(len(columns))]).first()  # one row
    wide = [max(len(c), widths[i] or 0) for i, c in enumerate(columns)]
    line = lambda value: F.rtrim(F.concat(*[F.rpad(value(i), w + gap, " ") for i, w in enumerate(wide)]))
    names = [f"_o{i}" for i in range(len(order))]
    body = own.select(*[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names, strict=True)], line(lambda i: F.col("_v")[i]).alias("line"))
    body = body.withColumn("line", F.when(F.col("line") == "", "-").otherwise(F.col("line"))).withColumn("_head", F.lit(1))
    head = rows.sparkSession.range(1).select(*[F.lit(None).cast(body.schema[n].dataType).alias(n) for n in names], line(lambda i: F.lit(columns[i])).alias("line"), F.lit(0).alias("_head"))
    return head.unionByName(body).orderBy("_head", *names).select("line")
