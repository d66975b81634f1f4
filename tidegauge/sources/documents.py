"""JSON documents of any shape: several in one text, one a line, open objects as VARIANT, and differences by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.labels import matched
from tidegauge.sources.tables import CONTAINERS

_BLOCK = ["file", "block"]


def chunks(spark: SparkSession, glob: str, stream: bool = False) -> DataFrame:
    """The pieces of text files between closing braces, with what tells their order: any split of a file may be another task's."""
    reader = spark.readStream if stream else spark.read
    rows = reader.option("lineSep", "}").text(glob)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"))


def documents(pieces: DataFrame) -> DataFrame:
    """``(file, n, text, doc)``: the JSON objects of each file in order, as text and as VARIANT; ``doc`` is null for bad parts.

    Objects may follow each other with or without anything between them, and may span lines and splits. A closing brace that
    closes nothing ends a bad part, and so does the file's end within an object. What is between two objects
    belongs to the second one, and makes it bad if it isn't white space.

    Whether a piece begins inside a string, and how deep, depends on all before it in its file. Pieces are counted within
    their block, blocks are joined by their counts, and only these go through one task a file.
    """
    # Outside of strings there are no escapes, and a brace is never part of one.
    rows = pieces.withColumn("at", F.monotonically_increasing_id())
    plain = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    opens = lambda parts, odd: F.aggregate(F.transform(F.filter(parts, lambda _, i: i % 2 == odd), lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("{"), F.lit("")))), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("parts", plain).select(*_BLOCK, "at", "value", "bytes", (F.size("parts") - 1).alias("quotes"), opens(F.col("parts"), 0).alias("out0"), opens(F.col("parts"), 1).alias("out1"))
    inner = Window.partitionBy(*_BLOCK).orderBy("at")
    so_far, whole = inner.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))

    # Inside a string or not; a last piece without a brace is told by the file's length.
    blocks = rows.groupBy(*_BLOCK).agg(F.sum("quotes").alias("quotes"), F.sum(F.octet_length("value") + 1).alias("length"), F.max("bytes").alias("bytes"))
    every = Window.partitionBy("file")
    tail = (F.sum("length").over(every) > F.col("bytes")) & (F.col("block") == F.max("block").over(every))
    blocks = blocks.select(*_BLOCK, none(F.sum("quotes").over(whole)).alias("before"), tail.alias("tail"))
    rows = matched(rows, blocks, _BLOCK)
    rows = rows.withColumn("after", F.col("before") + F.sum("quotes").over(so_far)).withColumn("open", F.col("tail") & F.lead("at").over(inner).isNull())
    outside = (F.col("after") % 2 == 0) & ~F.col("open")
    step = F.when((F.col("after") - F.col("quotes")) % 2 == 0, F.col("out0")).otherwise(F.col("out1")) - outside.cast("long")
    rows = rows.select(*_BLOCK, "at", "value", outside.alias("outside"), "open", step.cast("long").alias("step"))

    # Depth that never falls below 0: the running sum less its least value.
    rows = rows.withColumn("sum", F.sum("step").over(so_far)).withColumn("least", F.min("sum").over(so_far))
    sums = rows.groupBy(*_BLOCK).agg(F.sum("step").alias("step"), F.min("sum").alias("least"))
    sums = sums.withColumn("base", none(F.sum("step").over(whole))).withColumn("low", F.least(F.lit(0), F.min(F.col("base") + F.col("least")).over(whole)))
    rows = matched(rows, sums.select(*_BLOCK, "base", "low"), _BLOCK)
    depth = F.col("base") + F.col("sum") - F.least(F.lit(0), F.coalesce("low", F.lit(0)), F.col("base") + F.col("least"))
    rows = rows.select(*_BLOCK, "at", "value", "open", (F.col("outside") & (depth == 0)).alias("ends"))

    # A piece belongs to the document that the first end from it on closes.
    counts = rows.groupBy(*_BLOCK).agg(F.count_if("ends").alias("ends"))
    rows = matched(rows, counts.select(*_BLOCK, none(F.sum("ends").over(whole)).alias("ended")), _BLOCK)
    own = F.col("ended") + F.count_if("ends").over(so_far) - F.col("ends").cast("long")
    rows = rows.select("file", own.alias("n"), F.struct("block", "at", F.when(F.col("open"), F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("text")).alias("piece"))
    texts = rows.groupBy("file", "n").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select("file", "n", F.array_join("pieces.text", "").alias("text"))
    return texts.where(F.trim(F.translate("text", "\n\r\t", "   ")) != "").withColumn("doc", F.try_parse_json("text"))


def append_documents(spark: SparkSession, glob: str, path: str, checkpoint: str) -> None:
    """The documents of all files that are new since the last call; a batch that is run again replaces what it had written."""

    def batch(rows: DataFrame, number: int) -> None:
        out = documents(rows).withColumn("doc", F.to_json("doc")).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    chunks(spark, glob, stream=True).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def field(doc: str | Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a VARIANT; null if it is missing or of another kind."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, path, kind)


def elements(doc: str | Column, path: str) -> Column:
    """The elements of the array at a path; none if there is no array."""
    return F.coalesce(field(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def process_events(lines: DataFrame) -> DataFrame:
    """``(kind, node, binary, arguments, namespace, pod, function)`` of JSON lines ``(value)``, batch or stream, that hold one of the
    objects process_exec, process_exit and process_kprobe; other lines have a null kind, so that they can be counted."""
    doc = F.try_parse_json("value")
    kinds = ["process_exec", "process_exit", "process_kprobe"]
    kind = F.coalesce(*[F.when(F.try_variant_get("doc", f"$.{k}", "variant").isNotNull(), F.lit(k)) for k in kinds])
    of = lambda path: F.coalesce(*[F.try_variant_get("doc", f"$.{k}.{path}", "string") for k in kinds])
    rows = lines.select(doc.alias("doc"))
    return rows.select(kind.alias("kind"), field("doc", "$.node_name").alias("node"), of("process.binary").alias("binary"), of("process.arguments").alias("arguments"), of("process.pod.namespace").alias("namespace"), of("process.pod.name").alias("pod"), of("function_name").alias("function"))


def pod_objects(docs: DataFrame) -> DataFrame:
    """``(metadata, status)`` as ``containers`` takes them, of pods given as VARIANT ``doc``: fields of another kind are null, and
    missing lists are empty."""
    one = lambda c: F.struct(field(c, "$.name").alias("name"), field(c, "$.restartCount", "int").alias("restartCount"), field(c, "$.ready", "boolean").alias("ready"), F.struct(F.struct(*[field(c, f"$.lastState.terminated.{x}").alias(x) for x in ("reason", "finishedAt")]).alias("terminated")).alias("lastState"))
    states = F.transform(elements("doc", "$.status.containerStatuses"), one).cast(CONTAINERS)
    return docs.select(F.struct(field("doc", "$.metadata.namespace").alias("namespace"), field("doc", "$.metadata.name").alias("name")).alias("metadata"), F.struct(states.alias("containerStatuses")).alias("status"))


def rule_rows(docs: DataFrame) -> DataFrame:
    """``(grp, name, type, state, health, last_error)``: a row a rule of documents ``{groups: [{name, rules: [...]}]}``; groups without
    rules have none."""
    groups = docs.select(F.explode(elements("doc", "$.groups")).alias("g"))
    rules = groups.select(field("g", "$.name").alias("grp"), F.explode(elements("g", "$.rules")).alias("r"))
    return rules.select("grp", *[field("r", f"$.{p}").alias(c) for c, p in (("name", "name"), ("type", "type"), ("state", "state"), ("health", "health"), ("last_error", "lastError"))])


def targets(docs: DataFrame) -> DataFrame:
    """``(job, health, last_error)``: a row an active target of documents ``{data: {activeTargets: [...]}}``; errors of 60 characters."""
    each = docs.select(F.explode(elements("doc", "$.data.activeTargets")).alias("t"))
    return each.select(field("t", "$.labels.job").alias("job"), field("t", "$.health").alias("health"), F.left(F.coalesce(field("t", "$.lastError"), F.lit("")), F.lit(60)).alias("last_error"))


def rule_count(doc: str | Column = "doc") -> Column:
    """The rules of all groups of an object ``{spec: {groups: [{rules: [...]}]}}``; missing lists count nothing."""
    return F.aggregate(elements(doc, "$.spec.groups"), F.lit(0), lambda n, g: n + F.size(elements(g, "$.rules")))


def host_ports(docs: DataFrame) -> DataFrame:
    """``(namespace, pod, image, host_port)``: a row a port of a container of pods given as VARIANT ``doc``; missing lists have none."""
    each = docs.select(field("doc", "$.metadata.namespace").alias("namespace"), field("doc", "$.metadata.name").alias("pod"), F.explode(elements("doc", "$.spec.containers")).alias("c"))
    ports = each.select("namespace", "pod", field("c", "$.image").alias("image"), F.explode(elements("c", "$.ports")).alias("p"))
    return ports.select("namespace", "pod", "image", field("p", "$.hostPort", "int").alias("host_port"))


def store_status(docs: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """``(*key, what, place, name, value)`` of a series store's status ``{data: {...}}``: totals (place 0), and the first entries of
    its lists ``[{name, value}]``."""
    members = docs.select(*key, field("doc", "$.data", "map<string,variant>").alias("data")).select(*key, F.explode("data").alias("what", "v"))
    total = members.select(*key, "what", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("name"), field("v", "$", "long").alias("value"))
    listed = members.select(*key, "what", F.posexplode(F.slice(elements("v", "$"), 1, most)).alias("i", "e"))
    listed = listed.select(*key, "what", (F.col("i") + 1).cast("long").alias("place"), field("e", "$.name").alias("name"), field("e", "$.value", "long").alias("value"))
    return total.unionByName(listed).where("value is not null")


def leaves(docs: DataFrame, key: list[str], depth: int = 8) -> DataFrame:
    """``(*key, path, value)``: the values of VARIANT ``doc`` by path, as JSON text: scalars, empty objects and arrays, and below
    ``depth`` levels the whole rest. Keys with dots or brackets are quoted, so that paths are unambiguous."""
    level, out = docs.select(*key, F.lit("$").alias("path"), F.col("doc").alias("v")), []
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT<") | kind.startswith("ARRAY<") if k < depth else F.lit(False)
        full = inner & ~F.to_json("v").isin("{}", "[]")
        out.append(level.where(~F.coalesce(full, F.lit(False))).select(*key, "path", F.to_json("v").alias("value")))
        if k < depth:
            name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").rlike(r"[.\[\]'\s]|^$"), F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("''")), F.lit("']"))).otherwise(F.concat(F.lit("."), "key"))
            nested = level.where(full)
            each = nested.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
            level = each.select(*key, F.concat("path", name).alias("path"), F.col("value").alias("v"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, path, change, before, after)``: the paths of ``leaves`` that were added, removed or changed."""
    a, b = (x.withColumnRenamed("value", n) for x, n in ((before, "before"), (after, "after")))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [*key, "path"], "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*key, "path", "change", "before", "after")
