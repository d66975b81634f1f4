"""Rules on streams: state kept for each series, and timers that fire when nothing comes.

Rows are first counted by series and step, so that a series of any size brings one row a step to its state. Series are
dealt to BUCKETS groups, whose states and timers hold many series each, as a call to a group costs more than a series. A step is
judged once, when the watermark has passed its end; ``delay`` is how late a row may be. Every step is named by its end
``t`` in microseconds and holds ``(t - step, t]``. A row is late if the micro-batch before had passed its step's end. What has been told, and since when, lives in the checkpoint: a query
that is stopped and started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidegauge.functions.labels import labelled, micros
from tidegauge.operators.alerts import Rule

#: The state's "none": no time is that early.
NEVER = -(1 << 62)
#: Marks the rows that only tell the time.
CLOCK = "_clock"
#: Groups that series are dealt to by their hash; it can't change while a checkpoint lives.
BUCKETS = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step_counts(rows: DataFrame, ts: str, step: int, by: list[str], delay: str) -> DataFrame:
    """``(*by, at, t, n)`` of steps with rows that the watermark has passed; ``at`` is t as a timestamp. Rows without time don't count."""
    counted = ~F.col(CLOCK) if CLOCK in rows.columns else F.lit(True)  # a filter would be put before the watermark
    # A row at t itself belongs to the step that ends there.
    timed = labelled(rows, by).select(*by, counted.alias("_counted"), F.timestamp_micros(micros(ts) - 1).alias("_at")).withWatermark("_at", delay)
    counts = timed.groupBy(F.window("_at", f"{step} microseconds").alias("_w"), *by).agg(F.count_if("_counted").alias("n")).where("n > 0")
    return counts.select(*by, F.col("_w.end").alias("at"), F.unix_micros("_w.end").alias("t"), "n")


class _Rule(StatefulProcessor):
    """The series of a group, each with its closed steps in order. ``judge`` gets the counts of a series' steps that have come, and the
    step up to which all is closed; it changes ``self.memory``, appends to ``self.told`` and gives the step to wait for, or None."""

    memory_schema = ""

    def __init__(self, columns: list[str], step: int, start: int, end: int):
        self.columns, self.step, self.start, self.end = columns, step, start, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("group", f"members array<struct<series string, {self.memory_schema}>>")

    def judge(self, counts: dict[int, int], closed: int) -> int | None:
        raise NotImplementedError

    def _run(self, counts: dict[str, dict[int, int]], mark_ms: int) -> pd.DataFrame:
        closed = self.start + (mark_ms * 1000 - self.start) // self.step * self.step
        known = {m[0]: tuple(m[1:]) for m in self.state.get()[0]} if self.state.exists() else {}
        members, rows, first = [], [], None
        for series in {**known, **counts}:
            mine = counts.get(series, {})
            self.memory, self.told = known.get(series), []
            wait = self.judge(mine, min(max(closed, max(mine, default=NEVER)), self.end))
            if self.memory is not None:
                members.append((series, *self.memory))
            if wait is not None and wait <= self.end:
                first = wait if first is None else min(first, wait)
            rows += [(series, *row) for row in self.told]
        if members:
            self.state.update((members,))
        else:
            self.state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first is not None:
            self.handle.registerTimer(max(-(-first // 1000), mark_ms + 1))
        return pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[str, dict[int, int]] = {}
        for f in rows:
            for series, t, n in zip(f["series"].tolist(), f["t"].tolist(), f["n"].tolist(), strict=True):
                counts.setdefault(series, {})[t] = n
        yield self._run(counts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._run({}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class _Hold(_Rule):
    memory_schema = "since long, last long, firing boolean"

    def __init__(self, columns: list[str], rule: Rule, step: int, start: int, end: int):
        super().__init__(columns, step, start, end)
        self.rule = rule

    def judge(self, counts: dict[int, int], closed: int) -> int | None:
        since, last, firing = self.memory or (NEVER, NEVER, False)
        told = lambda t, state: self.told.append((t, self.rule.alert, self.rule.severity, state))
        true = sorted(t for t, n in counts.items() if self.start <= t <= self.end and n > self.rule.over)
        for t in [*true, NEVER]:  # the last one stands for what is closed
            until = closed if t == NEVER else t - 1
            if since != NEVER and until > last and last + self.step <= until:
                if firing:
                    told(last + self.step, "resolved")
                since, firing = NEVER, False
            if t != NEVER:
                since = t if since == NEVER else since
                firing, last = t - since >= self.rule.hold, t
                told(t, "firing" if firing else "pending")
        self.memory = (since, last, firing) if since != NEVER else None
        return last + self.step if since != NEVER else None


class _DeadMan(_Rule):
    memory_schema = "ahead long, out long"

    def __init__(self, columns: list[str], step: int, start: int, end: int, cooldown: int):
        super().__init__(columns, step, start, end)
        self.every = max(1, -(-cooldown // step))

    def judge(self, counts: dict[int, int], closed: int) -> int | None:
        ahead, out = self.memory or (self.start, 0)

        def silent(until: int) -> None:  # no heartbeat from ``ahead`` to before ``until``
            nonlocal ahead, out
            n = max(0, (min(until, self.end + self.step) - ahead) // self.step)
            self.told.extend((ahead + k * self.step, "missing") for k in range(-out % self.every, n, self.every))
            ahead, out = ahead + n * self.step, out + n

        for t in sorted(t for t in counts if t >= ahead):
            silent(t)
            if out and t <= self.end:
                self.told.append((t, "back"))
            ahead, out = t + self.step, 0
        silent(closed + self.step)
        self.memory = (ahead, out)
        return ahead


def _by_series(counts: DataFrame, by: list[str], processor: _Rule, more: str) -> DataFrame:
    """The rows that the processor tells of each series, which goes through it as one text."""
    series = F.to_json(F.array(*[F.col(c).cast("string") for c in by]))
    dealt = counts.select(series.alias("series"), "at", "t", "n").withColumn("bucket", F.pmod(F.xxhash64("series"), F.lit(BUCKETS)))
    told = dealt.groupBy("bucket").transformWithStateInPandas(processor, f"series string, {more}", "append", "EventTime")
    labels = F.from_json("series", "array<string>")
    return told.select(*[F.get(labels, F.lit(k)).cast(counts.schema[c].dataType).alias(c) for k, c in enumerate(by)], *processor.columns[1:])


def hold_stream(counts: DataFrame, rule: Rule, step: int, start: int, end: int, by: list[str]) -> DataFrame:
    """``(*by, t, alertname, severity, state)``: pending or firing at each step where the count is over the rule's bound, and
    resolved at the first step after a firing one where it isn't, also if no row of the series comes any more.

    ``counts`` is ``step_counts``; a step without rows is false. Steps outside ``[start, end]`` aren't judged.
    """
    names = ["series", "t", "alertname", "severity", "state"]
    return _by_series(counts, by, _Hold(names, rule, step, start, end), "t long, alertname string, severity string, state string")


def deadman_stream(beats: DataFrame, step: int, start: int, end: int, cooldown: int, by: list[str]) -> DataFrame:
    """``(*by, t, kind)`` of each series that has had a heartbeat: ``missing`` at the first step of an outage without one and
    again each ``cooldown`` while it lasts, and ``back`` at the first step with one after that.

    ``beats`` is ``step_counts``. A series is known from its first heartbeat on; then its steps from ``start`` are judged, to
    ``end``. A timer judges steps in which nothing comes, so that a series that falls silent for good is told too. The
    state is the next step to judge and how long the outage has lasted: what was told last, until recovery clears it.
    """
    return _by_series(beats, by, _DeadMan(["series", "t", "kind"], step, start, end, cooldown), "t long, kind string")


def last_told(told: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, t)``: of the rows that ``deadman_stream`` has appended, the last time each series was told missing, for those that
    haven't come back since."""
    last = told.groupBy(*by).agg(F.max(F.struct("t", "kind")).alias("_last"))
    return last.where("_last.kind = 'missing'").select(*by, "_last.t")


def append_all(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Judges all that there is now, appends what is told, and ends. The state store is RocksDB, as timers need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a stream takes no path of a single file


def with_clock(rows: DataFrame, ts: str, folder: str, at: int) -> DataFrame:
    """The stream ``rows`` and one row that has only a time, ``at``, which moves the watermark past all steps before it."""
    spark = rows.sparkSession
    tick = spark.range(1).select(*[(F.timestamp_micros(F.lit(at)).cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    tick.write.mode("overwrite").parquet(folder)
    ticks = spark.readStream.schema(rows.schema).parquet(folder)
    return rows.withColumn(CLOCK, F.lit(False)).unionByName(ticks.withColumn(CLOCK, F.lit(True)))
