"""Registered queries that run as streams over ``events`` and end, or in several runs over what they keep; the SQL is of one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.labels import micros
from tidegauge.operators import alerts as A
from tidegauge.operators import history as H
from tidegauge.operators import limits as X
from tidegauge.operators import recording as M
from tidegauge.operators import vectors as V
from tidegauge.plans.catalogue import AT, BY, DAY, HOUR, ORACLES, START, query
from tidegauge.plans.catalogue import _BEATS as BEATS
from tidegauge.sources.shared import shared_folder
from tidegauge.streaming import ingest as I
from tidegauge.streaming import rules as R


def _run(spark: SparkSession, d: str, name: str, of) -> DataFrame:
    """The rows that a stream over all events appends, with a last clock row a day after the last step."""
    folder = shared_folder(spark, name)
    rows = R.with_clock(R.table_stream(spark, f"{d}/events.parquet"), "ts", f"{folder}/clock", AT + 2 * DAY)
    out = of(rows)
    R.append_all(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(ORACLES["alert_hold_states"])
def alert_hold_stream(spark, d):
    rule = A.Rule("Burst", over=1, hold=2 * HOUR)
    told = _run(spark, d, "hold", lambda rows: R.hold_stream(R.step_counts(rows, "ts", HOUR, BY, "1 hour"), rule, HOUR, START, AT, BY))
    return told.where("state <> 'resolved'").select("t", "event_type", "state")


@query(ORACLES["deadman_cooldown"])
def deadman_stream(spark, d):
    told = _run(spark, d, "deadman", lambda rows: R.deadman_stream(R.step_counts(rows, "ts", DAY, BEATS, "1 hour"), DAY, START + DAY, AT, 3 * DAY, BEATS))
    return told.where("kind = 'missing'").select(*BEATS, "t")


_ISLANDS = f"""WITH s AS ({ORACLES['alert_hold_states']}), i AS (SELECT *, t - {HOUR} * row_number() OVER (PARTITION BY event_type ORDER BY t) AS island FROM s),
e AS (SELECT event_type, max(t) + {HOUR} AS t, bool_or(state = 'firing') AS fired FROM i GROUP BY event_type, island)"""


@query(f"{_ISLANDS} SELECT t, event_type FROM e WHERE fired AND t <= {AT}")
def alert_resolved_stream(spark, d):
    """The points at which a firing alert ends, which timers find for series that fall silent."""
    rule = A.Rule("Burst", over=1, hold=2 * HOUR)
    told = _run(spark, d, "resolved", lambda rows: R.hold_stream(R.step_counts(rows, "ts", HOUR, BY, "1 hour"), rule, HOUR, START, AT, BY))
    return told.where(F.col("state") == "resolved").select("t", "event_type")


_LATE = 5 * DAY


@query(f"""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS u FROM events), w AS (SELECT (max(u) // 1000 - {_LATE // 1000}) * 1000 AS w FROM e WHERE event_id % 3 <> 0),
k AS (SELECT event_type, event_id % 3 <> 0 OR u > w AS kept, (event_id % 6 = 1)::INT AS copies FROM e, w)
SELECT event_type, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS late, sum(copies)::BIGINT AS resent FROM k GROUP BY event_type""")
def late_and_resent(spark, d):
    """Two deliveries: the second brings what the first left out, some of it too late, and sends some lines again."""
    folder = shared_folder(spark, "late")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.timestamp_micros(micros("ts")).alias("at"))
    sent, kept = f"{folder}/sent", f"{folder}/kept"
    for part in (events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0 or event_id % 6 = 1")):
        part.write.mode("append").parquet(sent)
        stream = spark.readStream.schema(part.schema).parquet(sent)
        I.append(I.once(stream, "at", ["event_id"], f"{_LATE // HOUR} hours"), kept, f"{folder}/state").awaitTermination()
    stored = spark.read.schema(events.schema).parquet(kept)
    lost = I.unkept(spark.read.schema(events.schema).parquet(sent), stored, ["event_id"]).join(events, "event_id")
    counts = stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"), F.lit(0).alias("late"), F.lit(0).alias("resent")).unionByName(lost.groupBy("event_type").agg(F.lit(0).alias("kept"), F.sum("late").alias("late"), F.sum("resent").alias("resent")))
    return counts.groupBy("event_type").agg(*[F.sum(c).alias(c) for c in ("kept", "late", "resent")])


_RULES = [
    M.Recorded("type:lines:count", "events", BY),
    M.Recorded("type:errors:count", "events", BY, where="value > 100"),
    M.Recorded("all:value:max", "events", [], "max"),
    M.Quotient("type:errors:ratio", "type:errors:count", "type:lines:count"),
    M.Recorded("all:lines:sum", "type:lines:count", [], "sum"),
]


@query(f"""WITH e AS (SELECT event_type, value, ceil(epoch_us(ts) / {6 * HOUR})::BIGINT * {6 * HOUR} AS t FROM events),
c AS (SELECT t, event_type, count(*) AS n, count(*) FILTER (value > 100) AS k, max(value) AS m FROM e GROUP BY ALL)
SELECT 'type:errors:ratio' AS rule, event_type AS labels, t, round(k / n, 9) AS value FROM c WHERE k > 0 UNION ALL SELECT 'all:lines:sum', '', t, sum(n) FROM c GROUP BY t
UNION ALL SELECT 'all:value:max', '', t, max(m) FROM c GROUP BY t""")
def recorded_series(spark, d):
    """Rules of two levels, recorded in two runs: up to a time within a slot, then to the end."""
    folder = shared_folder(spark, "recorded")
    rows = spark.read.parquet(f"{d}/events.parquet")
    for upto in (START + 11 * DAY + 7 * HOUR, AT):
        M.record(spark, {"events": (rows, "ts")}, _RULES, folder, 6 * HOUR, DAY, START, upto)
    wanted = M.read(spark, folder).where(F.col("rule").isin("type:errors:ratio", "all:lines:sum", "all:value:max"))
    return wanted.select("rule", F.array_join("labels.value", ",").alias("labels"), "t", F.round("value", 9).alias("value"))


@query(f"""WITH s AS ({ORACLES['alert_hold_states']}), i AS (SELECT event_type, t, t - {HOUR} * row_number() OVER (PARTITION BY event_type ORDER BY t) AS island FROM s WHERE state = 'firing')
SELECT event_type, min(t) AS starts_at, max(t) + {HOUR} AS ends_at, max(t) + {HOUR} > {AT} AS open FROM i GROUP BY event_type, island""")
def alert_history(spark, d):
    """Three evaluations, each merged into what the one before left open."""
    rule = A.Rule("Burst", over=1, hold=2 * HOUR)
    counts = V.count_over_time(spark.read.parquet(f"{d}/events.parquet"), "ts", HOUR, HOUR, BY).withColumnRenamed("n", "value")
    history = H.History(spark, shared_folder(spark, "history"), BY, "event_type string")
    before = None
    for at in (START + 9 * DAY, START + 20 * DAY + 5 * HOUR, AT):
        since = START if before is None else before - rule.hold  # enough to know for how long the points after it have held
        history.merge(A.states(counts, rule, HOUR, since, at, BY), HOUR, before, at)
        before = at
    return history.intervals(AT)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_type, event_id, epoch_us(ts) AS u, length(props) * 200000000 AS need, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events),
b AS (SELECT event_type, event_id, u, r, 4000000000 - CASE WHEN need <= 4000000000 THEN need ELSE 0 END AS level, need <= 4000000000 AS accepted FROM e WHERE r = 1
UNION ALL SELECT event_type, event_id, u, r, l - CASE WHEN need <= l THEN need ELSE 0 END, need <= l
FROM (SELECT e.*, least(b.level + e.u - b.u, 4000000000) AS l FROM b JOIN e ON e.event_type = b.event_type AND e.r = b.r + 1))
SELECT event_type, event_id, accepted FROM b""")
def ingest_limit(spark, d):
    """Each event type may send 4000 bytes at once and then one byte a second; a line counts 200 times."""
    size = (F.char_length("props") * 200).alias("size")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_type", micros("ts").alias("at"), "event_id", size)
    return X.within_limit(rows, "event_type", "at", ["event_id"], "size", 1, 4000, 6 * HOUR).select("event_type", "event_id", "accepted")


@query("SELECT event_type AS namespace, 'n1' AS node, 'stderr' AS stream, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(props) AS line FROM events GROUP BY ALL")
def pod_log_stream(spark, d):
    """Events as lines of pod logs in files, tailed as a stream, parsed, given a static label, and kept in folders by day."""
    folder = shared_folder(spark, "pods")
    events = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" stderr F "), "props")
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]  # the namespaces: a handful
    for kind in kinds:
        part = events.where(F.col("event_type") == kind).select(line.alias("value"))
        part.write.option("quote", "\x00").option("escape", "\x00").option("sep", "\x01").option("extension", "log").csv(f"{folder}/var/log/pods/{kind}_pod_uid/app")
    I.append_by_day(I.tail(spark, f"{folder}/var/log/pods/*/*/*.log", node="n1"), f"{folder}/kept", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/kept").groupBy("namespace", "node", "stream", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("line"))


@query(f"WITH told AS ({ORACLES['deadman_cooldown']}) SELECT event_type, user_id, max(t) AS t FROM told JOIN (SELECT event_type, user_id, max(epoch_us(ts)) AS u FROM events GROUP BY ALL) USING (event_type, user_id) WHERE u <= {AT - DAY} AND t > u GROUP BY ALL")
def deadman_last_told(spark, d):
    """When each series that is missing at the end was told last: what recovery would clear."""
    told = _run(spark, d, "last", lambda rows: R.deadman_stream(R.step_counts(rows, "ts", DAY, BEATS, "1 hour"), DAY, START + DAY, AT, 3 * DAY, BEATS))
    return R.last_told(told, BEATS)
