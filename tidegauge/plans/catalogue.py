"""The registered queries over the driver's tables, each with the DuckDB SQL of the same result.

``events`` stands for log lines (label event_type, line props) and for samples (value); documents, pages and
conversations for texts; orders for alerts and snapshots; lineitem for a histogram. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.functions import lines as P
from tidegauge.operators import alerts as A
from tidegauge.operators import panes as N
from tidegauge.operators import tables as J
from tidegauge.operators import vectors as V
from tidegauge.sources.tables import table

HOUR, DAY = L.duration("1h"), L.duration("1d")
#: The evaluation time of instant queries, 2024-01-31, and the first grid point of rules.
AT, START = 1_706_659_200_000_000, 1_704_067_200_000_000
BY = ["event_type"]
_U = "epoch_us(ts)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- log lines -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, length(text) AS n FROM documents WHERE lang = 'en' AND contains(text, 'token')")
def log_select_contains(spark, d):
    return table(spark, d, "documents").where(L.equals("lang", "en") & F.contains("text", F.lit("token"))).select("doc_id", "lang", F.char_length("text").cast("long").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE regexp_full_match(coalesce(source, ''), 'src(1|2)') AND regexp_matches(text, '(?i)moron|trash|token')")
def log_select_regex_ci(spark, d):
    return table(spark, d, "documents").where(L.matches("source", "src(1|2)") & F.col("text").rlike("(?i)moron|trash|token")).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE coalesce(lang, '') <> 'en' AND NOT regexp_full_match(coalesce(source, ''), 'src1.*') AND NOT contains(text, 'http') AND NOT regexp_matches(text, '(?i)trash')")
def log_select_not(spark, d):
    rows = table(spark, d, "documents").where(L.differs("lang", "en") & L.matches_not("source", "src1.*"))
    return rows.where(~F.contains("text", F.lit("http")) & ~F.col("text").rlike("(?i)trash")).select("doc_id", "lang")


@query("SELECT event_id, event_type, props FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 400")
def log_newest_first(spark, d):
    return table(spark, d, "events").where(L.equals("event_type", "error")).orderBy(F.desc("ts"), "event_id").limit(400).select("event_id", "event_type", "props")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def label_values(spark, d):
    return table(spark, d, "events").where(L.one_of("event_type", None)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_TUMBLING = f"ceil({_U} / {HOUR})::BIGINT * {HOUR}"


@query(f"SELECT {_TUMBLING} AS t, count(*) AS value FROM events GROUP BY ALL")
def count_over_time_sum(spark, d):
    counts = V.count_over_time(table(spark, d, "events"), "ts", HOUR, HOUR, BY)
    return V.total(counts, "n", ["t"])


@query(f"SELECT {_TUMBLING} AS t, event_type, count(*) AS n FROM events WHERE regexp_matches(props, '(?i)k') GROUP BY ALL")
def count_over_time_by(spark, d):
    return V.count_over_time(table(spark, d, "events").where(F.col("props").rlike("(?i)k")), "ts", HOUR, HOUR, BY)


@query(f"SELECT event_type, count(*) / 86400.0::DOUBLE AS value FROM events WHERE {_U} > {AT - DAY * 5} AND {_U} <= {AT - DAY * 4} AND contains(props, '\"k\": 1') GROUP BY event_type")
def log_rate_by(spark, d):
    rows = table(spark, d, "events").where(V.in_range("ts", AT - 4 * DAY, DAY) & F.contains("props", F.lit('"k": 1')))
    return rows.groupBy("event_type").agg((F.count(F.lit(1)) / 86400.0).alias("value"))


@query(f"SELECT event_type, count(DISTINCT user_id) AS n FROM events WHERE {_U} > {AT - 7 * DAY} AND {_U} <= {AT} GROUP BY event_type")
def count_by_series(spark, d):
    series = table(spark, d, "events").where(V.in_range("ts", AT, 7 * DAY)).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return series.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, count(*) AS n FROM events WHERE {_U} > {AT - 7 * DAY} AND {_U} <= {AT} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_by(spark, d):
    counts = table(spark, d, "events").where(V.in_range("ts", AT, 7 * DAY)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return V.top(counts, "n", 10, ["user_id"])


@query(f"SELECT t, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, event_type) AS r FROM (SELECT {_TUMBLING} AS t, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 2")
def topk_per_point(spark, d):
    return V.top(V.count_over_time(table(spark, d, "events"), "ts", HOUR, HOUR, BY), "n", 2, BY, per=["t"])


@query(f"SELECT t, event_type, count(*) AS n FROM events, (SELECT unnest(range({START}, {AT + 1}, {HOUR})) AS t) WHERE {_U} > t - {6 * HOUR} AND {_U} <= t GROUP BY ALL")
def grid_overlap(spark, d):
    """Each window from pane sums; see grid_extremes for sums and extremes."""
    return N.over_windows(table(spark, d, "events"), "ts", None, HOUR, 6 * HOUR, START, AT, BY)


@query(f"""SELECT t, event_type, count(*) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events, (SELECT unnest(range({START}, {AT + 1}, {2 * HOUR})) AS t)
WHERE {_U} > t - {5 * HOUR} AND {_U} <= t GROUP BY ALL""")
def grid_extremes(spark, d):
    """A window that is no multiple of the step."""
    out = N.over_windows(table(spark, d, "events"), "ts", "value", 2 * HOUR, 5 * HOUR, START, AT, BY)
    return out.select("t", "event_type", "n", F.round("sum", 4).alias("sum"), "min", "max")


# ---- rules -----------------------------------------------------------------------------------------------------


@query(f"SELECT t, event_type, n, 'WARNING ' || event_type || ': ' || n || ' lines' AS summary FROM (SELECT {_TUMBLING} AS t, event_type, count(*) AS n FROM events WHERE regexp_full_match(event_type, 'error|click') AND regexp_matches(props, '[0-9]') GROUP BY ALL) WHERE n > 4")
def alert_burst(spark, d):
    rows = table(spark, d, "events").where(L.matches("event_type", "error|click") & F.col("props").rlike("[0-9]"))
    hot = V.count_over_time(rows, "ts", HOUR, HOUR, BY).where("n > 4")
    return hot.withColumn("summary", L.template("WARNING {{type}}: {{value}} lines", {"type": F.col("event_type"), "value": F.col("n")}))


def _states(vector: str, over: str, hold: int) -> str:
    return f"""WITH v AS ({vector}), g AS (SELECT DISTINCT event_type FROM v), grid AS (SELECT event_type, unnest(range({START}, {AT + 1}, {HOUR})) AS t FROM g),
    f AS (SELECT grid.t, grid.event_type, coalesce(value {over}, false) AS ok FROM grid LEFT JOIN v USING (event_type, t)),
    i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY t) AS island FROM f),
    s AS (SELECT *, min(t) OVER (PARTITION BY event_type, island) AS since FROM i WHERE ok)
    SELECT t, event_type, CASE WHEN t - since >= {hold} THEN 'firing' ELSE 'pending' END AS state FROM s"""


_COUNTS = f"SELECT {_TUMBLING} AS t, event_type, count(*) AS value FROM events GROUP BY ALL"


@query(_states(_COUNTS, "> 1", 2 * HOUR))
def alert_hold_states(spark, d):
    counts = V.count_over_time(table(spark, d, "events"), "ts", HOUR, HOUR, BY).withColumnRenamed("n", "value")
    return A.states(counts, A.Rule("Burst", over=1, hold=2 * HOUR), HOUR, START, AT, BY).select("t", "event_type", "state")


@query(_states(_COUNTS, "> -1", 0))
def alert_link_canary(spark, d):
    counts = V.count_over_time(table(spark, d, "events"), "ts", HOUR, HOUR, BY).withColumnRenamed("n", "value")
    return A.states(counts, A.Rule("LinkTest", over=-1), HOUR, START, AT, BY).select("t", "event_type", "state")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'pager' ELSE 'chat' END AS receiver FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')")
def alert_routing(spark, d):
    alerts = table(spark, d, "orders").withColumn("alertname", F.col("o_orderpriority"))
    return A.routed(alerts, [("[45]-.*", None), ("1-.*", "pager")], "chat").select("o_orderkey", "receiver")


_BEATS = ["event_type", "user_id"]
_MISSING = f"""beats AS (SELECT event_type, user_id, epoch_us(ts) AS u FROM events), grid AS (SELECT event_type, user_id, unnest(range({START + DAY}, {AT + 1}, {DAY})) AS t FROM (SELECT DISTINCT event_type, user_id FROM beats)),
gaps AS (SELECT event_type, user_id, t FROM grid ANTI JOIN (SELECT DISTINCT event_type, user_id, ceil(u / {DAY})::BIGINT * {DAY} AS t FROM beats) s USING (event_type, user_id, t))"""


def _gaps(spark, d):
    """Every event is a heartbeat of its (event_type, user_id) series; a day without one is a gap."""
    beats = table(spark, d, "events").select(*_BEATS, L.micros("ts").alias("u"))
    return A.missing(beats, "u", _BEATS, DAY, START + DAY, AT)


@query(f"WITH {_MISSING} SELECT event_type, user_id, t FROM gaps")
def deadman_gaps(spark, d):
    return _gaps(spark, d)


@query(f"""WITH {_MISSING}, o AS (SELECT *, t - {DAY} * row_number() OVER (PARTITION BY event_type, user_id ORDER BY t) AS outage FROM gaps),
k AS (SELECT event_type, user_id, t, (t - min(t) OVER (PARTITION BY event_type, user_id, outage)) // {DAY} AS k FROM o) SELECT event_type, user_id, t FROM k WHERE k % 3 = 0""")
def deadman_cooldown(spark, d):
    return A.cooled_down(_gaps(spark, d), _BEATS, DAY, 3 * DAY)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {_U} AS u FROM events WHERE event_type = 'error'), told AS (SELECT user_id, min(u) AS t FROM e GROUP BY user_id
UNION ALL SELECT e.user_id, min(e.u) FROM told JOIN e ON e.user_id = told.user_id AND e.u >= told.t + {12 * HOUR} GROUP BY e.user_id) SELECT user_id, t FROM told""")
def cooldown_emit(spark, d):
    """Greedy from the last told."""
    times = table(spark, d, "events").where(L.equals("event_type", "error")).select("user_id", L.micros("ts").alias("t"))
    return A.emitted(times, "user_id", "t", 12 * HOUR)


@query(f"SELECT greatest(2, least(6, ceil(count(*) / 300.0)))::INT AS replicas FROM events WHERE {_U} > {AT - 7 * DAY} AND {_U} <= {AT}")
def autoscale(spark, d):
    n = table(spark, d, "events").where(V.in_range("ts", AT, 7 * DAY)).agg(F.count(F.lit(1)).alias("n"))
    return n.select(A.replicas(F.col("n"), 300.0, 2, 6).alias("replicas"))


# ---- reports ---------------------------------------------------------------------------------------------------

_MASKED = r"regexp_replace(regexp_replace(regexp_replace(m, '0x[0-9a-fA-F]+', 'X', 'g'), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 'IP', 'g'), '[0-9.]{5,}', 'N', 'g')"


@query(rf"""WITH l AS (SELECT page_id, CASE WHEN regexp_matches(url, '://([^?#]*)') THEN regexp_extract(url, '://([^?#]*)', 1) ELSE left(url, 70) END AS m, url FROM pages),
f AS (SELECT {_MASKED} AS print, page_id, url FROM l) SELECT print, count(*) AS n, arg_min(url, page_id) AS sample FROM f GROUP BY print ORDER BY n DESC, print LIMIT 20""")
def error_fingerprint_topk(spark, d):
    prints = table(spark, d, "pages").select("page_id", "url", P.fingerprint(F.col("url"), "://([^?#]*)").alias("print"))
    counts = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "page_id").alias("sample"))
    return V.top(counts, "n", 20, ["print"])


_KEYWORDS = ["token", "Trash", "license", "moron", "the"]


@query("SELECT CASE " + " ".join(f"WHEN contains(lower(text), '{k.lower()}') THEN '{k}'" for k in _KEYWORDS) + " ELSE 'other' END AS bucket, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY bucket")
def keyword_first_match(spark, d):
    docs = table(spark, d, "documents").select("doc_id", J.first_match(F.col("text"), _KEYWORDS).alias("bucket"))
    return docs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT t, n, repeat('█', least(n // 100 + 1, 40)::INT) AS bar FROM (SELECT ceil({_U} / {DAY})::BIGINT * {DAY} AS t, count(*) AS n FROM events GROUP BY ALL)")
def trend_bars(spark, d):
    counts = V.total(V.count_over_time(table(spark, d, "events"), "ts", DAY, DAY, BY), "n", ["t"], "n")
    return counts.withColumn("bar", L.bar("n"))


@query("SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS percent FROM orders GROUP BY o_orderstatus")
def status_share(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("o_orderstatus", "n", F.round(100.0 * F.col("n") / F.col("whole"), 6).alias("percent"))  # one row


@query("SELECT o_orderpriority AS severity, o_orderstatus AS alertname, count(*) AS n FROM orders GROUP BY ALL ORDER BY ALL")
def alerts_by_severity_name(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("alertname")).agg(F.count(F.lit(1)).alias("n")).orderBy("severity", "alertname")


@query("SELECT o_orderpriority AS job, count(*) FILTER (o_orderstatus = 'O') AS up, count(*) FILTER (o_orderstatus <> 'O') AS down, count(*) AS total, bool_and(o_totalprice > 0) AS ok FROM orders GROUP BY ALL")
def target_health_rollup(spark, d):
    up = F.col("o_orderstatus") == "O"
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("job")).agg(F.count_if(up).alias("up"), F.count_if(~up).alias("down"), F.count(F.lit(1)).alias("total"), F.every(F.col("o_totalprice") > 0).alias("ok"))


@query("""SELECT b.o_custkey, b.v - a.v AS delta FROM (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1) b
JOIN (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) a USING (o_custkey) WHERE b.v > a.v""")
def snapshot_delta(spark, d):
    at = lambda day: table(spark, d, "orders").where(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v"))
    return J.snapshot_delta(at("1998-01-01"), at("2001-01-01"), ["o_custkey"], "v")


@query("SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM part GROUP BY p_type")
def distinct_sorted_list(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("brands"))


@query("SELECT event_type, sum(value) FILTER (user_id % 3 = 0) AS a, sum(value) FILTER (user_id % 3 = 1) AS b, sum(value) FILTER (user_id % 3 = 2) AS c FROM events GROUP BY event_type")
def state_matrix_pivot(spark, d):
    rows = table(spark, d, "events").withColumn("state", F.element_at(F.array(*map(F.lit, "abc")), (F.col("user_id") % 3 + 1).cast("int")))
    return J.matrix(rows, "event_type", "state", ["a", "b", "c"], F.sum("value"))


@query("SELECT event_type, count(*) FILTER (u > moment - 3600000000) AS h1, count(*) FILTER (u > moment - 21600000000) AS h6, count(*) AS d1 FROM (SELECT event_type, epoch_us(ts) AS u, " + str(AT - DAY) + f" AS moment FROM events) WHERE u > moment - {DAY} AND u <= moment GROUP BY event_type")
def windows_in_one_scan(spark, d):
    rows = table(spark, d, "events").where(V.in_range("ts", AT - DAY, DAY))
    within = lambda w: F.count_if(L.micros("ts") > AT - DAY - L.duration(w))
    return rows.groupBy("event_type").agg(within("1h").alias("h1"), within("6h").alias("h6"), F.count(F.lit(1)).alias("d1"))


# ---- samples ---------------------------------------------------------------------------------------------------

_RANGED = f"SELECT event_type, user_id, ts, event_id, value FROM events WHERE {_U} > {AT - 10 * DAY} AND {_U} <= {AT}"
_STEPS = f"SELECT *, value - lag(value) OVER w AS d, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS step FROM ({_RANGED}) WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)"


@query(f"SELECT event_type, user_id, round(sum(step), 6) AS increase FROM ({_STEPS}) GROUP BY ALL HAVING count(*) > 1")
def counter_increase_reset(spark, d):
    out = V.increase(table(spark, d, "events"), ["event_type", "user_id"], "ts", "value", AT, 10 * DAY)
    return out.select("event_type", "user_id", F.round("increase", 6).alias("increase"))


@query(f"SELECT event_type, round(sum(r), 6) AS value FROM (SELECT event_type, user_id, sum(step) / 864000.0 AS r FROM ({_STEPS}) GROUP BY ALL HAVING count(*) > 1) GROUP BY event_type")
def counter_rate_by(spark, d):
    rates = V.increase(table(spark, d, "events"), ["event_type", "user_id"], "ts", "value", AT, 10 * DAY).withColumn("r", F.col("increase") / 864000.0)
    return V.total(rates, "r", BY).select("event_type", F.round("value", 6).alias("value"))


_GRID = f"""WITH e AS (SELECT event_type, epoch_us(ts) AS u, value FROM events), g AS (SELECT unnest(range({START + DAY}, {AT + 1}, {12 * HOUR})) AS t),
w AS (SELECT t, event_type, u, value, CASE WHEN value < lag(value) OVER x THEN value ELSE value - lag(value) OVER x END AS step FROM e, g WHERE u > t - {DAY} AND u <= t WINDOW x AS (PARTITION BY t, event_type ORDER BY u, value)),
f AS (SELECT t, event_type, sum(step) AS d, min(u) AS a, max(u) AS b, arg_min(value, u) AS v, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT *, (b - a)::DOUBLE AS span, (b - a) / (n - 1)::DOUBLE AS mean FROM f),
k AS (SELECT *, CASE WHEN a - (t - {DAY}) < mean * 1.1 THEN a - (t - {DAY}) ELSE mean / 2 END AS l, CASE WHEN t - b < mean * 1.1 THEN t - b ELSE mean / 2 END AS r FROM h)"""


@query(f"{_GRID} SELECT t, event_type, round(d, 4) AS increase, round(d / 86400, 6) AS rate, n FROM k")
def counter_rate_grid(spark, d):
    """``rate`` and ``increase`` as a range query: each day's window, every twelve hours."""
    out = N.rate_on_grid(table(spark, d, "events"), "ts", "value", 12 * HOUR, DAY, START + DAY, AT, BY)
    return out.select("t", "event_type", F.round("increase", 4).alias("increase"), F.round("rate", 6).alias("rate"), "n")


@query(f"{_GRID} SELECT t, event_type, round(d * (span + CASE WHEN d > 0 AND v >= 0 THEN least(l, span * v / d) ELSE l END + r) / span, 6) AS increase FROM k")
def counter_rate_grid_extrapolated(spark, d):
    """From panes of one hour that were joined to twelve hours."""
    fine = N.counter_panes(N.ranged(table(spark, d, "events"), "ts", DAY, START + DAY, AT), "ts", "value", HOUR, BY)
    out = N.counters_on_grid(N.coarser(fine, 12 * HOUR, BY), 12 * HOUR, DAY, START + DAY, AT, BY)
    return out.select("t", "event_type", F.round("extrapolated", 6).alias("increase"))


def _sums(spark, d, i):
    return table(spark, d, "events").where(F.col("user_id") % 3 == i).groupBy("event_type").agg(F.sum("value").alias("value"))


_PART = "(SELECT event_type, sum(value) AS value FROM events WHERE user_id % 3 = {} GROUP BY event_type)"


@query("SELECT event_type, round((1 - a.value / b.value) * 100, 6) AS value FROM (SELECT event_type, count(*) AS value FROM events WHERE value > 20 GROUP BY 1) a JOIN (SELECT event_type, count(*) AS value FROM events GROUP BY 1) b USING (event_type)")
def ratio_one_to_one(spark, d):
    """Both sides read all events; the numerator counts those over a threshold."""
    count = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    return V.ratio(count(table(spark, d, "events").where("value > 20")), count(table(spark, d, "events")), BY).select("event_type", F.round((1 - F.col("value")) * 100, 6).alias("value"))


@query(f"SELECT event_type, round(a.value + b.value + c.value, 6) AS value FROM {_PART.format(0)} a JOIN {_PART.format(1)} b USING (event_type) JOIN {_PART.format(2)} c USING (event_type)")
def three_way_add(spark, d):
    return V.added([_sums(spark, d, i) for i in range(3)], BY).select("event_type", F.round("value", 6).alias("value"))


@query("SELECT event_type, 1 AS value FROM events WHERE event_type = 'nothing' UNION ALL SELECT 'none', 0")
def or_vector_default(spark, d):
    found = table(spark, d, "events").where(L.equals("event_type", "nothing")).select("event_type", F.lit(1).alias("value"))
    return V.otherwise(found, spark.createDataFrame([("none", 0)], "event_type string, value int"), [])


@query("SELECT DISTINCT event_type, 1 AS value FROM events UNION ALL SELECT 'reboot', 0")
def or_by_label(spark, d):
    found = table(spark, d, "events").select("event_type", F.lit(1).alias("value")).distinct()
    return V.otherwise(found, spark.createDataFrame([("reboot", 0), ("error", 0)], "event_type string, value int"), BY)


@query("SELECT 1 AS value FROM (SELECT count(*) AS n FROM events WHERE event_type = 'nothing') WHERE n = 0")
def absent_flag(spark, d):
    return V.absent(table(spark, d, "events").where(L.equals("event_type", "nothing")))


@query(f"SELECT event_type, min({AT} - epoch_us(ts)) AS staleness FROM events GROUP BY event_type")
def min_staleness(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min(AT - L.micros("ts")).alias("staleness"))


def _quantile(q: float, by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH c AS (SELECT {keys}le, sum(n) OVER ({part}ORDER BY le) AS c FROM (SELECT {keys}ceil(l_quantity / 10) * 10 AS le, count(*) AS n FROM lineitem GROUP BY ALL)),
    r AS (SELECT *, lag(c, 1, 0) OVER w AS c0, lag(le, 1, 0) OVER w AS le0, {q} * max(c) OVER (PARTITION BY {by or 1}) AS rank FROM c WINDOW w AS ({part}ORDER BY le))
    SELECT {keys}round(arg_min(le0 + (le - le0) * (rank - c0) / (c - c0), le), 6) AS value FROM r WHERE c >= rank {'GROUP BY ' + by if by else ''}"""


def _buckets(spark, d, by):
    """Cumulative counts of l_quantity at bounds 10 to 50, and +Inf: counted by the least bound, then expanded."""
    least = (F.ceil(F.col("l_quantity") / 10) * 10).cast("double")
    counts = table(spark, d, "lineitem").groupBy(*by, least.alias("least")).agg(F.count(F.lit(1)).alias("n"))
    bounds = F.filter(F.array(*[F.lit(float(x)) for x in range(10, 51, 10)]), lambda b: b >= F.col("least"))
    le = F.explode(F.concat(F.transform(bounds, lambda b: b.cast("string")), F.array(F.lit("+Inf"))))
    return counts.select(*by, le.alias("le"), "n").groupBy(*by, "le").agg(F.sum("n").alias("value"))


@query(_quantile(0.99, ""))
def histogram_quantile_le(spark, d):
    return V.histogram_quantile(0.99, _buckets(spark, d, []), []).select(F.round("value", 6).alias("value"))


@query(_quantile(0.5, "l_returnflag"))
def histogram_quantile_by(spark, d):
    return V.histogram_quantile(0.5, _buckets(spark, d, ["l_returnflag"]), ["l_returnflag"]).select("l_returnflag", F.round("value", 6).alias("value"))


# ---- joins of inventories --------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def mirror_anti_join(spark, d):
    have = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(have, "p_partkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def selector_semi_join(spark, d):
    named = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(named, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT 'small' AS selector, p_partkey FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 'both', p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'")
def selector_containment(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand").alias("labels"))
    selectors = spark.createDataFrame([("small", "type", "SMALL"), ("both", "type", "ECONOMY"), ("both", "brand", "Brand#2")], "selector string, k string, v string")
    return J.selected(parts, "p_partkey", "labels", selectors)


@query("SELECT s_suppkey, n - (s_acctbal > 0)::INT AS healthy, n - (s_acctbal > 0)::INT >= 2 AS quorum FROM supplier JOIN (SELECT s_nationkey, count(*) FILTER (s_acctbal > 0) AS n FROM supplier GROUP BY 1) USING (s_nationkey)")
def peer_quorum(spark, d):
    rows = table(spark, d, "supplier")
    all_of = rows.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 0).alias("n"))
    healthy = F.col("n") - (F.col("s_acctbal") > 0).cast("int")  # all peers but oneself
    return rows.join(all_of, "s_nationkey").select("s_suppkey", healthy.alias("healthy"), (healthy >= 2).alias("quorum"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS before, b.n AS after FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' GROUP BY 1) b ON a.k = b.k")
def before_after(spark, d):
    side = lambda status, skip, name: table(spark, d, "orders").where((F.col("o_orderstatus") == status) & (F.col("o_orderpriority") != skip)).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return side("F", "5-LOW", "before").join(side("O", "1-URGENT", "after"), "k", "full")


# ---- ingestion -------------------------------------------------------------------------------------------------


@query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://.*') AND NOT regexp_full_match(url, '.*/de/.*')")
def relabel_keep_drop(spark, d):
    rules = [{"action": "keep", "source": ["url"], "regex": "https://.*"}, {"action": "drop", "source": ["url"], "regex": ".*/de/.*"}]
    return J.relabelled(table(spark, d, "pages").select("page_id", "url"), rules)


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/.*$', 1) AS instance, 'web' AS job FROM pages")
def relabel_replace(spark, d):
    rules = [{"action": "replace", "source": ["url"], "regex": "https?://([^/]+)/.*", "target": "instance", "replacement": "$1"}, {"action": "replace", "target": "job", "replacement": "web"}]
    return J.relabelled(table(spark, d, "pages").select("page_id", "url"), rules).select("page_id", "instance", "job")


@query("SELECT event_id, event_type AS namespace, 'pod-' || user_id AS pod, 'c' || (event_id % 3) AS container, 'stderr' AS stream, props AS line FROM events")
def cri_parse(spark, d):
    e = table(spark, d, "events")
    path = F.concat(F.lit("/var/log/pods/"), "event_type", F.lit("_pod-"), F.col("user_id").cast("string"), F.lit("_uid/c"), (F.col("event_id") % 3).cast("string"), F.lit("/0.log"))
    raw = e.select("event_id", P.cri(F.concat(F.lit("2024-01-01T00:00:00Z stderr F "), "props")).alias("c"), P.pod_path(path).alias("p"))
    return raw.select("event_id", "p.namespace", "p.pod", "p.container", "c.stream", F.col("c.message").alias("line"))


@query("SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 12")
def last_n_per_series(spark, d):
    return J.last_n(table(spark, d, "events"), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")], 12).select("event_id", "event_type", "user_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3")
def first_k_per_stream(spark, d):
    return J.last_n(table(spark, d, "conversations"), ["conv_id"], [F.asc("turn")], 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def carry_forward_section(spark, d):
    rows = J.carried(table(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "section")
    return rows.select("conv_id", "turn", "section")


@query("SELECT conv_id, turn FROM (SELECT *, max(contains(text, 'the')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM conversations) WHERE near = 1")
def context_rows(spark, d):
    return J.context(table(spark, d, "conversations"), ["conv_id"], "turn", F.contains("text", F.lit("the")), 1, 1).select("conv_id", "turn")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT >= 90")
def props_json_get(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("SELECT 'env=' || p_brand || ',type=' || p_type AS key, count(*) AS n FROM part GROUP BY ALL")
def map_canonical_key(spark, d):
    parts = table(spark, d, "part").select(L.series_key(F.create_map(F.lit("type"), "p_type", F.lit("env"), "p_brand")).alias("key"))
    return parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'hub.local/base/' || split_part(p_name, ' ', 2) AS image FROM part")
def image_inventory(spark, d):
    source = F.concat(F.lit("docker.io/library/"), F.element_at(F.split("p_name", " "), -1), F.lit("@sha256:00"))
    return table(spark, d, "part").select(P.image_name(source, "hub.local", "base").alias("image")).distinct()
