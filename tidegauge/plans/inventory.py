"""Registered queries over nested objects, alerts with flags, selectors and formatted values, each with DuckDB SQL.

Orders stand for pods whose containers are their lines (restarts: quantity; finished: ship date), and for alerts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.operators import objects as O
from tidegauge.operators import vectors as V
from tidegauge.plans.catalogue import AT, BY, DAY, HOUR, query
from tidegauge.sources.tables import table

_RECENT = "TIMESTAMP '2000-01-01'"


def _pods(spark, d):
    """``(pod, containers)``: an object of a few containers each."""
    c = F.struct(F.col("l_linenumber").alias("no"), F.concat(F.lit("c"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("name"), F.col("l_quantity").cast("int").alias("restarts"), F.col("l_returnflag").alias("reason"), F.col("l_shipdate").alias("finished"), F.array("l_partkey", "l_suppkey").alias("ports"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pod")).agg(F.collect_list(c).alias("containers"))


@query("SELECT l_orderkey AS pod, sum(l_quantity::INT)::BIGINT AS restarts, max(l_shipdate) AS latest FROM lineitem GROUP BY 1")
def nested_sum_max(spark, d):
    return _pods(spark, d).select("pod", O.array_sum("containers", "restarts").alias("restarts"), F.array_max("containers.finished").alias("latest"))


@query(f"""SELECT pod, restarts, recent, CASE WHEN recent >= 3 THEN 'HOT' WHEN recent > 0 THEN 'warm' ELSE 'quiet' END AS flag FROM (SELECT l_orderkey AS pod, sum(l_quantity::INT)::BIGINT AS restarts,
count(*) FILTER (l_shipdate >= {_RECENT}) AS recent FROM lineitem GROUP BY 1) ORDER BY restarts DESC, pod LIMIT 20""")
def restart_leaders(spark, d):
    pods = _pods(spark, d).select("pod", O.array_sum("containers", "restarts").alias("restarts"), O.array_count("containers", lambda c: c["finished"] >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("recent"))
    return V.top(pods, "restarts", 20, ["pod"]).withColumn("flag", O.level(F.col("recent"), [(3, "HOT"), (1, "warm")], "quiet"))


@query("SELECT o_orderkey AS pod, count(*) AS quick FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 10 DAY GROUP BY 1")
def quick_terminations(spark, d):
    begun = table(spark, d, "orders").select(F.col("o_orderkey").alias("pod"), "o_orderdate")
    ends = _pods(spark, d).join(begun, "pod")
    quick = O.array_count("containers", lambda c: (c["finished"] >= F.col("o_orderdate")) & (c["finished"] < F.col("o_orderdate") + F.expr("INTERVAL 10 DAY")))
    return ends.select("pod", quick.alias("quick")).where("quick > 0")


@query("SELECT o_orderpriority AS grp, count(*) AS rules, count(DISTINCT l_orderkey) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rules_by_group(spark, d):
    files = _pods(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("pod"), F.col("o_orderpriority").alias("grp")), "pod")
    return files.groupBy("grp").agg(F.sum(F.size("containers")).alias("rules"), F.count(F.lit(1)).alias("files"))


@query("SELECT l_orderkey AS pod, bool_or(l_returnflag = 'R') AS any_reason, coalesce(string_agg('c' || lpad(l_linenumber::TEXT, 2, '0'), ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), '') AS bad, coalesce(string_agg('c' || lpad(l_linenumber::TEXT, 2, '0'), ',' ORDER BY l_linenumber) FILTER (l_returnflag <> 'R'), '') AS good FROM lineitem GROUP BY 1")
def names_in_two_lists(spark, d):
    bad = lambda c: c["reason"] == "R"
    return _pods(spark, d).select("pod", F.exists("containers", bad).alias("any_reason"), O.names("containers", bad).alias("bad"), O.names("containers", lambda c: ~bad(c)).alias("good"))


@query("SELECT l_orderkey AS pod FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A' AND l_quantity::INT > 40)")
def condition_true(spark, d):
    return _pods(spark, d).where(F.exists("containers", lambda c: (c["reason"] == "A") & (c["restarts"] > 40))).select("pod")


@query("SELECT port, count(*) AS n FROM (SELECT l_partkey AS port FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY port")
def ports_of_nested(spark, d):
    each = _pods(spark, d).select(F.explode("containers").alias("c")).where("c.reason = 'R'").select(F.explode("c.ports").alias("port"))
    return each.groupBy("port").agg(F.count(F.lit(1)).alias("n"))


def _alerts(spark, d):
    lists = lambda hit, name: F.when(hit, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("alertname"), lists(status == "F", "s1").alias("silenced_by"), lists(F.col("o_totalprice") < 50_000, "a1").alias("inhibited_by"))


@query("SELECT o_orderkey, o_orderpriority AS alertname, o_orderstatus = 'F' AS silenced, o_totalprice < 50000 AS inhibited, o_orderstatus <> 'F' AND o_totalprice >= 50000 AS active FROM orders")
def alert_list_flags(spark, d):
    return O.alert_flags(_alerts(spark, d)).select("o_orderkey", "alertname", "silenced", "inhibited", "active")


@query("SELECT o_orderkey, o_orderpriority AS alertname FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_totalprice >= 50000")
def one_alert_active(spark, d):
    return O.alert_flags(_alerts(spark, d)).where("alertname = '1-URGENT' AND active").select("o_orderkey", "alertname")


@query("SELECT o_orderkey, 'firing' AS state FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'pending' FROM orders WHERE o_orderstatus = 'P'")
def firing_and_pending(spark, d):
    orders = table(spark, d, "orders")
    of = lambda status, state: orders.where(F.col("o_orderstatus") == status).select("o_orderkey", F.lit(state).alias("state"))
    return of("O", "firing").unionByName(of("P", "pending"))


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'error' AND starts_with(props, '{\"k\": 1')) AND NOT (event_type IN ('click', 'view') AND user_id::TEXT NOT IN ('1', '2', '3'))")
def deny_list(spark, d):
    rows = table(spark, d, "events")
    policies = [[("event_type", "Equal", ["error"]), ("props", "Prefix", ['{"k": 1'])], [("event_type", "Equal", ["click", "view"]), ("user_id", "NotIn", ["1", "2", "3"])]]
    for policy in policies:
        rows = rows.where(~O.denied(rows, policy))
    return rows.select("event_id", "event_type")


def _labels():
    return F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand", F.lit("app.size"), F.col("p_size").cast("string"), F.lit("zone"), F.lit(""))


@query("SELECT unnest(['app.size', 'brand', 'type']) AS label")
def label_names(spark, d):
    named = table(spark, d, "part").select(F.explode(F.map_filter(_labels(), lambda k, v: v != "")).alias("label", "v"))
    return named.select("label").distinct().orderBy("label")


@query("SELECT p_partkey, 'brand=' || p_brand || ',type=' || p_type AS without, 'app.size=' || p_size AS dotted FROM part")
def map_keys(spark, d):
    plain = F.map_filter(_labels(), lambda k, v: ~k.startswith("app.") & (v != ""))
    dotted = F.map_filter(_labels(), lambda k, v: F.contains(k, F.lit("app.")))
    return table(spark, d, "part").select("p_partkey", L.series_key(plain).alias("without"), L.series_key(dotted).alias("dotted"))


@query(f"""WITH b AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events), s AS (SELECT {HOUR} * greatest(1, ceil((z - a) / (50.0 * {HOUR})))::BIGINT AS step FROM b)
SELECT (ceil(epoch_us(ts)::HUGEINT / step) * step)::BIGINT AS t, count(*) AS n FROM events, s GROUP BY 1""")
def auto_interval(spark, d):
    rows = table(spark, d, "events")
    step = V.auto_step(rows, "ts", 50, HOUR)
    return V.on_grid(rows, "ts", step, step).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(count(*) FILTER (event_type = 'error') / count(*), 9) AS value FROM events")
def scalar_over_scalar(spark, d):
    rows = table(spark, d, "events")
    count = lambda x: x.agg(F.count(F.lit(1)).alias("value"))
    return V.scalar_ratio(count(rows.where("event_type = 'error'")), count(rows)).select(F.round("value", 9).alias("value"))


@query(f"""WITH s AS (SELECT event_type, user_id, epoch_us(ts) AS u, value, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS step FROM events
WHERE epoch_us(ts) > {AT - 10 * DAY} AND epoch_us(ts) <= {AT} WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)),
f AS (SELECT event_type, user_id, sum(step) AS d, min(u) AS a, max(u) AS b, arg_min(value, u) AS v, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT *, (b - a)::DOUBLE AS span, (b - a) / (n - 1)::DOUBLE AS mean FROM f),
h AS (SELECT *, CASE WHEN a - {AT - 10 * DAY} < mean * 1.1 THEN a - {AT - 10 * DAY} ELSE mean / 2 END AS l, CASE WHEN {AT} - b < mean * 1.1 THEN {AT} - b ELSE mean / 2 END AS r FROM g)
SELECT event_type, user_id, round(d * (span + CASE WHEN d > 0 AND v >= 0 THEN least(l, span * v / d) ELSE l END + r) / span, 4) AS increase FROM h""")
def counter_increase_extrapolated(spark, d):
    out = V.extrapolated(table(spark, d, "events"), [*BY, "user_id"], "ts", "value", AT, 10 * DAY)
    return out.select("event_type", "user_id", F.round("increase", 4).alias("increase"))


@query("SELECT event_type, min(event_id) AS first, string_agg(props, '' ORDER BY event_id) AS line FROM (SELECT *, sum((k >= 50)::INT) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)) GROUP BY event_type, coalesce(part, 0)")
def cri_partial_lines(spark, d):
    flag = F.when(F.from_json("props", "k int")["k"] >= 50, "F").otherwise("P")
    return O.joined_lines(table(spark, d, "events").withColumn("flag", flag), BY, ["event_id"], "flag", "props", stretch=1024)


@query("""SELECT s_suppkey, CASE WHEN n = 0 THEN 'ok' ELSE concat_ws('|', CASE WHEN n & 1 > 0 THEN 'undervoltage' END, CASE WHEN n & 2 > 0 THEN 'capped' END, CASE WHEN n & 4 > 0 THEN 'throttled' END) END AS state,
CASE WHEN s_acctbal >= 5000 THEN 'high' WHEN s_acctbal >= 0 THEN 'normal' ELSE 'low' END AS level, round(s_acctbal * 1000000 / 1073741824, 3) AS gib FROM (SELECT *, s_nationkey % 8 AS n FROM supplier)""")
def decoded_values(spark, d):
    state = O.bits(F.col("s_nationkey") % 8, ["undervoltage", "capped", "throttled"])
    level = O.level(F.col("s_acctbal"), [(5000, "high"), (0, "normal")], "low")
    return table(spark, d, "supplier").select("s_suppkey", state.alias("state"), level.alias("level"), F.round(F.col("s_acctbal") * 1_000_000 / 1_073_741_824, 3).alias("gib"))


@query("SELECT c_custkey, coalesce(k.kind, 'other') AS kind FROM customer LEFT JOIN (VALUES ('BUILDING', 'own'), ('MACHINERY', 'own'), ('HOUSEHOLD', 'foreign')) k(seg, kind) ON seg = c_mktsegment")
def membership_or_other(spark, d):
    kinds = spark.createDataFrame([("BUILDING", "own"), ("MACHINERY", "own"), ("HOUSEHOLD", "foreign")], "c_mktsegment string, kind string")
    return table(spark, d, "customer").join(F.broadcast(kinds), "c_mktsegment", "left").select("c_custkey", F.coalesce("kind", F.lit("other")).alias("kind"))  # three rows


@query("SELECT DISTINCT image FROM (SELECT p_name AS image FROM part WHERE p_size > 25 UNION ALL SELECT p_name FROM part WHERE p_type = 'SMALL')")
def image_union(spark, d):
    parts = table(spark, d, "part")
    return parts.where("p_size > 25").select(F.col("p_name").alias("image")).unionByName(parts.where("p_type = 'SMALL'").select(F.col("p_name").alias("image"))).distinct()


@query("SELECT c_custkey, 'new' AS origin FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal > 5000")
def upsert_by_key(spark, d):
    rows = table(spark, d, "customer")
    of = lambda hit, origin: rows.where(hit).select("c_custkey", F.lit(origin).alias("origin"))
    return O.upsert(of("c_mktsegment = 'BUILDING'", "old"), of("c_acctbal > 5000", "new"), ["c_custkey"])


@query("""SELECT event_id, k, CASE WHEN k >= 90 THEN 'FAIL' WHEN k >= 70 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT event_id, coalesce(try_cast(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS INT), 0) AS k FROM events)""")
def verdict_with_defaults(spark, d):
    k = F.coalesce(F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("int"), F.lit(0))
    return table(spark, d, "events").select("event_id", k.alias("k")).withColumn("verdict", O.level(F.col("k"), [(90, "FAIL"), (70, "WARN")], "PASS"))


@query("SELECT p_name AS image, bool_or(p_type = 'SMALL') AND bool_or(p_type = 'ECONOMY') AS both, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS found FROM part GROUP BY 1")
def multi_arch_audit(spark, d):
    kinds = table(spark, d, "part").groupBy(F.col("p_name").alias("image")).agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))
    return kinds.select("image", (F.array_contains("kinds", "SMALL") & F.array_contains("kinds", "ECONOMY")).alias("both"), F.array_join("kinds", ",").alias("found"))


@query("WITH c AS (SELECT l_returnflag, l_linestatus, ceil(l_quantity / 10) * 10 AS le, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(n) OVER w AS c FROM c WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY le)), r AS (SELECT *, lag(c, 1, 0) OVER w AS c0, lag(le, 1, 0) OVER w AS le0, 0.9 * max(c) OVER (PARTITION BY l_returnflag, l_linestatus) AS rank FROM s WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY le)) SELECT l_returnflag, l_linestatus, round(arg_min(le0 + (le - le0) * (rank - c0) / (c - c0), le), 6) AS value FROM r WHERE c >= rank GROUP BY ALL")
def histogram_quantile_by_two(spark, d):
    from tidegauge.plans.catalogue import _buckets

    by = ["l_returnflag", "l_linestatus"]
    return V.histogram_quantile(0.9, _buckets(spark, d, by), by).select(*by, F.round("value", 6).alias("value"))


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%part 1%' AND lower(p_type) LIKE '%small%') OR lower(p_brand) LIKE '%#2%'")
def two_field_search(spark, d):
    has = lambda column, text: F.lower(column).contains(text)
    return table(spark, d, "part").where((has("p_name", "part 1") & has("p_type", "small")) | has("p_brand", "#2")).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 4 <> l_suppkey % 4")
def columns_differ(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_partkey") % 4 != F.col("l_suppkey") % 4).select("l_orderkey", "l_linenumber")


@query("""SELECT pod, string_agg(tag, ',' ORDER BY tag) FILTER (r <= 5) AS tags FROM (SELECT pod, tag, row_number() OVER (PARTITION BY pod ORDER BY tag DESC) AS r FROM
(SELECT DISTINCT l_orderkey AS pod, '8.' || lpad(l_partkey::TEXT, 8, '0') AS tag FROM lineitem WHERE l_returnflag <> 'A')) GROUP BY 1""")
def last_five_tags(spark, d):
    tag = F.concat(F.when(F.col("l_returnflag") == "A", "7.").otherwise("8."), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))
    tags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pod")).agg(F.array_sort(F.collect_set(tag)).alias("tags"))
    kept = O.last(F.filter("tags", lambda t: t.startswith("8.")), 5)
    return tags.select("pod", kept.alias("kept")).where(F.size("kept") > 0).select("pod", F.array_join("kept", ",").alias("tags"))


@query("SELECT l_orderkey AS node, 'd' || l_linenumber AS disk, sum(l_partkey)::BIGINT AS spec, coalesce(sum(l_suppkey) FILTER (l_returnflag = 'R'), 0)::BIGINT AS status FROM lineitem GROUP BY ALL")
def disks_with_status(spark, d):
    told = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).cast("long")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_partkey").cast("long").alias("part"), told.alias("supp"))
    disk = F.concat(F.lit("d"), F.col("l_linenumber").cast("string"))
    of = lambda value, hit: F.map_from_entries(F.filter(F.collect_list(F.when(hit, F.struct(disk, value))), lambda e: e.isNotNull()))
    nodes = lines.groupBy(F.col("l_orderkey").alias("node")).agg(of("part", F.lit(True)).alias("spec"), of("supp", F.col("supp").isNotNull()).alias("status"))
    return nodes.select("node", F.explode(O.with_entry(F.col("spec"), F.col("status"), F.lit(0).cast("long"))).alias("e")).select("node", F.col("e.key").alias("disk"), "e.spec", "e.status")


@query("SELECT user_id, count(DISTINCT event_type) AS seen, round((max(value) - min(value)) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 9) AS per_second FROM events GROUP BY 1")
def sampled_distinct(spark, d):
    took = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    slope = F.try_divide(F.max("value") - F.min("value"), took / 1_000_000)
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("seen"), F.round(slope, 9).alias("per_second"))


@query("SELECT p_partkey, size FROM (SELECT p_partkey, p_size || CASE p_partkey % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'M' ELSE '' END AS size, p_size * CASE p_partkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE 1 END AS b FROM part) ORDER BY b DESC, p_partkey LIMIT 20")
def largest_by_size_text(spark, d):
    unit = F.when(F.col("p_partkey") % 3 == 0, "K").when(F.col("p_partkey") % 3 == 1, "M").otherwise("")
    sizes = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("size"))
    return V.top(sizes.withColumn("b", O.size_bytes(F.col("size"))), "b", 20, ["p_partkey"]).select("p_partkey", "size")


@query("SELECT event_id, strftime(ts, '%m-%d %H:%M:%S') AS short, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain FROM events")
def time_texts(spark, d):
    started = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, d, "events").select("event_id", F.date_format("ts", "MM-dd HH:mm:ss").alias("short"), F.translate(F.left(started, F.lit(19)), "T", " ").alias("plain"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'vip=' || s_nationkey ELSE '' END AS kept, s_nationkey = 7 AS mentioned FROM supplier WHERE s_acctbal > 0 OR s_nationkey < 10""")
def annotations_by_substring(spark, d):
    notes = F.create_map(F.when(F.col("s_acctbal") > 0, "net/vip").otherwise("net/name"), F.col("s_nationkey").cast("string"))
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", notes.alias("notes"))
    kept = F.map_filter("notes", lambda k, v: k.contains("vip") | k.contains("lb"))
    text = F.array_join(F.transform(F.map_values("kept"), lambda v: F.concat(F.lit("vip="), v)), ",")
    out = rows.withColumn("kept", kept).where((F.size("kept") > 0) | (F.col("s_nationkey") < 10))
    return out.select("s_suppkey", text.alias("kept"), F.to_json("notes").contains('":"7"').alias("mentioned"))
