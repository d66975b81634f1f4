"""Registered queries over JSON documents, listings, reports and folders, each with DuckDB SQL.

Texts are made from the driver's tables by Spark, written to the shared folder, and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.functions import lines as P
from tidegauge.operators import folders as U
from tidegauge.operators import vectors as V
from tidegauge.plans.catalogue import AT, query
from tidegauge.sources import documents as D
from tidegauge.sources import listings as T
from tidegauge.sources.shared import shared_folder
from tidegauge.sources.tables import containers, snapshot, table, write_snapshot


@query("SELECT (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def concatenated_documents(spark, d):
    """All props one after the other, many in a line, taken apart again."""
    at = shared_folder(spark, "texts")
    table(spark, d, "events").select("props").write.option("lineSep", " ").text(at)
    return D.documents(D.chunks(spark, at)).groupBy(D.field("doc", "$.k", "int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


_KINDS = {"click": "process_exec", "error": "process_exit", "view": "process_kprobe"}


@query("SELECT CASE event_type WHEN 'click' THEN 'process_exec' WHEN 'error' THEN 'process_exit' WHEN 'view' THEN 'process_kprobe' END AS kind, 'ns' || user_id % 4 AS namespace, count(*) AS n, max('/bin/' || user_id) AS binary FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), NULL FROM events WHERE event_type NOT IN ('click', 'error', 'view')")
def process_event_kinds(spark, d):
    """Events as JSON lines of a process-event stream; other kinds are counted too."""
    process = F.struct(F.concat(F.lit("/bin/"), F.col("user_id").cast("string")).alias("binary"), F.struct(F.concat(F.lit("ns"), (F.col("user_id") % 4).cast("string")).alias("namespace")).alias("pod"))
    lines = F.to_json(F.struct(*[F.when(F.col("event_type") == e, F.struct(process.alias("process"))).alias(k) for e, k in _KINDS.items()]))
    events = D.process_events(table(spark, d, "events").select(lines.alias("value")))
    return events.groupBy("kind", "namespace").agg(F.count(F.lit(1)).alias("n"), F.max("binary").alias("binary"))


@query("SELECT l_orderkey::TEXT AS pod, 'c' || l_linenumber AS container, l_quantity::INT AS restarts, CASE WHEN l_returnflag = 'R' THEN 'OOMKilled' END AS reason FROM lineitem")
def pod_containers_json(spark, d):
    """Pods as JSON documents, read as VARIANT; a container that never ended has no ``terminated``."""
    ended = F.when(F.col("l_returnflag") == "R", F.struct(F.lit("OOMKilled").alias("reason"), F.col("l_shipdate").cast("string").alias("finishedAt")))
    state = F.struct(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_quantity").cast("int").alias("restartCount"), F.struct(ended.alias("terminated")).alias("lastState"))
    pods = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(state).alias("states"))
    docs = pods.select(F.to_json(F.struct(F.struct(F.col("l_orderkey").cast("string").alias("name")).alias("metadata"), F.struct(F.col("states").alias("containerStatuses")).alias("status"))).alias("value"))
    return containers(D.pod_objects(docs.select(F.try_parse_json("value").alias("doc")))).select("pod", "container", "restarts", "reason")


@query("SELECT o_orderstatus AS grp, CASE WHEN o_totalprice > 150000 THEN 'firing' ELSE 'inactive' END AS state, count(*) AS n, max('r' || o_orderkey) AS last FROM orders GROUP BY ALL")
def rules_document(spark, d):
    """A rules document ``{groups: [{name, rules}]}`` for each customer."""
    rule = F.struct(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_totalprice") > 150_000, "firing").otherwise("inactive").alias("state"))
    groups = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("name")).agg(F.collect_list(rule).alias("rules"))
    docs = groups.groupBy("o_custkey").agg(F.collect_list(F.struct("name", "rules")).alias("groups")).select(F.try_parse_json(F.to_json(F.struct("groups"))).alias("doc"))
    return D.rule_rows(docs).groupBy("grp", "state").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("last"))


@query("""WITH u AS (SELECT user_id, arg_min(props, event_id) AS a, arg_max(props, event_id) AS b, arg_min(event_type, event_id) AS x, arg_max(event_type, event_id) AS y FROM events GROUP BY 1)
SELECT user_id, '$.spec.k' AS path, 'changed' AS change, a->>'$.k' AS before, b->>'$.k' AS after FROM u WHERE a->>'$.k' <> b->>'$.k'
UNION ALL SELECT user_id, '$.' || x, 'removed', '1', NULL FROM u WHERE x <> y UNION ALL SELECT user_id, '$.' || y, 'added', NULL, '1' FROM u WHERE x <> y""")
def document_difference(spark, d):
    """Each user's first and last event as documents, and the paths in which they differ."""
    events = table(spark, d, "events")

    def side(pick):
        one = events.groupBy("user_id").agg(pick(F.struct("props", "event_type"), F.col("event_id")).alias("e"))
        text = F.concat(F.lit('{"spec": '), "e.props", F.lit(', "'), "e.event_type", F.lit('": 1}'))
        return D.leaves(one.select("user_id", F.try_parse_json(text).alias("doc")), ["user_id"], 3)

    return D.difference(side(F.min_by), side(F.max_by), ["user_id"])


@query("SELECT p_brand AS brand, count(*) AS n, sum(p_size)::BIGINT AS size, count(*) FILTER (p_partkey % 3 = 0) AS empty FROM part GROUP BY 1")
def listing_columns(spark, d):
    """Parts as a fixed-width report with empty cells, read back by its blanks."""
    at = shared_folder(spark, "listing")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("p_type"), "p_size")
    T.report(parts, ["p_name", "p_brand", "p_type", "p_size"], ["p_partkey"]).coalesce(1).write.text(at)  # a report is one text
    rows = T.cells(T.read_lines(spark, at)).select(T.cell("p_brand").alias("brand"), T.cell("p_type").alias("type"), T.cell("p_size").cast("int").alias("size"))
    return rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.count_if(F.col("type") == "").alias("empty"))


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-z]*://([^?#]*)', 1) AS path, length(html) AS bytes FROM pages WHERE url LIKE '%://%'), s AS (SELECT string_split(rtrim(regexp_replace(path, '/+', '/', 'g'), '/'), '/') AS s, bytes FROM p)
SELECT array_to_string(s[1:k], '/') AS folder, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM s, range(0, len(s)) t(k) GROUP BY 1""")
def folder_use(spark, d):
    """Pages as files of their html's length, rolled up into hosts and folders."""
    pages = table(spark, d, "pages").where(F.col("url").contains("://"))
    found = pages.select(F.regexp_extract("url", "^[a-z]*://([^?#]*)", 1).alias("path"), F.char_length("html").alias("bytes"))
    return U.folder_sizes(found)


@query("SELECT s_name AS name, s_nationkey AS restarts FROM supplier")
def snapshot_round_trip(spark, d):
    """Written as lines with bars and read back; only two columns are asked for."""
    at = shared_folder(spark, "snapshot")
    rows = table(spark, d, "supplier").select(F.lit("ns").alias("ns"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("restarts"), F.lit(-1.0).alias("minutes_ago"))
    write_snapshot(rows, at)
    return snapshot(spark, at).select("name", "restarts")


@query("SELECT page_id, regexp_extract(url, '(error|warn|page)s?/?([0-9]*)', 0) AS whole, url_encode(url) AS encoded, to_base64(url::BLOB) AS coded FROM pages WHERE url IS NOT NULL")
def encoded_values(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").where(url.isNotNull()).select("page_id", P.found(url, "(error|warn|page)s?/?([0-9]*)").alias("whole"), L.percent_encoded(url).alias("encoded"), L.base64_text(url.cast("binary")).alias("coded"))


@query("""SELECT l_orderkey AS pod, string_agg(p, ',' ORDER BY p) AS ports FROM (SELECT DISTINCT l_orderkey, (8000 + l_suppkey % 50) || ':' || l_partkey % 90 || CASE WHEN l_returnflag = 'R' THEN '/udp' ELSE '' END AS p
FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1""")
def port_texts(spark, d):
    key = F.concat((F.col("l_partkey") % 90).cast("string"), F.when(F.col("l_returnflag") == "R", "/udp").when(F.col("l_returnflag") == "A", "/tcp").otherwise(""))
    bound = F.struct(F.when(F.col("l_linestatus") == "O", (8000 + F.col("l_suppkey") % 50).cast("string")).alias("HostPort"))
    binds = table(spark, d, "lineitem").groupBy("l_orderkey", key.alias("key")).agg(F.collect_list(bound).alias("value"))
    pods = binds.groupBy(F.col("l_orderkey").alias("pod")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("bindings"))
    return pods.select("pod", F.array_join(P.port_bindings(F.col("bindings")), ",").alias("ports")).where("ports <> ''")


@query("SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus = 'F') AS last_f, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_custkey)")
def last_known_and_total(spark, d):
    """The last value that isn't null of each series in order, and totals with the total over all."""
    known = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return table(spark, d, "orders").rollup("o_custkey").agg(V.last_known(known, F.col("o_orderkey")).alias("last_f"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_partkey, 'A=' || p_brand || ',B=x=' || p_type AS kept FROM part")
def env_blocklist(spark, d):
    env = F.array(*[F.concat(F.lit(k), c) for k, c in (("PATH=", "p_name"), ("B=x=", "p_type"), ("HOSTNAME=", "p_name"), ("A=", "p_brand"))], F.lit("TERM"))
    return table(spark, d, "part").select("p_partkey", F.array_join(P.variables(env, ["PATH", "HOSTNAME", "HOME", "TERM"]), ",").alias("kept"))


@query("SELECT DISTINCT 'hub/' || replace(p_name, ' ', '-') AS image FROM part")
def manifest_images(spark, d):
    """Image names scraped from rendered manifests."""
    text = F.concat(F.lit('kind: Pod\n  - image: "hub/'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('"\n    name: x\n  - image: $IMAGE\n'))
    return table(spark, d, "part").select(F.explode(P.images(text)).alias("image")).distinct()


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type)
SELECT user_id, 'totalSeries' AS what, 0 AS place, NULL AS name, sum(n)::BIGINT AS value FROM c GROUP BY 1 UNION ALL SELECT user_id, 'seriesCountByMetricName', r, event_type, n FROM c WHERE r <= 3""")
def store_status(spark, d):
    """A status document for each user, with its totals and the longest of its lists."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("event_type").alias("name"), F.col("n").alias("value"))))
    docs = counts.groupBy("user_id").agg(entry.alias("e"), F.sum("n").alias("totalSeries"))
    names = F.transform("e", lambda x: F.struct(x["name"], x["value"])).alias("seriesCountByMetricName")
    return D.store_status(docs.select("user_id", F.try_parse_json(F.to_json(F.struct(F.struct("totalSeries", names).alias("data")))).alias("doc")), ["user_id"])


@query("SELECT l_orderkey::TEXT AS pod, 'img' || l_suppkey AS image FROM lineitem WHERE l_returnflag <> 'A' AND l_partkey % 100 = 7")
def pods_on_host_port(spark, d):
    ports = F.when(F.col("l_returnflag") != "A", F.array(F.struct((F.col("l_partkey") % 100).alias("hostPort"))))
    container = F.struct(F.concat(F.lit("img"), F.col("l_suppkey").cast("string")).alias("image"), ports.alias("ports"))
    pods = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(container).alias("containers"))
    docs = pods.select(F.try_parse_json(F.to_json(F.struct(F.struct(F.col("l_orderkey").cast("string").alias("name")).alias("metadata"), F.struct("containers").alias("spec")))).alias("doc"))
    return D.host_ports(docs).where("host_port = 7").select("pod", "image")


@query("SELECT o_custkey, count(*)::INT AS rules FROM orders GROUP BY 1")
def rules_in_groups(spark, d):
    """The lengths of all groups' rule lists in each object."""
    groups = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_list("o_orderkey").alias("rules"))
    docs = groups.groupBy("o_custkey").agg(F.collect_list(F.struct("rules")).alias("groups"))
    return docs.select("o_custkey", D.rule_count(F.try_parse_json(F.to_json(F.struct(F.struct("groups").alias("spec"))))).alias("rules"))


@query("SELECT CASE WHEN p_size % 3 = 0 THEN p_brand || ' N' WHEN p_size % 3 = 1 THEN '.' ELSE left('plain text of ' || p_name || ' and then some more that is cut off', 50) END AS key, count(*) AS n FROM part GROUP BY 1")
def error_keys(spark, d):
    """A name from the line, else a mark, else the line's beginning."""
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("errors: 2 "), "p_brand", F.lit(" 123456: x"))).when(F.col("p_size") % 3 == 1, F.lit("lookup of . NS: failed")).otherwise(F.concat(F.lit("plain text of "), "p_name", F.lit(" and then some more that is cut off")))
    return table(spark, d, "part").select(P.error_key(line).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS starts_at FROM orders ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 100")
def tuples_descending(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("starts_at"))
    return rows.orderBy(F.desc("o_orderpriority"), F.desc("o_orderstatus"), F.desc("o_orderkey")).limit(100)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS starts_at FROM orders ORDER BY 2 DESC, 1 LIMIT 50")
def latest_by_time_text(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("starts_at"))
    return V.top(rows, "starts_at", 50, ["o_orderkey"])


@query("SELECT l_returnflag, l_linestatus, l_linenumber, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL")
def sum_by_three(spark, d):
    by = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return V.total(table(spark, d, "lineitem"), "l_quantity", by).withColumn("value", F.round("value", 2))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), '-') AS mark, coalesce(try_cast(regexp_extract(url, '([0-9]+)$', 1) AS DOUBLE), 0.0) AS number, length(html) // 3600 || 'h' AS age,
regexp_replace(url, '/(en|de)/', '/[\1]/', 'g') AS rewritten, replace(url, '://', ':') AS plain, CASE WHEN length(html) % 2 = 0 THEN (length(html) // 2)::TEXT ELSE (length(html) // 2) || '.5' END AS half FROM pages""")
def value_texts(spark, d):
    """Defaults, numbers, whole numbers, back-references and literal replacement."""
    url, size = F.col("url"), F.char_length("html").cast("long")
    hours = F.floor(size * L.duration("1s") / L.duration("1h")).cast("string")
    return table(spark, d, "pages").select(
        "page_id", L.default(F.regexp_extract(url, "#(.*)$", 1), "-").alias("mark"), L.number(F.regexp_extract(url, "([0-9]+)$", 1)).alias("number"), F.concat(hours, F.lit("h")).alias("age"),
        F.regexp_replace(url, "/(en|de)/", "/[$1]/").alias("rewritten"), F.replace(url, F.lit("://"), F.lit(":")).alias("plain"), L.whole(size / 2).alias("half"),
    )


@query("SELECT p_partkey, 'app=' || p_brand || ',size=' || p_size || ',type=' || p_type AS labels, '''' || p_name || ': it''''s''' AS scalar FROM part")
def merged_labels(spark, d):
    """Static labels under a row's own, and scalars in quotes."""
    static = F.create_map(F.lit("app"), F.lit("none"), F.lit("type"), "p_type")
    own = F.create_map(F.lit("app"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", L.series_key(L.merged(static, own)).alias("labels"), P.yaml_scalar(F.concat("p_name", F.lit(": it's"))).alias("scalar"))


@query("SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_extendedprice) FILTER (l_discount > 0.05), 0) / nullif(coalesce(sum(l_quantity) FILTER (l_linenumber > 3), 0), 0), 6) AS value FROM lineitem GROUP BY ALL")
def guarded_ratio(spark, d):
    by = ["l_returnflag", "l_linestatus"]
    of = lambda c, hit: table(spark, d, "lineitem").groupBy(*by).agg(F.coalesce(F.sum(F.when(F.expr(hit), F.col(c))), F.lit(0.0)).alias("value"))
    return V.ratio(of("l_extendedprice", "l_discount > 0.05"), of("l_quantity", "l_linenumber > 3"), by).select(*by, F.round("value", 6).alias("value"))


@query("SELECT event_id, split_part(props, ' ', 2) AS second, strftime(ts, '%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000 // 1000)::TEXT, 3, '0') AS clock FROM events")
def fields_and_clock(spark, d):
    """A field by position, as column-wise text tools count, and a time of day from nanoseconds."""
    return table(spark, d, "events").select("event_id", P.nth(F.col("props"), 2).alias("second"), L.clock(L.micros("ts") * 1000).alias("clock"))


@query("""SELECT 'job' || o_custkey % 7 AS job, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS up, min(left(CASE WHEN o_orderstatus = 'F' THEN 'timed out after ' || o_totalprice::INT ELSE '' END, 60)) FILTER (o_orderstatus <> 'O') AS error
FROM orders GROUP BY 1""")
def targets_document(spark, d):
    """A targets document for each customer; a target that is up has no error."""
    error = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("timed out after "), F.round("o_totalprice").cast("int").cast("string")))
    target = F.struct(F.struct(F.concat(F.lit("job"), (F.col("o_custkey") % 7).cast("string")).alias("job")).alias("labels"), F.when(F.col("o_orderstatus") == "O", "up").otherwise("down").alias("health"), error.alias("lastError"))
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(target).alias("activeTargets"))
    found = D.targets(docs.select(F.try_parse_json(F.to_json(F.struct(F.struct("activeTargets").alias("data")))).alias("doc")))
    up = F.col("health") == "up"
    return found.groupBy("job").agg(F.count(F.lit(1)).alias("total"), F.count_if(up).alias("up"), F.min(F.when(~up, F.col("last_error"))).alias("error"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN (p_size * 40)::DOUBLE END AS iops, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 90)::DOUBLE + 0.5::DOUBLE END AS p999,
CASE WHEN p_partkey % 5 <> 0 AND p_size * 40 >= 1000 AND p_partkey % 7 <> 0 AND p_partkey % 90 + 0.5 <= 50 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM part""")
def disk_benchmarks(spark, d):
    """A benchmark's text for each part, some without one value or the other."""
    iops = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("  write: IOPS="), (F.col("p_size") * 40).cast("string"), F.lit(", BW=1"))).otherwise("  write: none")
    told = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit(" | 99.90th="), (F.col("p_partkey") % 90).cast("string"), F.lit(".5"))).otherwise(" |")
    text = F.concat(iops, F.lit("\n 99.90th=7\n  fsync/fdatasync/sync_file_range:\n    min=1\n"), told, F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", P.disk_benchmark(text).alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hub' END AS registry, CASE p_partkey % 3 WHEN 0 THEN 'base/' || p_brand WHEN 1 THEN 'hub/base/' || p_brand ELSE 'hub/x/' || p_brand END AS repository FROM part""")
def image_homes(spark, d):
    kind = F.col("p_partkey") % 3
    registry = F.when(kind == 0, "docker.io")
    repository = F.concat(F.when(kind == 2, "hub/x/").otherwise("library/a/"), "p_brand", F.when(kind == 1, "/").otherwise(""))
    return table(spark, d, "part").select("p_partkey", P.image_home(registry, repository, "hub", "base").alias("i")).select("p_partkey", "i.*")


@query("SELECT p_partkey, 'net: a' || chr(10) || '  external: true' || chr(10) || 'net: ' || p_brand || chr(10) || '  external: true' || chr(10) AS text FROM part")
def lines_added_where_missing(spark, d):
    """A line after each that it doesn't follow yet: a look-ahead and a back-reference, line by line."""
    text = F.concat(F.lit("net: a\n"), F.when(F.col("p_partkey") % 2 == 0, "  external: true\n").otherwise(""), F.lit("net: "), "p_brand", F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(text, r"(?m)(^net: [^\n]*\n)(?!  external: true)", "$1  external: true\n").alias("text"))


@query("SELECT event_type AS Pod, count(*) AS Status, round((1706659200000000 - max(epoch_us(ts))) / 60000000.0, 6) AS minutes, CASE WHEN event_type = 'view' THEN -1.0 ELSE round((1706659200000000 - min(epoch_us(ts))) / 3600000000.0, 6) END AS hours FROM events GROUP BY 1")
def promoted_columns(spark, d):
    """A label of a series' map as a column, renamed and put in order; how long ago the last and first rows were."""
    series = table(spark, d, "events").select(F.create_map(F.lit("pod"), "event_type", F.lit("job"), F.lit("x")).alias("labels"), L.micros("ts").alias("u"))
    rows = series.groupBy(F.col("labels")["pod"].alias("Pod")).agg(F.count(F.lit(1)).alias("Status"), F.max("u").alias("last"), F.min("u").alias("first"))
    first = F.when(F.col("Pod") != "view", F.col("first"))
    return rows.select("Pod", "Status", F.round(P.since(F.col("last"), AT, L.duration("1m")), 6).alias("minutes"), F.round(P.since(first, AT, L.duration("1h"), -1.0), 6).alias("hours"))
