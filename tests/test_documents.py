"""JSON documents in texts, as VARIANT, and their differences."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.plans import documents
from tidegauge.sources import documents as D
from tidegauge.sources import tables as S

TEXT = '{"a": 1}{"b": {"c": "}{"}}\n{"d": "\\"}\\\\"}  {"e": [1, {"f": {}}]}\n\n{"g":\n "x\n{"\n}'


@pytest.mark.parametrize("size", ["1g", "7b", "40b"])
def test_documents_over_splits(spark, tmp_path, size):
    long = "".join(json.dumps({"i": i, "s": "{" * (i % 5) + '"\\' * (i % 3), "n": {"x": [i] * (i % 4)}}) + " \n"[: i % 3] for i in range(60))
    (tmp_path / "a.txt").write_text(TEXT + " \n")
    (tmp_path / "b.txt").write_text(long)
    (tmp_path / "c.txt").write_text('}{"ok": 1} oops {"bad": 1}{"ok": 2}} {"ok": 3}{"open": {"x": 1}')
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.txt").write_text(" \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        pieces = D.chunks(spark, str(tmp_path / "*.txt"))
        if size != "1g":
            assert pieces.select("file", "block").distinct().count() > 8
        got = {}
        for r in D.documents(pieces).select("file", "n", "text", F.to_json("doc").alias("doc")).orderBy("file", "n").collect():
            got.setdefault(r.file[-5], []).append((r.text, r.doc))
        read = lambda f: [json.loads(doc) for _, doc in got[f] if doc is not None]
        assert [json.loads(t, strict=False) for t, _ in got["a"]] == [{"a": 1}, {"b": {"c": "}{"}}, {"d": '"}\\'}, {"e": [1, {"f": {}}]}, {"g": "x\n{"}]
        assert read("b") == [json.loads(x) for x in [json.dumps({"i": i, "s": "{" * (i % 5) + '"\\' * (i % 3), "n": {"x": [i] * (i % 4)}}) for i in range(60)]]
        assert read("c") == [{"ok": 1}, {"ok": 2}, {"ok": 3}]
        assert [t.strip() for t, doc in got["c"] if doc is None] == ["}", 'oops {"bad": 1}', "}", '{"open": {"x": 1}']
        assert "d" not in got and "e" not in got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_new_files_come_as_a_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for k, text in enumerate(('{"a": 1}{"a": 2}', '{"a": 3}\n{"a"', '{"a": {"b": "}"}} x')):
        (tmp_path / "in" / f"{k}.json").write_text(text)
        D.append_documents(spark, source, out, state)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.doc for r in rows if r.doc) == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":{"b":"}"}}'] and sorted(r.text.strip() for r in rows if not r.doc) == ["x", '{"a"']


def variants(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "i int, value string")


def test_process_events(spark):
    lines = variants(spark, {"process_exec": {"process": {"binary": "/bin/sh", "arguments": "-c x", "pod": {"namespace": "a", "name": "p"}}}, "node_name": "n1"}, {"process_kprobe": {"process": {"binary": 7}, "function_name": "open"}}, {"process_exit": "odd"}, {"other": 1}, "no json", "")
    got = [tuple(r) for r in D.process_events(lines).collect()]
    assert got == [("process_exec", "n1", "/bin/sh", "-c x", "a", "p", None), ("process_kprobe", None, "7", None, None, None, "open"), ("process_exit", None, None, None, None, None, None), *[(None,) * 7] * 3]


def test_pods_with_missing_and_mixed_fields(spark):
    docs = variants(spark,
        {"metadata": {"namespace": "a", "name": "p"}, "status": {"containerStatuses": [{"name": "c1", "restartCount": 3, "lastState": {"terminated": {"reason": "OOMKilled", "finishedAt": "2024-01-01T00:00:00Z"}}}, {"name": "c2", "restartCount": "many", "lastState": {}}]}},
        {"metadata": {"name": "q"}, "status": {"containerStatuses": None}}, {"metadata": "odd", "status": {"containerStatuses": {"no": "list"}}}, [], {"metadata": {"namespace": "b", "name": "r"}, "status": {"containerStatuses": [{"name": "c3", "lastState": {"terminated": {"finishedAt": "yesterday"}}}]}},
    ).select(F.try_parse_json("value").alias("doc"))
    rows = S.containers(D.pod_objects(docs)).collect()
    assert [(r.namespace, r.pod, r.container, r.restarts, r.reason, r.finished_at is not None) for r in rows] == [("a", "p", "c1", 3, "OOMKilled", True), ("a", "p", "c2", None, None, False), ("b", "r", "c3", None, None, False)]


def test_rules_of_nested_groups(spark):
    docs = variants(spark, {"groups": [{"name": "g1", "rules": [{"name": "r1", "type": "alerting", "state": "firing", "health": "ok"}, {"name": "r2", "lastError": "x"}]}, {"name": "g2", "rules": []}, {"name": "g3"}, 5]}, {"groups": {}}, {}).select(F.try_parse_json("value").alias("doc"))
    assert [tuple(r) for r in D.rule_rows(docs).collect()] == [("g1", "r1", "alerting", "firing", "ok", None), ("g1", "r2", None, None, None, "x")]


def test_differences_by_path(spark):
    before = variants(spark, {"a": 1, "b": {"c": [1, 2], "d.e": None, "it's": 1}, "same": "x", "e": {}}, {"only": 1}, None or "null").select("i", F.try_parse_json("value").alias("doc"))
    after = variants(spark, {"same": "x", "b": {"c": [1, 3, 4], "d.e": 5, "it's": 1}, "a": "1", "e": []}, {}, "null").select("i", F.try_parse_json("value").alias("doc"))
    rows = D.difference(D.leaves(before, ["i"]), D.leaves(after, ["i"]), ["i"]).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        (0, "$.a", "changed", "1", '"1"'), (0, "$.b.c[1]", "changed", "2", "3"), (0, "$.b.c[2]", "added", None, "4"), (0, "$.b['d.e']", "changed", "null", "5"), (0, "$.e", "changed", "{}", "[]"),
        (1, "$.only", "removed", "1", None), (1, "$", "added", None, "{}"),
    ], key=str)
    assert {r.path: r.value for r in D.leaves(before.where("i = 0"), ["i"], 1).collect()}["$.b"] == '{"c":[1,2],"d.e":null,"it\'s":1}'


def test_snapshot_drops_malformed_lines_for_any_columns(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ns|x|1|-1.0\nbad line\nns|y|4|2.5\nns|y|4|2.5|more\nns|z|many|1\n|||\n")
    a = S.snapshot(spark, str(tmp_path / "a.txt"))
    assert a.count() == 2 and [r.ns for r in a.select("ns").collect()] == ["ns", "ns"] and a.schema.simpleString() == "struct<ns:string,name:string,restarts:int,minutes_ago:double>"
    S.write_snapshot(a, str(tmp_path / "b"))
    assert sorted(map(tuple, S.snapshot(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, a.collect()))
    with pytest.raises(Exception, match="bar"):
        S.write_snapshot(a.withColumn("name", F.lit("a|b")), str(tmp_path / "c"))


def test_long_values_are_encoded_in_one_line(spark, tmp_path):
    import base64

    urls = {k: c * n for k, (c, n) in enumerate([("u", 57), ("u", 58), ("v", 200), ("é", 40), ("u", 0)])}
    spark.createDataFrame([(k, u) for k, u in urls.items()] + [(9, None)], "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.coded for r in documents.encoded_values(spark, str(tmp_path)).collect()}
    assert got == {k: base64.b64encode(u.encode()).decode() for k, u in urls.items()}
