"""Listings, reports and disk use."""

import os

from pyspark.sql import functions as F

from tidegauge.operators import folders
from tidegauge.operators import vectors as V
from tidegauge.sources import listings as T

PODS = """NAMESPACE     NAME                 READY   STATUS    AGE   NOMINATED NODE
shop          web-1                1/1     Running   2d

shop          web with a long na   0/1               14h   node 7
kube-system   x                    1/1     Bad é     3d

"""


def test_columns_from_blanks(spark, tmp_path):
    (tmp_path / "a.txt").write_text(PODS)
    (tmp_path / "b.txt").write_text("ONE  TWO\n")
    (tmp_path / "c.txt").write_text("  A" + " " * 130 + "B\n  1" + " " * 130 + "2 3\n  44" + " " * 133 + "5\n")
    (tmp_path / "d.txt").write_text("\n\n")
    out = {}
    for r in T.cells(T.read_lines(spark, str(tmp_path / "*.txt"))).orderBy("listing", "n").collect():
        out.setdefault(r.listing[-5], []).append([c["value"] for c in r.cells])
    assert out["a"] == [["shop", "web-1", "1/1", "Running", "2d", ""], ["shop", "web with a long na", "0/1", "", "14h", "node 7"], ["kube-system", "x", "1/1", "Bad é", "3d", ""]]
    assert out["c"] == [["1", "2 3"], ["44", "    5"]] and "b" not in out and "d" not in out
    one = T.cells(T.read_lines(spark, str(tmp_path / "a.txt"))).where(T.cell("STATUS") == "Running").select(T.cell("NOMINATED NODE").alias("n"), T.cell("none").alias("m")).collect()
    assert [tuple(r) for r in one] == [("", None)]


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(3, "a b", None, 1.5), (1, "", "x\ny", None), (2, "long value here", "z", -2.0), (4, None, None, None)], "i int, s string, t string, d double")
    T.report(rows, ["s", "t", "d"], ["i"]).write.text(str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(lines, key=len)[-1].startswith("long value here  z") and "-" in lines and "s                t    d" in lines
    parts = T.report(rows, ["s", "t", "d"], ["i"]).select(F.lit("r").alias("listing"), F.monotonically_increasing_id().alias("n"), "line")
    got = [[c["value"] for c in r.cells] for r in T.cells(parts).orderBy("n").collect()]
    assert got == [["", "x y", ""], ["long value here", "z", "-2.0"], ["a b", "", "1.5"], ["-", "", ""]]
    assert T.report(rows.where("false"), ["s", "t"], ["i"]).count() == 1


def test_folder_sizes_equal_a_walk(spark, tmp_path):
    for k in range(60):
        folder = tmp_path / "top" / f"a{k % 3}" / "/".join(f"b{j}" for j in range(k % 5))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}").write_bytes(b"x" * (1 + k % 7))
    found = folders.files(spark, str(tmp_path / "top"))
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    got = {r.folder.removeprefix("file:"): (r.files, r.bytes) for r in folders.folder_sizes(found).collect()}
    want = {}
    for at, _, names in os.walk(tmp_path / "top"):
        for n in names:
            size, folder = os.path.getsize(f"{at}/{n}"), at
            while folder.startswith(str(tmp_path)):
                a, b = want.get(folder, (0, 0))
                want[folder] = (a + 1, b + size)
                folder = os.path.dirname(folder)
    assert {k: v for k, v in got.items() if k.startswith(str(tmp_path))} == want and got[""] == (60, sum(1 + k % 7 for k in range(60)))
    assert folders.files(spark, str(tmp_path / "top"), before="2001-01-01T00:00:00").count() == 0
    assert folders.files(spark, str(tmp_path / "top"), least=5).count() == sum(1 + k % 7 >= 5 for k in range(60))
    rows = spark.createDataFrame([("a/b/x", 1), ("a//b/y/", None), ("z", 5), (None, 9)], "path string, bytes long")
    assert sorted(map(tuple, folders.folder_sizes(rows).collect())) == [("", 3, 6), ("a", 2, 1), ("a/b", 2, 1)]
    top = V.top(folders.folder_sizes(rows), "bytes", 2, ["folder"])
    assert [r.folder for r in top.collect()] == ["", "a"]
    assert folders.folder_sizes(rows.where("false")).count() == 0
