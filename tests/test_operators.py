import pytest
from pyspark.sql import functions as F

from loomspar import functions as fn
from loomspar.operators import catalog, graphs, metrics, ranking, relations, routes
from loomspar.sources import readers
from loomspar.streaming import sinks


def test_merge_keeps_first_on_ties_and_renames_clashes(spark):
    rows = [("k1", "i", "p", 1, 1, ["q:9"]), ("k1", "j", "r", 1, 2, []), ("k2", "i", "p", 1, 3, []), (None, "x", "p", 1, 4, [])]
    df = spark.createDataFrame(rows, "key string, id string, prov string, rank int, ord int, src array<string>")
    got = {r.key: r for r in catalog.merge_catalogs(df, "key", "id", "prov", "rank", ["ord"], F.col("src")).collect()}
    assert got["k1"].id == "i" and got["k1"].sources == "p:i;q:9;r:j" and got["k2"].id == "i__1" and got["k2"].sources == "p:i__1"


def test_apportion_sums_to_budget(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 1.0, 1.0])] + [(2, i, 0.0) for i in range(7)], "g int, i int, s double")
    got = ranking.apportion(df, ["g"], "s", 100, "i").groupBy("g").agg(F.sum("alloc").alias("t"), F.collect_list("alloc").alias("a")).collect()
    assert all(r.t == 100 for r in got)


def test_missing_column_fails_and_nan_fails(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert df.where(metrics.in_bounds(df, {"x": (0.0, 2.0)})).count() == 1
    assert df.where(metrics.in_bounds(df, {"y": (0.0, 2.0)})).count() == 0


def test_js_distance_of_disjoint_histograms(spark):
    p, q = spark.createDataFrame([(1, 5)], "bin int, p int"), spark.createDataFrame([(2, 5)], "bin int, q int")
    assert metrics.js_distance(p, q).first()[0] == pytest.approx(0.8325546111576977)


def test_cascade_takes_first_level(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one, two = spark.createDataFrame([("a", 1, 0)], "k string, v int, ord int"), spark.createDataFrame([("a", 2, 0), ("b", 4, 1), ("b", 3, 0)], "k string, v int, ord int")
    got = {r.k: (r.v, r.matched_by) for r in relations.cascade(q, [("x", one), ("y", two)], "k", "v").collect()}
    assert got == {"a": (1, "x"), "b": (3, "y"), "c": (None, None)}


def test_components_and_ancestors(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (9, 9)], "a int, b int")
    assert {(r.node, r.comp) for r in graphs.components(e, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)}
    t = spark.createDataFrame([(1, None)] + [(n, n - 1) for n in range(2, 12)], "n int, p int")
    assert graphs.ancestors(t, "n", "p").count() == 66


def test_trace_parser_and_replay(spark):
    assert routes.parse_one("<<a>.<b>:r1:c>") == [{"depth": 0, "rule": "r1", "product": "c", "parts": ["a", "b"]}]
    nested = routes.parse_one("<<<a>:r1:b>.<x>:r2:c>")
    assert [s["product"] for s in nested] == ["b", "c"] and nested[1]["parts"] == ["b", "x"]
    assert routes.parse_one(None) == routes.parse_one("") == []
    df = spark.createDataFrame([(1, "<<a>:r1:b>"), (2, "<<a>:r1:z>"), (3, "<<a>:r9:b>"), (4, None)], "k int, t string")
    edges = spark.createDataFrame([("b", "r1", ["a"])], "product string, rule string, parts array<string>")
    assert {r.k: r.reason for r in routes.replay(routes.parse_traces(df, "k", "t"), edges, "k").collect()} == {1: None, 2: "product_mismatch", 3: "unknown_rule"}


def test_search_cuts_cycles_and_reports_unsolved(spark):
    edges = spark.createDataFrame([("a", "r", ["b"]), ("b", "r", ["a"]), ("b", "s", ["l", "l"]), ("c", "r", ["c"])], "product string, rule string, parts array<string>")
    t, leaves = spark.createDataFrame([("a",), ("c",), ("l",)], "node string"), spark.createDataFrame([("l",)], "node string")
    got = {r.node: (r.cost, r.trace) for r in routes.find_routes(t, edges, leaves, 2, 3).collect()}
    assert got == {"a": (2, "<<<l>.<l>:s:b>:r:a>"), "c": (None, None), "l": (0, "<l>")}
    edges = spark.createDataFrame([("a", "r", ["b"]), ("b", "r", ["a"]), ("a", "s", ["l"])], "product string, rule string, parts array<string>")
    deep = {(r.node, r.cost, r.trace) for r in routes.find_routes(t.where("node = 'a'"), edges, leaves, 3, 5).collect()}
    assert deep == {("a", 1, "<<l>:s:a>")}


def test_division_and_grid_join(spark):
    have = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "o int, i string")
    need = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "x")], "g string, i string")
    assert {tuple(r) for r in relations.divides(have, need, "o", "g", "i").collect()} == {(1, "g"), (1, "h"), (2, "h")}
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 5.0, 5.0)], "l int, x double, y double")
    assert {(r.l, r.r) for r in relations.within_distance(p, p.withColumnRenamed("l", "r"), ["x", "y"], 1.0).where("l < r").collect()} == {(1, 2)}


def test_functions(spark):
    r = spark.range(1).select(fn.doi_of(F.lit("https://doi.org/10.1/x")), fn.doi_of(F.lit(" ")), fn.normal_angle(F.lit(7.0)), fn.distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))).first()
    assert r[0] == "10.1/x" and r[1] is None and r[2] == pytest.approx(0.7168146928) and r[3] == 5.0


def test_readers(spark, tmp_path):
    (tmp_path / "v.txt").write_text("smiles id\n# no\nCCO a1\n\nCCN\n")
    got = readers.read_values(spark, str(tmp_path / "v.txt"), "x_").orderBy("ord").collect()
    assert [r.value for r in got] == ["CCO", "CCN"] and got[0].id == "a1" and got[1].id.startswith("x_")
    (tmp_path / "t.csv").write_text("ID,Smiles\n1,CC\n,\n")
    assert readers.read_table_text(spark, str(tmp_path / "t.csv"), {"id": "?", "provider": "own"}).collect()[1].id == "?"
    (tmp_path / "r.txt").write_text("# c\nA.B>>C\nbad\nA.B.C.D>>E\n")
    kept, counts = readers.read_rule_lines(spark, str(tmp_path / "r.txt"))
    assert kept.count() == 1 and {r.label: r.n for r in counts.collect()} == {"kept": 1, "malformed": 1, "too_many": 1}
    assert readers.read_json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    readers.write_stamped(spark.range(3), str(tmp_path / "cache"), 1, "h")
    assert readers.read_stamped(spark, str(tmp_path / "cache"), 1, "h").count() == 3 and readers.read_stamped(spark, str(tmp_path / "cache"), 2, "h") is None
    (tmp_path / "k.json").write_text('{"a": [{"d": "1"}, {"d": "2"}], "b": []}')
    assert readers.read_keyed_json(spark, str(tmp_path / "k.json"), "struct<d:string>").count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("g", n) for n in (4, 4, 4, 9, 1)], "g string, n int").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, n int").parquet(str(tmp_path / "in"))
    sinks.append_results(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    q = sinks.packed_batches(stream, "g", "n", 10, "n").writeStream.format("memory").queryName("packed").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    loads = spark.sql("select batch, sum(size) s from packed group by batch").collect()
    assert sum(r.s for r in loads) == 22 and all(r.s <= 10 for r in loads)
