from datetime import datetime as T

from pyspark.sql import functions as F

from loomspar.operators.references import availability, item_key, orphan_references, rule_key

CHILD = "parent_table string, src_table string, src_id bigint, field string, ref_id string, at timestamp_ntz, extra int"
PARENT = "parent_table string, key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, extra int"


def test_orphans(spark):
    day = lambda n: T(2024, 1, n)
    parents = spark.createDataFrame(
        [("p", "a", day(2), None, 1), ("p", "b", day(2), day(5), 1), ("p", "b", day(8), None, 1), ("p", "b", day(8), None, 1), ("p", "c", None, None, 1), ("q", "z", day(1), None, 1), ("p", None, day(1), None, 1)], PARENT
    )
    children = [("a", 3), ("a", 1), ("b", 2), ("b", 5), ("b", 9), ("c", 9), ("z", 9), ("d", 9), (None, 9), ("a", 3)]
    df = spark.createDataFrame([("p", "s", i, "f", k, day(n), 0) for i, (k, n) in enumerate(children)] + [("p", "s", 3, "f", "b", day(5), 0), ("p", "s", 99, "f", "a", None, 0)], CHILD)
    got = {(r.src_id, r.ref_id, r.reason) for r in orphan_references(df, parents).collect()}
    assert got == {(1, "a", "not_loaded"), (3, "b", "withdrawn"), (5, "c", "not_loaded"), (6, "z", "missing"), (7, "d", "missing"), (99, "a", "not_loaded")}
    assert orphan_references(df.limit(0), parents).count() == 0
    assert orphan_references(df, parents.limit(0)).where("reason = 'missing'").count() == orphan_references(df, parents.limit(0)).count() == 10


def test_availability_merges(spark):
    day = lambda n: T(2024, 1, n)
    rows = [("p", "a", day(1), day(4), 0), ("p", "a", day(3), day(6), 0), ("p", "a", day(8), None, 0)]
    assert availability(spark.createDataFrame(rows, PARENT)).count() == 2


def test_normal_forms(spark):
    df = spark.createDataFrame([(" R007 Tormov-Amination__RETRO ",), ("__a__retro__retro",), (None,)], "x string")
    assert [r[0] for r in df.select(rule_key(F.col("x"))).collect()] == ["r007_tormov_amination", "a_retro", None]
    assert df.select(item_key(F.col("x"))).first()[0] == "r007 tormov-amination__retro"


def test_a_row_never_loaded_does_not_extend_a_period(spark):
    day = lambda n: T(2024, 1, n)
    parents = spark.createDataFrame([("p", "a", day(1), day(4), 0), ("p", "a", None, None, 0)], PARENT)
    child = spark.createDataFrame([("p", "s", 1, "f", "a", day(2), 0), ("p", "s", 2, "f", "a", day(9), 0)], CHILD)
    assert {(r.src_id, r.reason) for r in orphan_references(child, parents).collect()} == {(2, "withdrawn")}
