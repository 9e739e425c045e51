import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspar.functions import geometry as geo
from loomspar.operators import candidates, elements, loop, metrics
from loomspar.operators.evaluators import Evaluator, chosen, evaluate, evaluate_elements
from loomspar.sources import readers, writers


def test_intervals_picked_apart_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, n, b, b + rng.randrange(1, 6)) for g in range(20) for n in range(15) for b in [rng.randrange(30)]]
    df = spark.createDataFrame(rows, "g int, n int, b int, e int")
    want = set()
    for g in range(20):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if all(r[3] <= k[2] or r[2] >= k[3] for k in kept):
                kept.append(r)
        want |= set(kept)
    assert {tuple(r) for r in elements.pick_apart(df, "g", "b", "e", ["n"]).collect()} == want
    assert elements.pick_apart(df.limit(0), "g", "b", "e", ["n"]).count() == 0


def test_moments_and_frechet(spark):
    x = np.random.default_rng(1).normal(size=(300, 4))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>")
    n, mean, cov = elements.moments(df, "v", 4)
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    assert elements.frechet((n, mean, cov), (n, mean, cov)) == pytest.approx(0, abs=1e-9)
    assert elements.frechet((n, mean, np.diag([4.0, 1, 1, 1])), (n, mean + 1, np.eye(4))) == pytest.approx(5.0)
    assert elements.moments(df.limit(0), "v", 4)[0] == 0


def test_laplacian_features(spark):
    df = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("q", 7, 7)], "g string, s int, t int")
    got = {(r.g, r.node): r.features for r in elements.laplacian_features(df, "g", "s", "t", 2).collect()}
    assert np.allclose(np.abs(got["p", 1][0]), 1 / math.sqrt(2)) and abs(got["p", 2][0]) < 1e-9 and got["q", 7] == [0.0, 0.0]


def test_geometry(spark):
    p = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = spark.range(1).select(
        geo.bond_angle(p(1, 0, 0), p(0, 0, 0), p(0, 2, 0)), geo.torsion(p(1, 0, 0), p(0, 0, 0), p(0, 0, 1), p(0, 1, 1)), geo.plane_distance(p(3, 4, 5), p(0, 0, 0), p(1, 0, 0), p(0, 1, 0)),
        geo.covers_circle(F.array(F.struct(F.lit(3.0).alias("lo"), F.lit(6.3).alias("hi")), F.struct(F.lit(0.0).alias("lo"), F.lit(3.1).alias("hi")))), geo.covers_circle(F.array(F.struct(F.lit(0.1).alias("lo"), F.lit(6.3).alias("hi")))),
    ).first()
    assert r[0] == pytest.approx(math.pi / 2) and abs(r[1]) == pytest.approx(math.pi / 2) and r[2] == 5.0 and r[3] and not r[4]


def test_verdicts_and_positive_elements(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, x int")
    v = spark.createDataFrame([(1, 2.0)], "x int, v double")
    got = {r.s: tuple(r)[1:] for r in elements.segment_verdicts(e, v, ["s"], "x", "v", 1.5).collect()}
    assert got == {"a": (True, False, False, True), "b": (False, True, False, True)}
    s = spark.createDataFrame([([1.0, -2.0, 3.0],), ([-1.0],), ([],), (None,)], "a array<double>").select(elements.positive_summary(F.col("a")).alias("s")).collect()
    assert tuple(s[0].s) == (2.0, 1.0, 3.0) and all(r.s is None for r in s[1:])


def test_evaluators_have_limits_prefixes_and_exclusions(spark):
    def slow(row):
        from time import sleep

        if row["x"] == 1:
            sleep(5)
        if row["x"] is None:
            raise KeyError("none")
        return {"twice": row["x"] * 2}

    every = [Evaluator("slow", {"twice": "int"}, function=slow, inputs=("x",), limit_s=0.3), Evaluator("plus", {"one": "int"}, {"one": F.col("x") + 1})]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, `o.p` string")
    got = {r.x: r for r in evaluate(df, every).collect()}
    assert got[1]["slow.twice"] is None and "TimeoutError" in got[1]["slow.error"] and got[2]["slow.twice"] == 4 and got[2]["slow.error"] is None and got[2]["plus.one"] == 3 and got[1]["o.p"] == "a"
    assert evaluate(df, every, exclude={"slow"}).columns == ["x", "o.p", "plus.one"] and evaluate(df.limit(0), every).count() == 0
    with pytest.raises(ValueError):
        chosen(every, {"unknown"})
    e = evaluate_elements(spark.createDataFrame([(["a", "bb"], [5, 9]), ([], []), (None, None)], "v array<string>, at array<int>"), "v", {"n": F.length}, "at").collect()
    assert e[0].n == {5: 1, 9: 2} and e[1].n is None and e[2].n is None


def test_loop_accepts_once_and_stops(spark):
    start = spark.createDataFrame([(1, 0), (1, 5), (2, 9)], "k int, v int")
    grow = lambda t: t.select((F.col("k") + 1).alias("k"), F.lit(9).alias("v"))
    run = lambda n, enough=None: sorted((r.k, r.round) for r in loop.sample_filter_expand(start, "k", ["v"], F.col("v") > 3, grow, n, enough).collect())
    assert run(3) == [(1, 0), (2, 0), (3, 1), (4, 2)] and run(9, enough=2) == [(1, 0), (2, 0)]
    assert loop.sample_filter_expand(start.limit(0), "k", ["v"], F.lit(True), grow, 3).count() == 0
    c = [("a", "x", 0.0, 1.0), ("b", "y", 0.0, 1.0), ("a", "y", 5.0, 6.0)]
    assert loop.ranked_criteria(c) == {"a": 0, "b": 1} and loop.moved_bounds(c, {"y": (2.0, 3.0)})[1:] == [("b", "y", 2.0, 3.0), ("a", "y", 2.0, 3.0)]
    rows = spark.createDataFrame([(0.5, 5.5), (0.5, 0.5), (None, 5.5), (float("nan"), 5.5)], "x double, y double")
    assert [r[0] for r in rows.select(loop.first_failure(c)).collect()] == ["b", "a", "a", "a"]


def test_cache_computes_only_what_is_missing(spark):
    asked = []
    compute = lambda t: asked.append(sorted(r.k for r in t.collect())) or t.withColumn("y", F.col("k") * 10)
    cache = spark.createDataFrame([(1, 111, 2), (2, 222, 1)], "k int, y int, version int")
    got, new = loop.with_cache(spark.createDataFrame([(1,), (2,), (2,)], "k int"), "k", cache, 2, compute)
    assert {(r.k, r.y) for r in got.collect()} == {(1, 111), (2, 20)} and asked == [[2]] and new.count() == 2


def test_candidates(spark):
    rules = spark.createDataFrame([("r", ["a", "b", "a"]), ("s", []), ("t", None), ("u", ["a"])], "rule string, needs array<string>")
    items = spark.createDataFrame([("x", ["a", "c"]), ("y", [])], "item string, f array<string>")
    fit = candidates.fitting_rules(items, "item", F.col("f"), candidates.needs_index(rules, "rule", "needs"), "rule")
    assert {tuple(r) for r in fit.collect()} == {("x", "s"), ("x", "t"), ("x", "u"), ("y", "s"), ("y", "t")}
    kinds = spark.createDataFrame([(["p", "q"],), (["q", "p"],), (["p", "p"],), (["p"],), (None,), ([None, "p"],)], "k array<string>")
    assert [r[0] for r in kinds.select(candidates.fits_some_order(F.col("k"), [["p"], ["q"]])).collect()][:4] == [True, True, False, False]
    rng = random.Random(1)
    have = [(rng.choice("ab"), f"i{n}", rng.randrange(30), rng.randrange(4)) for n in range(200)]
    want = [(n, rng.choice("ab"), rng.randrange(30)) for n in range(20)]
    got = candidates.ranked_partners(spark.createDataFrame(want, "w int, rule string, expected int"), spark.createDataFrame(have, "rule string, item string, size int, prio int"), "rule", "size", "prio", "item", 4, 5, 6)
    brute = {(w, i) for w, r, e in want for _, _, i in sorted((p, abs(s - e), i) for q, i, s, p in have if q == r and (abs(s - e) <= 4 or s <= 5))[:6]}
    assert {(r.w, r.item) for r in got.collect()} == brute


def test_sources_and_sinks(spark, tmp_path):
    where = str(tmp_path / "v")
    spark.createDataFrame([("a", None)], "key string, n int").write.json(where)
    with pytest.raises(ValueError):
        readers.read_vocabulary(spark, where, "key string, n int", ("key", "n"))
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.read_json_array(spark, str(tmp_path / "e.json"), "a int")
    for name, text in (("7_x.txt", "seven"), ("8_y.txt", ""), ("none.txt", "?")):
        (tmp_path / "n").mkdir(exist_ok=True)
        (tmp_path / "n" / name).write_text(text)
    assert {r.number: bytes(r.content) for r in readers.read_numbered_files(spark, str(tmp_path / "n"), r"(\d+)_[^/]*$").collect()} == {7: b"seven"}
    assert {r.number: bytes(r.content) for r in readers.read_numbered_files(spark, str(tmp_path / "n"), r"(\d+)_[^/]*$", spark.createDataFrame([(7,), (8,)], "number int"), b"-").collect()} == {7: b"seven", 8: b"-"}
    odd = spark.createDataFrame([(' a "b", c ', None)], "x string, y string")
    writers.write_catalog(odd, str(tmp_path / "c"))
    assert spark.read.options(header=True, escape='"').csv(str(tmp_path / "c")).first()[0] == ' a "b", c '


def test_js_distance_by_group(spark):
    p = spark.createDataFrame([("g", 1, 2), ("g", 2, 2), ("h", 1, 5)], "g string, bin int, p int")
    q = spark.createDataFrame([("g", 1, 7), ("g", 2, 7), ("h", 2, 5)], "g string, bin int, q int")
    assert {r.g: round(r.js, 6) for r in metrics.js_distance(p, q, ["g"]).collect()} == {"g": 0.0, "h": round(math.sqrt(math.log(2)), 6)}
