"""Similarity, distance-range and nearest joins, and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspar import functions as fn
from loomspar.operators import relations as ops
from loomspar.session import table


def _tokens(spark, d, name, key):
    t = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    return table(spark, d, name).select(F.col(key).alias("id"), t.alias("tokens")).where(F.size("tokens") > 0)


def items_near_items(spark, d):
    """The three most similar other evaluation items of each, by shared words."""
    t = _tokens(spark, d, "eval_items", "item_id")
    near = ops.nearest_by_tokens(t, t, 4).where("q <> i")
    return ops_rank(near)


def ops_rank(near):
    n = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "i"))
    return near.withColumn("rank", n).where("rank <= 3")


def _points(spark, d, name):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias(name), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def points_within(spark, d):
    p = ops.within_distance(_points(spark, d, "l"), _points(spark, d, "r"), ["x", "y", "z"], 0.1)
    return p.where("l < r").select("l", "r", F.round("distance", 7).alias("distance"))


def clash_share(spark, d):
    """Points that have any other within a distance, as a share."""
    near = ops.within_distance(_points(spark, d, "l"), _points(spark, d, "r"), ["x", "y", "z"], 0.06).where("l <> r").select("l").distinct().withColumn("c", F.lit(1))
    return _points(spark, d, "l").join(near, "l", "left").agg(F.round(F.avg(F.coalesce("c", F.lit(0))), 9).alias("clash"))


def label_centres(spark, d):
    """Mean vector per label: one aggregate per place, no array of rows is ever collected."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 7).alias("mean"))


def nearest_centre(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    c = e.groupBy(F.col("label").alias("c"), "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    sq = e.join(c, "i").groupBy("vec_id", "label", "c").agg(F.round(F.sum((F.col("v") - F.col("m")) ** 2), 6).alias("d2"))
    return sq.groupBy("vec_id", "label").agg(F.min_by("c", F.struct("d2", "c")).alias("nearest"))


def scalar_functions(spark, d):
    """Hashes, traces, codecs and angles over parts."""
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", fn.content_hash(F.col("p_name")).alias("h"), fn.step_trace(F.array("p_brand", "p_type"), F.lit("r"), F.col("p_name")).alias("trace"),
        F.array_join(fn.one_hot(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#13"]), "").alias("hot"), F.round(fn.normal_angle(F.col("p_size") / 2.0), 7).alias("angle"),
        F.round(fn.log_odds(F.col("p_size") / 100.0), 7).alias("odds"),
    )


def hashed_subsample(spark, d):
    """One record per cluster by hash order, and the share drawn: repeatable on any partitioning."""
    i = table(spark, d, "dataset_items").dropDuplicates(["item_id"])
    return i.groupBy("cluster_id").agg(F.min_by("item_id", F.struct(F.xxhash64("item_id", F.lit(3)), "item_id")).alias("item_id"))


def first_of_cluster(spark, d):
    return table(spark, d, "dataset_items").groupBy("cluster_id").agg(F.min("item_id").alias("item_id"))


def json_fields(spark, d):
    e = table(spark, d, "events")
    keys = F.json_object_keys("props")
    return e.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (items_near_items, points_within, clash_share, label_centres, nearest_centre, scalar_functions, hashed_subsample, first_of_cluster, json_fields)}
_P = "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
SQL = {
    "items_near_items": "WITH t AS (SELECT item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS k FROM eval_items), e AS (SELECT id, len(k) AS n, unnest(k) AS w FROM t), s AS (SELECT a.id AS q, b.id AS i, round(count(*) / (a.n + b.n - count(*)), 8) AS sim FROM e a JOIN e b ON a.w = b.w GROUP BY a.id, b.id, a.n, b.n), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, i) AS r4 FROM s), f AS (SELECT q, i, sim FROM r WHERE r4 <= 4 AND q <> i) SELECT q, i, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, i) AS rank FROM f QUALIFY rank <= 3",
    "points_within": _P + f" SELECT a.vec_id AS l, b.vec_id AS r, round({_D}, 7) AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE {_D} <= 0.1",
    "clash_share": _P + f" SELECT round(avg(CAST(EXISTS (SELECT 1 FROM p b WHERE b.vec_id <> a.vec_id AND {_D} <= 0.06) AS INT)), 9) AS clash FROM p a",
    "label_centres": "SELECT label, CAST(i AS INT) AS i, round(avg(v), 7) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL",
    "nearest_centre": "WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label AS c, i, avg(v) AS m FROM e GROUP BY ALL), s AS (SELECT vec_id, e.label, c, round(sum((v - m) ** 2), 6) AS d2 FROM e JOIN c ON c.i = e.i GROUP BY ALL) SELECT vec_id, label, arg_min(c, struct_pack(d2, c)) AS nearest FROM s GROUP BY ALL",
    "scalar_functions": "SELECT p_partkey, left(sha256(p_name), 16) AS h, '<' || coalesce(p_brand, 'NA') || '.' || coalesce(p_type, 'NA') || ':r:' || coalesce(p_name, 'NA') || '>' AS trace, CAST(CAST(coalesce(p_brand = 'Brand#11', false) AS INT) AS VARCHAR) || CAST(CAST(coalesce(p_brand = 'Brand#12', false) AS INT) AS VARCHAR) || CAST(CAST(coalesce(p_brand = 'Brand#13', false) AS INT) AS VARCHAR) AS hot, round((p_size / 2.0 + pi()) - 2 * pi() * floor((p_size / 2.0 + pi()) / (2 * pi())) - pi(), 7) AS angle, round(ln((p_size / 100.0) / (1 - p_size / 100.0)), 7) AS odds FROM part",
    "first_of_cluster": "SELECT cluster_id, min(item_id) AS item_id FROM dataset_items GROUP BY 1",
    "json_fields": "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1",
}
