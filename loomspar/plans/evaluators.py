"""Queries over the evaluator registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspar.operators.evaluators import Evaluator, evaluate, evaluate_collection, evaluate_elements
from loomspar.session import table


def _digits(row: dict) -> dict:
    if row["p_size"] == 13:
        raise ValueError("thirteen")
    return {"n": sum(c.isdigit() for c in row["p_brand"]), "odd": row["p_size"] % 2 == 1}


def _evaluators():
    words = F.size(F.split("p_name", " "))
    return [
        Evaluator("text", {"n_words": "int", "n_chars": "int"}, {"n_words": words, "n_chars": F.length("p_name")}),
        Evaluator("price", {"high": "boolean", "per_size": "double"}, {"high": F.col("p_retailprice") > 950, "per_size": F.col("p_retailprice") / F.col("p_size")}),
        Evaluator("digits", {"n": "int", "odd": "boolean"}, function=_digits, inputs=("p_brand", "p_size")),
    ]


def item_evaluators(spark, d):
    e = evaluate(table(spark, d, "part"), _evaluators())
    return e.select("p_partkey", F.col("`text.n_words`").alias("n_words"), F.col("`text.n_chars`").alias("n_chars"), F.col("`price.high`").alias("high"), F.round("`price.per_size`", 8).alias("per_size"), F.col("`digits.n`").alias("n_digits"), F.col("`digits.odd`").alias("odd"), F.col("`digits.error`").alias("error"))


def evaluators_left_out(spark, d):
    """Without the Python evaluator no Python runs at all."""
    e = evaluate(table(spark, d, "part"), _evaluators(), exclude={"digits", "text"})
    return e.select("p_partkey", F.col("`price.high`").alias("high"), F.round("`price.per_size`", 8).alias("per_size"))


def element_evaluators(spark, d):
    """Values per element of a route's blocks, as maps by place, read back as rows."""
    r = table(spark, d, "routes").where(F.size("building_block_smiles") > 0).select("route_id", "ingested_at", "building_block_smiles")
    e = evaluate_elements(r, "building_block_smiles", {"chars": lambda x: F.length(x).cast("double"), "ring": lambda x: F.contains(x, F.lit("1")).cast("double")})
    return e.select("route_id", "ingested_at", F.explode("chars").alias("place", "chars"), "ring").select("route_id", "ingested_at", "place", "chars", F.col("ring")[F.col("place")].alias("ring"))


def collection_evaluators(spark, d):
    c = evaluate_collection(
        table(spark, d, "part"), ["p_brand"],
        {"unique": {"share": F.round(F.count_distinct("p_name") / F.count(F.lit(1)), 9)}, "size": {"mean": F.round(F.avg("p_size"), 9), "max": F.max("p_size")}, "none": {"x": F.lit(1)}}, exclude=("none",),
    )
    return c.select("p_brand", F.col("`unique.share`").alias("share"), F.col("`size.mean`").alias("mean"), F.col("`size.max`").alias("max"))


def fragment_masks(spark, d):
    """Item to fragments: one row per word of a name, with a mask of the words that remain."""
    w = F.split("p_name", " ")
    f = table(spark, d, "part").select("p_partkey", w.alias("w"), F.posexplode(w).alias("pos", "fragment"))
    return f.select("p_partkey", "pos", "fragment", F.array_join(F.transform("w", lambda x, i: F.when(i == F.col("pos"), "1").otherwise("0")), "").alias("mask"))


def transform_chain(spark, d):
    """Transforms one after the other: centred, scaled, clipped."""
    chain = [
        lambda t: t.withColumn("x", F.col("l_quantity") - 25),
        lambda t: t.withColumn("x", F.col("x") / 25),
        lambda t: t.withColumn("x", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), "x"))),
    ]
    t = table(spark, d, "lineitem")
    for step in chain:
        t = t.transform(step)
    return t.groupBy("l_returnflag").agg(F.round(F.sum("x"), 6).alias("total"), F.count_if(F.col("x") == 0.5).alias("n_top"))


QUERIES = {f.__name__: f for f in (item_evaluators, evaluators_left_out, element_evaluators, collection_evaluators, fragment_masks, transform_chain)}
SQL = {
    "item_evaluators": "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INT) AS n_words, CAST(length(p_name) AS INT) AS n_chars, p_retailprice > 950 AS high, round(p_retailprice / p_size, 8) AS per_size, CASE WHEN p_size <> 13 THEN CAST(length(regexp_replace(p_brand, '[^0-9]', '', 'g')) AS INT) END AS n_digits, CASE WHEN p_size <> 13 THEN p_size % 2 = 1 END AS odd, CASE WHEN p_size = 13 THEN 'ValueError: thirteen' END AS error FROM part",
    "evaluators_left_out": "SELECT p_partkey, p_retailprice > 950 AS high, round(p_retailprice / p_size, 8) AS per_size FROM part",
    "element_evaluators": "WITH e AS (SELECT route_id, ingested_at, unnest(range(len(building_block_smiles)))::INT AS place, unnest(building_block_smiles) AS s FROM routes) SELECT route_id, ingested_at, place, CAST(length(s) AS DOUBLE) AS chars, CAST(contains(s, '1') AS DOUBLE) AS ring FROM e",
    "collection_evaluators": "SELECT p_brand, round(count(DISTINCT p_name) / count(*), 9) AS share, round(avg(p_size), 9) AS mean, max(p_size) AS max FROM part GROUP BY 1",
    "fragment_masks": "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), f AS (SELECT p_partkey, w, unnest(range(len(w)))::INT AS pos, unnest(w) AS fragment FROM w) SELECT p_partkey, pos, fragment, array_to_string(list_transform(range(len(w)), lambda i: CASE WHEN i = pos THEN '1' ELSE '0' END), '') AS mask FROM f",
    "transform_chain": "SELECT l_returnflag, round(sum(greatest(-0.5, least(0.5, (l_quantity - 25) / 25))), 6) AS total, count(*) FILTER ((l_quantity - 25) / 25 >= 0.5) AS n_top FROM lineitem GROUP BY 1",
}
