"""Queries of the iterative driver, its criteria, samplings and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspar.functions import uniform
from loomspar.operators import loop as ops
from loomspar.session import table

CRITERIA = [("size", "l_quantity", 5.0, 45.0), ("price", "l_extendedprice", 2000.0, 90000.0), ("size", "l_tax", 0.0, 0.07), ("rest", "l_discount", 0.01, 1.0)]


def criteria_failures(spark, d):
    """Which group of criteria each line fails first; groups rank by their first criterion."""
    f = F.coalesce(ops.first_failure(CRITERIA), F.lit("passed"))
    return table(spark, d, "lineitem").groupBy(f.alias("first_failure")).agg(F.count(F.lit(1)).alias("n"))


def moved_criteria(spark, d):
    """The same after the bounds of quantity moved to its quartiles."""
    li = table(spark, d, "lineitem")
    lo, hi = li.agg(F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()["q"]
    f = F.coalesce(ops.first_failure(ops.moved_bounds(CRITERIA, {"l_quantity": (lo, hi)})), F.lit("passed"))
    return li.groupBy(f.alias("first_failure")).agg(F.count(F.lit(1)).alias("n"))


def unique_selection(spark, d):
    """Orders that pass and are the first of their customer, customers of great balance being known before."""
    o = table(spark, d, "orders")
    known = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return ops.select_unique(o, "o_custkey", F.col("o_totalprice") > 100000, ["o_orderdate", "o_orderkey"], known).select("o_custkey", "o_orderkey")


def loop_rounds(spark, d):
    """Parts found in up to three rounds from those of one brand: accepted above a size, expanded to two others by number."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    link = lambda t, e: t.select(e.alias("p_partkey")).distinct()
    grow = lambda t: link(t, F.col("p_partkey") * 2).union(link(t, F.col("p_partkey") * 3 + 1)).distinct().join(p, "p_partkey").select("p_partkey", "p_size", "p_brand")
    return ops.sample_filter_expand(p.where("p_brand = 'Brand#1'"), "p_partkey", ["p_size"], F.col("p_size") > 10, grow, 3).select("p_partkey", "round")


def cached_results(spark, d):
    """Totals per customer, those of the older half of orders' customers from a cache."""
    o = table(spark, d, "orders")
    compute = lambda keys: o.join(keys, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    cache = compute(known).withColumn("version", F.lit(2)).unionByName(o.select("o_custkey", F.lit(-1).cast("bigint").alias("n"), F.lit(1).alias("version")).distinct())
    return ops.with_cache(o, "o_custkey", cache, 2, compute)[0]


def allowed_profile(spark, d):
    """Lines whose flag is listed and whose status its flag's allow-list holds; ``*`` allows all."""
    allow = spark.createDataFrame([("A", "F"), ("N", "*")], "l_returnflag string, ok string")
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N", "R"))
    kept = li.join(F.broadcast(allow), "l_returnflag").where((F.col("ok") == "*") | (F.col("ok") == F.col("l_linestatus")))  # two rows
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def tagged_rejections(spark, d):
    """Routes with the reason for which they are passed over, if any, in order of the tests."""
    r = table(spark, d, "routes")
    why = F.when(~F.coalesce("found", F.lit(False)), "not_found").when(F.coalesce(F.size("reaction_ids"), F.lit(0)) <= 0, "no_steps").when(F.col("n_steps") > 3, "too_deep").when(F.isnan("similarity") | F.col("similarity").isNull(), "no_similarity").otherwise("kept")
    return r.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def shallow_progress(spark, d):
    """Queries with any route of few steps whose blocks hold none of an excluded provider."""
    r = table(spark, d, "routes").where("query_smiles is not null")
    good = F.coalesce(F.col("n_steps") <= 2, F.lit(False)) & (F.coalesce(F.size("building_block_providers"), F.lit(0)) > 0) & ~F.exists(F.coalesce("building_block_providers", F.array().cast("array<string>")), lambda x: F.coalesce(x == "proposed", F.lit(False)))
    return r.groupBy("query_smiles").agg(F.bool_or(good).alias("progress"))


def checks_all_passed(spark, d):
    """Orders valid in every one of three checks: one aggregation instead of intersections."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("a"), F.bool_and(F.col("l_tax") < 0.08).alias("b"), F.max("l_discount").alias("c")).where("a and b and c < 0.1").select("l_orderkey")


def evolving_tables(spark, d):
    """Tables of different columns put together by name, with the place of their source."""
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("src"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(1).alias("src"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("src").agg(F.count("name").alias("n_name"), F.count("balance").alias("n_balance"), F.count("nation").alias("n_nation"))


def merged_products(spark, d):
    """Two product sets together, one row per product, from the first set that has it."""
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", F.lit(0).alias("src"))
    b = table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey", F.lit(1).alias("src"))
    return a.union(b).groupBy("l_partkey").agg(F.min("src").alias("src"))


def derived_keys(spark, d):
    """Keys derived from names, without those that are seen as they stand."""
    p = table(spark, d, "part").select(F.regexp_extract("p_name", r"(\w+)$", 1).alias("k")).distinct()
    seen = table(spark, d, "part").select(F.lower("p_type").alias("k")).union(spark.createDataFrame([("ring",)], "k string"))
    return p.join(seen, "k", "left_anti")


def best_complete(spark, d):
    """The most complete record per rule card, and of equals the one of highest confidence, then the newest."""
    c = table(spark, d, "procedure_cards")
    filled = sum((F.col(x).isNotNull() & (F.trim(F.col(x)) != "")).cast("int") for x in ("temperature", "duration_text", "typical_yield", "notes", "title"))
    level = F.coalesce(F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("confidence")), F.lit(0))
    n = F.row_number().over(Window.partitionBy("reaction_id").orderBy(F.col("filled").desc(), F.col("level").desc(), F.col("prepared_at").desc(), F.col("card_id").desc(), "ingested_at"))
    return c.withColumns({"filled": F.coalesce(filled, F.lit(0)), "level": level}).withColumn("n", n).where("n = 1").select("reaction_id", "card_id", "filled")


def kept_by_number(spark, d):
    """Running ids of the kept rows of each brand."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, d, "part").where("p_size > 20").select("p_partkey", F.concat_ws("_", "p_brand", F.lpad(n.cast("string"), 6, "0")).alias("id"))


def dropped_fraction(spark, d):
    """A tenth of each customer's orders dropped at random, repeatably."""
    o = table(spark, d, "orders").withColumn("u", uniform(3, F.col("o_orderkey")))
    n, r = F.count(F.lit(1)).over(Window.partitionBy("o_custkey")), F.row_number().over(Window.partitionBy("o_custkey").orderBy("u", "o_orderkey"))
    return o.withColumns({"n": n, "r": r}).where(F.col("r") > F.floor(F.col("n") * 0.1)).select("o_custkey", "o_orderkey")


def reference_subsample(spark, d):
    """Of every provider 100 blocks without replacement, by hash order."""
    b = table(spark, d, "building_blocks").select("id", F.lower(F.trim("provider")).alias("provider")).distinct()
    return b.withColumn("r", F.row_number().over(Window.partitionBy("provider").orderBy(F.xxhash64("id", F.lit(42)), "id"))).where("r <= 100").drop("r")


def fragment_masks_by_regime(spark, d):
    """Each line masked or not by the interval that its repeatable random number falls in."""
    u = uniform(7, F.col("l_orderkey"), F.col("l_linenumber"))
    regime = F.when(u < 0.2, "none").when(u < 0.7, "half").otherwise("all")
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", regime.alias("regime"), (uniform(8, F.col("l_orderkey"), F.col("l_linenumber")) < 0.5).alias("coin"))
    return m.select("l_orderkey", "l_linenumber", "regime", ((F.col("regime") == "all") | ((F.col("regime") == "half") & F.col("coin"))).alias("masked"))


def virtual_nodes(spark, d):
    """A node at the centre of each label's vectors beside the vectors themselves (three places)."""
    e = table(spark, d, "embeddings").select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    v = e.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"]).select("label", F.lit(-1).cast("bigint").alias("vec_id"), "x", "y", "z")
    return e.unionByName(v).select("label", "vec_id", *[F.round(c, 7).alias(c) for c in "xyz"])


def replaced_failures(spark, d):
    """Routes whose similarity is no number take the one of the same query's first good route."""
    r = table(spark, d, "routes").where("query_smiles is not null").select("route_id", "ingested_at", "query_smiles", F.when(~F.isnan("similarity"), F.col("similarity")).alias("s"))
    w = Window.partitionBy("query_smiles").orderBy("route_id", "ingested_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return r.select("route_id", "ingested_at", F.coalesce("s", F.first("s", ignorenulls=True).over(w)).alias("similarity"))


def conditioned_draw(spark, d):
    """For every item a size drawn from the histogram of sizes of its residue bin, repeatably."""
    i = table(spark, d, "dataset_items").where("n_atoms is not null and n_residues is not null").groupBy("item_id").agg(F.max(F.struct("ingested_at", "n_atoms", "n_residues")).alias("r")).select("item_id", "r.n_atoms", F.floor(F.col("r.n_residues") / 10).alias("bin"))
    h = i.groupBy("bin", "n_atoms").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bin")
    h = h.select("bin", "n_atoms", (F.sum("n").over(w.orderBy("n_atoms")) / F.sum("n").over(w)).alias("hi"))
    cut = h.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("hi", "n_atoms"))).alias("c"))  # as many as there are sizes
    u = uniform(11, F.col("item_id"))
    return i.select("item_id", "bin").join(F.broadcast(cut), "bin").select("item_id", "bin", F.filter("c", lambda x: x["hi"] > u)[0]["n_atoms"].alias("drawn"))


QUERIES = {f.__name__: f for f in (criteria_failures, moved_criteria, unique_selection, loop_rounds, cached_results, allowed_profile, tagged_rejections, shallow_progress, checks_all_passed, evolving_tables, merged_products, derived_keys, best_complete, kept_by_number, dropped_fraction, reference_subsample, fragment_masks_by_regime, virtual_nodes, replaced_failures, conditioned_draw)}
_FAIL = "SELECT CASE WHEN NOT (l_quantity BETWEEN {lo} AND {hi} AND l_tax BETWEEN 0 AND 0.07) THEN 'size' WHEN NOT l_extendedprice BETWEEN 2000 AND 90000 THEN 'price' WHEN NOT l_discount BETWEEN 0.01 AND 1 THEN 'rest' ELSE 'passed' END AS first_failure, count(*) AS n FROM lineitem GROUP BY 1"
_GROW = "SELECT DISTINCT p_partkey, p_size FROM part JOIN (SELECT p_partkey * 2 AS k FROM {a} UNION SELECT p_partkey * 3 + 1 FROM {a}) ON k = p_partkey WHERE p_size > 10"
_FILLED = " + ".join(f"CAST({x} IS NOT NULL AND trim({x}) <> '' AS INT)" for x in ("temperature", "duration_text", "typical_yield", "notes", "title"))
SQL = {
    "criteria_failures": _FAIL.format(lo=5, hi=45),
    "moved_criteria": _FAIL.format(lo="(SELECT quantile_cont(l_quantity, 0.25) FROM lineitem)", hi="(SELECT quantile_cont(l_quantity, 0.75) FROM lineitem)"),
    "unique_selection": "SELECT o_custkey, arg_min(o_orderkey, struct_pack(o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1",
    "loop_rounds": f"WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#1' AND p_size > 10), b AS (SELECT * FROM ({_GROW.format(a='a')}) WHERE p_partkey NOT IN (SELECT p_partkey FROM a)), c AS (SELECT * FROM ({_GROW.format(a='b')}) WHERE p_partkey NOT IN (SELECT p_partkey FROM a UNION SELECT p_partkey FROM b)) SELECT p_partkey, 0 AS round FROM a UNION ALL SELECT p_partkey, 1 FROM b UNION ALL SELECT p_partkey, 2 FROM c",
    "cached_results": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1",
    "allowed_profile": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' OR l_returnflag = 'N' GROUP BY ALL",
    "tagged_rejections": "SELECT CASE WHEN NOT coalesce(found, false) THEN 'not_found' WHEN coalesce(len(reaction_ids), 0) = 0 THEN 'no_steps' WHEN n_steps > 3 THEN 'too_deep' WHEN similarity IS NULL OR isnan(similarity) THEN 'no_similarity' ELSE 'kept' END AS reason, count(*) AS n FROM routes GROUP BY 1",
    "shallow_progress": "SELECT query_smiles, bool_or(coalesce(n_steps <= 2, false) AND coalesce(len(building_block_providers), 0) > 0 AND NOT coalesce(list_contains(building_block_providers, 'proposed'), false)) AS progress FROM routes WHERE query_smiles IS NOT NULL GROUP BY 1",
    "checks_all_passed": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 5) INTERSECT SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_tax < 0.08) INTERSECT SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_discount) < 0.1",
    "evolving_tables": "SELECT 0 AS src, count(c_name) AS n_name, count(c_acctbal) AS n_balance, CAST(0 AS BIGINT) AS n_nation FROM customer UNION ALL SELECT 1, count(s_name), 0, count(s_nationkey) FROM supplier",
    "merged_products": "SELECT l_partkey, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS src FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 40 GROUP BY 1",
    "derived_keys": "SELECT DISTINCT regexp_extract(p_name, '(\\w+)$', 1) AS k FROM part WHERE regexp_extract(p_name, '(\\w+)$', 1) NOT IN (SELECT lower(p_type) FROM part UNION SELECT 'ring')",
    "best_complete": f"WITH c AS (SELECT *, {_FILLED} AS filled, coalesce(list_position(['low', 'medium', 'high'], confidence), 0) AS level FROM procedure_cards), r AS (SELECT *, row_number() OVER (PARTITION BY reaction_id ORDER BY filled DESC, level DESC, prepared_at DESC, card_id DESC, ingested_at) AS n FROM c) SELECT reaction_id, card_id, filled FROM r WHERE n = 1",
    "kept_by_number": "SELECT p_partkey, p_brand || '_' || lpad(CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS VARCHAR), 6, '0') AS id FROM part WHERE p_size > 20",
    "virtual_nodes": "WITH e AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT label, vec_id, round(x, 7) AS x, round(y, 7) AS y, round(z, 7) AS z FROM e UNION ALL SELECT label, -1, round(avg(x), 7), round(avg(y), 7), round(avg(z), 7) FROM e GROUP BY label",
    "replaced_failures": "WITH r AS (SELECT route_id, ingested_at, query_smiles, CASE WHEN NOT isnan(similarity) THEN similarity END AS s FROM routes WHERE query_smiles IS NOT NULL) SELECT route_id, ingested_at, coalesce(s, first_value(s IGNORE NULLS) OVER (PARTITION BY query_smiles ORDER BY route_id, ingested_at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS similarity FROM r",
}
