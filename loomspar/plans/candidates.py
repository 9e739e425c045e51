"""Queries of candidate generation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspar.operators import candidates as ops
from loomspar.session import table


def _features(c):
    """Features of a SMILES by ordered text rules: an aromatic ring hides the plain ring."""
    return F.filter(
        F.array(
            F.when(F.contains(c, F.lit("c1")), "aromatic").when(F.contains(c, F.lit("1")), "ring"), F.when(F.contains(c, F.lit("N")), "amine"),
            F.when(F.contains(c, F.lit("C(=O)O")), "acid").when(F.contains(c, F.lit("O")), "oxygen"), F.when(c.rlike("F|Cl|Br|I"), "halogen"),
        ), lambda x: x.isNotNull(),
    )


def _rule_needs(spark, d):
    r = table(spark, d, "reaction_rules").select("id", "reaction", "molecularity").dropDuplicates(["id", "reaction", "molecularity"])
    need = F.filter(F.array(F.when(F.contains("reaction", F.lit("N")), "amine"), F.when(F.contains("reaction", F.lit("Br")), "halogen"), F.when(F.contains("reaction", F.lit("OH")), "oxygen")), lambda x: x.isNotNull())
    return r.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(need))).alias("need"))


def _blocks(spark, d):
    return table(spark, d, "building_blocks").where("smiles is not null and trim(smiles) <> ''").groupBy("id").agg(F.min(F.trim("smiles")).alias("smiles"), F.min(F.coalesce("priority", F.lit(100))).alias("priority"))


def inferred_features(spark, d):
    f = _blocks(spark, d).select("id", _features(F.col("smiles")).alias("f"))
    return f.select("id", F.array_join("f", "+").alias("features"))


def needs_index(spark, d):
    return ops.needs_index(_rule_needs(spark, d), "id", "need").groupBy("feature").agg(F.count(F.lit(1)).alias("n_rules"), F.max("n_need").alias("most"))


def fitting_rules(spark, d):
    """How many rules fit each block's features, those without needs always."""
    b = _blocks(spark, d).select(F.col("id").alias("block"), _features(F.col("smiles")).alias("f"))
    return ops.fitting_rules(b, "block", "f", ops.needs_index(_rule_needs(spark, d), "id", "need"), "id").groupBy("block").agg(F.count(F.lit(1)).alias("n_rules"))


ROLES = [["orvend", "kelmora", "brixel"], ["talvane", "pelorus", "quillon"]]


def membership_fits(spark, d):
    """Two-block routes whose providers fit two roles in some order."""
    kinds = F.transform("building_block_providers", lambda x: F.lower(F.trim(x)))
    r = table(spark, d, "routes").where(F.size("building_block_providers") == 2)
    return r.groupBy(ops.fits_some_order(kinds, ROLES).alias("fits")).agg(F.count(F.lit(1)).alias("n"))


def theta_roles(spark, d):
    """Parts by the roles whose price range holds them; ranges may overlap."""
    roles = spark.createDataFrame([("low", 0, 0.0, 930.0), ("mid", 1, 910.0, 970.0), ("high", 2, 960.0, 9999.0)], "rule string, role int, lo double, hi double")
    p = table(spark, d, "part").select("p_partkey", "p_retailprice").join(F.broadcast(roles), F.col("p_retailprice").between(F.col("lo"), F.col("hi")))  # three rows
    return p.groupBy("rule", "role").agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("last"))


def unknown_roles(spark, d):
    """Members of unknown rules or roles, each once, with the reason."""
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("rule"), F.col("l_linenumber").alias("role"), F.col("l_suppkey").alias("item")).distinct()
    why = F.when(~F.col("rule").isin("A", "R"), "rule").when(~F.col("role").between(1, 4), "role")
    return m.withColumn("why", why).where("why is not null").groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def leave_one_out(spark, d):
    """For every order status and priority the parts of a brand near the expected size, by price and distance."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("rule"), F.col("p_size").alias("size"), F.floor("p_retailprice").alias("priority"), F.col("p_partkey").alias("item"))
    w = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.floor(F.avg("p_size")).cast("int").alias("expected")).select(F.concat_ws("/", "p_brand", "p_type").alias("w"), F.col("p_brand").alias("rule"), "expected")
    return ops.ranked_partners(w, p, "rule", "size", "priority", "item", 4, 5, 8).select("w", "item", "size", "rank")


def role_pairs(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rule"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("role"), F.col("l_partkey").alias("item")).distinct()
    m = m.join(table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("size")), "item")
    return ops.role_pairs(m, "rule", "role", "item", "size", 3)


def fallback_candidates(spark, d):
    """Suppliers of a nation above a balance, or of any balance where there is none, or of its region."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    first = s.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.lit(0).alias("level"))
    second = s.where("s_acctbal > 7000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.lit(1).alias("level"))
    region = n.join(n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("s_suppkey")), "n_regionkey")
    return ops.with_fallback_candidates([first, second, region.select("n_nationkey", "s_suppkey", F.lit(2).alias("level"))], "n_nationkey")


def full_route_order(spark, d):
    """Every route's place among its query's, by fourteen keys."""
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    keys = [
        F.coalesce("found", F.lit(False)).desc(), F.coalesce("exact", F.lit(False)).desc(), F.round(F.coalesce(F.nanvl("similarity", F.lit(-1.0)), F.lit(-1.0)), 6).desc(), F.coalesce("n_steps", F.lit(99)), F.size(F.array_distinct(F.coalesce("reaction_ids", F.array().cast("array<string>")))),
        size("building_block_ids"), size("building_block_providers"), F.coalesce("bb_priority", F.lit(999)), F.length(F.coalesce("react_trace", F.lit(""))), F.length(F.coalesce("pathway", F.lit(""))), F.coalesce("searched_smiles", F.lit("")), F.coalesce("query_transforms", F.lit("")), "route_id", "ingested_at",
    ]
    r = table(spark, d, "routes").where("query_smiles is not null")
    return r.select("route_id", "ingested_at", F.row_number().over(Window.partitionBy("query_smiles").orderBy(*keys)).alias("place"))


def largest_first(spark, d):
    """The ten largest parts of each brand, largest first; equal ones by number."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc(), "p_partkey"))
    return table(spark, d, "part").withColumn("rank", n).where("rank <= 10").select("p_brand", "p_partkey", "rank")


def contained_names(spark, d):
    """For every type the largest parts whose words a part name of the type also holds, smaller than it: containment by word lists."""
    w = table(spark, d, "part").groupBy("p_type", F.col("p_size").alias("size")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    w = w.withColumn("words", F.array_sort(F.array_distinct(F.flatten(F.transform("names", lambda x: F.split(x, " ")))))).drop("names")
    rows = w.select("p_type", "size", F.size("words").alias("n"), F.explode("words").alias("word"))
    met = rows.join(rows.toDF("p_type", "size_b", "n_b", "word"), ["p_type", "word"]).where("size_b < size").groupBy("p_type", "size", "size_b", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    k = F.row_number().over(Window.partitionBy("p_type", "size").orderBy(F.col("size_b").desc()))
    return met.where(F.col("shared") >= 0.5 * F.col("n_b")).withColumn("k", k).where("k <= 2").select("p_type", "size", "size_b", "shared")


QUERIES = {f.__name__: f for f in (inferred_features, needs_index, fitting_rules, membership_fits, theta_roles, unknown_roles, leave_one_out, role_pairs, fallback_candidates, full_route_order, largest_first, contained_names)}
_B = "b AS (SELECT id, min(trim(smiles)) AS s, min(coalesce(priority, 100)) AS priority FROM building_blocks WHERE smiles IS NOT NULL AND trim(smiles) <> '' GROUP BY id), bf AS (SELECT id, list_filter([CASE WHEN contains(s, 'c1') THEN 'aromatic' WHEN contains(s, '1') THEN 'ring' END, CASE WHEN contains(s, 'N') THEN 'amine' END, CASE WHEN contains(s, 'C(=O)O') THEN 'acid' WHEN contains(s, 'O') THEN 'oxygen' END, CASE WHEN regexp_matches(s, 'F|Cl|Br|I') THEN 'halogen' END], lambda x: x IS NOT NULL) AS f FROM b)"
_R = "rn AS (SELECT DISTINCT id, unnest(list_filter([CASE WHEN contains(reaction, 'N') THEN 'amine' END, CASE WHEN contains(reaction, 'Br') THEN 'halogen' END, CASE WHEN contains(reaction, 'OH') THEN 'oxygen' END, ''], lambda x: x IS NOT NULL)) AS feature FROM reaction_rules), rc AS (SELECT id, count(*) - 1 AS n_need FROM rn GROUP BY id), ri AS (SELECT rc.id, n_need, feature FROM rc JOIN rn ON rn.id = rc.id WHERE feature <> '' UNION ALL SELECT id, 0, NULL FROM rc WHERE n_need = 0)"
SQL = {
    "inferred_features": f"WITH {_B} SELECT id, array_to_string(f, '+') AS features FROM bf",
    "needs_index": f"WITH {_R} SELECT feature, count(*) AS n_rules, max(n_need) AS most FROM ri GROUP BY 1",
    "fitting_rules": f"WITH {_B}, {_R}, h AS (SELECT id AS block, unnest(f) AS feature FROM bf), m AS (SELECT block, ri.id, count(*) AS n, max(n_need) AS n_need FROM h JOIN ri USING (feature) GROUP BY ALL), a AS (SELECT block, id FROM m WHERE n = n_need UNION ALL SELECT bf.id, ri.id FROM bf, ri WHERE ri.feature IS NULL) SELECT block, count(*) AS n_rules FROM a GROUP BY 1",
    "membership_fits": "WITH k AS (SELECT lower(trim(building_block_providers[1])) AS x, lower(trim(building_block_providers[2])) AS y FROM routes WHERE len(building_block_providers) = 2), m AS (SELECT coalesce(x IN ('orvend', 'kelmora', 'brixel'), false) AS x0, coalesce(y IN ('orvend', 'kelmora', 'brixel'), false) AS y0, coalesce(x IN ('talvane', 'pelorus', 'quillon'), false) AS x1, coalesce(y IN ('talvane', 'pelorus', 'quillon'), false) AS y1 FROM k) SELECT x0 AND y1 OR y0 AND x1 AS fits, count(*) AS n FROM m GROUP BY 1",
    "theta_roles": "SELECT rule, role, count(*) AS n, max(p_partkey) AS last FROM part JOIN (VALUES ('low', 0, 0.0, 930.0), ('mid', 1, 910.0, 970.0), ('high', 2, 960.0, 9999.0)) v(rule, role, lo, hi) ON p_retailprice BETWEEN lo AND hi GROUP BY ALL",
    "unknown_roles": "WITH m AS (SELECT DISTINCT l_returnflag AS rule, l_linenumber AS role, l_suppkey AS item FROM lineitem) SELECT CASE WHEN rule NOT IN ('A', 'R') THEN 'rule' WHEN role NOT BETWEEN 1 AND 4 THEN 'role' END AS why, count(*) AS n FROM m GROUP BY 1 HAVING why IS NOT NULL",
    "leave_one_out": "WITH w AS (SELECT p_brand || '/' || p_type AS w, p_brand, CAST(floor(avg(p_size)) AS INT) AS expected FROM part GROUP BY p_brand, p_type), c AS (SELECT w, p_partkey AS item, p_size AS size, row_number() OVER (PARTITION BY w ORDER BY floor(p_retailprice), abs(p_size - expected), p_partkey) AS rank FROM w JOIN part USING (p_brand) WHERE abs(p_size - expected) <= 4 OR p_size <= 5) SELECT w, item, size, CAST(rank AS INT) AS rank FROM c WHERE rank <= 8",
    "role_pairs": "WITH m AS (SELECT DISTINCT l_suppkey AS rule, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS role, l_partkey AS item, p_size AS size FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT *, row_number() OVER (PARTITION BY rule, role ORDER BY size DESC, item) AS n FROM m), k AS (SELECT * FROM t WHERE n <= 3) SELECT a.rule, a.item AS item_0, a.size AS size_0, b.item AS item_1, b.size AS size_1 FROM k a JOIN k b ON b.rule = a.rule AND a.role = 0 AND b.role = 1",
    "fallback_candidates": "WITH a AS (SELECT s_nationkey AS n_nationkey, s_suppkey, 0 AS level FROM supplier WHERE s_acctbal > 9000), b AS (SELECT s_nationkey, s_suppkey, 1 FROM supplier WHERE s_acctbal > 7000 AND s_nationkey NOT IN (SELECT n_nationkey FROM a)), g AS (SELECT n_regionkey, min(s_suppkey) AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT n_nationkey, s, 2 FROM nation JOIN g USING (n_regionkey) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM a) AND n_nationkey NOT IN (SELECT s_nationkey FROM b)",
    "full_route_order": "SELECT route_id, ingested_at, CAST(row_number() OVER (PARTITION BY query_smiles ORDER BY coalesce(found, false) DESC, coalesce(exact, false) DESC, round(coalesce(CASE WHEN isnan(similarity) THEN -1.0 ELSE similarity END, -1.0), 6) DESC, coalesce(n_steps, 99), len(list_distinct(coalesce(list_transform(reaction_ids, lambda x: coalesce(x, '<null>')), []))), coalesce(len(building_block_ids), -1), coalesce(len(building_block_providers), -1), coalesce(bb_priority, 999), length(coalesce(react_trace, '')), length(coalesce(pathway, '')), coalesce(searched_smiles, ''), coalesce(query_transforms, ''), route_id, ingested_at) AS INT) AS place FROM routes WHERE query_smiles IS NOT NULL",
    "largest_first": "SELECT p_brand, p_partkey, CAST(rank AS INT) AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part) WHERE rank <= 10",
    "contained_names": "WITH r AS (SELECT DISTINCT p_type, p_size AS size, unnest(string_split(p_name, ' ')) AS word FROM part), n AS (SELECT p_type, size, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT a.p_type, a.size, b.size AS size_b, count(*) AS shared FROM r a JOIN r b ON a.p_type = b.p_type AND a.word = b.word AND b.size < a.size GROUP BY ALL), k AS (SELECT m.*, row_number() OVER (PARTITION BY m.p_type, m.size ORDER BY size_b DESC) AS k FROM m JOIN n ON n.p_type = m.p_type AND n.size = m.size_b WHERE shared >= 0.5 * n.n) SELECT p_type, size, size_b, shared FROM k WHERE k <= 2",
}
