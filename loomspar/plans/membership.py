"""Membership, validation, division and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspar.operators import relations as ops
from loomspar.operators.references import item_key, rule_key
from loomspar.session import table


def _members(spark, d):
    """Order = rule, parity of the line = role, part = item."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("rule"), (F.col("l_linenumber") % 2).alias("role"), F.col("l_partkey").alias("item"))


def complementary_roles(spark, d):
    return ops.complementary(_members(spark, d), "rule", "role", "item")


def min_role_count(spark, d):
    per = _members(spark, d).distinct().groupBy("rule", "role").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("rule").agg(F.min("n").alias("min_items"), F.count(F.lit(1)).alias("n_roles"))


def unknown_members(spark, d):
    """Membership rows whose item no catalog row offers, per rule."""
    li, part = _members(spark, d), table(spark, d, "part").where(F.col("p_size") > 25).select(F.col("p_partkey").alias("item"))
    return li.join(part, "item", "left_anti").groupBy("rule").agg(F.countDistinct("item").alias("n_unknown"))


def nations_that_cover(spark, d):
    """Relational division: customers whose orders have every status that some order of their segment group needs."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    have = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("item"))
    need = c.join(o, F.col("c_custkey") == F.col("o_custkey")).where(F.col("o_totalprice") > 400000).select(F.col("c_mktsegment").alias("grp"), F.col("o_orderpriority").alias("item"))
    return ops.divides(have, need, "owner", "grp", "item")


def replaced_columns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    right = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return ops.replacing_join(o, right, ["o_orderkey"])


def card_lookup(spark, d):
    """Cards for rules: by id, else by alias, else by class tag of the rule's name, else none."""
    rules = table(spark, d, "reaction_rules").select(rule_key(F.col("id")).alias("k")).distinct()
    cards = table(spark, d, "procedure_cards").select("card_id", "reaction_id", "aliases", "class_tags")
    exact = cards.where(F.col("reaction_id").isNotNull()).select(rule_key(F.col("reaction_id")).alias("k"), "card_id", F.col("card_id").alias("ord"))
    alias = cards.select(F.posexplode("aliases").alias("ord", "a"), "card_id").select(rule_key(F.col("a")).alias("k"), "card_id", (F.col("card_id") * 100 + F.col("ord")).alias("ord"))
    tags = cards.select(F.explode("class_tags").alias("tag"), "card_id").groupBy(F.lower("tag").alias("tag")).agg(F.min("card_id").alias("card_id"))
    by_class = rules.withColumn("tag", F.element_at(F.split("k", "_"), -1)).join(tags, "tag").select("k", "card_id", F.col("card_id").alias("ord"))
    return ops.cascade(rules, [("id", exact), ("alias", alias), ("class", by_class)], "k", "card_id")


def first_refs(spark, d):
    """Literature keys per rule in card order, distinct, the first five."""
    c = table(spark, d, "procedure_cards").where(F.col("reaction_id").isNotNull()).select(rule_key(F.col("reaction_id")).alias("k"), "card_id", F.posexplode("openalex_keys").alias("i", "ref"))
    first = c.where(F.col("ref").isNotNull() & (F.col("ref") != "")).groupBy("k", "ref").agg(F.min(F.struct("card_id", "i")).alias("at"))
    listed = first.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "ref"))).alias("r"))
    return listed.select("k", F.array_join(F.slice("r.ref", 1, 5), ";").alias("refs"), F.size("r").alias("n_refs"))


def available_blocks(spark, d):
    """Block uses per provider, of blocks that the catalog holds (semi) and lacks (anti)."""
    uses = table(spark, d, "routes").select(F.explode("building_block_ids").alias("b")).where(F.col("b").isNotNull()).select(item_key(F.col("b")).alias("k"))
    known = table(spark, d, "building_blocks").select(item_key(F.col("id")).alias("k")).distinct().withColumn("known", F.lit(True))
    return uses.join(known, "k", "left").groupBy(F.split_part("k", F.lit("_"), F.lit(1)).alias("prefix"), F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (complementary_roles, min_role_count, unknown_members, nations_that_cover, replaced_columns, card_lookup, first_refs, available_blocks)}
_M = "WITH m AS (SELECT DISTINCT l_orderkey AS rule, l_linenumber % 2 AS role, l_partkey AS item FROM lineitem)"
_T = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_K = r"regexp_replace(regexp_replace(regexp_replace(" + _T + r", '__retro$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
SQL = {
    "complementary_roles": _M + ", o AS (SELECT rule, item, min(role) AS role FROM m GROUP BY ALL HAVING count(*) = 1), s AS (SELECT rule, 1 - role AS role, count(*) AS n_partners FROM m GROUP BY ALL) SELECT o.rule, item, o.role, n_partners FROM o JOIN s ON s.rule = o.rule AND s.role = o.role",
    "min_role_count": _M + ", p AS (SELECT rule, role, count(*) AS n FROM m GROUP BY ALL) SELECT rule, min(n) AS min_items, count(*) AS n_roles FROM p GROUP BY rule",
    "unknown_members": _M + " SELECT rule, count(DISTINCT item) AS n_unknown FROM m WHERE item NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY rule",
    "nations_that_cover": "WITH need AS (SELECT DISTINCT c_mktsegment AS grp, o_orderpriority AS item FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000), n AS (SELECT grp, count(*) AS n_need FROM need GROUP BY 1), m AS (SELECT o_custkey AS owner, grp, count(*) AS n_met FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) h JOIN need ON item = o_orderpriority GROUP BY ALL) SELECT owner, m.grp AS grp FROM m JOIN n ON n.grp = m.grp WHERE n_met = n_need",
    "replaced_columns": "SELECT o_orderkey, o_orderstatus, round(sum(l_extendedprice), 2) AS o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "card_lookup": f"""WITH r AS (SELECT DISTINCT {_K.format('id')} AS k FROM reaction_rules), e AS (SELECT {_K.format('reaction_id')} AS k, card_id, card_id AS ord, 0 AS level FROM procedure_cards WHERE reaction_id IS NOT NULL),
  a0 AS (SELECT card_id, unnest(aliases) AS a, unnest(range(len(aliases))) AS i FROM procedure_cards), a AS (SELECT {_K.format('a')} AS k, card_id, card_id * 100 + i AS ord, 1 AS level FROM a0),
  t AS (SELECT lower(tag) AS tag, min(card_id) AS card_id FROM (SELECT unnest(class_tags) AS tag, card_id FROM procedure_cards) GROUP BY 1),
  c AS (SELECT k, card_id, card_id AS ord, 2 AS level FROM r JOIN t ON tag = string_split(k, '_')[-1]),
  b AS (SELECT k, min(struct_pack(level, ord, card_id)) AS b FROM (FROM e UNION ALL FROM a UNION ALL FROM c) GROUP BY k)
  SELECT r.k, b.card_id AS card_id, CASE b.level WHEN 0 THEN 'id' WHEN 1 THEN 'alias' WHEN 2 THEN 'class' END AS matched_by FROM r LEFT JOIN b ON b.k = r.k""",
    "first_refs": f"""WITH c AS (SELECT {_K.format('reaction_id')} AS k, card_id, unnest(openalex_keys) AS ref, unnest(range(len(openalex_keys))) AS i FROM procedure_cards WHERE reaction_id IS NOT NULL),
  f AS (SELECT k, ref, min(struct_pack(card_id, i)) AS at_ FROM c WHERE ref IS NOT NULL AND ref <> '' GROUP BY ALL), l AS (SELECT k, list(ref ORDER BY at_) AS r FROM f GROUP BY k) SELECT k, array_to_string(r[1:5], ';') AS refs, CAST(len(r) AS INT) AS n_refs FROM l""",
    "available_blocks": f"WITH u AS (SELECT {_T.format('b')} AS k FROM (SELECT unnest(building_block_ids) AS b FROM routes) WHERE b IS NOT NULL) SELECT string_split(k, '_')[1] AS prefix, k IN (SELECT {_T.format('id')} FROM building_blocks) AS known, count(*) AS n FROM u GROUP BY ALL",
}
