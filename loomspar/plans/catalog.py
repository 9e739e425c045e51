"""Catalog queries: scan readings, provider rules, merges and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspar.operators import catalog as ops
from loomspar.session import table

# rules of these queries' own: provider labels by id prefix, and their ranks
PREFIXES = [("orvend", "orvend"), ("kelmora", "kelmora"), ("brixel", "brixel"), ("talvane", "talvane"), ("pelorus", "pelorus"), ("quillon", "quillon"), ("proposed__", "proposed")]
RANKS = {"orvend": 10, "kelmora": 20, "brixel": 30, "talvane": 40, "pelorus": 50, "quillon": 60}


def _blocks(spark, d):
    b = table(spark, d, "building_blocks")
    rows = b.withColumn("prov", ops.prefix_label(F.col("id"), PREFIXES, "other", F.col("provider")))
    return ops.ranked(rows, "prov", RANKS, 100, "rank").withColumn("key", F.when(F.trim("smiles") != "", F.trim("smiles")))


def _case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({column}) LIKE '{p.replace('_', chr(92) + '_')}%' ESCAPE '\\' THEN '{n}'" for p, n in PREFIXES) + " ELSE 'other' END"


_PROV = f"CASE WHEN trim(coalesce(provider, '')) <> '' THEN lower(trim(provider)) ELSE {_case('id')} END"
_RANK = "CASE prov " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " ELSE 100 END"
_BASE = f"WITH b0 AS (SELECT *, {_PROV} AS prov, CASE WHEN trim(smiles) <> '' THEN trim(smiles) END AS key FROM building_blocks), b AS (SELECT *, {_RANK} AS rank FROM b0)"


def provider_labels(spark, d):
    return _blocks(spark, d).groupBy("prov", "rank").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def catalog_merge(spark, d):
    return ops.merge_catalogs(_blocks(spark, d), "key", "id", "prov", "rank", ["loaded_at", "id"], ops.parse_sources(F.col("sources")))


_MERGE = (
    _BASE
    + """, f AS (SELECT key, arg_min(struct_pack(id, prov, rank), struct_pack(rank, loaded_at, id)) AS p FROM b WHERE key IS NOT NULL GROUP BY key),
  t AS (SELECT key, loaded_at, id, list_concat([concat_ws(':', prov, id)], list_filter(list_transform(string_split(coalesce(sources, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS toks FROM b WHERE key IS NOT NULL),
  u AS (SELECT key, loaded_at, id, unnest(toks) AS origin, unnest(range(len(toks))) AS i FROM t),
  o AS (SELECT key, origin, min(struct_pack(loaded_at, id, i)) AS at_ FROM u GROUP BY ALL),
  s AS (SELECT key, list(origin ORDER BY at_) AS srcs FROM o GROUP BY key),
  m AS (SELECT f.key, p.id AS id, p.prov AS provider, p.rank AS priority, srcs, row_number() OVER (PARTITION BY p.id ORDER BY p.rank, f.key) - 1 AS n FROM f JOIN s ON s.key = f.key),
  r AS (SELECT *, CASE WHEN n > 0 THEN id || '__' || n ELSE id END AS nid FROM m)"""
)


def catalog_merge_stats(spark, d):
    rows = _blocks(spark, d)
    return ops.merge_stats(rows, catalog_merge(spark, d), "key")


def catalog_last_writer(spark, d):
    rows = table(spark, d, "reaction_rules").select("id", "name", "molecularity", "loaded_at", F.coalesce("source", F.lit("")).alias("source"))
    return ops.keep_last(rows, ["id"], ["loaded_at", "source"]).select("id", "name", "molecularity")


def catalog_first_text(spark, d):
    rows = table(spark, d, "reaction_rules").select("reaction", "id", "molecularity", "loaded_at")
    return ops.keep_first(rows, ["reaction"], ["loaded_at", "id"]).select("reaction", "id")


def rule_merge(spark, d):
    """First-seen text, then ids made unique by their source, and arity counts by source."""
    rows = table(spark, d, "reaction_rules").select("reaction", "id", F.coalesce("source", F.lit("none")).alias("source"), "molecularity", "loaded_at")
    first = ops.keep_first(rows, ["reaction"], ["loaded_at", "id"])
    return ops.rename_clashes(first, "id", "source", ["loaded_at", "reaction"]).select("id", "source", "molecularity")


def rules_not_in_main(spark, d):
    r = table(spark, d, "reaction_rules")
    return ops.without_known(r.where("explicit_hs").select("id", "reaction"), r.where(~F.col("explicit_hs")).select("id", "reaction"), ["id", "reaction"]).distinct()


def rule_arity(spark, d):
    """Text-level molecularity: the reactant side's parts, against the stored number."""
    side = F.split(F.element_at(F.split("reaction", ">>"), 1), r"\.")
    return table(spark, d, "reaction_rules").groupBy("molecularity", F.size(side).alias("parts")).agg(F.count(F.lit(1)).alias("n"))


def catalog_order(spark, d):
    return catalog_merge(spark, d).groupBy("provider").agg(F.min(F.struct("priority", "key")).alias("f")).select("provider", F.col("f.priority").alias("priority"), F.col("f.key").alias("first_key"))


def generic_branches(spark, d):
    """Halogens folded into one token, parts sorted: branches that differ in no other way are counted together."""
    parts = F.filter("building_block_smiles", lambda x: x.isNotNull() & (x != ""))
    generic = F.array_join(F.array_sort(F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("Cl"), F.lit("X")), F.lit("Br"), F.lit("X")), F.lit("I"), F.lit("X")))), ".")
    return table(spark, d, "routes").where(F.size(parts) > 0).groupBy(generic.alias("branch")).agg(F.countDistinct("route_id").alias("n_routes"))


def catalog_provider_stats(spark, d):
    """Of every provider the merged entries, those from several sources, and the keys that another provider offers as well."""
    b = _blocks(spark, d).where("key is not null")
    shared = b.groupBy("key").agg(F.count_distinct("prov").alias("k")).where("k > 1").select("key", F.lit(1).alias("shared"))
    offers = b.select("prov", "key").distinct().join(shared, "key", "left").groupBy(F.col("prov").alias("provider")).agg(F.count(F.lit(1)).alias("n_keys"), F.count("shared").alias("n_collisions"))
    merged = catalog_merge(spark, d).groupBy("provider").agg(F.count(F.lit(1)).alias("n_merged"), F.count_if(F.col("n_sources") > 1).alias("n_multi"))
    return offers.join(merged, "provider", "left").na.fill(0)


QUERIES = {f.__name__: f for f in (provider_labels, catalog_merge, catalog_merge_stats, catalog_last_writer, catalog_first_text, rule_merge, rules_not_in_main, rule_arity, catalog_order, generic_branches, catalog_provider_stats)}
SQL = {
    "provider_labels": _BASE + " SELECT prov, CAST(rank AS INT) AS rank, count(*) AS n, count(DISTINCT id) AS n_ids FROM b GROUP BY prov, rank",
    "catalog_merge": _MERGE + " SELECT key, nid AS id, provider, priority, array_to_string(list_transform(srcs, lambda x: CASE WHEN x = concat_ws(':', provider, id) THEN concat_ws(':', provider, nid) ELSE x END), ';') AS sources, CAST(len(srcs) AS INT) AS n_sources FROM r",
    "catalog_merge_stats": _MERGE + " SELECT (SELECT count(*) FROM b) AS n_input, (SELECT count(*) FROM b WHERE key IS NULL) AS n_invalid, count(*) AS n_output, count(*) FILTER (len(srcs) = 1) AS n_single, count(*) FILTER (len(srcs) > 1) AS n_multi FROM r",
    "catalog_provider_stats": _MERGE + ", c AS (SELECT key, count(DISTINCT prov) AS k FROM b WHERE key IS NOT NULL GROUP BY key), off AS (SELECT prov AS provider, count(*) AS n_keys, count(*) FILTER (k > 1) AS n_collisions FROM (SELECT DISTINCT prov, key FROM b WHERE key IS NOT NULL) JOIN c USING (key) GROUP BY 1), g AS (SELECT provider, count(*) AS n_merged, count(*) FILTER (len(srcs) > 1) AS n_multi FROM r GROUP BY 1) SELECT provider, n_keys, n_collisions, coalesce(n_merged, 0) AS n_merged, coalesce(n_multi, 0) AS n_multi FROM off LEFT JOIN g USING (provider)",
    "catalog_last_writer": "SELECT id, m.name AS name, m.molecularity AS molecularity FROM (SELECT id, arg_max(struct_pack(name, molecularity), struct_pack(loaded_at, s := coalesce(source, ''))) AS m FROM reaction_rules GROUP BY id)",
    "catalog_first_text": "SELECT reaction, arg_min(id, struct_pack(loaded_at, id)) AS id FROM reaction_rules GROUP BY reaction",
    "rule_merge": "WITH f AS (SELECT reaction, arg_min(struct_pack(id, s := coalesce(source, 'none'), m := molecularity, t := loaded_at), struct_pack(loaded_at, id)) AS p FROM reaction_rules GROUP BY reaction) SELECT CASE WHEN row_number() OVER (PARTITION BY p.id ORDER BY p.t, reaction) > 1 THEN p.id || '__' || p.s ELSE p.id END AS id, p.s AS source, p.m AS molecularity FROM f",
    "rules_not_in_main": "SELECT DISTINCT id, reaction FROM reaction_rules WHERE explicit_hs AND id NOT IN (SELECT id FROM reaction_rules WHERE NOT explicit_hs) AND reaction NOT IN (SELECT reaction FROM reaction_rules WHERE NOT explicit_hs)",
    "rule_arity": "SELECT molecularity, CAST(len(string_split(string_split(reaction, '>>')[1], '.')) AS INT) AS parts, count(*) AS n FROM reaction_rules GROUP BY ALL",
    "catalog_order": _MERGE + ", g AS (SELECT provider, min(struct_pack(priority, key)) AS f FROM r GROUP BY provider) SELECT provider, f.priority AS priority, f.key AS first_key FROM g",
    "generic_branches": "WITH p AS (SELECT route_id, list_filter(building_block_smiles, lambda x: x IS NOT NULL AND x <> '') AS s FROM routes) SELECT array_to_string(list_sort(list_transform(s, lambda x: replace(replace(replace(x, 'Cl', 'X'), 'Br', 'X'), 'I', 'X'))), '.') AS branch, count(DISTINCT route_id) AS n_routes FROM p WHERE len(s) > 0 GROUP BY ALL",
}
