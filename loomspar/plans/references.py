"""Queries of problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.operators.references import design_parents, design_references, orphan_references
from loomspar.session import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    children = design_references(table(spark, folder, "routes"), table(spark, folder, "procedure_cards"))
    parents = design_parents(table(spark, folder, "reaction_rules"), table(spark, folder, "building_blocks"))
    return orphan_references(children, parents)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("src_table", "src_id", "field", "ref_id").distinct()


def p3_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field, month and reason."""
    month = F.date_format("at", "yyyy-MM")
    return _orphans(spark, folder).groupBy("src_table", "field", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref_id").alias("n_keys"))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ITEM = f"lower({_TRIM})"
_RULE = r"regexp_replace(regexp_replace(regexp_replace(" + _ITEM + r", '__retro$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _sql(tail: str) -> str:
    none = "('', 'nan', 'na', 'none')"
    return f"""
WITH raw AS (
  SELECT 'reaction_rules' AS ptable, 'routes' AS src_table, route_id AS src_id, 'reaction_ids' AS field, unnest(reaction_ids) AS r, created_at AS at_ FROM routes
  UNION ALL
  SELECT 'building_blocks', 'routes', route_id, 'building_block_ids', unnest(building_block_ids), created_at FROM routes
  UNION ALL
  SELECT 'reaction_rules', 'procedure_cards', card_id, 'reaction_id', reaction_id, prepared_at FROM procedure_cards
), child AS (
  SELECT ptable, src_table, src_id, field, at_,
         CASE WHEN ptable = 'reaction_rules' THEN {_RULE.format('r')} ELSE {_ITEM.format('r')} END AS ref_id
  FROM raw
  WHERE r IS NOT NULL AND {_ITEM.format('r')} NOT IN {none}
    AND NOT (ptable = 'building_blocks' AND {_ITEM.format('r')} LIKE 'proposed\\_\\_%' ESCAPE '\\')
    AND NOT (src_table = 'procedure_cards' AND {_ITEM.format('r')} LIKE 'class:%')
), parent AS (
  SELECT 'reaction_rules' AS ptable, {_RULE.format('id')} AS k, loaded_at, deleted_at FROM reaction_rules
  UNION ALL
  SELECT 'building_blocks', {_ITEM.format('id')}, loaded_at, deleted_at FROM building_blocks
), keys AS (
  SELECT c.ptable, c.ref_id, c.at_, count(p.k) AS n_rows, count(*) FILTER (p.loaded_at <= c.at_) AS n_before,
         count(*) FILTER (p.loaded_at <= c.at_ AND (p.deleted_at IS NULL OR p.deleted_at > c.at_)) AS n_good
  FROM (SELECT DISTINCT ptable, ref_id, at_ FROM child) c LEFT JOIN parent p ON p.ptable = c.ptable AND p.k = c.ref_id
  GROUP BY ALL
), orphan AS (
  SELECT DISTINCT c.src_table, c.src_id, c.field, c.ref_id, c.at_,
         CASE WHEN k.n_rows = 0 THEN 'missing' WHEN k.n_before > 0 THEN 'withdrawn' ELSE 'not_loaded' END AS reason
  FROM child c JOIN keys k ON k.ptable = c.ptable AND k.ref_id = c.ref_id AND k.at_ IS NOT DISTINCT FROM c.at_
  WHERE k.n_good = 0
)
{tail}"""


SQL = {
    "p3_found": _sql("SELECT DISTINCT src_table, src_id, field, ref_id FROM orphan"),
    "p3_by_month": _sql("SELECT src_table, field, strftime(at_, '%Y-%m') AS month, reason, count(*) AS n_orphans, count(DISTINCT ref_id) AS n_keys FROM orphan GROUP BY ALL"),
}
QUERIES = {"p3_found": p3_found, "p3_by_month": p3_by_month}
