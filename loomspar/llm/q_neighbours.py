"""Queries of problem 5: the most similar blocks of every block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspar.llm.neighbours import nearest_pairs
from loomspar.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_pairs(table(spark, folder, "building_blocks"), "id", "fp").select("id_a", "id_b")


QUERIES = {"p5_found": p5_found}
# brute force over posting lists; the forest is approximate, and equal to this at the sizes where nearly all leaves are opened
SQL = {
    "p5_found": """WITH s AS (SELECT id, max(list_sort(list_distinct(list_filter(fp, lambda b: b IS NOT NULL AND b BETWEEN 0 AND 2047)))) AS b FROM building_blocks WHERE id IS NOT NULL AND len(fp) > 0 GROUP BY id),
  e AS (SELECT id, len(b) AS n, unnest(b) AS bit FROM s),
  m AS (SELECT x.id AS q, y.id AS o, count(*) AS k, any_value(x.n) + any_value(y.n) AS t FROM e x JOIN e y ON x.bit = y.bit AND x.id <> y.id GROUP BY x.id, y.id),
  r AS (SELECT q, o, row_number() OVER (PARTITION BY q ORDER BY k / (t - k) DESC, o) AS n, k / (t - k) AS sim FROM m WHERE k / (t - k) >= 0.5)
  SELECT DISTINCT least(q, o) AS id_a, greatest(q, o) AS id_b FROM r WHERE n <= 5"""
}
