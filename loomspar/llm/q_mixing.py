"""Queries of problem 1: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.llm.mixing import block_draws, draw_mix, mix_report
from loomspar.session import table

MIX = ["mix_id", "stage", "datasets", "weights", "num_samples_per_epoch_per_gpu", "max_repeats", "ingested_at"]
ITEM = ["item_id", "datadir", "split"]


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "mixed_dataset_params").select(*MIX), table(spark, folder, "dataset_items").select(*ITEM)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose target cannot be met within the cap, out of the report on what was drawn."""
    return mix_report(*_tables(spark, folder)).where("over").select("mix_id", "dataset_pos")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of every entry."""
    return mix_report(*_tables(spark, folder)).select("mix_id", "dataset_pos", "source", "n_records", F.round("target", 3).alias("target"), "drawn", F.round("share_reached", 6).alias("share_reached"))


def p1_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Every mix as runs of source blocks by output shard."""
    return block_draws(*_tables(spark, folder))


def p1_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every mix, by output shard in its random order."""
    return draw_mix(*_tables(spark, folder))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PATH = "array_to_string(list_filter(string_split(" + _TRIM + ", '/'), lambda s: s NOT IN ('', '.')), '/')"
_SPLIT = f"""CASE WHEN lower({_TRIM}) IN ('train', 'training', 'trn') THEN 'train'
  WHEN lower({_TRIM}) IN ('val', 'valid', 'validation', 'validate', 'dev', 'development') THEN 'val'
  WHEN lower({_TRIM}) IN ('test', 'testing', 'tst') THEN 'test' END"""

_ENTRIES = f"""
WITH once AS (
  SELECT mix_id, arg_max(struct_pack(stage, datasets, weights, n := num_samples_per_epoch_per_gpu, max_repeats), ingested_at) AS m FROM mixed_dataset_params GROUP BY mix_id
), mix AS (
  SELECT mix_id, {_SPLIT.format('m.stage')} AS split, m.datasets AS datasets, m.n AS epoch, m.max_repeats AS max_repeats,
    CASE WHEN m.weights IS NULL THEN list_transform(m.datasets, lambda x: CAST(1 AS DECIMAL(24,9)))
         ELSE list_transform(m.weights, lambda x: coalesce(CAST(x AS DECIMAL(24,9)), 0)) END AS w
  FROM once
), entry AS (
  SELECT mix_id, split, epoch, max_repeats, list_sum(w) AS weight_sum, unnest(w) AS weight, unnest(datasets) AS d, unnest(range(len(datasets))) AS dataset_pos
  FROM mix WHERE epoch > 0 AND len(w) = len(datasets) AND list_sum(w) > 0
), size AS (
  SELECT {_PATH.format('datadir')} AS source, {_SPLIT.format('split')} AS split, count(DISTINCT item_id) AS n_records FROM dataset_items GROUP BY ALL
), q AS (
  SELECT e.*, {_PATH.format('e.d')} AS source, coalesce(s.n_records, 0) AS n_records
  FROM entry e LEFT JOIN size s ON s.source = {_PATH.format('e.d')} AND s.split = e.split
)"""

SQL = {
    "p1_found": _ENTRIES + " SELECT mix_id, CAST(dataset_pos AS INT) AS dataset_pos FROM q WHERE epoch * weight > max_repeats * n_records * weight_sum",
    "p1_shares": _ENTRIES
    + """, t AS (SELECT *, round(epoch * CAST(weight / weight_sum AS DOUBLE), 6) AS target FROM q),
  r AS (SELECT *, floor(target) + CASE WHEN row_number() OVER (PARTITION BY mix_id ORDER BY round(target - floor(target), 6) DESC, dataset_pos) <= epoch - sum(floor(target)) OVER (PARTITION BY mix_id) THEN 1 ELSE 0 END AS wish FROM t),
  c AS (SELECT *, max_repeats * n_records AS cap, coalesce(sum(wish) OVER (PARTITION BY mix_id, source ORDER BY dataset_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
  f AS (SELECT *, CAST(least(wish, cap - least(before, cap)) AS BIGINT) AS drawn FROM c)
  SELECT mix_id, CAST(dataset_pos AS INT) AS dataset_pos, source, n_records, round(target, 3) AS target, drawn, round(CASE WHEN sum(drawn) OVER (PARTITION BY mix_id) > 0 THEN drawn / sum(drawn) OVER (PARTITION BY mix_id) END, 6) AS share_reached FROM f""",
}
QUERIES = {"p1_found": p1_found, "p1_shares": p1_shares, "p1_draws": p1_draws, "p1_mix": p1_mix}
