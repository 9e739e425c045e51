"""References to records that do not exist, were withdrawn or had not arrived yet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING = ("", "nan", "na", "none")  # words that stand for "no reference"
FOREVER = "9999-12-31 23:59:59.999999"


def outer_trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def item_key(c: Column) -> Column:
    """Normal form of an item id: trimmed, lower case."""
    return F.lower(outer_trim(c))


def rule_key(c: Column) -> Column:
    """Normal form of a rule id: one final ``__retro`` dropped, other characters than a-z and 0-9
    folded into single ``_`` signs, none of them at the ends."""
    base = F.regexp_replace(item_key(c), "__retro$", "")
    return F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_reference(c: Column, placeholder_prefix: str | None = None) -> Column:
    """False for null, blank and the words for nothing, and for ids with the given prefix."""
    plain = item_key(c)
    ok = c.isNotNull() & ~plain.isin(*NOTHING)
    return ok & ~plain.startswith(placeholder_prefix) if placeholder_prefix else ok


def availability(parents: DataFrame) -> DataFrame:
    """``(parent_table, key, loaded_at, deleted_at)`` rows as disjoint periods ``(parent_table, key, lo, hi)``.

    Rows are deduplicated map-side first, so that a key offered again and again shrinks before the
    shuffle; overlapping periods are merged. A null ``deleted_at`` is open-ended; a null ``loaded_at``
    never becomes available, but the key counts as known.
    """
    forever = F.lit(FOREVER).cast("timestamp_ntz")
    rows = (
        parents.where(F.col("key").isNotNull())
        .groupBy("parent_table", "key", F.col("loaded_at").cast("timestamp_ntz").alias("lo"))
        .agg(F.max(F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), forever)).alias("hi"))
    )
    w = Window.partitionBy("parent_table", "key").orderBy(F.col("lo").asc_nulls_last())
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("fresh", F.when(F.col("lo").isNull() | before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("fresh").over(w))
    return islands.groupBy("parent_table", "key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def orphan_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a parent row that was available at the reference's own time.

    ``children``: ``parent_table, src_table, src_id, field, ref_id, at`` (keys in normal form);
    ``parents``: ``parent_table, key, loaded_at, deleted_at``.
    Gives ``src_table, src_id, field, ref_id, at, reason``, one row per distinct reference and time;
    ``reason`` is ``missing``, ``not_loaded`` (only later rows exist) or ``withdrawn``.

    Parent and child keys are united in tagged long form and grouped by parent table and key. The
    grouping carries only a flag, the (merged) periods and the span of reference times, so hot keys
    collapse in the map-side aggregation. Groups that lack a parent, or whose periods do not cover
    every reference time, are kept and joined back to the references; that join is left to AQE,
    which broadcasts a small set of suspects and splits skewed keys.

    A null ``ref_id`` is no reference. A null ``at`` cannot be shown to be covered and is reported.
    Empty inputs give an empty result; further columns are ignored.
    """
    at = F.col("at").cast("timestamp_ntz")
    child = children.where(F.col("ref_id").isNotNull()).select("parent_table", "src_table", "src_id", "field", "ref_id", at.alias("at"))
    periods = availability(parents)
    none = F.lit(None).cast("timestamp_ntz")
    long_form = child.select(
        "parent_table", F.col("ref_id").alias("key"), F.lit(False).alias("is_parent"), none.alias("lo"), none.alias("hi"), "at", F.lit(True).alias("is_child")
    ).unionByName(periods.select("parent_table", "key", F.lit(True).alias("is_parent"), "lo", "hi", none.alias("at"), F.lit(False).alias("is_child")))
    period = F.when(F.col("is_parent"), F.struct("lo", "hi"))
    grouped = long_form.groupBy("parent_table", "key").agg(
        F.max("is_parent").alias("known"),
        F.max("is_child").alias("used"),
        F.collect_list(period).alias("periods"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.max(F.col("is_child") & F.col("at").isNull()).alias("undated"),
    )
    covers_all = F.exists("periods", lambda p: (p["lo"] <= F.col("first_at")) & (p["hi"] > F.col("last_at")))
    suspects = grouped.where(F.col("used") & (~F.col("known") | F.col("undated") | ~F.coalesce(covers_all, F.lit(False)))).select(
        F.col("parent_table").alias("s_table"), F.col("key").alias("s_key"), "known", "periods"
    )
    good = F.exists("periods", lambda p: (p["lo"] <= F.col("at")) & (p["hi"] > F.col("at")))
    earlier = F.exists("periods", lambda p: p["lo"] <= F.col("at"))
    return (
        child.join(suspects, (F.col("parent_table") == F.col("s_table")) & (F.col("ref_id") == F.col("s_key")))
        .where(~F.coalesce(good, F.lit(False)))
        .select(
            "src_table", "src_id", "field", "ref_id", "at",
            F.when(~F.col("known"), "missing").when(F.coalesce(earlier, F.lit(False)), "withdrawn").otherwise("not_loaded").alias("reason"),
        )
        .distinct()
    )


def exploded_references(df: DataFrame, parent: str, src: str, src_id: str, field: str, at: str, key, prefix: str | None = None) -> DataFrame:
    """Long-form child rows from one column that holds a key or an array of keys."""
    column = F.col(f"`{field}`")
    if dict(df.dtypes)[field].startswith("array"):
        column = F.explode(column)
    rows = df.select(F.col(src_id).cast("bigint").alias("src_id"), F.col(at).alias("at"), column.alias("raw"))
    return rows.where(is_reference(F.col("raw"), prefix)).select(
        F.lit(parent).alias("parent_table"), F.lit(src).alias("src_table"), "src_id", F.lit(field).alias("field"), key(F.col("raw")).alias("ref_id"), "at"
    )


def design_references(routes: DataFrame, cards: DataFrame) -> DataFrame:
    """The references of routes and procedure cards in long form."""
    parts = [
        exploded_references(routes, "reaction_rules", "routes", "route_id", "reaction_ids", "created_at", rule_key),
        exploded_references(routes, "building_blocks", "routes", "route_id", "building_block_ids", "created_at", item_key, "proposed__"),
        exploded_references(cards, "reaction_rules", "procedure_cards", "card_id", "reaction_id", "prepared_at", rule_key, "class:"),
    ]
    return reduce(DataFrame.unionByName, parts)


def design_parents(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows that rules and blocks offer, in long form."""
    return rules.select(F.lit("reaction_rules").alias("parent_table"), rule_key(F.col("id")).alias("key"), "loaded_at", "deleted_at").unionByName(
        blocks.select(F.lit("building_blocks").alias("parent_table"), item_key(F.col("id")).alias("key"), "loaded_at", "deleted_at")
    )
