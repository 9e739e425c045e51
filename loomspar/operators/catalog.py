"""Multi-source catalogs: providers, priorities and provenance-keeping deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_label(c: Column, rules: list[tuple[str, str]], default: str, explicit: Column | None = None) -> Column:
    """An ordered list of ``(prefix, label)`` over the lower-cased text; an explicit label, where it is
    not blank, goes before the rules."""
    out = F.lit(default)
    for prefix, name in reversed(rules):
        out = F.when(F.lower(c).startswith(prefix), name).otherwise(out)
    if explicit is not None:
        out = F.when(F.trim(F.coalesce(explicit, F.lit(""))) != "", F.lower(F.trim(explicit))).otherwise(out)
    return out


def ranked(df: DataFrame, column: str, ranks: dict[str, int], default: int, out: str = "priority") -> DataFrame:
    """The rank of a label by a lookup of bounded size (a literal map), unknown labels get the default."""
    lookup = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.element_at(lookup, F.col(column)), F.lit(default)))


def parse_sources(c: Column, sep: str = ";") -> Column:
    """A joined list as an array without empty entries; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def origin_token(provider: Column, item: Column) -> Column:
    return F.concat_ws(":", provider, item)


def union_sources(tables: list[DataFrame]) -> DataFrame:
    """Catalogs of partly different columns under each other, with the ordinal of their table."""
    tagged = [t.withColumn("source_ord", F.lit(i)) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_catalogs(rows: DataFrame, key: str, ident: str, provider: str, priority: str, order: list[str], sources: Column | None = None) -> DataFrame:
    """One row per canonical key: ``key, id, provider, priority, sources, n_sources``.

    The primary is the row of lowest priority, first in arrival order on ties. ``sources`` are the
    distinct origins, each row's own token before those it lists, in arrival order. Ids that clash
    between keys get ``__1``, ``__2`` in the order of priority and key. Only distinct origins reach
    the collecting step, and each is reduced to its first place map-side.
    """
    base = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(ident).cast("string").alias("id"), F.col(provider).alias("provider"), F.col(priority).cast("int").alias("priority"),
        F.struct(*order).alias("ord"), (sources if sources is not None else F.array().cast("array<string>")).alias("listed"),
    )
    first = base.groupBy("key").agg(F.min(F.struct("priority", "ord", "id", "provider")).alias("p"))
    tokens = F.concat(F.array(origin_token(F.col("provider"), F.col("id"))), F.col("listed"))
    places = base.select("key", "ord", F.posexplode(tokens).alias("i", "origin")).groupBy("key", "origin").agg(F.min(F.struct("ord", "i")).alias("at"))
    listed = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "origin"))).alias("s"))
    merged = first.join(listed, "key").select("key", F.col("p.id").alias("id"), F.col("p.provider").alias("provider"), F.col("p.priority").alias("priority"), F.col("s.origin").alias("sources"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("priority", "key")) - 1
    renamed = merged.withColumn("n", n).withColumn("new_id", F.when(F.col("n") > 0, F.concat("id", F.lit("__"), F.col("n").cast("string"))).otherwise(F.col("id")))
    tokens = renamed.withColumns({"own": origin_token(F.col("provider"), F.col("id")), "new": origin_token(F.col("provider"), F.col("new_id"))})
    joined = tokens.withColumn("joined", F.array_join(F.transform("sources", lambda s: F.when(s == F.col("own"), F.col("new")).otherwise(s)), ";"))
    return joined.select("key", F.col("new_id").alias("id"), "provider", "priority", F.col("joined").alias("sources"), F.size("sources").alias("n_sources"))


def merge_stats(rows: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Counts of a merge: rows in, rows without key, keys out, keys of one and of several sources."""
    before = rows.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(F.col(key).isNull()).alias("n_invalid"))
    after = merged.agg(F.count(F.lit(1)).alias("n_output"), F.count_if(F.col("n_sources") == 1).alias("n_single"), F.count_if(F.col("n_sources") > 1).alias("n_multi"))
    return before.join(F.broadcast(after))  # one row each


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: the row of highest order per key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, *[F.col("r")[c].alias(c) for c in rest])


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First seen wins: the row of lowest order per key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, *[F.col("r")[c].alias(c) for c in rest])


def without_known(extra: DataFrame, main: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``extra`` that agree with no row of ``main`` in any of the keys."""
    out = extra
    for k in keys:
        out = out.join(main.select(F.col(k)).distinct(), k, "left_anti")
    return out


def rename_clashes(rows: DataFrame, ident: str, source: str, order: list[str]) -> DataFrame:
    """Ids repeated later in the order get their source as a suffix."""
    n = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    return rows.withColumn(ident, F.when(n > 1, F.concat(F.col(ident), F.lit("__"), F.col(source))).otherwise(F.col(ident)))
