"""Metric roll-ups, distribution comparison and timing summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10  # fixed value of the divergence's smoothing


def roll_up(df: DataFrame, valid: str, numeric: list[str], boolean: list[str]) -> DataFrame:
    """``(metric, value, std)``: the valid share over all rows, then per metric the mean over valid rows
    (population deviation for numbers; booleans count null as false and have no deviation). NaN counts
    as null. One pass: all aggregates are computed together and then stacked."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    aggs = [F.avg(ok.cast("double")).alias("validity")]
    for c in numeric:
        x = F.when(ok & ~F.isnan(c), F.col(c).cast("double"))
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    for c in boolean:
        aggs.append(F.avg(F.when(ok, F.coalesce(F.col(c), F.lit(False)).cast("double"))).alias(f"m_{c}"))
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit("validity").alias("metric"), F.col("validity").alias("value"), none.alias("std"))]
    rows += [F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("value"), F.col(f"s_{c}").alias("std")) for c in numeric]
    rows += [F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("value"), none.alias("std")) for c in boolean]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def in_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> Column:
    """A conjunction of ranges; a missing column, null and NaN count as minus infinity."""
    low = F.lit(float("-inf"))
    ok = F.lit(True)
    for c, (lo, hi) in bounds.items():
        x = F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), low) if c in df.columns else low
        ok &= (x >= lo) & (x <= hi)
    return ok


def stop_at_failure(steps: list[tuple[str, Column, Column]]) -> list[Column]:
    """Short-circuit cascade: each step ``(name, value, passed)`` is null once an earlier one failed."""
    out, open_ = [], F.lit(True)
    for name, value, passed in steps:
        out.append(F.when(open_, value).alias(name))
        open_ = open_ & F.coalesce(passed, F.lit(False))
    return out


def histogram(df: DataFrame, bin_: Column, name: str) -> DataFrame:
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias(name))


def js_distance(p: DataFrame, q: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Jensen-Shannon distance (natural logarithm) of two histograms ``(bin, p)`` and ``(bin, q)``."""
    both = p.join(q, [*by, "bin"], "full").withColumns({"p": F.coalesce("p", F.lit(0)), "q": F.coalesce("q", F.lit(0))})
    totals = both.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))  # one row per group
    both = (both.join(totals, by) if by else both.crossJoin(totals)).withColumns({"p": F.col("p") / F.col("np"), "q": F.col("q") / F.col("nq")})
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    return both.groupBy(*by).agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("js"))


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """Smoothed divergence of a sample's histogram ``(bin, q)`` from the reference ``(bin, p)``."""
    both = p.join(q, "bin", "left").withColumn("q", F.coalesce("q", F.lit(0)))
    totals = p.agg(F.sum("p").alias("np")).join(F.broadcast(q.agg(F.sum("q").alias("nq"))))  # one row each
    both = both.join(F.broadcast(totals)).withColumns({"p": F.col("p") / F.col("np"), "q": F.col("q") / F.col("nq")})
    return both.agg((-F.sum(F.col("p") * F.log(F.col("q") / (F.col("p") + EPS) + EPS))).alias("kl"))


def time_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median, 95th percentile (linear), extremes and population deviation."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"),
    )
