"""Metric queries: roll-ups, quality rates, collection metrics, distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspar.functions import split_name, trimmed
from loomspar.operators import metrics as ops
from loomspar.session import table


def metric_roll_up(spark, d):
    v = table(spark, d, "route_verify").withColumn("ok", F.coalesce("found", F.lit(False)))
    out = ops.roll_up(v, "ok", ["n_steps", "n_proposed_bbs", "similarity_to_searched", "similarity_to_query"], ["forward_replay_ok", "catalog_only", "reconstructs_query"])
    return out.select("metric", F.round("value", 9).alias("value"), F.round("std", 9).alias("std"))


def route_rates(spark, d):
    """Success, reconstruction, catalog and forward rates over each query's best row; denominators are the distinct queries."""
    v = table(spark, d, "route_verify").where(F.col("query_smiles").isNotNull())
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    order = [flag(c).desc() for c in ("found", "reconstructs_query", "reconstructs_searched", "forward_replay_ok", "catalog_only")] + [F.coalesce("n_steps", F.lit(99)), "verify_id"]
    q = v.withColumn("n", F.row_number().over(Window.partitionBy("query_smiles").orderBy(*order))).where("n = 1")
    rate = lambda c, name: F.round(F.avg(flag(c).cast("int")), 9).alias(name)
    return q.agg(F.count(F.lit(1)).alias("n_queries"), rate("found", "success"), rate("reconstructs_searched", "reconstruction"), rate("reconstructs_query", "vs_query"), rate("catalog_only", "catalog"), rate("forward_replay_ok", "forward"))


def bounded_lines(spark, d):
    li = table(spark, d, "lineitem")
    ok = ops.in_bounds(li, {"l_quantity": (10, 40), "l_discount": (0.02, float("inf")), "absent": (float("-inf"), 1.0)})
    return li.where(ok).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def failing_column(spark, d):
    """A missing column is minus infinity, so a finite lower bound lets nothing pass."""
    li = table(spark, d, "lineitem")
    return li.agg(F.count_if(ops.in_bounds(li, {"absent": (0.0, 1.0)})).alias("n_pass"), F.count(F.lit(1)).alias("n"))


def cascade_counts(spark, d):
    q, x, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    steps = ops.stop_at_failure([("a", q, q > 10), ("b", x, x > 20000), ("c", t, t > 0.02)])
    return table(spark, d, "lineitem").select("l_returnflag", *steps).groupBy("l_returnflag").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count("c").alias("n_c"))


def _items(spark, d):
    """Each item once, as last delivered, by the usual name of its split; ligand and pocket without layout, null where blank."""
    i = table(spark, d, "dataset_items").where("item_id is not null").groupBy("item_id").agg(F.max(F.struct("ingested_at", "split", "ligand_smiles", "pocket_seq")).alias("r")).select("r.*")
    pocket = F.upper(F.regexp_replace("pocket_seq", r"\P{L}+", ""))
    return i.select(split_name(F.col("split")).alias("split"), F.nullif(trimmed(F.col("ligand_smiles")), F.lit("")).alias("ligand"), F.nullif(pocket, F.lit("")).alias("pocket")).where("split is not null")


def whole_uniqueness_novelty(spark, d):
    """Distinct share, and the share of distinct ligands outside the training split, over all items of any spelling of a split."""
    i = _items(spark, d).where("ligand is not null")
    per = i.groupBy("ligand").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1)))
    each = per.select(F.col("train").isNotNull().alias("known"), F.explode(F.create_map(*[x for s in ("train", "val", "test") for x in (F.lit(s), F.col(s))])).alias("split", "n")).where("n > 0")
    return each.groupBy("split").agg(F.round(F.count(F.lit(1)) / F.sum("n"), 9).alias("uniqueness"), F.round(F.count_if(~F.col("known")) / F.count(F.lit(1)), 9).alias("novelty"))


def whole_precision_recall(spark, d):
    """Pockets of test that stand in train, over all items of any spelling of a split."""
    per = _items(spark, d).where("pocket is not null").groupBy("pocket").agg(F.max(F.col("split") == "train").alias("a"), F.max(F.col("split") == "test").alias("b"))
    n = per.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if("a").alias("n_ref"), F.count_if("b").alias("n_sample"))
    share = lambda c: F.round(F.try_divide("n_both", c), 9)
    return n.select("n_both", share(F.col("n_sample")).alias("precision"), share(F.col("n_ref")).alias("recall"))


def category_histogram(spark, d):
    return table(spark, d, "routes").select(F.explode("building_block_providers").alias("provider")).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def _years(spark, d):
    e = table(spark, d, "events").where(F.col("value").isNotNull()).withColumns({"bin": F.floor("value"), "half": F.col("event_id") % 2})
    return ops.histogram(e.where("half = 0"), F.col("bin"), "p"), ops.histogram(e.where("half = 1"), F.col("bin"), "q")


def js_of_halves(spark, d):
    return ops.js_distance(*_years(spark, d)).select(F.round("js", 8).alias("js"))


def js_of_top_bins(spark, d):
    """On the ten most frequent bins of the reference only."""
    p, q = _years(spark, d)
    top = p.orderBy(F.col("p").desc(), "bin").limit(10)
    return ops.js_distance(top, q.join(F.broadcast(top.select("bin")), "bin", "left_semi")).select(F.round("js", 8).alias("js"))  # ten bins


def kl_of_halves(spark, d):
    return ops.kl_divergence(*_years(spark, d)).select(F.round("kl", 8).alias("kl"))


def value_summary(spark, d):
    s = ops.time_summary(table(spark, d, "events"), "value", ["event_type"])
    return s.select("event_type", "n", *[F.round(c, 8).alias(c) for c in ("mean", "median", "p95", "min", "max", "std")])


def series_correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


def pivot_counts(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.na.fill(0, ["F", "O"]).select("l_returnflag", F.col("F").alias("n_f"), F.col("O").alias("n_o"))


def geometric_means(spark, d):
    """Minimum and geometric mean of positive values per user, null for one row."""
    e = table(spark, d, "events").where(F.col("value") > 0)
    return e.groupBy("user_id").agg(F.min("value").alias("min_q"), F.round(F.when(F.count(F.lit(1)) > 1, F.exp(F.avg(F.log("value")))), 8).alias("gmean"))


def flag_counts(spark, d):
    v = table(spark, d, "route_verify")
    c = F.col("forward_replay_ok")
    known = F.count(c)
    return v.groupBy("n_steps").agg(F.count_if(c).alias("n_valid"), F.count_if(~c).alias("n_invalid"), F.count_if(c.isNull()).alias("n_unknown"), F.when(known > 0, F.round(F.count_if(c) / known, 9)).alias("ratio"), F.bool_and(F.coalesce(c, F.lit(False))).alias("all_ok"))


QUERIES = {f.__name__: f for f in (metric_roll_up, route_rates, bounded_lines, failing_column, cascade_counts, whole_uniqueness_novelty, whole_precision_recall, category_histogram, js_of_halves, js_of_top_bins, kl_of_halves, value_summary, series_correlation, pivot_counts, geometric_means, flag_counts)}
_H = "WITH h AS (SELECT floor(value) AS bin, count(*) FILTER (event_id % 2 = 0) AS p0, count(*) FILTER (event_id % 2 = 1) AS q0 FROM events WHERE value IS NOT NULL GROUP BY 1)"
_JS = "SELECT round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 8) AS js FROM n"
_num = lambda c: f"CASE WHEN coalesce(found, false) AND NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
_ITEMS = r"""WITH i AS (SELECT item_id, arg_max(struct_pack(split, l := ligand_smiles, p := pocket_seq), ingested_at) AS r FROM dataset_items WHERE item_id IS NOT NULL GROUP BY 1),
 n AS (SELECT lower(regexp_replace(r.split, '^\s+|\s+$', '', 'g')) AS s, nullif(regexp_replace(r.l, '^\s+|\s+$', '', 'g'), '') AS ligand, nullif(upper(regexp_replace(r.p, '[^\p{L}]+', '', 'g')), '') AS pocket FROM i),
 t AS (SELECT CASE WHEN s IN ('train', 'training', 'trn') THEN 'train' WHEN s IN ('val', 'valid', 'validation', 'validate', 'dev', 'development') THEN 'val' WHEN s IN ('test', 'testing', 'tst') THEN 'test' END AS split, ligand, pocket FROM n)"""
SQL = {
    "whole_uniqueness_novelty": _ITEMS + " SELECT split, round(count(DISTINCT ligand) / count(*), 9) AS uniqueness, round(count(DISTINCT CASE WHEN ligand NOT IN (SELECT ligand FROM t WHERE split = 'train' AND ligand IS NOT NULL) THEN ligand END) / count(DISTINCT ligand), 9) AS novelty FROM t WHERE split IS NOT NULL AND ligand IS NOT NULL GROUP BY 1",
    "whole_precision_recall": _ITEMS + ", a AS (SELECT pocket, bool_or(split = 'train') AS a, bool_or(split = 'test') AS b FROM t WHERE split IS NOT NULL AND pocket IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (a AND b) AS n_both, round(count(*) FILTER (a AND b) / count(*) FILTER (b), 9) AS precision, round(count(*) FILTER (a AND b) / count(*) FILTER (a), 9) AS recall FROM a",
    "metric_roll_up": "SELECT 'validity' AS metric, round(avg(CAST(coalesce(found, false) AS INT)), 9) AS value, CAST(NULL AS DOUBLE) AS std FROM route_verify"
    + "".join(f" UNION ALL SELECT '{c}', round(avg({_num(c)}), 9), round(stddev_pop({_num(c)}), 9) FROM route_verify" for c in ("n_steps", "n_proposed_bbs", "similarity_to_searched", "similarity_to_query"))
    + "".join(f" UNION ALL SELECT '{c}', round(avg(CASE WHEN coalesce(found, false) THEN CAST(coalesce({c}, false) AS INT) END), 9), NULL FROM route_verify" for c in ("forward_replay_ok", "catalog_only", "reconstructs_query")),
    "route_rates": "WITH v AS (SELECT coalesce(found, false) AS f, coalesce(reconstructs_query, false) AS q, coalesce(reconstructs_searched, false) AS r, coalesce(forward_replay_ok, false) AS w, coalesce(catalog_only, false) AS c, row_number() OVER (PARTITION BY query_smiles ORDER BY coalesce(found, false) DESC, coalesce(reconstructs_query, false) DESC, coalesce(reconstructs_searched, false) DESC, coalesce(forward_replay_ok, false) DESC, coalesce(catalog_only, false) DESC, coalesce(n_steps, 99), verify_id) AS n FROM route_verify WHERE query_smiles IS NOT NULL) SELECT count(*) AS n_queries, round(avg(CAST(f AS INT)), 9) AS success, round(avg(CAST(r AS INT)), 9) AS reconstruction, round(avg(CAST(q AS INT)), 9) AS vs_query, round(avg(CAST(c AS INT)), 9) AS catalog, round(avg(CAST(w AS INT)), 9) AS forward FROM v WHERE n = 1",
    "bounded_lines": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_discount >= 0.02 GROUP BY 1",
    "failing_column": "SELECT CAST(0 AS BIGINT) AS n_pass, count(*) AS n FROM lineitem",
    "cascade_counts": "SELECT l_returnflag, count(l_quantity) AS n_a, count(CASE WHEN l_quantity > 10 THEN l_extendedprice END) AS n_b, count(CASE WHEN l_quantity > 10 AND l_extendedprice > 20000 THEN l_tax END) AS n_c FROM lineitem GROUP BY 1",
    "category_histogram": "SELECT provider, count(*) AS n FROM (SELECT unnest(building_block_providers) AS provider FROM routes) GROUP BY 1",
    "js_of_halves": _H + ", n AS (SELECT p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM h) " + _JS,
    "js_of_top_bins": _H + ", t AS (SELECT * FROM h WHERE p0 > 0 ORDER BY p0 DESC, bin LIMIT 10), n AS (SELECT p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM t) " + _JS,
    "kl_of_halves": _H + ", n AS (SELECT p0, p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM h) SELECT round(-sum(p * ln(q / (p + 1e-10) + 1e-10)), 8) AS kl FROM n WHERE p0 > 0",
    "value_summary": "SELECT event_type, count(value) AS n, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.95), 8) AS p95, round(min(value), 8) AS min, round(max(value), 8) AS max, round(stddev_pop(value), 8) AS std FROM events GROUP BY 1",
    "series_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY 1",
    "pivot_counts": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'O') AS n_o FROM lineitem GROUP BY 1",
    "geometric_means": "SELECT user_id, min(value) AS min_q, round(CASE WHEN count(*) > 1 THEN exp(avg(ln(value))) END, 8) AS gmean FROM events WHERE value > 0 GROUP BY 1",
    "flag_counts": "SELECT n_steps, count(*) FILTER (forward_replay_ok) AS n_valid, count(*) FILTER (NOT forward_replay_ok) AS n_invalid, count(*) FILTER (forward_replay_ok IS NULL) AS n_unknown, round(count(*) FILTER (forward_replay_ok) / nullif(count(forward_replay_ok), 0), 9) AS ratio, bool_and(coalesce(forward_replay_ok, false)) AS all_ok FROM route_verify GROUP BY 1",
}
