"""Queries that write tables in other formats and read them back, and the plug-in source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomspar.session import shared_dir, table
from loomspar.sources import readers, writers
from loomspar.sources.plugin import ItemSource


def _place(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_catalog(spark, d):
    """Blocks as CSV and back: text columns, defaults for what is missing."""
    where = _place(spark, "csv")
    writers.write_catalog(table(spark, d, "building_blocks").select("id", "smiles", "provider", F.col("priority").alias("Priority")), where)
    c = readers.read_table_text(spark, where, {"provider": "unknown", "sources": "none"})
    return c.groupBy("provider", "sources").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("priority").cast("int")).alias("total"))


def value_lines(spark, d):
    """SMILES by line and back: the first of each value."""
    where = _place(spark, "lines")
    b = table(spark, d, "building_blocks").where("smiles is not null and trim(smiles) <> '' and smiles not like '% %' and id not like '% %'")
    b.select(F.concat_ws(" ", F.trim("smiles"), F.trim("id"))).write.option("compression", "gzip").text(where)
    return readers.read_values(spark, where, "x").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def rule_lines(spark, d):
    """Rules by line and back: arity classes with what is dropped."""
    where = _place(spark, "rules")
    table(spark, d, "reaction_rules").select("reaction").union(spark.createDataFrame([("# a comment",), ("no arrow",), ("a.b.c.d>>e",)], "reaction string")).write.text(where)
    return readers.read_rule_lines(spark, where)[1]


def card_lines(spark, d):
    """Cards as JSON lines and back by a schema, with a vocabulary check."""
    where = _place(spark, "cards")
    table(spark, d, "procedure_cards").select("card_id", "reaction_id", "aliases").write.json(where)
    c = readers.read_vocabulary(spark, where, "card_id bigint, reaction_id string, aliases array<string>", ("card_id",))
    return c.groupBy("reaction_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.size("aliases") > 0, F.size("aliases")).otherwise(0)).alias("n_aliases"))


def json_array(spark, d):
    """Nations as one JSON array and back."""
    where = _place(spark, "array")
    n = table(spark, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))  # a table of fixed size
    n.write.text(where)
    return readers.read_json_array(spark, where, "n_nationkey int, n_name string")


def numbered_files(spark, d):
    """One file per region key, read by the number in the path."""
    where = _place(spark, "files")
    table(spark, d, "region").repartition(1).select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(where)
    f = readers.read_numbered_files(spark, where, r"r_regionkey=(\d+)")
    return f.select("number", F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "\\n", "")).alias("name"))


def prepared_space(spark, d):
    """Blocks prepared by provider, without fingerprints, read back for two providers only."""
    where = _place(spark, "space")
    writers.write_space(table(spark, d, "building_blocks").withColumn("p", F.coalesce(F.lower(F.trim("provider")), F.lit("none"))), where, "p", ["fp"])
    return spark.read.parquet(where).where("p in ('orvend', 'brixel')").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def replaced_table(spark, d):
    """A table replaced as a whole, twice; the last one is read."""
    where = _place(spark, "table")
    writers.write_atomic(table(spark, d, "nation"), where)
    writers.write_atomic(table(spark, d, "region"), where)
    return spark.read.parquet(where).select("r_regionkey", "r_name")


def stats_line(spark, d):
    where = _place(spark, "stats")
    writers.write_stats(table(spark, d, "routes").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"), F.max("n_steps").alias("most_steps")), where)
    return spark.read.schema("n bigint, n_found bigint, most_steps int").json(where)


def steps_as_json(spark, d):
    """Steps attached to a route as a JSON text column."""
    z = F.transform(F.arrays_zip("reaction_ids"), lambda x: F.struct(F.coalesce(x["reaction_ids"], F.lit("")).alias("rule")))
    return table(spark, d, "routes").where("reaction_ids is not null").select("route_id", "ingested_at", writers.json_column(z).alias("steps"))


def markdown_report(spark, d):
    """The five largest customers of each nation as list items."""
    c = table(spark, d, "customer")
    return writers.markdown_lines(c, "c_nationkey", [F.col("c_acctbal").desc(), "c_custkey"], F.concat("c_name", F.lit(": "), F.format_string("%.2f", "c_acctbal")), 5)


def several_sources(spark, d):
    """Given values and a table together, the first source of each value."""
    given = spark.createDataFrame([("Supplier#000000001",), ("typed",), ("typed",)], "name string")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_nationkey")
    return readers.union_of(given, s).groupBy("name").agg(F.min("source_ord").alias("source_ord"), F.max("s_nationkey").alias("nation"))


def plugged_source(spark, d):
    """A limited plug-in source joined to parts by number."""
    spark.dataSource.register(ItemSource)
    items = spark.read.format("loom_items").option("limit", "500").load()
    return items.join(table(spark, d, "part"), F.col("item") == F.col("p_partkey")).select("item", "value", "p_brand")


QUERIES = {f.__name__: f for f in (csv_catalog, value_lines, rule_lines, card_lines, json_array, numbered_files, prepared_space, replaced_table, stats_line, steps_as_json, markdown_report, several_sources, plugged_source)}
SQL = {
    "csv_catalog": "SELECT CASE WHEN trim(coalesce(provider, '')) = '' THEN 'unknown' ELSE trim(provider) END AS provider, 'none' AS sources, count(*) AS n, sum(priority) AS total FROM building_blocks GROUP BY 1, 2",
    "value_lines": "SELECT trim(smiles) AS value, count(*) AS n FROM building_blocks WHERE smiles IS NOT NULL AND trim(smiles) <> '' AND smiles NOT LIKE '% %' AND id NOT LIKE '% %' GROUP BY 1",
    "rule_lines": "WITH r AS (SELECT CASE WHEN NOT contains(reaction, '>>') THEN 'malformed' WHEN len(string_split(string_split(reaction, '>>')[1], '.')) > 3 THEN 'too_many' ELSE 'kept' END AS label FROM (SELECT reaction FROM reaction_rules UNION ALL SELECT 'no arrow' UNION ALL SELECT 'a.b.c.d>>e')) SELECT label, count(*) AS n FROM r GROUP BY 1",
    "card_lines": "SELECT reaction_id, count(*) AS n, sum(coalesce(len(aliases), 0)) AS n_aliases FROM procedure_cards GROUP BY 1",
    "json_array": "SELECT n_nationkey, n_name FROM nation",
    "numbered_files": "SELECT CAST(r_regionkey AS BIGINT) AS number, r_name AS name FROM region",
    "prepared_space": "SELECT lower(trim(provider)) AS p, count(*) AS n, max(id) AS last FROM building_blocks WHERE lower(trim(provider)) IN ('orvend', 'brixel') GROUP BY 1",
    "replaced_table": "SELECT r_regionkey, r_name FROM region",
    "stats_line": "SELECT count(*) AS n, count(*) FILTER (found) AS n_found, max(n_steps) AS most_steps FROM routes",
    "steps_as_json": "SELECT route_id, ingested_at, '[' || array_to_string(list_transform(reaction_ids, lambda x: '{\"rule\":' || CAST(to_json(coalesce(x, '')) AS VARCHAR) || '}'), ',') || ']' AS steps FROM routes WHERE reaction_ids IS NOT NULL",
    "markdown_report": "SELECT c_nationkey, CAST(line AS INT) AS line, '- ' || c_name || ': ' || format('{:.2f}', c_acctbal) AS text FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS line FROM customer) WHERE line <= 5",
    "several_sources": "SELECT name, min(o) AS source_ord, max(n) AS nation FROM (SELECT s_name AS name, 1 AS o, s_nationkey AS n FROM supplier UNION ALL SELECT 'Supplier#000000001', 0, NULL UNION ALL SELECT 'typed', 0, NULL) GROUP BY 1",
    "plugged_source": "SELECT p_partkey AS item, p_partkey * p_partkey AS value, p_brand FROM part WHERE p_partkey < 500",
}
