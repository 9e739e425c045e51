"""Queries of text codecs, names, JSON and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspar.session import table


def pathway_text(spark, d):
    """A route's steps as lines for a reader."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x, F.lit("NA")))
    r = table(spark, d, "routes").where(F.size("reaction_ids") > 0)
    return r.select("route_id", "ingested_at", F.concat(F.array_join(F.transform("reaction_ids", line), "\n"), F.lit("\n=> "), F.coalesce("searched_smiles", F.lit("NA"))).alias("text"))


def single_products(spark, d):
    """Rules by whether their product side is one part."""
    side = F.element_at(F.split("reaction", ">>", 2), -1)
    return table(spark, d, "reaction_rules").groupBy((F.contains("reaction", F.lit(">>")) & ~F.contains(side, F.lit("."))).alias("single")).agg(F.count(F.lit(1)).alias("n"))


def mapped_columns(spark, d):
    """Columns renamed by a map, the others with a suffix, missing ones as null."""
    s = table(spark, d, "supplier")
    names = {"s_suppkey": "id", "s_name": "name"}
    cols = [F.col(c).alias(names.get(c, f"{c}_raw")) for c in s.columns] + [F.lit(None).cast("string").alias("phone")]
    return s.select(*cols).select("id", "name", "s_nationkey_raw", "s_acctbal_raw", "phone")


def pattern_codec(spark, d):
    """Patterns written as ``inner|outer[neighbours]`` with neighbours in order, and read back."""
    p = table(spark, d, "part")
    text = F.concat("p_brand", F.lit("|"), "p_type", F.lit("["), F.array_join(F.array_sort(F.split("p_name", " ")), ","), F.lit("]"))
    t = p.select("p_partkey", "p_brand", "p_type", text.alias("pattern"))
    part = lambda k: F.regexp_extract("pattern", r"^([^|]*)\|([^\[]*)\[(.*)\]$", k)
    return t.select("p_partkey", "pattern", (part(1) == F.col("p_brand")).alias("inner_ok"), (part(2) == F.col("p_type")).alias("outer_ok"), F.size(F.split(part(3), ",")).alias("n_neighbours"))


def generalized_keys(spark, d):
    """Key fields nulled out level by level, by grouping sets in one pass."""
    g = table(spark, d, "part").groupingSets([["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_brand"]], "p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return g.select("p_brand", "p_type", "p_size", "n")


def _size_of(spec: str):
    """A size from a small language: a number, ``uniform_a_b``, ``histogram`` (the bin's middle) or ``ground_truth``."""
    if spec.isdigit():
        return F.lit(int(spec))
    if spec.startswith("uniform_"):
        a, b = map(int, spec.split("_")[1:])
        return (F.lit(a) + F.pmod(F.col("item_id") * 7919, F.lit(b - a + 1))).cast("int")
    if spec == "histogram":
        return (F.floor(F.col("n_atoms") / 10) * 10 + 5).cast("int")
    if spec == "ground_truth":
        return F.col("n_atoms")
    raise ValueError(f"unknown size: {spec}")


SPECS = ["25", "uniform_10_19", "histogram", "ground_truth"]


def sizes_by_spec(spark, d):
    i = table(spark, d, "dataset_items").select("item_id", "ingested_at", "n_atoms")
    return i.select("item_id", "ingested_at", *[_size_of(s).alias(s.split("_")[0] if not s.isdigit() else "fixed") for s in SPECS])


def safe_names(spark, d):
    """Titles as file stems and as text for pages."""
    c = table(spark, d, "procedure_cards").where("title is not null")
    html = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return c.select("card_id", "ingested_at", F.left(F.regexp_replace(F.regexp_replace("title", "[^A-Za-z0-9._-]+", "_"), "^_|_$", ""), F.lit(40)).alias("stem"), html.alias("html"))


def normalized_json(spark, d):
    """JSON fields with defaults for what is missing."""
    j = F.from_json("props", "k int, a struct<b:string>")
    return table(spark, d, "events").select("event_id", F.coalesce(j["k"], F.lit(-1)).alias("k"), F.coalesce(j["a"]["b"], F.lit("")).alias("b"))


def card_json(spark, d):
    """Cards as JSON text, lists inside."""
    c = table(spark, d, "procedure_cards").where("confidence is not null and match_level is not null and aliases is not null")
    return c.select("card_id", "ingested_at", F.to_json(F.struct("card_id", "match_level", "confidence", "aliases")).alias("json"))


def chained_fingerprints(spark, d):
    """A fingerprint of every order over its lines in order, chained with the version of the reading."""
    line = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    return g.select("l_orderkey", F.left(F.sha2(F.concat(F.lit("v2:"), F.sha2("t", 256)), 256), F.lit(16)).alias("fingerprint"))


def count_similarity(spark, d):
    """Similarity of counts of every supplier's profile (flag and status) to its nation's mean profile: sum of least over sum of greatest."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    own = li.groupBy("s_nationkey", "l_suppkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    size = own.groupBy("s_nationkey").agg(F.count_distinct("l_suppkey").alias("k"))
    mean = own.groupBy("s_nationkey", "l_returnflag", "l_linestatus").agg(F.sum("n").alias("t")).join(size, "s_nationkey").select("s_nationkey", "l_returnflag", "l_linestatus", (F.col("t") / F.col("k")).alias("m"))
    grid = own.select("s_nationkey", "l_suppkey").distinct().join(mean, "s_nationkey").join(own, ["s_nationkey", "l_suppkey", "l_returnflag", "l_linestatus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.groupBy("l_suppkey").agg(F.round(F.sum(F.least("n", "m")) / F.sum(F.greatest("n", "m")), 9).alias("similarity"))


QUERIES = {f.__name__: f for f in (pathway_text, single_products, mapped_columns, pattern_codec, generalized_keys, sizes_by_spec, safe_names, normalized_json, card_json, chained_fingerprints, count_similarity)}
SQL = {
    "pathway_text": "SELECT route_id, ingested_at, array_to_string(list_transform(reaction_ids, lambda x, i: CAST(i AS VARCHAR) || '. ' || coalesce(x, 'NA')), chr(10)) || chr(10) || '=> ' || coalesce(searched_smiles, 'NA') AS text FROM routes WHERE len(reaction_ids) > 0",
    "single_products": "SELECT contains(reaction, '>>') AND NOT contains(string_split(reaction, '>>')[2], '.') AS single, count(*) AS n FROM reaction_rules GROUP BY 1",
    "mapped_columns": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS s_nationkey_raw, s_acctbal AS s_acctbal_raw, CAST(NULL AS VARCHAR) AS phone FROM supplier",
    "pattern_codec": "SELECT p_partkey, p_brand || '|' || p_type || '[' || array_to_string(list_sort(string_split(p_name, ' ')), ',') || ']' AS pattern, true AS inner_ok, true AS outer_ok, CAST(len(string_split(p_name, ' ')) AS INT) AS n_neighbours FROM part",
    "generalized_keys": "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type, p_size), (p_brand, p_type), (p_brand))",
    "sizes_by_spec": "SELECT item_id, ingested_at, 25 AS fixed, CAST(10 + (item_id * 7919) % 10 AS INT) AS uniform, CAST(floor(n_atoms / 10) * 10 + 5 AS INT) AS histogram, n_atoms AS ground FROM dataset_items",
    "safe_names": "SELECT card_id, ingested_at, left(regexp_replace(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), '^_|_$', '', 'g'), 40) AS stem, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM procedure_cards WHERE title IS NOT NULL",
    "normalized_json": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.a.b'), '') AS b FROM events",
    "card_json": "SELECT card_id, ingested_at, CAST(to_json(struct_pack(card_id, match_level, confidence, aliases)) AS VARCHAR) AS json FROM procedure_cards WHERE confidence IS NOT NULL AND match_level IS NOT NULL AND aliases IS NOT NULL",
    "chained_fingerprints": "SELECT l_orderkey, left(sha256('v2:' || sha256(string_agg(concat_ws('|', l_partkey, l_suppkey, l_linenumber), chr(10) ORDER BY concat_ws('|', l_partkey, l_suppkey, l_linenumber)))), 16) AS fingerprint FROM lineitem GROUP BY 1",
    "count_similarity": "WITH o AS (SELECT s_nationkey, l_suppkey, l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), k AS (SELECT s_nationkey, count(DISTINCT l_suppkey) AS k FROM o GROUP BY 1), m AS (SELECT s_nationkey, f, s, sum(n) / any_value(k) AS m FROM o JOIN k USING (s_nationkey) GROUP BY ALL), g AS (SELECT d.l_suppkey, m.m, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT s_nationkey, l_suppkey FROM o) d JOIN m USING (s_nationkey) LEFT JOIN o ON o.l_suppkey = d.l_suppkey AND o.f = m.f AND o.s = m.s) SELECT l_suppkey, round(sum(least(n, m)) / sum(greatest(n, m)), 9) AS similarity FROM g GROUP BY 1",
}
