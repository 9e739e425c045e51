"""Literature index and coverage queries over procedure cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspar.operators.ranking import top_k
from loomspar.operators.references import rule_key
from loomspar.session import table


def _cards(spark, d):
    c = table(spark, d, "procedure_cards")
    return c.groupBy("card_id").agg(F.max(F.struct("ingested_at", "reaction_id", "prepared_at", "openalex_keys")).alias("r")).select("card_id", rule_key(F.col("r.reaction_id")).alias("k"), F.col("r.prepared_at").alias("prepared_at"), F.col("r.openalex_keys").alias("keys"))


def rule_index(spark, d):
    """Per rule, rules without cards kept: number of cards, sorted distinct years, first ten literature keys."""
    rules = table(spark, d, "reaction_rules").select(rule_key(F.col("id")).alias("k")).distinct()
    c = _cards(spark, d)
    n = c.groupBy("k").agg(F.count(F.lit(1)).alias("n_cards"), F.array_join(F.array_sort(F.collect_set(F.year("prepared_at").cast("string"))), ";").alias("years"))
    keys = c.select("k", "card_id", F.posexplode("keys").alias("i", "ref")).where("ref is not null").groupBy("k", "ref").agg(F.min(F.struct("card_id", "i")).alias("at"))
    ten = top_k(keys, ["k"], ["at"], 10).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]), ";").alias("refs"))
    return rules.join(n, "k", "left").join(ten, "k", "left").select("k", F.coalesce("n_cards", F.lit(0)).alias("n_cards"), F.coalesce("years", F.lit("")).alias("years"), F.coalesce("refs", F.lit("")).alias("refs"))


def coverage_buckets(spark, d):
    """Rules by whether routes use them and cards describe them; ``rare`` overlaps the other buckets."""
    i = rule_index(spark, d).select("k", "n_cards")
    uses = table(spark, d, "routes").select(F.explode("reaction_ids").alias("r")).where("r is not null").groupBy(rule_key(F.col("r")).alias("k")).agg(F.count(F.lit(1)).alias("n_uses"))
    j = i.join(uses, "k", "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))
    u, c = F.col("n_uses") > 0, F.col("n_cards") > 0
    return j.agg(F.count_if(u & c).alias("covered"), F.count_if(u & ~c).alias("uncovered"), F.count_if(~u & c).alias("unused"), F.count_if(~u & ~c).alias("idle"), F.count_if(F.col("n_uses") == 1).alias("rare"))


def coverage_report(spark, d):
    """The forty most described rules, by number of cards, ties by key."""
    return rule_index(spark, d).orderBy(F.col("n_cards").desc(), "k").limit(40).select("k", "n_cards")


QUERIES = {f.__name__: f for f in (rule_index, coverage_buckets, coverage_report)}
_T = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_K = r"regexp_replace(regexp_replace(regexp_replace(" + _T + r", '__retro$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_I = f"""WITH c0 AS (SELECT card_id, arg_max(struct_pack(r := reaction_id, p := prepared_at, o := openalex_keys), struct_pack(ingested_at, x := coalesce(reaction_id, ''))) AS m FROM procedure_cards GROUP BY 1),
  c AS (SELECT card_id, {_K.format('m.r')} AS k, m.p AS p, m.o AS o FROM c0), r AS (SELECT DISTINCT {_K.format('id')} AS k FROM reaction_rules),
  n AS (SELECT k, count(*) AS n_cards, string_agg(DISTINCT CAST(year(p) AS VARCHAR), ';' ORDER BY CAST(year(p) AS VARCHAR)) AS years FROM c WHERE k IS NOT NULL GROUP BY k),
  u AS (SELECT k, card_id, unnest(o) AS ref, unnest(range(len(o))) AS i FROM c), f AS (SELECT k, ref, min(struct_pack(card_id, i)) AS at_ FROM u WHERE ref IS NOT NULL GROUP BY ALL),
  t AS (SELECT k, array_to_string(list(ref ORDER BY at_)[1:10], ';') AS refs FROM f GROUP BY k),
  i AS (SELECT r.k AS k, coalesce(n_cards, 0) AS n_cards, coalesce(years, '') AS years, coalesce(refs, '') AS refs FROM r LEFT JOIN n ON n.k = r.k LEFT JOIN t ON t.k = r.k)"""
SQL = {
    "rule_index": _I + " SELECT * FROM i",
    "coverage_buckets": _I + f", x AS (SELECT {_K.format('a')} AS k, count(*) AS n_uses FROM (SELECT unnest(reaction_ids) AS a FROM routes) WHERE a IS NOT NULL GROUP BY 1), j AS (SELECT i.k, n_cards, coalesce(n_uses, 0) AS n_uses FROM i LEFT JOIN x ON x.k = i.k) SELECT count(*) FILTER (n_uses > 0 AND n_cards > 0) AS covered, count(*) FILTER (n_uses > 0 AND n_cards = 0) AS uncovered, count(*) FILTER (n_uses = 0 AND n_cards > 0) AS unused, count(*) FILTER (n_uses = 0 AND n_cards = 0) AS idle, count(*) FILTER (n_uses = 1) AS rare FROM j",
    "coverage_report": _I + " SELECT k, n_cards FROM i ORDER BY n_cards DESC, k LIMIT 40",
}
