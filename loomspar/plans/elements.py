"""Queries on per-element values, arrays, geometry and alignment."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspar.functions import geometry as geo
from loomspar.functions import rbf
from loomspar.operators import elements as ops
from loomspar.operators.relations import within_distance
from loomspar.session import table


def segment_verdicts(spark, d):
    """Lines as elements of orders, their part's size below 10 as a metric that some lack."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    small = table(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") < 10).cast("double").alias("v"))
    return ops.segment_verdicts(li, small, ["l_orderkey"], "l_partkey", "v", 0.25)


def summed_profile(spark, d):
    return ops.summed_profile(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity", "l_discount", "l_tax"]).select("l_suppkey", "l_returnflag", F.round("total", 4).alias("total"))


def derived_counts(spark, d):
    """Counts by kind as columns, and sums of kinds derived from them."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "signup", "purchase", "error"]).count().na.fill(0)
    return p.withColumns({"seen": F.col("click") + F.col("view"), "good": F.col("signup") + F.col("purchase"), "not_error": F.col("click") + F.col("view") + F.col("signup") + F.col("purchase")})


def pivot_unfilled(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


def pattern_bins(spark, d):
    """Values per pattern at two levels of detail, as histograms: never a list of a whole pattern's values."""
    p = table(spark, d, "part")
    g = p.groupBy(F.floor(F.col("p_retailprice") / 50).alias("bin"), "p_brand", "p_type")
    fine = g.agg(F.count(F.lit(1)).alias("n")).select("p_brand", "p_type", "bin", "n")
    coarse = fine.groupBy("p_brand", "bin").agg(F.sum("n").alias("n")).select("p_brand", F.lit(None).cast("string").alias("p_type"), "bin", "n")
    return fine.unionByName(coarse)


def zero_filled_types(spark, d):
    vocab = spark.createDataFrame([(t,) for t in ("ECONOMY", "STANDARD", "PROMO", "LARGE", "UNKNOWN", "ABSENT")], "p_type string")
    return ops.zero_filled(table(spark, d, "part"), "p_type", vocab)


def batch_sums(spark, d):
    """Sum over everything but the batch."""
    v = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.sum(v), 5).alias("total"))


def sampled_success(spark, d):
    """Counts and success rates per supplier, 0 where nothing was tried."""
    li = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("ok"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return s.join(li, "l_suppkey", "left").select("l_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(0.0), 9).alias("rate"))


def positive_summary(spark, d):
    s = ops.positive_summary(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.round(s["mean"], 7).alias("mean"), F.round(s["min"], 9).alias("low"), F.round(s["max"], 9).alias("high"))


def size_columns(spark, d):
    """Counts of part sizes 1 to 6 as columns, per brand."""
    p = table(spark, d, "part").where("p_size between 1 and 6").groupBy("p_brand").pivot("p_size", [1, 2, 3, 4, 5, 6]).count().na.fill(0)
    return p.select("p_brand", *[F.col(str(k)).alias(f"num_{k}") for k in range(1, 7)])


def aligned_edges(spark, d):
    """Lines of the first half of line numbers aligned to all lines of an order."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("x"), F.min("l_linenumber").alias("k"))
    return ops.align_edges(li.where("k <= 3"), li, ["l_orderkey", "l_partkey"], "x")


def parallel_lists(spark, d):
    """Parallel lists of a route as rows: block, its SMILES and its provider by place."""
    r = table(spark, d, "routes").select("route_id", "ingested_at", F.posexplode(F.arrays_zip("building_block_ids", "building_block_smiles", "building_block_providers")).alias("pos", "z"))
    return r.select("route_id", "ingested_at", "pos", F.col("z.building_block_ids").alias("id"), F.col("z.building_block_smiles").alias("smiles"), F.col("z.building_block_providers").alias("provider"))


def _xyz(k):
    return F.array(*[F.col("embedding")[3 * k + i].cast("double") for i in range(3)])


def bond_geometry(spark, d):
    """Length, angle, torsion and plane distance of the first four points of each vector."""
    a, b, c, e = (F.col(f"p{k}") for k in range(4))
    rows = table(spark, d, "embeddings").select("vec_id", *[_xyz(k).alias(f"p{k}") for k in range(4)])
    return rows.select("vec_id", F.round(geo.norm(geo.minus(a, b)), 7).alias("length"), F.round(geo.bond_angle(a, b, c), 7).alias("angle"), F.round(geo.torsion(a, b, c, e), 6).alias("torsion"), F.round(geo.plane_distance(e, a, b, c), 6).alias("off_plane"))


TURN = [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


def rigid_moves(spark, d):
    m = geo.moved(_xyz(0), TURN, [0.5, -0.25, 1.0])
    return table(spark, d, "embeddings").select("vec_id", *[F.round(m[i], 7).alias(c) for i, c in enumerate("xyz")])


def rmsd_to_centre(spark, d):
    """Root mean square deviation of every vector from its label's centre, over all places."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.join(c, ["label", "i"]).groupBy("vec_id").agg(F.round(F.sqrt(F.avg((F.col("x").cast("double") - F.col("m")) ** 2)), 7).alias("rmsd"))


def line_arcs(spark, d):
    """Whether the arcs of an order's lines, begun at the line's place and as long as its quantity, cover the circle."""
    lo = F.pmod(F.col("l_linenumber") * 0.9, 2 * F.pi())
    arc = F.struct(lo.alias("lo"), F.least(lo + F.col("l_quantity") / 25, 2 * F.pi()).alias("hi"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(arc).alias("arcs")).select("l_orderkey", geo.covers_circle(F.col("arcs")).alias("covered"))


def embeddings_of_time(spark, d):
    """Sinusoids and radial bases of the discount."""
    s, r = geo.sinusoid(F.col("t"), 3, 100.0), rbf(F.col("t"), 0.0, 1.0, 4)
    t = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("t")).distinct()
    return t.select("t", *[F.round(s[i], 8).alias(f"s{i}") for i in range(6)], *[F.round(r[i], 8).alias(f"r{i}") for i in range(4)])


def estimated_price(spark, d):
    """A linear model of the price with a rule count and a ratio."""
    p = table(spark, d, "part")
    hits = (F.col("p_size") > 25).cast("int") + (F.col("p_retailprice") > 950).cast("int") + F.col("p_name").contains("ring").cast("int")
    return p.select("p_partkey", F.round(0.16 - 0.63 * F.log(F.col("p_retailprice")) + 0.066 * F.col("p_size"), 8).alias("score"), hits.alias("n_rules"), F.round(F.col("p_size") / F.col("p_retailprice"), 9).alias("ratio"))


def rebased_offsets(spark, d):
    """Offsets of all lines in their supplier, turned back to offsets in their part of the supplier."""
    w = Window.partitionBy("l_suppkey").orderBy("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, d, "lineitem").withColumn("at", F.row_number().over(w) - 1)
    return ops.rebased(li, ["l_suppkey", "l_returnflag"], "at").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "at")


def repeated_items(spark, d):
    """Each part as often as its size divided by ten, numbered."""
    return table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.floor(F.col("p_size") / 10).cast("int") + 1)).alias("copy"))


def segment_ids(spark, d):
    """The order's key repeated for each of its lines, by the count of lines alone."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("l_orderkey", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))


def segment_lists(spark, d):
    """The parts of every order in order of their lines, an empty text for orders without lines."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return o.join(li, "l_orderkey", "left").select("l_orderkey", F.coalesce(F.array_join(F.transform("a", lambda x: x["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"))


def nearest_in_space(spark, d):
    """The nearest point within a radius for every vector, by cells of the radius; the first by number on ties."""
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    p = within_distance(e.withColumnRenamed("vec_id", "l"), e.withColumnRenamed("vec_id", "r"), ["x", "y", "z"], 0.15).where("l <> r")
    return p.groupBy("l").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "r")).alias("m")).select("l", F.col("m.r").alias("r"), F.round("m.distance", 7).alias("distance"))


def near_edges(spark, d):
    """Edges to the three nearest within a radius, in one label, with the chain of vectors forced in."""
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    p = within_distance(e.withColumnRenamed("vec_id", "l"), e.withColumnRenamed("vec_id", "r"), ["x", "y", "z"], 0.15, ["label"]).where("l <> r")
    k = F.row_number().over(Window.partitionBy("l").orderBy(F.round("distance", 9), "r"))
    chain = e.select("vec_id", "label", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("next")).where("next is not null")
    forced = chain.select("label", F.col("vec_id").alias("l"), F.col("next").alias("r"))
    return p.withColumn("k", k).where("k <= 3").select("label", "l", "r").union(forced).distinct()


def clashes(spark, d):
    """Pairs nearer than a share of the sum of their radii, without neighbours in number."""
    e = table(spark, d, "embeddings").select("vec_id", (0.03 + 0.01 * F.col("label") / 10).alias("rad"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    most = 0.16  # beyond twice the greatest radius, so no pair is lost
    p = within_distance(e.withColumnRenamed("vec_id", "l"), e.withColumnRenamed("vec_id", "r"), ["x", "y", "z"], most).where("l < r and r - l > 1")
    rad = e.select("vec_id", "rad")
    p = p.join(rad.toDF("l", "rl"), "l").join(rad.toDF("r", "rr"), "r")
    return p.where(F.col("distance") < 0.9 * (F.col("rl") + F.col("rr"))).select("l", "r")


def chosen_fragments(spark, d):
    """Intervals of an order's lines that do not overlap, larger first."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") * 10).alias("b"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e"))
    return ops.pick_apart(li.withColumn("neg", F.col("b") - F.col("e")), "l_orderkey", "b", "e", ["neg", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "b", "e")


def frechet_of_labels(spark, d):
    """Frechet distance of two halves of the vectors (by label), over all 64 places."""
    e = table(spark, d, "embeddings")
    a, b = ops.moments(e.where("label < 5"), "embedding", 64), ops.moments(e.where("label >= 5"), "embedding", 64)
    return spark.createDataFrame([(a[0], b[0], round(ops.frechet(a, b), 6))], "n_a bigint, n_b bigint, distance double")


def order_graph_features(spark, d):
    """Laplacian features of the bipartite graph of a customer's orders and statuses."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("src"), (-F.ascii("o_orderstatus").cast("bigint")).alias("dst"))
    f = ops.laplacian_features(o, "o_custkey", "src", "dst", 2)
    return f.select("o_custkey", "node", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[1], 6).alias("f1"))


QUERIES = {f.__name__: f for f in (segment_verdicts, summed_profile, derived_counts, pivot_unfilled, pattern_bins, zero_filled_types, batch_sums, sampled_success, positive_summary, size_columns, aligned_edges, parallel_lists, bond_geometry, rigid_moves, rmsd_to_centre, line_arcs, embeddings_of_time, estimated_price, rebased_offsets, repeated_items, segment_ids, segment_lists, nearest_in_space, near_edges, clashes, chosen_fragments, frechet_of_labels, order_graph_features)}
_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_P = _V + ", p AS (SELECT vec_id, label, e[1] AS x, e[2] AS y, e[3] AS z FROM v), n AS (SELECT a.vec_id AS l, b.vec_id AS r, a.label AS la, b.label AS lb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id)"
_GEO = _V + """, q AS (SELECT vec_id, e, e[4]-e[1] AS px, e[5]-e[2] AS py, e[6]-e[3] AS pz, e[7]-e[4] AS qx, e[8]-e[5] AS qy, e[9]-e[6] AS qz, e[10]-e[7] AS rx, e[11]-e[8] AS ry, e[12]-e[9] AS rz FROM v),
 m AS (SELECT *, py*qz-pz*qy AS mx, pz*qx-px*qz AS my, px*qy-py*qx AS mz, qy*rz-qz*ry AS nx, qz*rx-qx*rz AS ny, qx*ry-qy*rx AS nz FROM q)
 SELECT vec_id, round(sqrt(px*px+py*py+pz*pz), 7) AS length, round(acos((-px*qx-py*qy-pz*qz)/(sqrt(px*px+py*py+pz*pz)*sqrt(qx*qx+qy*qy+qz*qz))), 7) AS angle,
 round(atan2(sqrt(qx*qx+qy*qy+qz*qz)*(px*nx+py*ny+pz*nz), mx*nx+my*ny+mz*nz), 6) AS torsion,
 round(((px+qx+rx)*mx+(py+qy+ry)*my+(pz+qz+rz)*mz)/sqrt(mx*mx+my*my+mz*mz), 6) AS off_plane FROM m"""
_CNT = lambda v: f"count(*) FILTER (event_type = '{v}')"
SQL = {
    "segment_verdicts": "WITH v AS (SELECT l_orderkey, CASE WHEN p_size < 10 THEN 1.0 ELSE 0.0 END AS x FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) SELECT l_orderkey, sum(x) > 0 AS any_positive, sum(x) = 0 AS none_positive, bool_and(x = 1) AS all_one, avg(x) < 0.25 AS low_mean FROM v GROUP BY 1",
    "summed_profile": "SELECT l_suppkey, l_returnflag, round(sum(coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0)), 4) AS total FROM lineitem GROUP BY ALL",
    "derived_counts": f"SELECT user_id, {', '.join(_CNT(v) + ' AS ' + v for v in ('click', 'view', 'signup', 'purchase', 'error'))}, {_CNT('click')} + {_CNT('view')} AS seen, {_CNT('signup')} + {_CNT('purchase')} AS good, {_CNT('click')} + {_CNT('view')} + {_CNT('signup')} + {_CNT('purchase')} AS not_error FROM events GROUP BY 1",
    "pivot_unfilled": "SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1",
    "pattern_bins": "SELECT p_brand, p_type, CAST(floor(p_retailprice / 50) AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT p_brand, NULL, CAST(floor(p_retailprice / 50) AS BIGINT), count(*) FROM part GROUP BY ALL",
    "zero_filled_types": "SELECT v AS p_type, count(p_partkey) AS n FROM (SELECT unnest(['ECONOMY', 'STANDARD', 'PROMO', 'LARGE', 'UNKNOWN', 'ABSENT']) AS v) LEFT JOIN part ON p_type = v GROUP BY 1",
    "batch_sums": _V + " SELECT label, round(sum(list_sum(e)), 5) AS total FROM v GROUP BY 1",
    "sampled_success": "SELECT s_suppkey AS l_suppkey, count(l_orderkey) AS n, round(CASE WHEN count(l_orderkey) > 0 THEN count(*) FILTER (l_returnflag = 'R') / count(l_orderkey) ELSE 0.0 END, 9) AS rate FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY 1",
    "positive_summary": _V + " SELECT vec_id, round(list_avg(list_filter(e, lambda x: x > 0)), 7) AS mean, round(list_min(list_filter(e, lambda x: x > 0)), 9) AS low, round(list_max(list_filter(e, lambda x: x > 0)), 9) AS high FROM v",
    "size_columns": "SELECT p_brand, " + ", ".join(f"count(*) FILTER (p_size = {k}) AS num_{k}" for k in range(1, 7)) + " FROM part WHERE p_size BETWEEN 1 AND 6 GROUP BY 1",
    "aligned_edges": "SELECT l_orderkey, l_partkey, CASE WHEN min(l_linenumber) <= 3 THEN max(l_discount) END AS x, min(l_linenumber) <= 3 AS matched FROM lineitem GROUP BY ALL",
    "parallel_lists": "SELECT route_id, ingested_at, unnest(range(greatest(len(building_block_ids), len(building_block_smiles), len(building_block_providers))))::INT AS pos, unnest(list_resize(building_block_ids, greatest(len(building_block_ids), len(building_block_smiles), len(building_block_providers)))) AS id, unnest(list_resize(building_block_smiles, greatest(len(building_block_ids), len(building_block_smiles), len(building_block_providers)))) AS smiles, unnest(list_resize(building_block_providers, greatest(len(building_block_ids), len(building_block_smiles), len(building_block_providers)))) AS provider FROM routes WHERE building_block_ids IS NOT NULL AND building_block_smiles IS NOT NULL AND building_block_providers IS NOT NULL",
    "bond_geometry": _GEO,
    "rigid_moves": _V + " SELECT vec_id, round(0.5 - e[2], 7) AS x, round(e[1] - 0.25, 7) AS y, round(e[3] + 1.0, 7) AS z FROM v",
    "rmsd_to_centre": "WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL) SELECT vec_id, round(sqrt(avg((x - m) ** 2)), 7) AS rmsd FROM e JOIN c USING (label, i) GROUP BY 1",
    "line_arcs": f"WITH a AS (SELECT l_orderkey, (l_linenumber * 0.9) % {2 * math.pi!r} AS lo, least((l_linenumber * 0.9) % {2 * math.pi!r} + l_quantity / 25, {2 * math.pi!r}) AS hi FROM lineitem), g AS (SELECT l_orderkey, lo, hi, coalesce(max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) SELECT l_orderkey, bool_and(lo <= before) AND max(hi) >= {2 * math.pi - 1e-12!r} AS covered FROM g GROUP BY 1",
    "embeddings_of_time": "WITH t AS (SELECT DISTINCT l_discount * 10 AS t FROM lineitem) SELECT t, " + ", ".join(f"round({'sin' if i < 3 else 'cos'}(t * pow(100.0, -{i % 3} / 3.0)), 8) AS s{i}" for i in range(6)) + ", " + ", ".join(f"round(exp(-(((t - {i} / 3.0) / 0.25) ** 2)), 8) AS r{i}" for i in range(4)) + " FROM t",
    "estimated_price": "SELECT p_partkey, round(0.16 - 0.63 * ln(p_retailprice) + 0.066 * p_size, 8) AS score, CAST(p_size > 25 AS INT) + CAST(p_retailprice > 950 AS INT) + CAST(contains(p_name, 'ring') AS INT) AS n_rules, round(p_size / p_retailprice, 9) AS ratio FROM part",
    "rebased_offsets": "SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INT) AS at FROM lineitem",
    "repeated_items": "SELECT p_partkey, unnest(range(1, p_size // 10 + 2))::INT AS copy FROM part",
    "segment_ids": "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey) - 1 AS INT) AS k FROM lineitem",
    "segment_lists": "SELECT o_orderkey AS l_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "nearest_in_space": _P + " SELECT l, arg_min(r, struct_pack(d := round(dist, 9), r)) AS r, round(min(round(dist, 9)), 7) AS distance FROM n WHERE dist <= 0.15 GROUP BY 1",
    "near_edges": _P + ", k AS (SELECT la, l, r, row_number() OVER (PARTITION BY l ORDER BY round(dist, 9), r) AS k FROM n WHERE dist <= 0.15 AND la = lb), c AS (SELECT label, vec_id AS l, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS r FROM p) SELECT la AS label, l, r FROM k WHERE k <= 3 UNION SELECT label, l, r FROM c WHERE r IS NOT NULL",
    "clashes": _P + " SELECT l, r FROM n WHERE l < r AND r - l > 1 AND dist < 0.9 * (0.03 + 0.01 * la / 10 + 0.03 + 0.01 * lb / 10)",
}
