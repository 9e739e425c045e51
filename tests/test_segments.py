import random
from itertools import combinations

from loomspar.plans import segments


def test_graph_queries_take_all_rows_and_real_keys(spark, tmp_path):
    rng = random.Random(4)
    # quantities above 2, parts above 120: rows and keys that a filter or a modulo would lose or fold
    lines = [(rng.randrange(1, 60), p := rng.randrange(1, 160) * 7, p % 7 + rng.randrange(3) + 7 * (p % 5), float(rng.randrange(1, 50)), rng.choice("ANR")) for _ in range(250)]
    suppliers = [(s, rng.choice([-1.0, 5.0])) for s in range(1, 45)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string", "lineitem")
    write(suppliers, "s_suppkey bigint, s_acctbal double", "supplier")
    write([(p,) for p in range(1, 1200)], "p_partkey bigint", "part")
    run = lambda name: [tuple(r) for r in segments.QUERIES[name](spark, str(tmp_path)).collect()]

    comp = {x: x for _, p, s, _, _ in lines for x in (2 * p, 2 * s + 1)}
    for _ in comp:
        for _, p, s, _, _ in lines:
            comp[2 * p] = comp[2 * s + 1] = min(comp[2 * p], comp[2 * s + 1])
    got = run("whole_components")
    assert dict(got) == comp and len(got) == len(comp) and len(set(comp.values())) > 1

    nodes = sorted([2 * s + 1 for s, x in suppliers if x > 0] + [2 * p for p in range(1, 1200)])
    at = {x: i for i, x in enumerate(nodes)}
    want = sorted({(g, at[2 * s + 1], at[2 * p]) for _, p, s, _, g in lines if 2 * s + 1 in at})
    assert sorted(run("whole_subgraph")) == want and want

    orders = {}
    for o, p, *_ in lines:
        orders.setdefault(o, set()).add(p)
    edges = {e for parts in orders.values() for e in combinations(sorted(parts), 2)}
    count = {}
    for t in combinations(sorted({x for e in edges for x in e}), 3):
        if all(e in edges for e in combinations(t, 2)):
            for x in t:
                count[x] = count.get(x, 0) + 1
    assert dict(run("whole_triangles")) == count and len(count) > 50 and max(count) > 120


def _tree_tables(spark, tmp_path, monkeypatch, name):
    """The query over 400 events, some without their parent's row, and the most rows of a table that cut lineage."""
    ids = [i for i in range(400) if i not in (3, 10, 25)]
    spark.createDataFrame([(i, [None, "purchase", "view"][i % 3]) for i in ids], "event_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    rows = []

    def cut(df, real=segments.ops.cut_lineage):
        rows.append((table := real(df)).count())
        return table

    monkeypatch.setattr(segments.ops, "cut_lineage", cut)
    got = [tuple(r) for r in segments.QUERIES[name](spark, str(tmp_path)).collect()]
    up = lambda i: [i, *(up(i // 2) if i > 1 and i in ids else [])]
    return ids, up, got, max(rows)


def test_tree_paths_have_one_row_per_node_in_every_round(spark, tmp_path, monkeypatch):
    ids, up, got, most = _tree_tables(spark, tmp_path, monkeypatch, "tree_paths")
    assert sorted(got) == [(i, "-".join(map(str, reversed(up(i))))) for i in ids]
    assert most <= 400


def test_tree_totals_have_one_row_per_node_in_every_round(spark, tmp_path, monkeypatch):
    ids, up, got, most = _tree_tables(spark, tmp_path, monkeypatch, "tree_totals")
    below = {}
    for i in ids:
        for depth, x in enumerate(up(i)):
            below.setdefault(x, []).append((i, depth))
    value = {i: [None, 1, 0][i % 3] for i in ids}
    total = lambda b: sum(v) if (v := [value[i] for i, _ in b if value[i] is not None]) else None
    assert sorted(got) == [(x, total(b), max(k for _, k in b)) for x, b in sorted(below.items())]
    assert most <= 400


def test_triangles_in_passes_make_no_wedge_rows(spark, monkeypatch):
    edges = [*combinations(range(14), 2), *((99, x) for x in range(40)), (3, 1), (5, 5)]
    want = {}
    every = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    for t in combinations([*range(40), 99], 3):
        for x in t if all(e in every for e in combinations(t, 2)) else ():
            want[x] = want.get(x, 0) + 1
    monkeypatch.setattr(segments.ops, "WEDGES", 2)
    rows = []
    monkeypatch.setattr(segments.ops, "cut_lineage", lambda df, cut=segments.ops.cut_lineage: rows.append(df.count()) or cut(df))
    assert {r[0]: r[1] for r in segments.ops.triangles(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()} == want
    assert max(rows) <= len(every) and len(rows) > 5
