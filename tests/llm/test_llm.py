import base64
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspar import session
from loomspar.llm import leaks, mixing, neighbours, overlap, residue, tokens
from loomspar.llm.items import path_key, split_name

MIX = "mix_id bigint, stage string, datasets array<string>, weights array<double>, num_samples_per_epoch_per_gpu int, max_repeats int, ingested_at timestamp_ntz, extra int"
ITEM = "item_id bigint, datadir string, split string, extra int"


def items(spark, sizes):
    rows = [(1000 * i + n, d, " Training", 0) for i, (d, size) in enumerate(sizes.items()) for n in range(size)]
    return spark.createDataFrame(rows + rows[:3] + [(None, "a", "train", 0), (7, None, "train", 0), (8, "a", None, 0)], ITEM)


def test_mix_keeps_quotas_caps_and_disjoint_blocks(spark):
    rows = [(1, "train", ["./a/", "b", "a"], [1.0, 1.0, 2.0], 400, 2, None, 0), (2, "TRAIN", ["a", "gone"], None, 50, 1, None, 0), (3, "train", ["a"], [1.0, 2.0], 9, 1, None, 0), (4, "train", ["a"], [0.0], 9, 1, None, 0), (5, "train", ["b"], [None], 9, 1, None, 0), (6, "train", None, None, None, None, None, 0)]
    mixes, it = spark.createDataFrame(rows + rows[:1], MIX), items(spark, {"a": 90, "b": 300})
    report = {(r.mix_id, r.dataset_pos): r for r in mixing.mix_report(mixes, it, shard_size=16).collect()}
    assert {k for k, r in report.items() if r.over} == {(1, 2), (2, 1)} and {k[0] for k in report} == {1, 2}
    assert [report[1, i].drawn for i in range(3)] == [100, 100, 80] and report[2, 0].drawn == 25 and report[2, 1].drawn == 0
    drawn = mixing.draw_mix(mixes, it, block_rows=16, shard_size=16).cache()
    got = {(r.mix_id, r.dataset_pos): r.n for r in drawn.groupBy("mix_id", "dataset_pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(1, 0): 100, (1, 1): 100, (1, 2): 80, (2, 0): 25}
    assert drawn.groupBy("mix_id", "item_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix_report(mixes.limit(0), it).count() == 0 and mixing.mix_report(mixes, it.limit(0)).where("drawn > 0").count() == 0


def test_splitting_tree_is_exact():
    q = np.array([1000, 1, 0, 77])
    leaves = list(mixing.split_node(5, 0, 13, 13, int(q.sum()), q, np.zeros(4, np.int64), 1, 1))
    assert sum(x[2] for x in leaves).tolist() == q.tolist()
    assert [int(x[2].sum()) for x in leaves] == [mixing.shard_start(x[0] + 1, 13, 1078) - mixing.shard_start(x[0], 13, 1078) for x in leaves]
    big = mixing.draw_part(mixing.node_rng(1), np.array([10**10, 3 * 10**10]), 10**9 + 1)
    assert big.sum() == 10**9 + 1


@pytest.mark.parametrize("good, bad, size", [(7, 5, 6), (40, 900, 300), (900, 40, 700), (3 * 10**11, 10**12, 4 * 10**10), (10**6, 10**14, 10**10)])
def test_hypergeometric_draws_at_any_size(good, bad, size):
    rng, total = mixing.node_rng(good, size), good + bad
    drawn = np.array([mixing.draw_good(rng, good, bad, size) for _ in range(4000)], float)
    mean, var = size * good / total, size * good / total * (bad / total) * ((total - size) / (total - 1))
    assert drawn.min() >= max(0, size - bad) and drawn.max() <= min(good, size)
    assert abs(drawn.mean() - mean) < 5 * (var / 4000) ** 0.5 and 0.88 < drawn.var() / var < 1.12
    z = (drawn - mean) / var**0.5
    assert var < 100 or abs((z**4).mean() - 3) < 0.6


def test_paths_and_splits(spark):
    df = spark.createDataFrame([(" ./a//b/ ",), ("a/./b",), ("a/c/../b",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(path_key(F.col("x"))).collect()] == ["a/b", "a/b", "a/b", None, "."]
    df = spark.createDataFrame([(" Valid ",), ("DEV",), ("testing",), ("unassigned",), (None,)], "x string")
    assert [r[0] for r in df.select(split_name(F.col("x"))).collect()] == ["val", "val", "test", None, None]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def change(rng, text, n):
    t = list(text)
    for _ in range(n):
        k, what = rng.randrange(len(t)), rng.randrange(3)
        t[k : k + 1] = [] if what == 0 else [rng.choice("ABCDE")] if what == 1 else [t[k], rng.choice("ABCDE")]
    return "".join(t)


def test_overlap_finds_every_pair(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ABCDE") for _ in range(rng.choice([1, 5, 8, 9, 10, 19, 20, 30, 58, 90]))) for _ in range(12)]
    rows = []
    for n in range(400):
        a, b = rng.choice(base), rng.choice(base[:4])
        rows.append((n, rng.choice(["train", "Training", "val", "test", "x", None]), "d", change(rng, a, rng.randrange(1 + max(1, len(a) // 10))), change(rng, b, rng.randrange(1 + len(b) // 10)).lower(), n))
    rows += [(900, "train", "d", None, "abc", 1), (901, "val", "d", " ", "abc", 1), (902, "val", "d", "ABC", "--", 1), (903, None, None, None, None, None), (None, "val", "d", "ABC", "abc", 1), rows[0]]
    df = spark.createDataFrame(rows, "item_id bigint, split string, datadir string, ligand_smiles string, pocket_seq string, pid int")
    side = {"train": 1, "Training": 1, "val": 0, "test": 0}
    near = lambda a, b: edits(a, b) * 10 <= max(len(a), len(b))
    recs = [(i, side[s], lig.strip(), p.upper()) for i, s, _, lig, p, _ in {r[0]: r for r in rows[:400]}.values() if s in side and lig.strip() and p]
    want = {(e[0], t[0]) for e in recs if not e[1] for t in recs if t[1] and near(e[2], t[2]) and near(e[3], t[3])}
    got = [(r.eval_id, r.train_id) for r in overlap.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_nearest_pairs_against_brute_force(spark):
    rng = random.Random(5)
    sets = {}
    for n in range(900):
        old = list(rng.choice(list(sets.values()))) if sets and rng.random() < 0.8 else rng.sample(range(2048), 30)
        sets[f"i{n:04d}"] = old if rng.random() < 0.2 else sorted({*rng.sample(old, max(2, len(old) - 3)), *rng.sample(range(2048), 2)})
    rows = [(k, v, 1) for k, v in sets.items()] + [("i0001", None, 1), ("e1", [], 1), ("e2", None, 1), (None, [1], 1), ("i0002", sets["i0002"][::-1] + sets["i0002"][:2], 1)]
    df = spark.createDataFrame(rows, "id string, fp array<int>, c int")
    keys, want = sorted(sets), set()
    as_set = {k: set(v) for k, v in sets.items()}
    for a in keys:
        sims = sorted(((-len(as_set[a] & as_set[b]) / len(as_set[a] | as_set[b]), b) for b in keys if b != a))[:5]
        want |= {(min(a, b), max(a, b)) for s, b in sims if -s >= 0.5}
    got = {(r.id_a, r.id_b) for r in neighbours.nearest_pairs(df, "id", "fp").collect()}
    exact = {(r.id_a, r.id_b) for r in neighbours.nearest_pairs(df, "id", "fp", leaf=10**6).collect()}
    assert exact == want and len(got & want) >= 0.9 * len(want)
    assert neighbours.nearest_pairs(df.limit(0), "id", "fp").count() == 0


def test_copies_of_one_set(spark):
    df = spark.createDataFrame([(f"k{n:03d}", [1, 2, 3]) for n in range(200)], "id string, fp array<int>")
    got = [(r.id_a, r.id_b) for r in neighbours.nearest_pairs(df, "id", "fp").collect()]
    first = [f"k{n:03d}" for n in range(6)]
    assert len(got) == len(set(got)) and all(a in first for a, _ in got) and len(got) == 15 + 5 * 194 - 0


def test_encoding_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", None, " ", "\n\n  x", "Hello world's  end ", "<|endoftext|>", "中文 한글 🧪 ⚗️", "a" * 3000, " " * 500 + "x", "é́́", "x" * 20 + "1234567890" * 50] + ["".join(chr(rng.choice([*range(32, 127), *range(160, 1500), 0x4E2D, 0x1F9EA])) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(n, t, 0) for n, t in enumerate(texts)] + [(0, "", 0)], "doc_id bigint, text string, ids int")
    got = tokens.encode_texts(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id] or "")
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{n}" for n in range(40)] + ["Straße", "ﬁne", "中文"]
    evals = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 11, 12, 40])))) for n in range(30)]
    docs = []
    for n in range(300):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            part = rng.choice(evals)[1].split()
            k = rng.randrange(max(1, len(part) - 10))
            own[len(own) // 2 : len(own) // 2] = part[k : k + rng.choice([10, 11, 12, 13, 50])]
        docs.append((n, ", ".join(own).upper().replace("W1", "w­1​"), 0))
    docs += [(900, None, 0), (901, "", 0), (902, " \n", 0), (None, "x", 0), (903, " ".join(["w0"] * 30000) + " " + evals[3][1], 0)]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leaks.words(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t, _ in docs if d is not None for i, e in evals if grams(t) & grams(e)}
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame([*evals, (99, None)], "item_id bigint, text string")
    for size in (leaks.SLICE_BYTES, 500):
        assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, e, slice_bytes=size).collect()} == want and want
    assert leaks.leaked_items(d.limit(0), e).count() == 0 and leaks.leaked_items(d, e.limit(0)).count() == 0


RESIDUE = [
    (None, None), ("", None), (" \n ", None), ("Heat {{ temp }} to boil.", "placeholder"), ("Use `{{ temp }}` in the template.", None), ("```\n${NAME}\n```\nDone well.", None), ("Add [INSERT SOLVENT HERE] now.", "placeholder"),
        ("The set {1, 2} is small.", None), ("x <b>bold</b> y", None), ("Stir <solvent> for 2 h.", "placeholder"), ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", "filler"), ("The intern pasted lorem ipsum into the draft.", None),
        ("404 Not Found\nThe record x_1 you asked for could not be found on this server.", "page"), ("Menu\nSearch\n\nPlease enable JavaScript to continue.\n\nBack to top", "page"), ("Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "page"),
        ("The vendor portal returned error 404 for lot 7, so we ordered elsewhere.", None), ("Our viewer needs JavaScript; the static image is attached.", None), ("Seite nicht gefunden (Fehler 404).", "page"), ("请启用 JavaScript 以继续浏览。", "page"),
        ("Our viewer requires JavaScript. Please enable it and reload.", "page"), ("403 Forbidden\nPlease sign out and sign in again.", "page"), ("JavaScript is off. " + "Please turn it on in your browser" + " and reload the page" * 9 + ".", "page"),
        ("You must enable JavaScript to use this site" + ", its catalog and its routes" * 7 + ".", "page"), ("Home About Contact Help Search Login Register Sitemap Privacy Terms Imprint Cookies Blog News FAQ\n404 Not Found", "page"),
        ("JavaScript is not required to read this report.", None), ("We enabled JavaScript in the viewer and repeated the measurement.", None), ("The script needs 3 h on one node and reads all fingerprints.", None), ("404 Not Found\nPlease stir 5 g of the acid in 20 mL of water.", None),
]


def page_corpus():
    """Pages with menus around them and pages with courtesy lines, as a corpus holds many of them, and content."""
    bodies = ["404 Not Found", "502 Bad Gateway", "The page does not exist.", "JavaScript is disabled in your browser.", "Access denied.", "Your session has expired.", "The page you asked for could not be found on this server.", "The record cannot be displayed, since the connection to the database failed."]
    frames = ["Menu\nSearch\n\n{}\n\nBack to top", "Home About Contact Help Search Login Register Sitemap Privacy Terms Imprint Cookies Blog News FAQ\n{}", "{}\nPlease sign out and sign in again.", "{}\nPlease enable it and reload."]
    content = [f"Run {w} gave a clear oil. It was stored cold." for w in "alpha beta gamma delta".split()]
    return [f.format(x) for f in frames for x in bodies] + content


def labels_of(spark, texts):
    rows = [(n, t) for n, t in enumerate([*texts, *page_corpus()])]
    got = {r.doc_id: r.label for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    return [got.get(n) for n in range(len(texts))], got


def test_residue_labels(spark):
    got, every = labels_of(spark, [t for t, _ in RESIDUE])
    assert [(t, g) for (t, _), g in zip(RESIDUE, got)] == RESIDUE
    assert all(len(RESIDUE) + n in every for n in range(32)) and not any(len(RESIDUE) + n in every for n in range(32, 36))


def test_passages_join_by_the_company_they_keep(spark):
    told = "The host did not respond to the first call."  # a trusted passage inside content
    body = ["Crystals formed over night in the cold room, then melted again on the bench.", "The yield was poor.", "Nothing else changed."]
    texts = [f"{a}\n{x}" for a in ("404 Not Found", "The page does not exist.", "Access to this page was denied.") for x in ("Nichts da.", "Geh heim, bitte.")]
    texts += ["Nichts da. Geh heim, bitte."] + [" ".join([told, *body[:k]]) for k in (1, 2, 3)] * 3 + [" ".join(body)] * 5
    got, _ = labels_of(spark, texts)
    assert got[:7] == ["page"] * 7 and not any(got[7:])


def test_residue_spreads_over_near_duplicates(spark):
    body = "404 Not Found. The requested URL /item/7 was not found. Please try again later or contact the administrator if this keeps happening on a different day. Check the address and reload."
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()
    near = body + " Zuletzt geprüft am Montag."
    docs = [(1, body), (2, body.replace("7", "8")), (3, near), (4, " ".join(words)), (5, None), (6, ""), (None, body), (1, body), (7, "Dose {{ n }} " + " ".join(words)), (8, "Dose 9 " + " ".join(words))]
    got = {r.doc_id: (r.label, r.via) for r in residue.residue_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: ("page", "own"), 2: ("page", "own"), 3: ("page", "near"), 7: ("placeholder", "own")}
    assert residue.residue_documents(spark.createDataFrame([], "doc_id bigint, text string, label int")).count() == 0


def test_links_of_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        own = [rng.choice("abcdefgh") + "".join(rng.choice("klmnopqrst") for _ in range(3)) for _ in range(60)]
        texts.append(own)
        for _ in range(3):
            t = list(own)
            t[rng.randrange(60)] = "changed"
            texts.append(t)
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id bigint, text string")
    marked = residue.mark_documents(docs, "doc_id", "text", residue.table_plan(160)).cache()
    of = {r.doc: r.cls for r in marked.collect()}
    core = {of[n]: t for n, t in enumerate(texts)}
    grams = {c: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for c, t in core.items()}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    got = {(r.a, r.b) for r in residue.near_classes(marked).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0 and len(of) == 160


def test_query_draws_the_records_of_the_whole_tables(spark, tmp_path):
    from loomspar.llm.queries import QUERIES

    n = 9000  # source a spans several blocks of the default size
    rows = [(k, "./a/" if k < n else "b", "Training", 0) for k in range(n + 40)]
    spark.createDataFrame(rows + rows[:50], ITEM).write.parquet(str(tmp_path / "dataset_items.parquet"))
    mixes = [(1, "train", ["a", "b"], [0.9, 0.1], 20000, 3, None, 0), (2, "TRAIN", ["a"], None, 5000, 1, None, 0)]
    spark.createDataFrame(mixes, MIX).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "mixed_dataset_params.parquet"))
    got = QUERIES["p1_mix"](spark, str(tmp_path)).cache()
    count = {(r.mix_id, r.dataset_pos): r["count"] for r in got.groupBy("mix_id", "dataset_pos").count().collect()}
    assert count == {(1, 0): 18000, (1, 1): 120, (2, 0): 5000}
    times = {(r.mix_id, r.item_id): r["count"] for r in got.groupBy("mix_id", "item_id").count().collect()}
    assert {t for (m, i), t in times.items() if m == 1} == {2, 3} and all(t == (2 if i < n else 3) for (m, i), t in times.items() if m == 1) and {t for (m, _), t in times.items() if m == 2} == {1}
    shard = [r.item_id for r in got.where("mix_id = 1 and shard = 3").orderBy("pos").collect()]
    assert [r.pos for r in got.where("mix_id = 1 and shard = 3").orderBy("pos").collect()] == list(range(len(shard))) and shard != sorted(shard)


def test_recall_on_other_phrasings(spark):
    import pathlib
    import runpy

    texts = runpy.run_path(str(pathlib.Path(__file__).with_name("phrasings.py")))
    assert sum(g == "page" for g in labels_of(spark, texts["PAGES"])[0]) >= 15 and not any(labels_of(spark, texts["CONTENT"])[0])


def test_the_tree_draws_for_the_cases_too(spark, tmp_path, monkeypatch):
    from loomspar.llm import q_mixing

    cuts = []
    monkeypatch.setattr(mixing, "cut_lineage", lambda df, cut=mixing.cut_lineage: cuts.append(df.columns) or cut(df))
    items(spark, {"a": 90}).write.parquet(str(tmp_path / "dataset_items.parquet"))
    spark.createDataFrame([(1, "train", ["a"], None, 400, 2, None, 0)], MIX).write.parquet(str(tmp_path / "mixed_dataset_params.parquet"))
    assert [tuple(r) for r in q_mixing.p1_found(spark, str(tmp_path)).collect()] == [(1, 0)]
    assert ["mix_id", "dataset_pos", "drawn", "n_shards"] in cuts


def test_overlap_covers_all_of_ligand_and_pocket(spark):
    lig, pocket = "CCOCNCCSCCOCCNFCCBrC", "ACDEFGHIKLMNPQRSTVWYACDEGFHIKL"
    near = pocket[:15] + "X" + pocket[16:]
    rows = [(1, "train", "d", lig, near), (2, "val", "d", lig, pocket), (3, "test", "d", lig, near), (4, "test", "d", "CC", "AB"), (5, "train", "d", "CC", "ab")]
    df = spark.createDataFrame(rows, "item_id bigint, split string, datadir string, ligand_smiles string, pocket_seq string")
    got = {(r.eval_id, r.train_id): r.overlap for r in overlap.cross_split_pairs(df).collect()}
    assert set(got) == {(2, 1), (3, 1), (4, 5)} and got[3, 1] == got[4, 5] == 1.0 and 0.5 < got[2, 1] < 1.0


def test_content_defined_chunks_move_only_near_an_edit():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACDEFGHIKL") for _ in range(300)) for _ in range(40)]

    def pieces(text):
        digests, sizes, begins = overlap.content_chunks(["x", text, ""])
        i, j = begins[1], begins[2]
        assert sizes[i:j].sum() == len(text) and begins[3] == j
        ends = np.cumsum(sizes[i:j])
        return [(text[e - n : e], d) for e, n, d in zip(ends, sizes[i:j], digests[i:j])]

    digest_of = {}
    for t in texts:
        for change_at in (None, 150):
            for piece, d in pieces(t if change_at is None else t[:150] + "Q" + t[150:]):
                assert digest_of.setdefault(piece, d) == d
        before, after = pieces(t), pieces(t[:150] + "Q" + t[150:])
        assert before[:20] == after[:20] and before[-20:] == after[-20:] and 3 < 300 / len(before) < 8
    assert len(set(digest_of.values())) == len(digest_of)


def test_leaks_with_a_huge_vocabulary_and_repeats_without_end():
    names = [f"n{k}" for k in range(2_200_000)]  # their number cubed is beyond 64 bits
    index = leaks.ItemIndex([(1, " ".join(names)), (2, "so " * 50_000 + "it goes")])
    codes, places = index.prefix(np.zeros(len(index.codes), np.int64))
    some = [" ".join(names[k : k + 12]) for k in range(2_100_000, 2_101_000, 10)]
    assert index.matches(some, codes, places) == {(k, 1) for k in range(100)}
    assert (places > 2_200_000).sum() < 100 and index.matches(["so " * 20_000, "so " * 11], codes, places) == {(0, 2)}


def test_shuffle_files_go_when_lineage_is_cut(spark):
    from loomspar.session import cut_lineage

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllBlocks().size()
    cut = cut_lineage(spark.range(20000).groupBy((F.col("id") % 7000).alias("k")).count())
    for _ in range(50):  # the files are removed in the background
        if disk.getAllBlocks().size() <= before:
            break
        time.sleep(0.1)
    assert disk.getAllBlocks().size() <= before and cut.count() == 7000


def test_overlap_makes_chunks_of_ligands_around_popular_pockets_only(spark, monkeypatch):
    rng = random.Random(6)
    pockets, ligands = (["".join(rng.choice("ABCDE") for _ in range(n)) for _ in range(6)] for n in (40, 60))
    rows = [(n, "train" if n % 3 else "val", "d", change(rng, rng.choice(ligands), rng.randrange(7)), pockets[min(5, n % 20)]) for n in range(600)]
    df = spark.createDataFrame(rows, "item_id bigint, split string, datadir string, ligand_smiles string, pocket_seq string")
    chunked = []
    monkeypatch.setattr(overlap, "with_chunks", lambda df, text, *a, make=overlap.with_chunks: chunked.append(df.count() if text == "ligand" else 0) or make(df, text, *a))
    found = lambda **few: sorted((r.eval_id, r.train_id) for r in overlap.cross_split_pairs(df, **few).collect())
    every, n_every = found(few=0), sum(chunked)
    chunked.clear()
    some, n_some = found(few=30), sum(chunked)
    assert some == every and len(every) > 500
    assert 0 < n_some < n_every
    chunked.clear()
    assert found(few=600) == every and sum(chunked) == 0


def test_shingles_are_kept_only_where_a_label_may_reach(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("klmnopqrst") for _ in range(4)) for _ in range(90)]
    body = "404 Not Found. The requested URL was not found. Please try again later or contact the administrator if this keeps happening on a different day. Check the address and reload."
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(100)]
    texts += [f"{t} {rng.choice(words)}" for t in texts] + [body, body + " Zuletzt am Montag.", body + " Zuletzt am Montag geprüft."]  # the last is near to the one before, hardly to the first
    kept = []
    monkeypatch.setattr(residue, "cut_lineage", lambda df, cut=residue.cut_lineage: (out := cut(df), "shingles" in df.columns and kept.append(out.count()))[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    got = {r.doc: r.via for r in residue.residue_documents(docs, "doc").collect()}
    assert got == {200: "own", 201: "near", 202: "near"} and 0 < sum(kept) < 20
    marked = residue.mark_documents(docs, "doc", "text", residue.table_plan(203)).cache()
    few = {tuple(r) for r in residue.meeting_classes(marked).collect()}
    monkeypatch.setattr(residue, "AT_ONCE", 10**6)
    assert few == {tuple(r) for r in residue.meeting_classes(marked).collect()} and len(few) >= 90


def test_neighbours_missed_by_few_leaves_are_found_around_others(spark):
    rng = random.Random(12)
    sets = {}
    for f in range(250):
        core = rng.sample(range(2048), 40)
        for n in range(12):
            sets[f"f{f:03d}-{n:02d}"] = sorted({*rng.sample(core, 40 - rng.randrange(2, 9)), *rng.sample(range(2048), rng.randrange(1, 5))})
    want = set()
    as_set = {k: set(v) for k, v in sets.items()}
    for a in sets:
        sims = sorted((-len(as_set[a] & as_set[b]) / len(as_set[a] | as_set[b]), b) for b in sets if b[:4] == a[:4] and b != a)[:5]
        want |= {(min(a, b), max(a, b)) for s, b in sims if -s >= 0.5}
    df = spark.createDataFrame(list(sets.items()), "id string, fp array<int>")
    got = {(r.id_a, r.id_b) for r in neighbours.nearest_pairs(df, "id", "fp", trees=4, probes=8, leaf=40).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got)


def test_members_around_a_class_are_compared_exactly():
    import pyarrow as pa

    rng = random.Random(13)
    core = rng.sample(range(2048), 40)
    sets = [sorted({*rng.sample(core, 30), *rng.sample(range(2048), 6), 2047 * (n % 2)}) for n in range(150)]
    rows = [(m, c) for m, some in ((1, range(150)), (2, range(5)), (3, range(3, 40)), (4, [7])) for c in some]
    table = pa.table({"m": [m for m, _ in rows], "c": [c for _, c in rows], "bits": [sets[c] for _, c in rows]})
    got = list(zip(*neighbours.rank_around(table, 2048, 0.5).to_pydict().values()))
    alike = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    assert len(got) == len(set(got)) and all(abs(alike(a, b) - s) < 1e-12 for a, b, s in got)
    want = {(a, b) for a in range(40) for b in range(40) if a != b and alike(a, b) >= 0.5}
    assert {(a, b) for a, b, _ in got if a < 40 and b < 40} == want


def test_chunk_joins_in_passes_find_the_same_and_leave_no_chunks(spark, monkeypatch):
    rng = random.Random(8)
    pockets, ligands = (["".join(rng.choice("ABCDE") for _ in range(n)) for _ in range(4)] for n in (40, 60))
    rows = [(n, "train" if n % 3 else "val", "d", change(rng, rng.choice(ligands), rng.randrange(7)), change(rng, rng.choice(pockets), rng.randrange(3))) for n in range(200)]
    df = spark.createDataFrame(rows, "item_id bigint, split string, datadir string, ligand_smiles string, pocket_seq string")
    made = []
    monkeypatch.setattr(overlap, "near_by_chunks", lambda *a, meet=overlap.near_by_chunks: made.append(1) or meet(*a))
    found = lambda: sorted((r.eval_id, r.train_id, r.overlap, r.by_chunks) for r in overlap.cross_split_pairs(df, few=5).collect())
    before = len(session._CUTS)
    one, n_one = found(), len(made)
    assert not [t for _, _, t in session._CUTS[before:] if "chunk" in t.columns]
    monkeypatch.setattr(overlap, "MEETINGS", overlap.MEETINGS / 4)
    assert found() == one and len(one) > 200 and len(made) - n_one > n_one


def test_content_defined_chunks_do_not_depend_on_other_texts():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ABCDE") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    digests, sizes, begins = overlap.content_chunks(texts)
    for t, i, j in zip(texts, begins[:-1], begins[1:]):
        alone = overlap.content_chunks([t])
        assert digests[i:j].tolist() == alone[0].tolist() and sizes[i:j].tolist() == alone[1].tolist()
