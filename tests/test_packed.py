import random

import pytest

from loomspar.operators.packed import Model, count_values, parse, unpack_values

SEPARATORS = [";", ",", "|", "\t", " ", "; ", " / ", " + ", " -> ", ";;", "；"]


def ids(rng):
    kinds = ["orvend_OV{:08d}-{}", "brixel:BX{:08d}{}", "kelmora_KLM-{:04d}-{:04d}-1", 'trivial_3,{}-dichloro{}', "trivial_{}; grade {}", 'trivial_{}"-amino{}']
    return rng.choice(kinds[:3] * 5 + kinds[3:]).format(rng.randrange(1000, 9999), rng.randrange(1, 9))


def pack(values, rng):
    style = rng.randrange(4)
    if style == 0:
        q = rng.choice("\"'")
        return "[" + ", ".join(q + v.replace("\\", "\\\\").replace(q, "\\" + q) + q for v in values) + "]"
    sep = rng.choice(SEPARATORS)
    return sep.join('"' + v.replace('"', '""') + '"' if style == 1 or any(c in v for c in " ,;\"'") else v for v in values)


def test_round_trip_of_random_dialects():
    rng = random.Random(4)
    lists = [[ids(rng) for _ in range(rng.randrange(1, 5))] for _ in range(3000)]
    texts = [pack(v, rng) for v in lists]
    model = None
    for _ in range(2):
        model = Model(*count_values(texts, model))
    wrong = [(t, v, parse(t, model)[0]) for t, v in zip(texts, lists) if parse(t, model)[0] != v]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("text", [None, "", "  ", "[]", "nan", "NA", " None ", ";", "null;nan", "[ ]"])
def test_nothing(text):
    assert parse(text, Model({}, {}))[0] == []


def test_unpack_edge_cases(spark):
    rows = [(1, "a_1;a_2;;nan;a_3", "x"), (2, None, "y"), (3, "", None), (1, "a_1;a_2;;nan;a_3", "x"), (4, ";".join(["a_7"] * 20000), None)] + [(n, f"a_{n};a_{n + 1}", "p") for n in range(10, 60)]
    df = spark.createDataFrame(rows, "k bigint, packed string, piece string")
    got = unpack_values(df, "k", ["packed"]).collect()
    assert [(r.pos, r.piece) for r in got if r.k == 1][:3] == [(0, "a_1"), (1, "a_2"), (2, "a_3")]
    assert sum(r.k == 4 for r in got) == 20000 and not any(r.k in (2, 3) for r in got)
    assert unpack_values(df.limit(0), "k", ["packed"]).count() == 0
