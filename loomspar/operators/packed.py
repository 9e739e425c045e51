"""Several values packed into one text: dialects chosen by description length.

A text holds values between separators that differ from text to text (and may differ within one),
with or without quotes, perhaps in brackets. Values that hold a blank or a quote are always quoted,
so bare blanks always separate. A *dialect* of a text is the set of further signs that separate in
it (a sign and the same sign alone between blanks are two kinds), plus whether quotes and brackets
are punctuation or part of the values. The chosen dialect is the one under which the text's
description is shortest, where

- a value costs its *value code*: the bits of its characters under first-order statistics of
  value characters (start, transitions, end) that are counted over the whole column, and
- a separator costs the bits of its share among the separators counted over the whole column.

The statistics come from two distributed counting passes. The first counts the values that quotes
delimit beyond doubt and the signs between them, at full weight, and all other texts split at every
sign, at a small weight. The second counts values and separators of every text as parsed under the
first model. Both are aggregated per partition before the shuffle, and their size is bounded by the
square of the number of character classes (below 200), whatever the data: a sign that is no ASCII counts by
its class, and longer runs of signs between blanks share one kind.
"""

from __future__ import annotations

import math
import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTHING = {"", "nan", "na", "none", "null"}  # fixed: words of a value that holds nothing
WEAK = 0.01  # weight of a piece whose limits are a guess
ESCAPE, WIDTH = 0.5, 200.0  # weight of all that was never seen, and over how many classes it spreads
QUOTED = re.compile(r'"(?:[^"]|"")*"|\'(?:[^\']|\'\')*\'', re.S)
ESCAPED = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)
LIST = re.compile(r'[\[({]\s*(?P<in>(?:"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')(?:\s*[^\w\s"\'\[\](){}]?\s*(?:"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|(?i:nan|na|none|null)(?!\w)))*\s*[,;]?)\s*[\])}]', re.S)
EMPTY_LIST = re.compile(r"\[\s*\]|\(\s*\)|\{\s*\}")


class Classes(dict):
    """For ``str.translate``: letters and digits fold into ``A``, ``a`` and ``9``, ASCII signs stay,
    other characters fold by Unicode category. Every class is one character."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if c.isdigit():
            k = "9"
        elif c.isalpha():
            k = "A" if c.isupper() else "a"
        elif c in "^$":
            k = chr(0xE000 + code)
        else:
            k = c if code < 128 else chr(0xE100 + 32 * ord(unicodedata.category(c)[0]) % 997 + ord(unicodedata.category(c)[1]) % 32)
        self[code] = ord(k)
        return self[code]


CLASSES = Classes()
START, END = "^", "$"


class Bits(dict):
    """Code length of a move between two classes, computed when first asked for."""

    def __init__(self, moves: dict[str, float]):
        super().__init__()
        self.moves, self.total = moves, Counter()
        for pair, n in moves.items():
            self.total[pair[0]] += n

    def __missing__(self, pair: str) -> float:
        p = (self.moves.get(pair, 0.0) + ESCAPE / WIDTH) / (self.total.get(pair[0], 0.0) + ESCAPE)
        self[pair] = bits = -math.log2(p)
        return bits


class Model:
    """Code lengths in bits from counted moves between classes and counted separators."""

    def __init__(self, moves: dict[str, float], signs: dict[str, float]):
        self.moves, self.signs = moves, signs
        self.all_signs = sum(signs.values())
        self.known = {kind[-1] for kind, n in signs.items() if n >= 0.01 * self.all_signs}
        self.bits = Bits(moves)
        self.own: dict[str, float] = {}

    def sign(self, c: str) -> float:
        if c not in self.own:
            self.own[c] = -math.log2((self.signs.get(c, 0.0) + ESCAPE / WIDTH) / (self.all_signs + ESCAPE))
        return self.own[c]

    def value(self, text: str) -> float:
        return sum(map(self.bits.__getitem__, moves_of(text)))


def moves_of(value: str) -> Iterator[str]:
    """The moves of a value from its start to its end, as pairs of classes."""
    k = value.translate(CLASSES)
    return map(operator.add, START + k, k + END)


def unquote(token: str, escapes: bool) -> str:
    body, q = token[1:-1], token[0]
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", _escape, body, flags=re.S) if escapes else body.replace(q + q, q)


def _escape(m: re.Match) -> str:
    s = m[1]
    if len(s) == 5:
        return chr(int(s[1:], 16))
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(s, s)


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans of quotes that open where a value may begin and close where one may end."""
    spans, at = [], 0
    while m := QUOTED.search(text, at):
        i, j = m.span()
        opens = i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "_)]}\"'")
        closes = j == len(text) or not (text[j].isalnum() or text[j] in "_([{\"'")
        if opens and closes:
            spans.append((i, j))
            at = j
        else:
            at = i + 1
    return spans


def as_list(text: str) -> list[str] | None:
    """The raw tokens of a bracketed list of quoted values, or None if the text is none."""
    if EMPTY_LIST.fullmatch(text):
        return []
    if text[:1] in "[({" and (m := LIST.fullmatch(text)):
        inner, out, at = m["in"], [], 0
        for q in ESCAPED.finditer(inner):
            out += [w for w in re.findall(r"\w+", inner[at : q.start()])]
            out.append(q[0])
            at = q.end()
        return out + re.findall(r"\w+", inner[at:])
    return None


WORDS = re.compile(r"(?<!\w)(?:nan|na|none|null)(?!\w)", re.I)
SIGNS = re.compile(r"(?<!\S)[^\w\s]+(?!\S)|[^\w\s]|_")


def occurrences(text: str, spans: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind of sign outside quotes: a sign, or ``~`` and the signs that stand alone
    between blanks."""
    kinds: dict[str, list[tuple[int, int]]] = {}
    at = 0
    for i, j in [*spans, (len(text), len(text))]:
        for m in SIGNS.finditer(text, at, i):
            k, e = m.span()
            alone = 0 < k and e < len(text) and text[k - 1].isspace() and text[e].isspace()
            if alone and len(set(m[0])) > 1:
                run = m[0].translate(CLASSES)
                # runs of more than two signs share one kind, so that the kinds are bounded by the classes
                kinds.setdefault("~" + run if len(run) == 2 else "~~~", []).append((k, e))
                continue
            for x in range(k, e):
                own = text[x] if text[x] < "\x80" else text[x].translate(CLASSES)
                spots = kinds.setdefault("~" + own if alone else own, [])
                if spots and spots[-1][1] == x:  # a sign repeated: one spot
                    spots[-1] = (spots[-1][0], x + 1)
                else:
                    spots.append((x, x + 1))
        at = j
    return kinds


def cheapest_signs(text: str, model: Model, spans: list[tuple[int, int]], kinds: dict[str, list[tuple[int, int]]]) -> set[str]:
    """The kinds of signs that separate under the cheapest dialect of this text.

    Under first-order codes a kind of sign saves or costs bits through its own neighbours only, so
    the best set is found by taking, again and again, the kind that saves most and marking its
    places as limits, until none saves anything.
    """
    limit = bytearray(len(text) + 2)  # 1 where position k - 1 separates or is quoted
    limit[0] = limit[-1] = 1
    for k, c in enumerate(text):
        if c.isspace():
            limit[k + 1] = 1
    for i, j in spans:
        limit[i + 1 : j + 1] = b"\1" * (j - i)
    for m in WORDS.finditer(text):  # a word for nothing between separators has no value code
        i, j = m.span()
        if (limit[i] or text[i - 1] in model.known) and (limit[j + 1] or text[j] in model.known):
            limit[i + 1 : j + 1] = b"\1" * (j - i)
    classes, bits = text.translate(CLASSES), model.bits
    chosen: set[str] = set()

    def saved(kind: str) -> float:
        own, total = model.sign(kind), 0.0
        for k, e in kinds[kind]:
            left = START if limit[k] else classes[k - 1]
            right = END if limit[e + 1] else classes[e]
            if e - k == 1:
                total += bits[left + classes[k]] + bits[classes[k] + right] - own
            else:
                path = left + classes[k:e] + right
                total += sum(bits[path[x : x + 2]] for x in range(len(path) - 1)) - own * (1 if len(kind) > 2 else e - k)
            if left != START:
                total -= bits[left + END]
            if right != END:
                total -= bits[START + right]
        return total

    gains = {kind: saved(kind) for kind in kinds}
    while gains:
        best = max(gains, key=gains.__getitem__)
        if gains.pop(best) <= 0:
            break
        chosen.add(best)
        touched = set()
        for k, e in kinds[best]:
            limit[k + 1 : e + 1] = b"\1" * (e - k)
            touched.update((text[max(0, k - 1) : k] + text[e : e + 1]).translate(CLASSES))
        for kind in gains:
            if kind == "~~~" or touched & set(kind.translate(CLASSES)):
                gains[kind] = saved(kind)
    return chosen


def bare_pieces(text: str, chosen: set[str], spans: list[tuple[int, int]], kinds: dict[str, list[tuple[int, int]]]) -> list[tuple[str, bool]]:
    """``(piece, quoted)`` in order, cut at blanks and at the chosen kinds of signs."""
    marks = sorted([(i, j, True) for i, j in spans] + [(k, e, False) for kind in chosen for k, e in kinds[kind]])
    out, at = [], 0
    for i, j, quoted in [*marks, (len(text), len(text), False)]:
        out += [(p, False) for p in text[at:i].split()]
        if quoted:
            out.append((text[i:j], True))
        at = j
    return out


def parse(text: str | None, model: Model) -> tuple[list[str], set[str], list[str]]:
    """Values of a text under its cheapest dialect; the separators of that dialect; its bare values."""
    if text is None:
        return [], set(), []
    text = text.strip()
    if text.lower() in NOTHING:
        return [], set(), []
    if not any(c.isalnum() for c in WORDS.sub(" ", text)) and not any(c in "\"'" for c in text):
        return [], set(), []
    tokens = as_list(text)
    if tokens is not None:
        inside = [unquote(t, True) if t[0] in "\"'" else t for t in tokens]
        # brackets and quotes as punctuation, against the whole as a bare text
        listed = sum(2.0 + model.value(v) for v in inside) + 4.0
        if not tokens or listed < model.value(text):
            return [v for v in inside if v.strip().lower() not in NOTHING], set(), []
    spans = quoted_spans(text)
    if spans:
        with_quotes = sum(2.0 + model.value(unquote(text[i:j], False)) for i, j in spans)
        without = sum(model.value(text[i:j]) for i, j in spans)
        if with_quotes >= without:
            spans = []
    kinds = occurrences(text, spans)
    chosen = cheapest_signs(text, model, spans, kinds)
    pieces = bare_pieces(text, chosen, spans, kinds)
    values = [(unquote(p, False) if q else p, q) for p, q in pieces]
    kept = [(v, q) for v, q in values if v.strip().lower() not in NOTHING]
    return [v for v, _ in kept], chosen, [v for v, q in kept if not q]


def count_values(texts: Iterable[str | None], model: Model | None) -> tuple[Counter, Counter]:
    """Transitions of value characters and separators: of sure and guessed values without a model,
    of all bare values (and quoted ones that might have been bare) as parsed with one."""
    moves: Counter = Counter()
    signs: Counter = Counter()
    known = model.known if model else set()

    def add(value: str, weight: float, quoted: bool = False) -> None:
        if quoted and (known & set(value) or re.search("[\\s\"']", value)):
            return
        if weight == 1.0:
            moves.update(moves_of(value))
        else:
            for pair in moves_of(value):
                moves[pair] += weight

    for text in texts:
        if text is None or (text := text.strip()).lower() in NOTHING:
            continue
        if model is not None:
            values, chosen, bare = parse(text, model)
            for v in bare if bare else values:
                add(v, 1.0, not bare)
            signs.update(chosen)
            continue
        tokens = as_list(text)
        if tokens is not None:
            for t in tokens:
                if t[0] in "\"'":
                    add(unquote(t, True), 1.0, True)
            continue
        spans = quoted_spans(text)
        at = 0
        for n, (i, j) in enumerate([*spans, (len(text), len(text))]):
            if j > i:
                add(unquote(text[i:j], False), 1.0, True)
            between = text[at:i]
            if 0 < n < len(spans) and re.fullmatch(r"\s*[^\w\s]\s*", between):
                signs[between.strip()] += 1.0
            for piece in re.split(r"[\W]+", between):
                if piece:
                    add(piece, WEAK if spans or not re.fullmatch(r"\w+", text) else 1.0)
            at = j
    return moves, signs


_COUNT_SCHEMA = "field string, kind string, a string, b string, n double"


def fit_models(df: DataFrame, fields: list[str], passes: int = 2) -> dict[str, Model]:
    """One model per column, from ``passes`` distributed counting passes over all texts."""
    models: dict[str, Model] | None = None
    for _ in range(passes):

        def count(batches: Iterator[pa.RecordBatch], models=models) -> Iterator[pa.RecordBatch]:
            totals: dict = {f: (Counter(), Counter()) for f in fields}
            for batch in batches:
                for f in fields:
                    moves, signs = count_values(batch.column(f).to_pylist(), models and models[f])
                    totals[f][0].update(moves)
                    totals[f][1].update(signs)
            rows = [(f, "move", a, b, float(n)) for f in fields for (a, b), n in totals[f][0].items()]
            rows += [(f, "sign", c, "", float(n)) for f in fields for c, n in totals[f][1].items()]
            cols = list(zip(*rows)) or [[], [], [], [], []]
            types = [pa.string()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["field", "kind", "a", "b", "n"])

        counted = df.select(*[F.col(f"`{f}`").cast("string").alias(f) for f in fields]).mapInArrow(count, _COUNT_SCHEMA)
        rows = counted.groupBy("field", "kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # bounded by the classes
        models = {
            f: Model({r["a"] + r["b"]: r["n"] for r in rows if r["field"] == f and r["kind"] == "move"}, {r["a"]: r["n"] for r in rows if r["field"] == f and r["kind"] == "sign"})
            for f in fields
        }
    return models


def unpack_values(df: DataFrame, key: str, fields: list[str], passes: int = 2) -> DataFrame:
    """``(key, field, pos, piece)``: one row per value of the packed columns, in order.

    Null texts, texts without values and the words for nothing give no row and take no position.
    Blanks around bare values are dropped; quoted values come out as written. Repeated keys are the
    caller's to remove. Further columns, and columns named like the outputs, do not matter. Texts of
    any length are parsed whole. An empty table gives an empty result.
    """
    models = fit_models(df, fields, passes)
    packed = {f: (m.moves, m.signs) for f, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {f: Model(*packed[f]) for f in fields}
        for batch in batches:
            keys = batch.column("__key").to_pylist()
            out_key, out_field, out_pos, out_piece = [], [], [], []
            for f in fields:
                model = own[f]
                for key_value, text in zip(keys, batch.column(f).to_pylist()):
                    for pos, piece in enumerate(parse(text, model)[0]):
                        out_key.append(key_value)
                        out_field.append(f)
                        out_pos.append(pos)
                        out_piece.append(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_key, batch.schema.field("__key").type), pa.array(out_field, pa.string()), pa.array(out_pos, pa.int32()), pa.array(out_piece, pa.string())],
                names=[key, "field", "pos", "piece"],
            )

    kind = dict(df.dtypes)[key]
    texts = df.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{f}`").cast("string").alias(f) for f in fields])
    return texts.mapInArrow(run, f"`{key}` {kind}, field string, pos int, piece string")
