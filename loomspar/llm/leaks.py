"""Evaluation texts leaking into training text: a prefix-filtered set join of shingles.

A document leaks an item if both share a run of ``run`` successive words. Whichever window of an
item is shared, all its shingles (``shingle`` words each) are in the document, so it is enough to
look for *one necessary shingle per window*: the rarest in the corpus. The union of those over an
item's windows is its prefix. A document's shingles are joined with the items' prefixes only; the
two positions of a match fix the alignment (positional bound), texts shorter than a run are left
out (length bound), and the words around the match are compared until the run is proven or broken.

Items are few beside the corpus. They go out to all tasks in slices of bounded size, each slice a
pass over the corpus (one slice, as long as the items fit one), so that no document is shuffled.
Document frequencies of the items' shingles come from a counting pass over all documents; what it
collects is bounded by the slice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12  # words that a case shares
SHINGLE = 3  # words of the joined tokens
SLICE_BYTES = 16 << 20  # item text per slice
PAIRS = 1_000_000  # comparisons made at a time

_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC and lower-casing, invisible format characters ignored."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", text))
        text = _FORMAT.sub("", text)
    return _WORD.findall(text.lower())


class ItemIndex:
    """The words of a slice of items as numbers, with the shingles of every position."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, shingle: int = SHINGLE):
        self.run, self.shingle = run, shingle
        self.vocabulary: dict[str, int] = {}
        flat: list[int] = [0] * run
        owner: list[int] = [-1] * run
        for item, text in items:
            own = words(text)
            if len(own) < run:
                continue
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own] + [0] * run
            owner += [item] * len(own) + [-1] * run
        self.flat, self.owner = np.array(flat, np.int64), np.array(owner, np.int64)
        self.codes, self.inverse = np.unique(self.shingles(self.flat), return_inverse=True)

    def shingles(self, flat: np.ndarray) -> np.ndarray:
        """A code for the shingle that begins at each place, 0 where a word is unknown or text ends.

        Codes are 64-bit hashes, for any size of the vocabulary. Shingles that share a code cost a
        comparison, no more, since matches are verified word by word.
        """
        if len(flat) < self.shingle:
            return np.zeros(len(flat), np.int64)
        code = np.zeros(len(flat) - self.shingle + 1, np.uint64)
        whole = np.ones(len(code), bool)
        for k in range(self.shingle):
            part = flat[k : k + len(code)]
            code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            whole &= part > 0
        code[code == 0] = 1
        return np.concatenate([np.where(whole, code, np.uint64(0)).view(np.int64), np.zeros(self.shingle - 1, np.int64)])

    def prefix(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, places)`` sorted by code: the rarest shingle of every window, where it stands.

        Places of one item with the same words around them, as far as a run can reach, are one place,
        so a phrase repeated without end in an item is looked at a bounded number of times.
        """
        span = self.run - self.shingle + 1
        n = len(self.flat) - self.run + 1
        if n <= 0 or not self.vocabulary:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.empty(len(self.codes), np.int64)  # rare first, ties by code
        rank[np.lexsort((self.codes, frequency))] = np.arange(len(self.codes))
        at = np.lib.stride_tricks.sliding_window_view(rank[self.inverse], span)[:n].argmin(axis=1) + np.arange(n)
        inside = np.lib.stride_tricks.sliding_window_view(self.flat > 0, self.run).all(axis=1)[:n]
        chosen = np.unique(self.inverse[at[inside]])
        places = np.flatnonzero(np.isin(self.inverse, chosen) & (self.flat > 0))
        codes = self.codes[self.inverse[places]]
        keep = codes != 0
        places, codes = places[keep], codes[keep]
        around = np.zeros(len(places), np.uint64)
        for d in range(self.shingle - self.run, self.run):
            at = np.clip(places + d, 0, len(self.flat) - 1)
            around = (around ^ self.flat[at].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            around ^= around >> np.uint64(31)
        order = np.lexsort((places, self.owner[places], around, codes))
        places, codes, around = places[order], codes[order], around[order]
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(codes) != 0) | (around[1:] != around[:-1]) | (np.diff(self.owner[places]) != 0)
        return codes[new], places[new]

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as numbers, a run of zeros between texts; and each place's text."""
        get, gap = self.vocabulary.get, [0] * self.run
        flat, owner = list(gap), [-1] * self.run
        for k, text in enumerate(texts):
            own = words(text)
            if len(own) >= self.run:
                flat += [get(w, 0) for w in own]
                flat += gap
                owner += [k] * (len(own) + self.run)
        return np.array(flat, np.int64), np.array(owner, np.int64)

    def matches(self, texts: list[str | None], codes: np.ndarray, places: np.ndarray) -> set[tuple[int, int]]:
        """``(text, item)`` that share a run, found at the prefix shingles and verified word by word."""
        flat, owner = self.numbered(texts)
        own = self.shingles(flat)
        lo, hi = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
        count = np.where(own != 0, hi - lo, 0)
        hits = np.flatnonzero(count)
        found: set[tuple[int, int]] = set()
        for some in np.split(hits, np.flatnonzero(np.diff(np.cumsum(count[hits]) // PAIRS)) + 1):  # about PAIRS comparisons at a time
            n = count[some]
            here = np.repeat(some, n)
            there = places[np.repeat(lo[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            length = np.full(len(here), self.shingle)
            for step, begin in ((-1, 0), (1, self.shingle - 1)):
                alive = np.ones(len(here), bool)
                for d in range(1, self.run):
                    x, y = flat[here + begin + step * d], self.flat[there + begin + step * d]
                    alive &= (x == y) & (x > 0)
                    length += alive
            long = length >= self.run
            found.update(zip(owner[here[long]].tolist(), self.owner[there[long]].tolist()))
        return found


def item_slices(items: DataFrame, key: str, text: str, slice_bytes: int = SLICE_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size, read one partition at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("k is not null and t is not null").distinct()
    for row in rows.toLocalIterator():
        part.append((row["k"], row["t"]))
        size += len(row["t"].encode("utf-8", "surrogatepass"))
        if size >= slice_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def shingle_frequencies(docs: DataFrame, sent) -> np.ndarray:
    """In how many documents each shingle of the slice stands, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = sent.value
        total = np.zeros(len(index.codes), np.int64)
        for batch in batches:
            flat, owner = index.numbered(batch.column("t").to_pylist())
            own = index.shingles(flat)
            at = np.minimum(np.searchsorted(index.codes, own), len(index.codes) - 1)
            hit = (own != 0) & (index.codes[at] == own)
            pairs = np.unique(owner[hit] * len(index.codes) + at[hit])
            total += np.bincount(pairs % len(index.codes), minlength=len(index.codes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    rows = docs.select("t").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()  # bounded by the slice
    frequency = np.zeros(len(sent.value.codes), np.int64)
    for r in rows:
        frequency[r["code"]] = r["n"]
    return frequency


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = RUN, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(doc_key, item_key)``: every document and item that share a run of ``run`` words.

    Null, empty and short texts on either side take part in no pair; repeated documents and items give
    their pair once per document key. Texts are read whole. Empty tables give an empty result; further
    columns do not matter.
    """
    spark = docs.sparkSession
    schema = f"`{doc_key}` bigint, `{item_key}` bigint"
    texts = docs.select(F.col(f"`{doc_key}`").cast("bigint").alias("k"), F.col(f"`{doc_text}`").cast("string").alias("t")).where("k is not null and t is not null")
    found = []
    for part in item_slices(items, item_key, item_text, slice_bytes):
        index = ItemIndex(part, run)
        if not index.vocabulary:
            continue
        sent = spark.sparkContext.broadcast(index)
        prefix = spark.sparkContext.broadcast(index.prefix(shingle_frequencies(texts, sent)))

        def match(batches: Iterator[pa.RecordBatch], sent=sent, prefix=prefix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("k").to_pylist()
                pairs = sorted(sent.value.matches(batch.column("t").to_pylist(), *prefix.value))
                yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=[doc_key, item_key])

        found.append(texts.mapInArrow(match, schema))
    return reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], schema)
