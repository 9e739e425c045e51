"""Template residue: trusted labels, spread over near-duplicates.

Trusted labels are few (``residue_rules``): placeholder syntax, filler, and single passages that show
by themselves that they belong to an error page or a notice about scripts. Everything else is reached
by spreading, on two graphs.

*Passages.* A document's text, without code, is cut into passages (sentences and lines), and a passage
without case, layout and numbers is its class. Documents are linked by the classes they share. A class
joins the residue if it occurs in at least ``LEAST_DOCS`` different documents and at least half of
these are residue by a seventh or more of their words (0.15); so navigation, courtesy lines and further phrasings
are learned from the company they keep, in any language, while a sentence that content holds as well
is not, and one mistaken passage does not take the content around it along. Copies of a document count once. A document of which every passage
is residue is residue, or a request to the reader beside it, is residue; one passage of another kind makes it
content.

*Documents.* Documents of equal core (all passages, numbers masked) form a class. Classes are linked
if they are near-duplicates: candidates share a part of a SimHash of their five-word shingles (several
tables), their first 64 bits differ in at most ``NEAR64`` places, and their shingle sets then have a
Jaccard similarity of at least 0.8. Labels of texts that are residue as a whole spread through the
connected components of these links; labels of texts that only hold residue do not, since the next
draft may have the gap filled.

The width of a part follows the number of documents (16 bits up to 65,536 of them, one more for each
doubling), so that random meetings stay in proportion to the documents, and the number of tables is
the one at which, by the binomial law of sign agreements, a pair of similarity 0.8 meets in some table
with probability 0.9 (one of 0.9 with 0.997); equal cores always meet. The tables are joined a few at
a time, so that only these lie in shuffle files at once; and shingles, many times the size of the
texts, are made again for just those classes that meet one which has the label already.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspar.llm import residue_rules as rules
from loomspar.session import cut_lineage

SHINGLE, LEAST = 5, 0.8
MEETS = 0.9  # probability that a pair of the least similarity meets in some table
NEAR64 = 20  # of the first 64 bits
AT_ONCE = 8  # tables that are joined at once
LEAST_DOCS, COMPANY, COVER = 3, 0.5, 0.15  # documents of a passage that joins the residue, the share of them that speak for it, and how much of such a document is residue
LEAST_WORDS = 3  # of a document that is residue as a whole

TOKEN = re.compile(r"[^\W_]+(?:[_-][^\W_]+)*")


class Codes(dict):
    """Of each word its masked form (words with a digit share one) and a 64-bit code, made when first asked for."""

    def __missing__(self, word: str) -> tuple[str, int]:
        if len(self) > 500_000:
            self.clear()
        plain = "#" if any(map(str.isdigit, word)) else word
        self[word] = both = plain, int.from_bytes(digest(plain.encode("utf-8", "surrogatepass")), "little")
        return both


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


CODES = Codes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    n = max(1, len(codes) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(codes))):
        h = mixed(h + codes[k : k + n])
    return np.unique(h)


def simhash(hashes: np.ndarray, words64: int) -> np.ndarray:
    """``64 * words64`` bits: the majority of each bit over all shingles."""
    total = np.zeros(64 * words64, np.int64)
    seeds = (np.arange(1, words64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(hashes), 4096):
        x = mixed(hashes[at : at + 4096, None] ^ seeds)
        total += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=0, dtype=np.int64)
    return total * 2 > len(hashes)


def table_plan(n: int) -> tuple[int, int]:
    """``(part bits, tables)`` for so many documents."""
    bits = min(40, max(16, math.ceil(math.log2(max(2, n)))))
    agree = 1 - math.acos(2 * LEAST / (1 + LEAST)) / math.pi
    return bits, math.ceil(math.log(1 - MEETS) / math.log(1 - agree**bits))


_MARKED = "doc bigint, label string, cls bigint, words int, passages array<struct<cls:bigint,seed:string,words:int>>, sig bigint, bits binary, shingles array<bigint>"


def mark_documents(docs: DataFrame, key: str, text: str, plan: tuple[int, int]) -> DataFrame:
    """One row per document: its trusted label, if it holds residue; its class; its passages; and the
    class's SimHash (after three bytes that tell the plan) and shingles."""
    bits, tables = plan
    words64 = -(-bits * tables // 64)
    head = bytes((bits, tables & 255, tables >> 8))

    def one(t: str) -> tuple:
        plain = rules.without_code(t)
        own = "placeholder" if rules.has_placeholder(plain) else None
        if "&" in plain:
            plain = html.unescape(plain)
        if own is None and rules.has_latin_filler(plain):
            own = "filler"
        every, seen, latin = [], {}, rules.may_be_latin(plain)
        for p in rules.passages(plain):
            low = p.lower()
            words = [CODES[w] for w in TOKEN.findall(low)]
            if not words:
                continue
            every += [code for _, code in words]
            at = int.from_bytes(digest(" ".join([form for form, _ in words]).encode("utf-8", "surrogatepass")), "little", signed=True)
            if at not in seen:
                seed = rules.trusted(low, latin)
                if seed == "filler!":
                    seed, own = "filler", own or "filler"
                seen[at] = seed, len(words)
        if not every:
            return own, None, 0, None, None, None, None
        codes = np.array(every, np.uint64)
        hashes = shingle_hashes(codes)
        h = simhash(hashes, words64)
        packed = head + np.packbits(h[: bits * tables]).tobytes()
        return own, int.from_bytes(digest(codes.tobytes()), "little", signed=True), len(every), list(seen.items()), int(np.packbits(h[:64]).view(np.int64)[0]), packed, hashes.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cls", pa.int64()), ("seed", pa.string()), ("words", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                label, cls, words, passages, sig, packed, shingles = zip(*map(one, piece.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(label, pa.string()), pa.array(cls, pa.int64()), pa.array(words, pa.int32()), pa.array([p and [{"cls": c, "seed": s, "words": n} for c, (s, n) in p] for p in passages], kind), pa.array(sig, pa.int64()), pa.array(packed, pa.binary()), pa.array(shingles, pa.list_(pa.int64()))],
                    names=["doc", "label", "cls", "words", "passages", "sig", "bits", "shingles"],
                )

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("k is not null and t is not null")
    return rows.mapInArrow(run, _MARKED)


def one_per_class(marked: DataFrame, *columns: str) -> DataFrame:
    return marked.where(F.col("cls").isNotNull()).select("cls", *columns).dropDuplicates(["cls"])


def plan_of(packed: bytes) -> tuple[int, int]:
    return packed[0], packed[1] | packed[2] << 8


def part_rows(marked: DataFrame, tables: range) -> DataFrame:
    """``(code, cls, sig)``: of each class its parts of these tables, ``code`` for table and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            raw = batch.column(2).to_pylist()
            bits, every = plan_of(raw[0])
            flat = np.unpackbits(np.frombuffer(b"".join(x[3:] for x in raw), np.uint8).reshape(len(raw), -1), axis=1)
            some = flat[:, tables.start * bits : tables.stop * bits].reshape(len(raw), len(tables), bits)
            codes = some @ (np.int64(1) << np.arange(bits, dtype=np.int64)) | np.array(tables, np.int64) << np.int64(40)
            of = pa.array(np.repeat(np.arange(len(raw)), len(tables)))
            yield pa.RecordBatch.from_arrays([pa.array(codes.reshape(-1)), batch.column(0).take(of), batch.column(1).take(of)], names=["code", "cls", "sig"])

    return marked.where("cls is not null").select("cls", "sig", "bits").mapInArrow(run, "code bigint, cls bigint, sig bigint")


def meeting_classes(marked: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of classes that meet in some table and differ in few of the first 64 bits.

    ``AT_ONCE`` tables are joined at once. Pairs that meet in a table within the first 64 bits are
    found with the first ones and are not written again with later ones."""
    first = marked.where("cls is not null").select("bits").first()
    if first is None:
        return marked.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    bits, tables = plan_of(first["bits"])
    differ = F.col("sig_a").bitwiseXOR(F.col("sig_b"))
    early = [int(np.packbits((np.arange(64) // bits == t).astype(np.uint8)).view(np.int64)[0]) for t in range(min(64 // bits, AT_ONCE, tables))]
    found = []
    for at in range(0, tables, AT_ONCE):
        rows = part_rows(marked, range(at, min(at + AT_ONCE, tables))).repartition("code").dropDuplicates(["code", "cls"])
        left, right = rows.withColumnsRenamed({"cls": "a", "sig": "sig_a"}), rows.withColumnsRenamed({"cls": "b", "sig": "sig_b"})
        met = left.join(right, "code").where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= NEAR64))
        for mask in early if at else ():
            met = met.where(differ.bitwiseAND(F.lit(mask)) != 0)
        found.append(cut_lineage(met.select("a", "b").distinct()))
    return cut_lineage(reduce(DataFrame.union, found).distinct())


def similar_pairs(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of which the shingle sets, compared by 64-bit hashes, are similar enough."""
    both = met.join(sets.withColumnsRenamed({"cls": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"cls": "b", "shingles": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= LEAST * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_classes(marked: DataFrame) -> DataFrame:
    """All links ``(a, b)``, a < b, between classes that are near-duplicates."""
    return similar_pairs(meeting_classes(marked), one_per_class(marked, "shingles"))


def spread_labels(met: DataFrame, seeds: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Classes of all components of near-duplicates that hold a seed: ``(cls)``. Each round takes one step
    along the pairs that met and are similar, with the shingle sets that ``sets_of`` gives for the classes
    at their ends only; rounds end when no class is new."""
    both = cut_lineage(met.union(met.select("b", "a")).toDF("a", "b"))
    reached = cut_lineage(seeds.select("cls").distinct())
    front = reached
    while True:
        pairs = cut_lineage(both.join(front.withColumnRenamed("cls", "a"), "a", "left_semi").join(reached.withColumnRenamed("cls", "b"), "b", "left_anti").select("a", "b"))
        if pairs.isEmpty():
            return reached
        sets = sets_of(cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()))
        front = cut_lineage(similar_pairs(pairs, sets).select(F.col("b").alias("cls")).distinct())
        if front.isEmpty():
            return reached
        reached = cut_lineage(reached.union(front))


def shingle_sets(docs: DataFrame, marked: DataFrame, classes: DataFrame, plan: tuple[int, int]) -> DataFrame:
    """``(cls, shingles)`` of these classes, from the text ``t`` of one document ``k`` of each."""
    one = cut_lineage(marked.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("doc").alias("k")).select("k").distinct())
    return cut_lineage(one_per_class(mark_documents(docs.join(one, "k", "left_semi"), "k", "t", plan).join(classes, "cls", "left_semi"), "shingles"))


def whole_residue(marked: DataFrame, least_docs: int = LEAST_DOCS, company: float = COMPANY, cover: float = COVER) -> DataFrame:
    """Classes of documents of which every passage is residue: ``(cls, label, via)``.

    Only documents of passages that are trusted or occur in at least ``least_docs`` documents can be
    such, or speak for one; the rest leaves before the rounds. Rounds end when no passage is new.
    """
    docs = one_per_class(marked, "passages")
    rows = docs.select(F.col("cls").alias("doc"), F.explode("passages").alias("p")).select("doc", F.col("p.words").alias("words"), F.col("p.cls").alias("cls"), F.col("p.seed").alias("seed"))
    counts = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    common = rows.select("doc", "words", "cls").join(counts, "cls")
    fit = common.groupBy("doc").agg(F.bool_and(F.col("seed").isNotNull() | (F.col("n") >= least_docs)).alias("fit")).where("fit").select("doc")
    live = cut_lineage(common.join(fit, "doc", "left_semi"))
    residue = cut_lineage(live.where("seed in ('page', 'filler')").select("cls").distinct())
    fits = F.col("in").isNotNull() | F.coalesce(F.col("seed") == "request", F.lit(False))
    while True:
        known = live.join(residue.withColumn("in", F.lit(True)), "cls", "left")
        hit = known.groupBy("doc").agg(F.sum(F.when(fits, F.col("words")).otherwise(0)).alias("w"), F.sum("words").alias("words")).where(F.col("w") >= cover * F.col("words")).select("doc")
        kept = known.where(~fits).join(hit, "doc", "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
        new = cut_lineage(kept.where((F.col("m") >= least_docs) & (F.col("m") >= company * F.col("n"))).select("cls"))
        if new.isEmpty():
            break
        residue = cut_lineage(residue.union(new))
    judged = live.join(residue.withColumn("in", F.lit(True)), "cls", "left").groupBy("doc").agg(
        F.bool_and(fits).alias("all"), F.count("in").alias("n_in"), F.sum("words").alias("words"),
        F.max(F.when(F.col("seed") != "request", F.col("seed"))).alias("label"), F.bool_and(F.col("seed").isNotNull()).alias("own"),
    )
    return judged.where(F.col("all") & (F.col("n_in") > 0) & (F.col("words") >= LEAST_WORDS)).select(F.col("doc").alias("cls"), F.coalesce("label", F.lit("page")).alias("label"), F.when(F.col("own"), "own").otherwise("near").alias("via"))


def residue_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, label, via)``: documents that are or hold template residue.

    ``label``: ``placeholder``, ``filler`` or ``page``; ``via``: ``own`` for a trusted label, ``near``
    for one that came over shared passages or near-duplicates. Null, empty and blank texts are no
    residue. A repeated key is marked if any of its texts is. Texts are read whole. An empty table
    gives an empty result; further columns do not matter.
    """
    plan = table_plan(docs.count())
    marked = cut_lineage(mark_documents(docs, key, text, plan).drop("shingles"))
    whole = cut_lineage(whole_residue(marked))
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    reached = spread_labels(meeting_classes(marked), whole, lambda classes: shingle_sets(texts, marked, classes, plan))
    own = marked.where(F.col("label").isNotNull()).select("doc", "label", F.lit("own").alias("via"))
    rest = marked.where(F.col("label").isNull())
    page = rest.join(whole.select("cls", F.col("label").alias("l"), "via"), "cls").select("doc", F.col("l").alias("label"), "via")
    near = rest.join(reached, "cls", "left_semi").select("doc", F.lit("page").alias("label"), F.lit("near").alias("via"))
    every = own.union(page).union(near)
    return every.groupBy("doc").agg(F.max_by("label", F.struct(F.col("via") == "own", "label")).alias("label"), F.max_by("via", F.col("via") == "own").alias("via")).withColumnRenamed("doc", key)
