"""Encoding of a corpus with a public byte-level BPE, by traversal of a trie of distinct words.

The encoding of every prefix of a word ends in one certain token, and it is the encoding of a
shorter prefix plus that token. So a trie node needs to keep only the *last token* of its prefix:
token ``t`` is it if ``t`` is a suffix of the prefix and the last token of what remains forms a
stable pair with it, that is, BPE of the two tokens' bytes gives the same two tokens. A depth-first
walk over the trie computes each prefix once for all words that share it; a word's encoding is read
backwards from its node.

Words are the pieces of the vocabulary's splitting pattern. The trie is walked in the order of the
sorted distinct words of a batch, so only the path to the present word is kept. Encoded words stay
in a table of bounded size for the next batches of the same worker. The work is a narrow map: there
is no shuffle, and what is sent out is the vocabulary file (under 1 MB).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"  # default of the path parameter
VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 400_000  # encoded words that a worker keeps; beyond that it starts afresh
KEPT_BYTES = 256  # longer words are encoded each time


class TrieEncoder:
    """Encodes words with the ranks of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, array] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """Plain BPE of a short text: the lowest-ranked pair is merged until no pair has a rank."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_whole(self, token: int) -> bool:
        """Whether BPE of a token's bytes gives that token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = len(self.merge(self.bytes_of[token])) == 1
        return known

    def is_stable(self, a: int, b: int) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            x, y = self.bytes_of[a], self.bytes_of[b]
            known = self.stable[a, b] = self.merge(x + y) == [x, y]
            if len(self.stable) > 4 * KEPT_WORDS:
                self.stable.clear()
        return known

    def last_token(self, word: bytes, end: int, last: list[int]) -> int:
        """The last token of ``word[:end]``; ``last[i]`` is that of ``word[:i]``, for all i below."""
        ranks = self.ranks
        for begin in range(max(0, end - self.longest), end):
            token = ranks.get(word[begin:end])
            if token is not None and (self.is_whole(token) if begin == 0 else self.is_whole(token) and self.is_stable(last[begin], token)):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, array]]:
        """Depth-first over the trie of the words: each with its token ids."""
        path, last = b"", [0]
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for a, b in zip(path, raw):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                last.append(self.last_token(raw, end, last))
            path = raw
            ids, at = array("i"), len(raw)
            while at:
                ids.append(last[at])
                at -= len(self.bytes_of[last[at]])
            ids.reverse()
            yield word, ids

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of the texts; null and empty texts have no ids."""
        split = regex.compile(PATTERN).findall
        pieces = [split(t) if t else () for t in texts]
        known = self.words
        new = set(chain.from_iterable(pieces)).difference(known)
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = set(chain.from_iterable(pieces))
        known.update(self.walk(new))
        ids = [array("i", chain.from_iterable(map(known.__getitem__, p))) for p in pieces]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        for w in new:
            if len(w) > KEPT_BYTES:
                del known[w]
        return offsets, np.frombuffer(b"".join(x.tobytes() for x in ids), np.int32)


_ENCODERS: dict[str, TrieEncoder] = {}  # of this worker


def encoder_of(vocabulary: bytes) -> TrieEncoder:
    key = hashlib.blake2b(vocabulary, digest_size=16).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a})
    return _ENCODERS[key]


def encode_texts(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: every row's text as token ids, without special tokens.

    One output row per input row, in the same partition: repeated keys stay repeated. Null and empty
    texts give an empty list. Texts are encoded whole, at any length, as they stand. Further columns,
    and columns named ``ids``, do not matter. An empty table gives an empty result.
    """
    with open(f"{tokenizers}/{vocabulary}", "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        for batch in batches:
            step = max(1, min(2000, batch.num_rows))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                offsets, ids = encoder.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    rows = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
