"""Column functions beyond the built-in ones, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the usual names of the splits
SPLIT_NAMES = {
    "train": ("train", "training", "trn"),
    "val": ("val", "valid", "validation", "validate", "dev", "development"),
    "test": ("test", "testing", "tst"),
}


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_name(c: Column) -> Column:
    """``train``, ``val`` or ``test`` for any spelling of a split's usual names, else null."""
    plain = F.lower(trimmed(c))
    out = F.lit(None).cast("string")
    for name, spellings in SPLIT_NAMES.items():
        out = F.when(plain.isin(*spellings), name).otherwise(out)
    return out


def doi_of(url: Column) -> Column:
    """A DOI without its resolver prefix; blank gives null."""
    return F.nullif(F.regexp_replace(F.trim(url), "^(?i)https?://(dx\\.)?doi\\.org/", ""), F.lit(""))


def content_hash(text: Column, length: int = 16) -> Column:
    """The first hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(length))


def leaf_trace(item: Column) -> Column:
    return F.format_string("<%s>", F.coalesce(item, F.lit("NA")))


def step_trace(parts: Column, rule: Column, product: Column) -> Column:
    """A recursive trace ``<part.part:rule:product>`` of up to three parts, missing names as ``NA``."""
    return F.concat(F.lit("<"), F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit("NA"))), "."), F.lit(":"), F.coalesce(rule, F.lit("NA")), F.lit(":"), F.coalesce(product, F.lit("NA")), F.lit(">"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normal_angle(radians: Column) -> Column:
    """An angle in [-pi, pi)."""
    two_pi = 2 * F.pi()
    return F.pmod(radians + F.pi(), two_pi) - F.pi()


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    """1 at the place of the value in the vocabulary, else 0; all 0 if it is unknown or null."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in vocabulary]), value), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.lit(len(vocabulary))), lambda i: F.when(i == at, 1).otherwise(0))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only: repeatable, whatever the partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def rbf(x: Column, low: float, high: float, n: int) -> Column:
    """Radial basis values of x at ``n`` centres between two limits."""
    width = (high - low) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(-(((x - (F.lit(low) + i * ((high - low) / (n - 1)))) / width) ** 2)))
