"""Shared readings of dataset items: paths, splits and letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspar.functions import SPLIT_NAMES, split_name, trimmed  # noqa: F401


def path_key(c: Column) -> Column:
    """A relative path in normal form: outer blanks, ``.`` segments and empty segments dropped,
    ``x/..`` resolved. Null stays null; a path without segments becomes ``.``."""
    segments = F.filter(F.split(trimmed(c), "/"), lambda s: ~s.isin("", "."))
    up = F.array(F.lit(".."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    plain = F.array_join(F.when(F.array_contains(segments, ".."), folded).otherwise(segments), "/")
    return F.when(c.isNotNull(), F.when(plain == "", ".").otherwise(plain))
