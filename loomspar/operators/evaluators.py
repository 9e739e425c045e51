"""Evaluator registry: typed item, element and collection evaluators, run together in few passes.

An item evaluator names its columns and their types. Its values come from column expressions, which
stay in the JVM, or from a Python function of one row, which runs in Arrow batches with a time limit
for each row; a row that fails or takes too long has nulls and a reason. Columns are prefixed with the
evaluator's name. Composition is a list; leaving some out is a set difference of names.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Evaluator:
    name: str
    columns: dict[str, str]
    expressions: dict[str, Column] = field(default_factory=dict)
    function: Callable[[dict], dict] | None = None
    inputs: tuple[str, ...] = ()
    limit_s: float = 10.0


def chosen(evaluators: Iterable[Evaluator], exclude: Iterable[str] = ()) -> list[Evaluator]:
    """Those whose names are not excluded, in order; a name may occur once, and an unknown exclusion is an error."""
    every = list(evaluators)
    names = [e.name for e in every]
    if len(set(names)) < len(names) or not set(exclude) <= set(names):
        raise ValueError(f"evaluator names must be unique and exclusions known: {names}, {sorted(exclude)}")
    return [e for e in every if e.name not in set(exclude)]


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Raises ``TimeoutError`` in the main thread after so many seconds; without effect in other threads."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise TimeoutError("time limit")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def evaluate(df: DataFrame, evaluators: Iterable[Evaluator], exclude: Iterable[str] = ()) -> DataFrame:
    """``df`` with every evaluator's columns, ``name.column``; Python evaluators add ``name.error``.
    Expressions make one projection, Python functions one pass, however many there are."""
    run = chosen(evaluators, exclude)
    python = [e for e in run if e.function is not None]
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}
    made = [(f"{e.name}.{c}", t) for e in python for c, t in [*e.columns.items(), ("error", "string")]]
    rows = df
    if python:

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                at = 0
                for e in python:
                    got, errors = [], []
                    for values in frame[[own[c] for c in e.inputs]].itertuples(index=False, name=None):
                        try:
                            with time_limit(e.limit_s):
                                got.append(e.function(dict(zip(e.inputs, values))))
                            errors.append(None)
                        except Exception as error:
                            got.append({})
                            errors.append(f"{type(error).__name__}: {error}")
                    for c in e.columns:
                        frame[f"x{at}"] = pd.Series([g.get(c) for g in got], index=frame.index, dtype=object)
                        at += 1
                    frame[f"x{at}"] = pd.Series(errors, index=frame.index, dtype=object)
                    at += 1
                yield frame

        schema = ", ".join([f"{own[c]} {t}" for c, t in df.dtypes] + [f"x{i} {t}" for i, (_, t) in enumerate(made)])
        rows = df.toDF(*own.values()).mapInPandas(batches, schema).toDF(*df.columns, *[n for n, _ in made])
    named = {n: F.col(f"`{n}`") for n, _ in made}
    for e in run:
        if e.function is None:
            named |= {f"{e.name}.{c}": e.expressions[c].cast(t) for c, t in e.columns.items()}
    order = [f"{e.name}.{c}" for e in run for c in [*e.columns, *(["error"] if e.function else [])]]
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[named[n].alias(n) for n in order])


def evaluate_elements(df: DataFrame, elements: str, evaluators: dict[str, Callable[[Column], Column]], places: str | None = None) -> DataFrame:
    """Element evaluators over an array column: each gives a map from place to value, as columns named
    like the evaluators; ``places``: an array column with the places to use instead of 0, 1, ..."""
    at = F.col(places) if places else F.sequence(F.lit(0), F.size(elements) - 1)
    made = {n: F.when(F.size(elements) > 0, F.map_from_arrays(at, F.transform(elements, f))) for n, f in evaluators.items()}
    return df.withColumns(made)


def evaluate_collection(df: DataFrame, by: list[str], evaluators: dict[str, dict[str, Column]], exclude: Iterable[str] = ()) -> DataFrame:
    """Collection evaluators: aggregates per group, ``name.column``, all in one aggregation."""
    return df.groupBy(*by).agg(*[c.alias(f"{n}.{k}") for n, columns in evaluators.items() if n not in set(exclude) for k, c in columns.items()])
