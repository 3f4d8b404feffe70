"""Many substrings looked for in one pass of each text, by an Aho-Corasick automaton."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Letters of words, besides which a pattern that stands alone has none.
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_.:-")
#: The automata that this worker has built last.
_BUILT: dict[str, _Automaton] = {}


class _Automaton(NamedTuple):
    machine: object
    always: list[int]


def _build(key: str, patterns: Sequence[str], alone: Sequence[bool]) -> _Automaton:
    import ahocorasick

    if key not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.clear()
        ids: dict[str, tuple[list[int], list[int]]] = {}
        for k, (pattern, single) in enumerate(zip(patterns, alone, strict=True)):
            ids.setdefault(pattern, ([], []))[bool(single)].append(k)
        machine = ahocorasick.Automaton()
        for pattern, (inside, single) in ids.items():
            if pattern:
                machine.add_word(pattern, (len(pattern), inside, single))
        machine.make_automaton()
        _BUILT[key] = _Automaton(machine if len(machine) else None, sum(ids.get("", ([], [])), []))
    return _BUILT[key]


def _found(automaton: _Automaton, text: str) -> list[int]:
    out = set(automaton.always)
    for end, (size, inside, single) in automaton.machine.iter(text) if automaton.machine is not None else ():
        out.update(inside)
        if single and (end + 1 == len(text) or text[end + 1] not in WORD) and (end < size or text[end - size] not in WORD):
            out.update(single)
    return sorted(out)


def finder(spark: SparkSession, patterns: Sequence[str], alone: Sequence[bool] | None = None) -> Callable[[Column], Column]:
    """A function from a text column to the places, in ``patterns``, of those that the text holds.

    Patterns that are ``alone`` count only where no letter of ``WORD`` is beside them; others count
    anywhere, and an empty one always. The list is broadcast, so its size must be bounded by the
    caller; the time for a text depends on its length and hits, not on the number of patterns. Only
    the text goes to Python. A null text holds nothing. Upper and lower case differ: lower both first.
    """
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, list(patterns), [False] * len(patterns) if alone is None else list(alone)))

    @F.pandas_udf("array<int>")
    def hits(texts: pd.Series) -> pd.Series:
        automaton = _build(*shared.value)
        none = np.empty(0, np.int32)
        return pd.Series([none if t is None else np.asarray(_found(automaton, t), np.int32) for t in texts], dtype=object)

    # not deterministic to the optimizer, so that it is not copied into a filter and run twice
    return hits.asNondeterministic()
