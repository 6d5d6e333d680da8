"""Which of many plain substrings occur in a text, told by one pass over it.

Patterns are guarded by substrings that every match holds, and lists of phrases are looked for one by one:
some hundred searches of the same text. Within `in_notes` a single Arrow function notes the substrings that
occur, exactly, and the searches read its short notes. All else stays a Column."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = "\x1f"
_FACTOR, _SLOTS = np.uint32(2654435761), 1 << 16
#: Letters by falling frequency in prose: a needle is looked for where it is rarest.
_COMMON = " eaitonsrhldcumfpgwybvkjxqz"
_learnt: dict[str, dict[str, None]] = {}
_reading: ContextVar[tuple[str, dict[str, None], Column | None, list[str]] | None] = ContextVar("reading", default=None)


def _cells(data: np.ndarray) -> np.ndarray:
    """A slot for each three bytes."""
    wide = data.astype(np.uint32)
    return ((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * _FACTOR) >> np.uint32(16)


def noter(needles) -> Callable[[str], str]:
    """A function of a text: those of the needles that are in it, joined. Needles are kept by the slot of
    their rarest three bytes; only those whose slot the text has are searched for."""
    groups: dict[int, list[str]] = {}
    short = []
    for needle in needles:
        data = needle.encode()
        if len(data) < 3:
            short.append(needle)
            continue
        rare = [sum(_COMMON.find(chr(b)) % 64 for b in data[i:i + 3]) for i in range(len(data) - 2)]
        at = rare.index(max(rare))
        groups.setdefault(int(_cells(np.frombuffer(data[at:at + 3], np.uint8))[0]), []).append(needle)
    slots = np.full(_SLOTS, -1, np.int32)
    slots[list(groups)] = np.arange(len(groups))
    kept = list(groups.values())

    def note(text: str) -> str:
        found = [n for n in short if n in text]
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) >= 3:
            met = slots[_cells(data)]
            for k in set(met[met >= 0].tolist()):
                found += [n for n in kept[k] if n in text]
        return CUT.join(found)
    return note


def noted(c: Column, needles) -> Column:
    """Those of the needles that occur in the text, as one text that contains a needle just where `c` does."""
    needles = tuple(needles)

    @F.arrow_udf("string")
    def notes(texts: pa.Array) -> pa.Array:
        note = noter(needles)
        return pa.array([None if t is None else note(t) for t in texts.to_pylist()], pa.string())
    return notes(c)


def in_notes(df: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], label: str = "") -> DataFrame:
    """step(df), whose searches of the stored column `name` for plain substrings read notes of it. The
    step is built twice: first to learn the substrings. What a step of this label asked for last is tried
    first; if it asks for others as well, they are learnt anew."""
    column = f"_noted_{name}"

    def built(rows: DataFrame, needles: dict[str, None], read: Column | None, missed: list[str]) -> DataFrame:
        token = _reading.set((name, needles, read, missed))
        try:
            return step(rows)
        finally:
            _reading.reset(token)

    def with_notes(needles: dict[str, None], missed: list[str]) -> DataFrame:
        return built(df.withColumn(column, noted(F.col(name), needles)), needles, F.col(column), missed).drop(column)
    if label in _learnt:
        missed: list[str] = []
        out = with_notes(_learnt[label], missed)
        if not missed:
            return out
    needles: dict[str, None] = {}
    plain = built(df, needles, None, [])
    if not needles:
        return plain
    if label:
        _learnt[label] = needles
    return with_notes(needles, [])


def is_noted(c: Column) -> bool:
    current = _reading.get()
    return current is not None and str(c) == str(F.col(current[0]))


def seen_in(c: Column, needles) -> Column:
    """Where to look for plain substrings of `c`: within `in_notes`, in its notes."""
    if not is_noted(c) or any(not n or CUT in n for n in needles):
        return c
    _, known, read, missed = _reading.get()
    if read is None:  # still learning them
        known.update(dict.fromkeys(needles))
        return c
    other = [n for n in needles if n not in known]
    missed += other
    return c if other else read
