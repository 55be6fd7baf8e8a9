"""Edit distances, alignments and edits on texts; offsets count code points, intervals are half open."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance with unit costs, over characters or tokens."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def token_distance(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="Int32")

    return distances(a, b)


def align(source: str, target: str) -> list[dict]:
    """Edits that turn source into target, by longest matching blocks."""
    blocks = SequenceMatcher(None, source, target, autojunk=False).get_opcodes()
    return [{"start": a, "end": b, "source": source[a:b], "target": target[c:d], "kind": kind} for kind, a, b, c, d in blocks if kind != "equal"]


def apply(source: str, edits: Sequence) -> str:
    """Apply ordered edits; overlapping ones, or ones whose source is not what stands there, are an error."""
    out, at = [], 0
    for e in edits:
        if e["start"] < at or source[e["start"] : e["end"]] != e["source"]:
            raise ValueError(f"edit does not fit: {e}")
        out += [source[at : e["start"]], e["target"]]
        at = e["end"]
    return "".join([*out, source[at:]])


def inserted(source: str, target: str) -> list[str]:
    """Texts that target has and source has not."""
    return [e["target"] for e in align(source, target) if e["target"]]


def revision_ratio(before: str, now: str) -> float:
    """1 - the similarity of successive hypotheses; 0 for the first one."""
    if not before:
        return 0.0
    if now.startswith(before) or before.startswith(now):
        return abs(len(before) - len(now)) / (len(before) + len(now))
    return 1.0 - SequenceMatcher(None, before, now, autojunk=False).ratio()


_EDITS = "array<struct<start:int,end:int,source:string,target:string,kind:string>>"


def align_edits(source: Column, target: Column) -> Column:
    @F.udf(_EDITS, useArrow=True)
    def aligned(a: str, b: str) -> list[dict] | None:
        return None if a is None or b is None else align(a, b)

    return aligned(source, target)


def apply_edits(source: Column, edits: Column) -> Column:
    @F.udf("string", useArrow=True)
    def applied(a: str, es: list) -> str | None:
        return None if a is None else apply(a, es or [])

    return applied(source, edits)


def revision(before: Column, now: Column) -> Column:
    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([revision_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return ratios(before, now)
