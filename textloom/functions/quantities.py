"""Numbers that a text mentions, spoken or in digits: whether a rewrite keeps them, and how they were written."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import numbers
from textloom.functions.edits import align, apply

_UNITS = sorted([*numbers.MEASURES, *numbers.COUNTERS, *numbers.MULTIPLIERS], key=len, reverse=True)
_WRITTEN = re.compile(rf"(?<![\d.])(?P<v>\d+(?:\.\d+)?)(?P<u>%|％|{'|'.join(map(re.escape, _UNITS))})?")
_CLAUSE = re.compile(r"[^，,。；;！？!?：:\n]+")


class Mention(NamedTuple):
    start: int
    end: int
    surface: str
    value: str
    unit: str


def mentions(text: str) -> list[Mention]:
    """Numbers in order of the text; of a conversion that says several (a date, a range), each by itself at the same place."""
    spoken = [(a, b, new) for a, b, new, _ in numbers.changes(text)]
    found = [Mention(a, b, text[a:b], m["v"], m["u"] or "") for a, b, new in spoken for m in _WRITTEN.finditer(new)]
    free = [m for m in _WRITTEN.finditer(text) if all(m.end() <= a or b <= m.start() for a, b, _ in spoken)]
    found += [Mention(*m.span(), m.group(), m["v"], m["u"] or "") for m in free]
    return sorted(found, key=lambda m: m.start)


def _plain(value: str) -> str:
    whole, _, rest = value.partition(".")
    return (whole.lstrip("0") or "0") + ("." + rest.rstrip("0") if rest.rstrip("0") else "")


def _said(text: str) -> list[tuple[str, str]]:
    """Values and units, a number said again right away once."""
    return [k for k, _ in groupby((_plain(m.value), m.unit.replace("％", "%")) for m in mentions(text))]


def preserved(source: str, target: str) -> bool:
    """Whether a rewrite says the same numbers in the same order; one that is repeated at once may be said once."""
    return _said(source) == _said(target)


def range_cut(source: str, target: str) -> bool:
    """Whether a range of the source lost one of its ends in the rewrite."""
    ends = [(m["a"], m["b"]) for m in re.finditer(r"(?P<a>\d+(?:\.\d+)?)(?:到|至|[-~～])(?P<b>\d+(?:\.\d+)?)", numbers.normalize(source) or "")]
    kept = {_plain(m.value) for m in mentions(target)}
    return any((_plain(a) in kept) != (_plain(b) in kept) for a, b in ends)


def restored(source: str, target: str) -> str:
    """The rewrite with its numbers written as in the source, where both say the same ones."""
    if not preserved(source, target):
        return target
    surfaces: dict[tuple[str, str], list[str]] = {}
    for m in mentions(source):
        surfaces.setdefault((_plain(m.value), m.unit), []).append(m.surface)
    out, at = [], 0
    for place, group in groupby(mentions(target), key=lambda m: (m.start, m.end)):
        several = list(group)
        known = surfaces.get((_plain(several[0].value), several[0].unit), [])
        # one surface for one number: those that share a conversion stay as they are
        new = known.pop(0) if known and len(several) == 1 else several[0].surface
        out += [target[at : place[0]], new]
        at = place[1]
    return "".join([*out, target[at:]])


def _copy_goes(source: str, e: dict) -> bool:
    n = e["end"] - e["start"]
    return e["kind"] == "delete" and n > 0 and (source[e["start"] - n : e["start"]] == e["source"] or source[e["end"] : e["end"] + n] == e["source"])


def salvaged(source: str, rejected: str, vetoes: Callable[[str, str], list[str]]) -> str:
    """Of a rejected rewrite the edits that are safe by themselves: numbers written otherwise with the same value, and copies
    that stand next to each other."""
    out = source
    for e in reversed(align(source, rejected)):
        if _copy_goes(source, e) or e["kind"] == "replace" and _said(e["source"]) and _said(e["source"]) == _said(e["target"]):
            tried = apply(out, [e])
            out = out if vetoes(source, tried) else tried
    return out


def repeated_clauses(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Neighbouring clauses with a number that say the same words and values: (start, end, start, end) of both."""
    clauses = [(m.start(), m.end(), m.group().strip()) for m in _CLAUSE.finditer(text) if m.group().strip()]
    for (a, b, one), (c, d, two) in zip(clauses, clauses[1:], strict=False):
        if mentions(one) and numbers.normalize(one) == numbers.normalize(two):
            yield a, b, c, d


def mentions_of(text: Column) -> Column:
    @F.udf("array<struct<start:int,end:int,surface:string,value:string,unit:string>>", useArrow=True)
    def found(t: str) -> list | None:
        return None if t is None else [m._asdict() for m in mentions(t)]

    return found(text)


def numbers_preserved(source: Column, target: Column) -> Column:
    """``preserved``; pairs without any numeral are settled by one look."""
    @F.udf("boolean", useArrow=True)
    def same(a: str, b: str) -> bool | None:
        return None if a is None or b is None else preserved(a, b)

    return F.when(~F.concat(source, target).rlike(r"[零〇一二两三四五六七八九十百千万亿\p{Nd}]"), F.lit(True)).otherwise(same(source, target))
