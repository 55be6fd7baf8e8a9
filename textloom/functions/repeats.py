"""Marks and repetitions: what a rewrite may not lose, where repeated stretches stand, and which of them may go."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that bound a window, particles that a wrong full stop leaves doubled, and words that begin with one.
MARK = r"[，,、。！？!?；;：:]|(?<!\d)\.|\.(?!\d)"
PARTICLES, STOPS, EXCEPTIONS = "的地得了着过", "。！？!?；;", ("的确", "的话", "的时候", "的一", "了不起")
#: Longest repeated phrase that is looked for, and the determiner in front of a doubled classifier.
WIDEST, DETERMINER = 12, "一"

_HAN = "[㐀-鿿]"
ANOMALY = f"[{PARTICLES}][{STOPS}](?!{'|'.join(EXCEPTIONS)})[{PARTICLES}]"


def marks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({MARK})"), 0)


def marks_lost(source: Column, refined: Column) -> Column:
    """Whether the source's marks are no longer a subsequence of the rewrite's: a fold that walks one list along the other."""
    # what is left to meet is part of the state, so that it is found once
    start = F.struct(marks_of(source).alias("marks"), F.lit(0).alias("met"))
    step = lambda s, m: F.struct(s["marks"].alias("marks"), F.when(F.try_element_at(s["marks"], s["met"] + 1) == m, s["met"] + 1).otherwise(s["met"]).alias("met"))
    return F.aggregate(marks_of(refined), start, step, lambda s: s["met"] < F.size(s["marks"]))


def boundary_anomalies(text: Column) -> Column:
    """array<struct<position, pattern>>: a hard mark between two particles, as a wrong sentence end leaves it."""
    found = F.regexp_extract_all(text, F.lit(f"({ANOMALY})"), 0)
    before = F.transform(F.split(text, ANOMALY, -1), F.length)
    place = lambda i: F.aggregate(F.slice(before, 1, i + 1), i * 3, lambda s, n: s + n)
    return F.transform(found, lambda p, i: F.struct(place(i).alias("position"), p.alias("pattern")))


def terminal_marks_kept(source: Column, refined: Column) -> Column:
    """The rewrite with the source's closing run of marks in place of its own; a source that closes with none changes nothing."""
    run = f"(?:{MARK})+$"
    own, theirs = F.regexp_extract(F.rtrim(source), f"({run})", 1), F.regexp_replace(F.rtrim(refined), run, "")
    return F.when((own == "") | (F.rtrim(refined) == ""), refined).otherwise(F.concat(theirs, own))


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "P"


def _runs(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, unit, kind) of what stands twice or more: one character, a stretch across a mark, a phrase, the widest
    first."""
    for m in re.finditer(rf"({_HAN})\1+", text):
        yield *m.span(), m[1], "character_run"
    for m in re.finditer(rf"({_HAN}+)([^\w\s㐀-鿿])\1", text):
        if _is_mark(m[2]):
            yield *m.span(), m[1], "punctuated_run"
    for width in range(min(WIDEST, len(text) // 2), 1, -1):
        for m in re.finditer(rf"(?=({_HAN}{{{width}}})\1)", text):
            if len(set(m[1])) > 1:
                yield m.start(), m.start() + 2 * width, m[1], "phrase_run"


def repetitions(text: str, most: int = 24) -> list[dict]:
    """Places where one copy might do, for review: no two overlap, none follows the determiner of a doubled classifier."""
    taken = bytearray(len(text))
    found = []
    for start, end, unit, kind in _runs(text):
        if text[start - 1 : start] == DETERMINER or any(taken[start:end]):
            continue
        taken[start:end] = b"\1" * (end - start)
        found.append({"start": start, "end": end, "source": text[start:end], "target": unit, "kind": kind})
    found.sort(key=lambda r: r["start"])
    return [{"index": i} | r for i, r in enumerate(found[:most], 1)]


def apply_decisions(text: str, candidates: Sequence[Mapping], removed: Sequence[int], vetoes: Callable[[str, str], list[str]]) -> tuple[str, list[int]]:
    """The text without the second copies of the removed candidates, and which of them went.  Each removal is judged by itself
    on the text so far, so that a vetoed one stops no other."""
    wanted = {c["index"]: c for c in candidates if c["index"] in set(removed) and text[c["start"] : c["end"]] == c["source"]}
    done: list[int] = []
    for index, c in sorted(wanted.items(), key=lambda x: -x[1]["start"]):
        shorter = text[: c["start"]] + c["target"] + text[c["end"] :]
        if not vetoes(text, shorter):
            text, done = shorter, [index, *done]
    return text, done


def doubled_classifier(text: Column, at: Column) -> Column:
    """Whether the two characters from ``at`` (counted from 0) on are a doubled classifier behind its determiner."""
    return F.coalesce((at > 0) & F.substring(text, at, F.lit(3)).rlike(f"^{DETERMINER}({_HAN})\\1$"), F.lit(False))


def deletes_doubled_classifier(text: str, start: int, end: int) -> bool:
    """Whether deleting [start, end), one character, takes a copy of a doubled classifier."""
    one = text[start:end]
    pairs = [start - 1] if start and text[start - 1] == one else [start] if text[end : end + 1] == one else []
    return len(one) == 1 and any(re.fullmatch(f"{DETERMINER}({_HAN})\\1", text[p - 1 : p + 2]) for p in pairs if p > 0)


def known_repairs(text: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Reviewed literal replacements, the longest source first."""
    for source, target in sorted(table, key=lambda x: (-len(x[0]), x[0])):
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


_CANDIDATES = "array<struct<index:int,start:int,end:int,source:string,target:string,kind:string>>"


def repetitions_of(text: Column, most: int = 24) -> Column:
    @F.udf(_CANDIDATES, useArrow=True)
    def found(t: str) -> list | None:
        return None if t is None else repetitions(t, most)

    return found(text)
