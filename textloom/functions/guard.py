"""Vetoes on a rewrite: reasons to keep the source instead.

The surface vetoes are here; those that need part-of-speech tables or the numeric rule pack are not."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import numbers

# Lengths, ratios and marks of the vetoes.
LONG_SENTENCE, TIMES = 8, 3
SHORT_SOURCE, SHORT_SIMILARITY = 4, 0.7
LOSS_SOURCE, LOSS_RATIO, LOSS_SIMILARITY, LOSS_LONG = 16, 0.65, 0.35, 24
TRUNCATED_SOURCE, TRUNCATED_RATIO = 100, 0.8
ENDS = "。！？!?；;"
_SENTENCE = re.compile("[^。！？!?；;\n]+")
_LOOP = re.compile(r"(.{8,80}?)(?:\1){2,}")
_NUMBER = re.compile(r"\d+(?:\.\d+)?%?")


def values(text: str) -> Counter:
    """The numbers a text says, spoken ones in digits."""
    return Counter(_NUMBER.findall(numbers.normalize(text) or ""))


def _sentences(text: str) -> Counter:
    return Counter(s.strip() for s in _SENTENCE.findall(text) if s.strip())


def _corrected_tail(raw: str, refined: str) -> bool:
    """The rewrite is what stands after a self-correction."""
    tail = re.split("不对|我说错了|说错了|应该是|改成", raw)[-1].strip(" ，,")
    return tail != raw and bool(tail) and tail.rstrip(ENDS) in refined


def reject_reasons(raw: str, refined: str) -> list[str]:
    raw, refined = raw.strip(), refined.strip()
    if not refined:
        return ["empty_refiner_output"]
    out = []
    before = _sentences(raw)
    if any(len(s) >= LONG_SENTENCE and n >= TIMES and n > before[s] for s, n in _sentences(refined).items()):
        out.append("repeated_sentence")
    if (loop := _LOOP.search(refined)) and loop[1] not in raw:
        out.append("repeated_phrase")
    if len(raw) >= SHORT_SOURCE:
        alike, share, corrected = SequenceMatcher(None, raw, refined, autojunk=False).ratio(), len(refined) / len(raw), _corrected_tail(raw, refined)
        lost = len(raw) >= LOSS_SOURCE and share < LOSS_RATIO and (len(raw) >= LOSS_LONG or alike < LOSS_SIMILARITY)
        other = alike < SHORT_SIMILARITY and refined not in raw
        if (lost or other) and not corrected:
            out.append("severe_content_loss")
    a, b = values(raw), values(refined)
    if a != b and (not _corrected_tail(raw, refined) or b - a):
        out.append("numeric_value_mismatch")
    if raw[-1:] in tuple(ENDS) and refined[-1] not in ENDS and len(raw) >= TRUNCATED_SOURCE and len(refined) < TRUNCATED_RATIO * len(raw):
        out.append("truncated_refiner_output")
    return out


def vetoes(raw: Column, refined: Column) -> Column:
    @F.udf("array<string>", useArrow=True)
    def reasons(a: str, b: str) -> list[str] | None:
        return None if a is None or b is None else reject_reasons(a, b)

    return reasons(raw, refined)
