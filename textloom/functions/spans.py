"""Protected spans: found by rules or a glossary, masked by placeholders, and restored."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types, patterns and priorities of the rules.
RULES = [
    ("URL", r"(?i)https?://[^\s，。！？；]+", 900),
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 890),
    ("DATE", r"(?<!\d)(?:\d{4}[./-]\d{1,2}[./-]\d{1,2}|(?:\d{4}年)?\d{1,2}月\d{1,2}日?)(?!\d)", 880),
    ("TIME", r"(?<!\d)(?:[01]?\d|2[0-3])[:：][0-5]\d(?:[:：][0-5]\d)?(?!\d)", 870),
    ("NUMBER", r"(?<![A-Za-z0-9_.])[+-]?\d+(?:\.\d+)?(?:%|％)?(?![A-Za-z0-9_.])", 700),
    ("IDENTIFIER", r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+(?![A-Za-z0-9])", 650),
    ("ACRONYM", r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{1,}(?![A-Za-z0-9])", 640),
]
LITERAL = 1000
_COMPILED = [(kind, re.compile(pattern), rank) for kind, pattern, rank in RULES]

Span = tuple[int, int, str, int]


def choose(spans: Iterable[Span]) -> list[Span]:
    """Of overlapping spans (start, end, kind, rank) the one of highest rank stays, then the longest, then the first."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def _word_at_edges(text: str, a: int, b: int) -> bool:
    """A Latin surface must not be part of a longer Latin word."""
    inside = lambda i, j: 0 <= i and j < len(text) and all(text[k].isascii() and text[k].isalnum() for k in (i, j))
    return not inside(a - 1, a) and not inside(b - 1, b)


def literal_spans(text: str, glossary: Sequence[tuple[str, int]]) -> list[Span]:
    """All places of glossary surfaces (surface, priority), without regard to case for ASCII ones."""
    out = []
    for surface, priority in glossary:
        if surface:
            flags = re.IGNORECASE if surface.isascii() else 0
            out += [(m.start(), m.end(), "ENTITY", LITERAL + priority) for m in re.finditer(re.escape(surface), text, flags) if _word_at_edges(text, *m.span())]
    return out


def protected(text: str, glossary: Sequence[tuple[str, int]] = ()) -> list[Span]:
    rules = [(m.start(), m.end(), kind, rank) for kind, pattern, rank in _COMPILED for m in pattern.finditer(text)]
    return choose(rules + literal_spans(text, glossary))


def mask(text: str, glossary: Sequence[tuple[str, int]] = ()) -> tuple[str, list[dict]]:
    """The text with numbered placeholders, and what they stand for."""
    out, at, table = [], 0, []
    for n, (a, b, kind, _) in enumerate(protected(text, glossary)):
        key = f"__ENTITY_{n:03d}__"
        out += [text[at:a], key]
        table.append({"placeholder": key, "kind": kind, "start": a, "end": b, "text": text[a:b]})
        at = b
    return "".join([*out, text[at:]]), table


_PLACEHOLDER = re.compile(r"__ENTITY_\d{3,}__")


def restore(masked: str, table: Sequence) -> str | None:
    """Placeholders replaced; None if they are not those of the table, each once and in order."""
    if _PLACEHOLDER.findall(masked) != [r["placeholder"] for r in table]:
        return None
    texts = {r["placeholder"]: r["text"] for r in table}
    return _PLACEHOLDER.sub(lambda m: texts[m.group()], masked)


def canonical_placeholders(text: str) -> str:
    """Placeholders numbered by first appearance."""
    seen: dict[str, str] = {}
    return _PLACEHOLDER.sub(lambda m: seen.setdefault(m.group(), f"__ENTITY_{len(seen):03d}__"), text)


class Trie:
    """Longest matches from left to right, without overlap."""

    def __init__(self, surfaces: Iterable[str]):
        self.root: dict = {}
        for s in surfaces:
            node = self.root
            for c in s:
                node = node.setdefault(c, {})
            node[""] = s

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        out, i = [], 0
        while i < len(text):
            node, best = self.root, None
            for j in range(i, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    best = (i, j + 1, node[""])
            if best:
                out.append(best)
            i = best[1] if best else i + 1
        return out


_TABLE = "array<struct<placeholder:string,kind:string,start:int,end:int,text:string>>"


def mask_text(text: Column, glossary: Sequence[tuple[str, int]] = ()) -> Column:
    """struct(masked, spans)."""
    terms = list(glossary)

    @F.udf(f"struct<masked:string,spans:{_TABLE}>", useArrow=True)
    def masked(t: str) -> dict | None:
        return None if t is None else dict(zip(("masked", "spans"), mask(t, terms), strict=True))

    return masked(text)


def restore_text(masked: Column, spans: Column) -> Column:
    @F.udf("string", useArrow=True)
    def restored(t: str, table: list) -> str | None:
        return None if t is None else restore(t, table or [])

    return restored(masked, spans)


def trie_matches(text: Column, surfaces: Sequence[str]) -> Column:
    terms = list(surfaces)

    @F.udf("array<struct<start:int,end:int,surface:string>>", useArrow=True)
    def found(t: str) -> list | None:
        trie = Trie(terms)
        return None if t is None else [{"start": a, "end": b, "surface": s} for a, b, s in trie.matches(t)]

    return found(text)
