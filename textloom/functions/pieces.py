"""Pieces of text for a bounded rewriter, how they are joined again, and where their characters came from."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end sentences, softer breaks, and the characters between which blanks are noise.
ENDINGS, SOFT = r"。！？!?；;\n", r"，、：:）)】\] "
CJK = "㐀-䶿一-鿿豈-﫿　-〿＀-￯"
CLOSING = r",.!?;:%)\]}"


def bounded_pattern(limit: int) -> str:
    """Pieces of at most ``limit`` characters: all that is left, else up to the last sentence end, else the last soft break, of
    the second half, else ``limit`` characters."""
    if limit < 32:
        raise ValueError("a piece needs 32 characters")
    half = f".{{{limit // 2},{limit - 1}}}"
    return rf"(?s).{{1,{limit}}}\z|{half}[{ENDINGS}]|{half}[{SOFT}]|.{{{limit}}}"


def split_bounded(text: str, limit: int = 600) -> list[str]:
    return [m.group() for m in re.finditer(bounded_pattern(limit).replace(r"\z", r"\Z"), text.strip())]


def bounded_pieces(text: Column, limit: int = 600) -> Column:
    return F.regexp_extract_all(F.trim(text), F.lit(f"({bounded_pattern(limit)})"), 0)


def joined(parts: Column) -> Column:
    """Parts one after the other; a blank stands between two ASCII ends, unless both are digits (a number that was cut)."""
    def put(out: Column, part: Column) -> Column:
        left, right = F.right(out, F.lit(1)), F.left(part, F.lit(1))
        apart = left.rlike(r"^[\x00-\x7F]$") & right.rlike(r"^[\x00-\x7F]$") & ~(left.rlike("[0-9]") & right.rlike("[0-9]"))
        return F.when(part == "", out).when(apart, F.concat(out, F.lit(" "), part)).otherwise(F.concat(out, part))

    return F.aggregate(F.transform(parts, lambda p: F.trim(p)), F.lit(""), put)


def cjk_spacing(text: Column) -> Column:
    """Without blanks inside East Asian text and before closing marks."""
    return F.regexp_replace(text, rf"(?<=[{CJK}])\s+(?=[{CJK}])|\s+(?=[{CLOSING}])", "")


def compact_offsets(text: Column) -> Column:
    """For every character that is no blank, its place in the text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.filter(F.transform(chars, lambda c, i: F.when(~c.rlike(r"^\s$"), i)), lambda i: i.isNotNull())


def project_span(source: str, target: str, start: int, end: int) -> tuple[int, int] | None:
    """Where [start, end) of the source lies in the target, by their alignment; None if its text was changed."""
    from textloom.functions.edits import align

    shift = 0
    for e in align(source, target):
        if e["end"] <= start and not (e["start"] == e["end"] == start):
            shift += len(e["target"]) - (e["end"] - e["start"])
        elif e["start"] < end:
            if e["start"] == e["end"] == start:  # an insertion right before it
                shift += len(e["target"])
                continue
            return None
    return start + shift, end + shift


def natural_prefixes(text: str, least: int = 8) -> list[str]:
    """Proper beginnings that end at a mark, with closed brackets, and not inside a number."""
    out = []
    for m in re.finditer(r"(?<![0-9])[,，;；。！？!?]|(?<=[0-9])[,，;；。！？!?](?![0-9])", text):
        head = text[: m.end()]
        if least <= len(head) < len(text) and all(head.count(a) <= head.count(b) for a, b in ("()", "[]", "{}", "（）")):
            out.append(head)
    return out


def without_marks(text: Column, strength: str = "medium") -> Column:
    """A transcript as a recogniser without marks would give it: those not kept become single blanks."""
    kept = {"light": "，。！？,.!?：:", "heavy": ",."}.get(strength, "，。！？,.!?")
    gone = "".join(c for c in "，。！？；：、,.!?;:\"“”‘’'（）()《》【】[]…—" if c not in kept)
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"[{re.escape(gone)}]", " "), r"\s+", " "))


# -- evidence of scored bytes


def ledger(spans: Sequence[Mapping], text: str, prefix: str, completion: str, scored: Sequence[Mapping], revision: int) -> tuple[str, list[dict]]:
    """Evidence after a decoder has kept ``prefix`` and written ``completion``: spans (start, end, width, logprob, evidence) in
    bytes.  What the kept prefix cuts through has no score any more; a prefix that is not the old text's keeps no evidence, and
    scores that do not add up to the completion are dropped."""
    cut = len(prefix.encode())
    kept = [s | {"end": min(s["end"], cut), "logprob": s["logprob"] if s["end"] <= cut else None} for s in spans if s["start"] < cut] if text.startswith(prefix) else []
    whole = sum(s["end"] - s["start"] for s in scored) == len(completion.encode())
    fresh = [{"start": s["start"] + cut, "end": s["end"] + cut, "width": s["end"] - s["start"], "logprob": s["logprob"], "evidence": f"{revision}:{i}"} for i, s in enumerate(scored if whole else [])]
    return prefix + completion, kept + fresh


def byte_score(text: str, spans: Sequence[Mapping], start: int, end: int) -> dict:
    """Geometric mean probability of the tokens behind the letters and digits of text[start:end], each weighted by the share of
    its bytes that they take; a character counts as covered if all of its bytes are scored.  ``score`` is null unless all are."""
    at, places = 0, []
    for i, c in enumerate(text):
        size = len(c.encode())
        if start <= i < end and unicodedata.category(c)[0] in "LNM":
            places.append((at, at + size))
        at += size
    usable = [s for s in spans if s["logprob"] is not None]
    weight: dict[str, float] = {}
    covered = 0
    for a, b in places:
        shares = [(s, min(b, s["end"]) - max(a, s["start"])) for s in usable if s["start"] < b and a < s["end"]]
        if sum(n for _, n in shares) == b - a:
            covered += 1
            for s, n in shares:
                weight[s["evidence"]] = weight.get(s["evidence"], 0.0) + n / s["width"]
    logs = {s["evidence"]: s["logprob"] for s in usable}
    mean = math.exp(sum(logs[k] * w for k, w in weight.items()) / sum(weight.values())) if weight else None
    return {"score": mean if places and covered == len(places) else None, "covered_score": mean, "coverage": covered / len(places) if places else None, "tokens": len(weight)}
