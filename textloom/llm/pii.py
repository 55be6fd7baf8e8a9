"""Personal data: exact patterns, and a character-level tagger that finds written variants of them."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import Tagger
from .common import documents_view, map_arrow, text_steps

KINDS = ("email", "ip", "card", "phone")

#: Characters that the tagger reads around a digit, and around an @, a bracketed "at" or "dot", or a "dot" between blanks (a local part has up to 64,
#: a domain's label 63), window length and stride, and windows decoded at once.
AROUND, ADDRESS, WINDOW, STRIDE, GROUP = 24, 72, 64, 32, 512
#: Characters of a stretch that are decoded at once, and how many of these two neighbouring cuts share.
CUT, SHARED = 4096, 256
#: Bounds of the training sample: documents with digits or @ read for it, windows cut from them, and made-up windows.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WINDOWS, MADE_UP = 600, 20_000, 1500, 3000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run that fails from its start fails from inside as well, so starts inside a run are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPELLED_OUT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]at[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[(]dot[\])]\s?[A-Za-z0-9-]{1,63})*\s?[\[(]dot[\])]\s?[A-Za-z]{2,63}")
_SEED = re.compile(r"[0-9]+|@+|[\[(](?:at|dot)[\])]|(?<= )dot(?= )")
#: How "@" and "." may be written in an address.
_AT, _DOT = r"(?:\s?(?:@|[\[(]at[\])])\s?| at )", r"(?:\s?(?:\.|[\[(]dot[\])])\s?| dot )"
_ADDRESS = re.compile(rf"[^\s@]+{_AT}[^\s@]+?(?:{_DOT}[^\s@]+?)*{_DOT}[A-Za-z]{{2,}}")

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in _DIGITS.findall(text))


def _is_card(text: str) -> bool:
    return 16 <= len(d := _digits(text)) <= 19 and luhn(d)


def _is_phone(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: a local part is the whole run before its @, back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed, then start; offsets in code points."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, right in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if right(m.group())]
    return out


# -- the tagger's view of characters

_SINGLE = "@.-+()_% ,:;/[]<>\n#=!?'\""
#: 0 padding, 1 lower, 2 upper, 3 digit, 4 other letters, 5 other, then single characters, then letters that spell "at dot".
_OWN = {c: 6 + i for i, c in enumerate(_SINGLE)}
_SPELL = {c: 6 + len(_SINGLE) + i for i, c in enumerate("atdo")}
CLASSES = 6 + len(_SINGLE) + 4
_ASCII = np.array([_OWN.get(chr(i), _SPELL.get(chr(i), 1 if chr(i).islower() else 2 if chr(i).isupper() else 3 if chr(i).isdigit() else 5)) for i in range(128)], np.uint8)


def view(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], 4 if text.isascii() else np.where(codes >= 0xC0, 4, 5)).astype(np.uint8)


def _tags(length: int, spans: list[Span], shift: int = 0) -> np.ndarray:
    """0 outside, 2k+1 at the start of a span of kind k, 2k+2 inside."""
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        a, b = a - shift, b - shift
        if b > 0 and a < length:
            out[max(0, a) : min(length, b)] = 2 * k + 2
            if 0 <= a:
                out[a] = 2 * k + 1
    return out


def segments(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, @ and bracketed "at" and "dot": without one of these, no kind can be present."""
    out: list[tuple[int, int]] = []
    for m in _SEED.finditer(text):
        around = AROUND if m.group()[0].isdigit() else ADDRESS
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        while out and a <= out[-1][1]:
            x, y = out.pop()
            a, b = min(a, x), max(b, y)
        out.append((a, b))
    return out


# -- training

def _made_up(rng: random.Random) -> tuple[str, str | None]:
    """A value and its kind, or a look-alike that is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda a, b: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(a, b)))
    pick = rng.randrange(17)
    if pick < 2:
        local = rng.choice([w(2, 10), w(2, 7) + rng.choice("._-") + w(2, 7), w(2, 8) + d(2), w(2, 8) + "." + d(2)])
        at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", "."), ("@", " . "), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        end = dot.join([w(3, 9) + rng.choice(["", d(1)]), rng.choice(["com", "org", "net", "example" + dot + "com"])])
        return local + at + end, "email"
    if pick >= 14:  # spelled out
        local = rng.choice([w(2, 10), w(2, 10), w(2, 7) + rng.choice("._-") + w(2, 7)])
        return f"{local} at {' dot '.join([w(3, 9) for _ in range(rng.choice([1, 1, 1, 2]))] + [rng.choice(['com', 'org', 'net', 'edu'])])}", "email"
    if pick < 4:
        dot = rng.choice([".", ".", ".", " . ", "[.]"])
        return dot.join(str(rng.randint(0, 255)) for _ in range(4)), "ip"
    if pick < 6:
        body = rng.choice("3456") + d(14)
        number = next(body + x for x in "0123456789" if luhn(body + x))
        sep = rng.choice(["", " ", "-", ".", "/"])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4)), "card"
    if pick < 9:
        form = rng.choice(["+1 ({}) {}-{}", "({}) {}-{}", "+1-{}-{}-{}", "+49 {} {}{}", "{}-{}-{}", "001 {} {} {}", "tel {}.{}.{}"])
        text = form.format(d(3), d(3), d(4))
        return (text, "phone") if not text.startswith("tel") else (text[4:], "phone")
    return rng.choice([f"{rng.randint(1, 9)}.{rng.randint(0, 20)}", f"{rng.randint(1990, 2030)}-{d(2)}-{d(2)}", hashlib.sha1(d(9).encode()).hexdigest()[: rng.randint(16, 40)], "$" + d(3) + "." + d(2), d(rng.randint(1, 6)), "Version " + d(1) + ".0", "@" + w(3, 9), d(2) + ":" + d(2), w(2, 5) + d(4), "#" + d(5), f"{d(2)}/{d(2)}/{d(4)}", d(1) + "," + d(3) + "," + d(3)]), None


def _window(text: str, middle: int, rng: random.Random) -> int:
    return max(0, min(len(text) - WINDOW, middle - rng.randint(8, WINDOW - 8)))


def train(texts: list[str], seed: int = 11) -> Tagger:
    """Train on windows of texts with their base spans as labels, and on made-up values (with their variants) in context."""
    rng = random.Random(seed)
    xs, ys = [], []
    words = [w for t in texts[:200] for w in t[:2000].split() if not re.search(r"[0-9@]", w)] or ["the", "of", "and"]

    def put(text: str, spans: list[Span], middle: int) -> None:
        a = _window(text, middle, rng)
        x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
        part = view(text[a : a + WINDOW])
        x[: len(part)], y[: len(part)] = part, _tags(len(part), spans, a)
        xs.append(x)
        ys.append(y)

    for text in texts:
        # the tagger learns what a card number looks like; its check sum is tested afterwards
        spans = [s for s in base_spans(text) if s[0] != "card"] + [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(_digits(m.group())) <= 19]
        for a, b in segments(text)[:8]:
            if len(xs) < SAMPLE_WINDOWS:
                put(text, spans, (a + b) // 2)
    for _ in range(MADE_UP):
        value, kind = _made_up(rng)
        left, right = (" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(2))
        a = len(left) + 1
        spans = [(kind, a, a + len(value))] if kind else []
        put(f"{left} {value}{rng.choice(['', '', '.', ',', '%%%'])} {right}", spans, a + len(value) // 2)
    tagger = Tagger(CLASSES, 2 * len(KINDS) + 1)
    tagger.fit(np.array(xs), np.array(ys))
    return tagger.lean()


# -- decoding

def _plausible(kind: str, value: str) -> bool:
    """What a tagged stretch must hold to count: the tagger proposes, digits and signs decide."""
    n = len(_digits(value))
    if kind == "email":
        return _ADDRESS.fullmatch(value) is not None and (" at " not in value or "dot" in value)
    if kind == "ip":
        parts = re.split(r"\s?\[?\.\]?\s?", value)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[ ./-]?[0-9])+", value) is not None and 16 <= n <= 19 and luhn(_digits(value))
    return re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", value) is not None and 9 <= n <= 15 and re.search(r"[ ().-]", value) is not None and not re.match(r"(?:19|20)[0-9]{2}-", value)


def _cuts(i: int, a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
    """A stretch of text ``i``, cut where it is long: (i, start, end, and between which places spans may begin), so that every
    span is reported by the one cut in whose middle it begins."""
    if b - a <= CUT:
        yield i, a, b, a, b
        return
    step = CUT - SHARED
    starts = range(a, b - SHARED, step)
    for n, x in enumerate(starts):
        y = min(b, x + CUT)
        yield i, x, y, x + SHARED // 2 if n else a, b if n == len(starts) - 1 else y - SHARED // 2


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans the tagger finds, and addresses with both signs bracketed, which are certain.  Stretches are cut into overlapping
    windows; the windows' emissions are averaged where they overlap, and each stretch is decoded as a whole, so a span across
    windows is one span."""
    where = [(i, a, b) for i, text in enumerate(texts) for a, b in segments(text)]
    out: list[list[Span]] = [[] for _ in texts]
    if not where:
        return out
    cuts = sorted((cut for stretch in where for cut in _cuts(*stretch)), key=lambda c: c[2] - c[1])
    for g in range(0, len(cuts), GROUP):
        _decode(tagger, texts, cuts[g : g + GROUP], out)
    for i, a, b in where:
        for m in _SPELLED_OUT.finditer(texts[i], a, b):
            out[i] = [s for s in out[i] if s[2] <= m.start() or m.end() <= s[1]] + [("email", *m.span())]
    return out


def _decode(tagger: Tagger, texts: list[str], group: list[tuple[int, int, int, int, int]], out: list[list[Span]]) -> None:
    longest = max(b - a for _, a, b, _, _ in group)
    cuts = list(range(0, max(1, longest - WINDOW + STRIDE), STRIDE))
    width = cuts[-1] + WINDOW
    if len(group) > 1 and len(group) * width > GROUP * 8 * WINDOW:  # bounded memory, whatever the stretches
        half = len(group) // 2
        _decode(tagger, texts, group[:half], out)
        _decode(tagger, texts, group[half:], out)
        return
    x = np.zeros((len(group), width), np.uint8)
    for r, (i, a, b, _, _) in enumerate(group):
        x[r, : b - a] = view(texts[i][a:b])
    em, times = np.zeros((len(group), width, tagger.tags), np.float32), np.zeros(width, np.float32)
    for cut in cuts:
        live = (x[:, cut : cut + WINDOW] != 0).any(1)
        if live.any():
            em[live, cut : cut + WINDOW] += tagger.emissions(x[live, cut : cut + WINDOW])
        times[cut : cut + WINDOW] += 1
    em /= times[None, :, None]
    em[x == 0] = -1e4
    em[x == 0, 0] = 0
    paths = tagger.decode(em)
    for (i, a, b, low, high), path in zip(group, paths, strict=True):
        tags = path[: b - a]
        outside = np.flatnonzero(tags == 0)
        for at in np.flatnonzero(tags % 2 == 1).tolist():
            if not low <= a + at < high:
                continue
            k = int(tags[at]) // 2
            inside = tags[at + 1 : int(outside[np.searchsorted(outside, at)]) if len(outside) and outside[-1] > at else len(tags)] == 2 * k + 2
            end = at + 1 + (int(np.argmin(inside)) if not inside.all() else len(inside))
            value = texts[i][a + at : a + end]
            trimmed = value.strip(" .,;:%!-\n")
            start = a + at + value.find(trimmed) if trimmed else a
            if trimmed and _plausible(KINDS[k], trimmed):
                out[i].append((KINDS[k], start, start + len(trimmed)))


def _merged(base: list[Span], own: list[Span]) -> list[Span]:
    """Base spans, and those of the tagger that touch none of them nor each other: one sweep over both in order."""
    taken = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
    extra: list[Span] = []
    for kind, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
        # of the base spans that begin before this one ends, none may end behind its start
        if furthest[bisect_left(starts, b)] <= a and (not extra or extra[-1][2] <= a):
            extra.append((kind, a, b))
    return sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SEEDS = np.zeros(256, bool)
_SEEDS[48:58] = _SEEDS[64] = True
_OPEN, _CLOSE = np.isin(np.arange(256), list(b"[(")), np.isin(np.arange(256), list(b"])"))
_EMPTY = hashlib.sha256(b"").hexdigest()


def _seeds(data: np.ndarray) -> np.ndarray:
    """Where bytes are digits or @, or a bracketed "at" or "dot" begins, or a "dot" between blanks."""
    seeds = _SEEDS[data]
    spelled = np.flatnonzero(data[:-4] == 32)
    for k, c in enumerate(b"dot ", 1):
        spelled = spelled[data[spelled + k] == c]
    seeds[spelled] = True
    opened = np.flatnonzero(_OPEN[data])
    for word in (b"at", b"dot"):
        at = opened[opened + len(word) + 1 < len(data)]
        for k, c in enumerate(word, 1):
            at = at[data[at + k] == c]
        seeds[at[_CLOSE[data[at + len(word) + 1]]]] = True
    return np.flatnonzero(seeds)


def _found(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_steps(batches):
        n = len(offsets) - 1
        seeded = np.unique(np.searchsorted(offsets, _seeds(data), side="right") - 1)
        counts = {k: np.zeros(n, np.int64) for k in KINDS}
        sums, spans = [_EMPTY] * n, [""] * n
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in seeded]
        for i, text, own in zip(seeded, texts, tagged_spans(tagger, texts), strict=True):
            base = base_spans(text)
            for kind, _, _ in base:
                counts[kind][i] += 1
            sums[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
            spans[i] = _joined(_merged(base, own))
        yield pa.record_batch([batch.column(0), *(pa.array(counts[k]) for k in KINDS), pa.array(sums), pa.array(spans)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def fit_tagger(docs: DataFrame) -> Tagger:
    """Train on the first ``SAMPLE_DOCS`` documents, by a hash of the text, that hold a digit or @ and are not overly long."""
    some = docs.where(F.length("text") <= SAMPLE_CHARS).where(F.col("text").rlike("[0-9@]"))
    order = F.xxhash64("text", F.lit(3))
    # first the hashes alone, so that no task sends more texts than are wanted
    picked = some.select(order.alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCS)
    rows = some.withColumn("h", order).join(F.broadcast(picked), "h").select("h", "text").groupBy("h").agg(F.min("text").alias("text")).collect()
    return train([r.text for r in sorted(rows, key=lambda r: (r.h, r.text))])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check; counts and the digest are
    of these.  ``spans`` adds what the tagger finds elsewhere (numbers without a plus, other separators, spelled-out signs),
    where it passes the kind's check as well.  Whole texts are searched; the tagger reads all stretches around digits, @ and
    bracketed "at" and "dot" and "dot" between blanks, outside of which none of the kinds can stand; addresses with both signs
    bracketed are found by their pattern.  A null or empty text has no spans.  Repeated rows get equal results, and rows without
    doc_id theirs; other columns are not read; an empty table gives none.  Very long stretches are decoded in cuts that overlap."""
    docs = documents_view(docs)
    tagger = fit_tagger(docs)
    return map_arrow(docs, partial(_found, tagger=tagger), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
