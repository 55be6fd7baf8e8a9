"""Spoken Chinese numbers: values, and conversion to digits where the context says that a number is meant."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals, units, idioms and lexical exceptions of the grammar.
DIGITS = dict(zip("零〇一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
SMALL = {"十": 10, "百": 100, "千": 1000}
LARGE = {"万": 10**4, "亿": 10**8}
MEASURES = "平方公里 平方米 立方米 公里 千米 厘米 毫米 公斤 千克 毫升 小时 分钟 人民币 块钱 平米 米 克 吨 升 秒 度 岁 元 块".split()
CURRENCIES = frozenset("人民币 块钱 元 块".split())
COUNTERS = list("个只件本张台条位名辆套箱袋杯份枚颗粒栋间户艘架门次")
MULTIPLIERS = list("倍成折")
IDIOMS = (
    "一五一十 一心一意 三心二意 不三不四 乱七八糟 七上八下 五湖四海 四面八方 九牛一毛 十全十美 百里挑一 千方百计 万无一失 一举两得 三番五次 一清二楚 说一不二 "
    "十有八九 七七八八 三三两两 五花八门 五颜六色 千言万语 千军万马 千变万化 千山万水 万水千山 九死一生 八九不离十 四通八达 四平八稳 两全其美 两肋插刀 一针一线 "
    "一朝一夕 一刀两断 一穷二白 一来二去 一干二净 一百年大计 一百年好合 一千年一遇 百年大计 百年好合 千年一遇"
).split()
LEXICAL = frozenset("万一 千万 亿万 万万 千千万万 万万千千".split())
LEXICAL_PAIRS = frozenset({("一", "度"), ("一", "块")})
VAGUE_AFTER = frozenset("几多来余")
_BEFORE = "点几多来余数0-9０-９"

_D = "".join(DIGITS)
_I = _D + "".join(SMALL) + "".join(LARGE)
_N = f"[{_I}]+(?:点[{_D}]+)?"
_START = f"(?<![{_I}{_BEFORE}])"


def _any(units: list[str]) -> str:
    return "|".join(sorted(map(re.escape, units), key=len, reverse=True))


def _below_ten_thousand(part: str) -> int:
    """Value of a part without large units; of neighbouring digits the last counts, a bare unit is one of it."""
    total = 0
    for digits, unit in re.findall(f"([{_D}]*)([十百千]|$)", part):
        digit = DIGITS[digits[-1]] if digits else 0
        total += (digit or 1) * SMALL[unit] if unit else digit
    return total


def value_of(token: str) -> Decimal | None:
    """The number a token says, or None: digits one by one, or sections of small units before large ones, and decimals."""
    whole, dot, decimals = token.partition("点")
    if dot:
        before = value_of(whole)
        if before is None or not decimals or set(decimals) - DIGITS.keys():
            return None
        return Decimal(f"{int(before)}." + "".join(str(DIGITS[c]) for c in decimals))
    if not token or set(token) - set(_I):
        return None
    if not set(token) - DIGITS.keys():
        return Decimal("".join(str(DIGITS[c]) for c in token))
    total = 0
    for part, unit in re.findall("([^万亿]*)([万亿]|$)", token):
        here = _below_ten_thousand(part) if part else 0
        total += (here or 1) * LARGE[unit] if unit else here
    return Decimal(total)


def shown(value: Decimal) -> str:
    return str(int(value)) if value == int(value) else format(value.normalize(), "f")


def _vague(token: str, after: str) -> bool:
    """Two or three, twenty or thirty, a unit alone: not one value."""
    if token in LARGE or token in LEXICAL or after in VAGUE_AFTER:
        return True
    run = re.match(f"[{_D}]*", token).end()
    return run >= 2


def _read(token: str) -> str | None:
    value = value_of(token)
    return None if value is None else shown(value)


def _in(token: str, low: int, high: int) -> str | None:
    value = value_of(token)
    return str(int(value)) if value is not None and value == int(value) and low <= value <= high else None


def _year(token: str) -> str | None:
    return _in(token, 1, 9999)


def _joined(*parts: str | None) -> str | None:
    return None if None in parts else "".join(parts)


def _after(m: re.Match, end: int) -> str:
    return m.string[end : end + 1]


def _approximate(m: re.Match) -> str | None:
    token = m["n"]
    if set(token) & LARGE.keys() or not set(token) & SMALL.keys() or _vague(token, _after(m, m.end())):
        return None
    return _joined(_read(token), "多")


def _large(m: re.Match) -> str | None:
    token = m["n"]
    if len(token) >= 2 and not set(token) - SMALL.keys() - LARGE.keys() or _vague(token, m["u"]):
        return None
    return _joined(_read(token), m["pre"] or "", m["u"], m["post"] or "")


def _measured(m: re.Match) -> str | None:
    if (m["n"], m["u"]) in LEXICAL_PAIRS or _vague(m["n"], m["u"][0]):
        return None
    return _joined(_read(m["n"]), m["u"])


def _counted(m: re.Match) -> str | None:
    if m.string.startswith(m["u"], m.end()) or _vague(m["n"], _after(m, m.end())):
        return None
    return _joined(_read(m["n"]), m["u"])


def _multiplied(m: re.Match) -> str | None:
    return None if _vague(m["n"], _after(m, m.end())) else _joined(_read(m["n"]), m["u"])


def _positional(m: re.Match) -> str | None:
    return None if len(m["n"]) < 2 or _vague(m["n"], _after(m, m.end())) else _read(m["n"])


#: Families in order of precedence: what is claimed by one is closed to those after it.
_FAMILIES: list[tuple[str, re.Pattern[str], Callable[[re.Match], str | None]]] = [
    ("percent", re.compile(f"百分之(?P<n>{_N})"), lambda m: _joined(_read(m["n"]), "%")),
    ("date", re.compile(f"(?P<y>[{_I}]+)年(?P<m>[{_I}]+)月(?P<d>[{_I}]+)(?P<u>[日号])"), lambda m: _joined(_year(m["y"]), "年", _in(m["m"], 1, 12), "月", _in(m["d"], 1, 31), m["u"])),
    ("date", re.compile(f"(?P<y>[{_I}]+)年(?P<m>[{_I}]+)月"), lambda m: _joined(_year(m["y"]), "年", _in(m["m"], 1, 12), "月")),
    ("date", re.compile(f"(?P<y>[{_D}]{{4}})年"), lambda m: _joined(_year(m["y"]), "年")),
    ("time", re.compile(f"(?P<h>[{_I}]+)点(?P<m>[{_I}]+)(?P<u>分钟?)"), lambda m: _joined(_in(m["h"], 0, 23), "点", _in(m["m"], 0, 59), m["u"])),
    ("approximate_count", re.compile(f"{_START}(?P<n>[{_I}]+)多(?![{_I}])"), _approximate),
    ("range", re.compile(f"{_START}(?P<a>{_N})(?P<s>到|至|[-~～])(?P<b>{_N})(?P<u>{_any(MEASURES + COUNTERS)})"), lambda m: _joined(_read(m["a"]), m["s"], _read(m["b"]), m["u"])),
    ("number", re.compile(f"{_START}(?P<n>[{_I}]+(?:点[{_D}]+)?)(?P<pre>多)?(?P<u>[万亿])(?P<post>多)?(?![{_I}])"), _large),
    ("measurement", re.compile(f"{_START}(?P<n>{_N})(?P<u>{_any(MEASURES)})"), _measured),
    ("multiplier", re.compile(f"{_START}(?P<n>{_N})(?P<u>{_any(MULTIPLIERS)})"), _multiplied),
    ("count", re.compile(f"{_START}(?P<n>{_N})(?P<u>{_any(COUNTERS)})"), _counted),
    ("number", re.compile(f"{_START}(?P<n>[{_I}]*[十百千万亿][{_I}]*)(?![{_I}])"), _positional),
]
_IDIOM = re.compile(_any(IDIOMS))


def _idiom_spans(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.start() + len(i)) for i in IDIOMS for m in re.finditer(re.escape(i), text)] if _IDIOM.search(text) else []


def changes(text: str, keep_single_one: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, replacement, kind) of every conversion, in order of the text."""
    closed, out = _idiom_spans(text), []
    for kind, pattern, write in _FAMILIES:
        for m in pattern.finditer(text):
            if any(m.start() < b and a < m.end() for a, b in closed):
                continue
            new = write(m)
            if new is None or new == m.group() or keep_single_one and kind == "count" and new[0] == "1" and not new[1].isdigit():
                continue
            label = kind
            if kind == "measurement" and m["u"] in CURRENCIES:
                label = "currency"
            elif kind == "range":
                label = "count_range" if m["u"] in COUNTERS else "measurement_range"
            closed.append(m.span())
            out.append((*m.span(), new, label))
    yield from sorted(out)


def normalize(text: str | None, keep_single_one: bool = False) -> str | None:
    if not text:
        return text
    parts, at = [], 0
    for start, end, new, _ in changes(text, keep_single_one):
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def normalize_numbers(text: Column) -> Column:
    @F.pandas_udf("string")
    def normal(column: pd.Series) -> pd.Series:
        return column.map(normalize)

    return normal(text)


def number_value(text: Column) -> Column:
    """The value of a whole token as text, or null."""

    @F.pandas_udf("string")
    def values(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None or (v := value_of(t)) is None else shown(v))

    return values(text)
