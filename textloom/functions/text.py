"""Text expressions in Catalyst, and the normalisation families that need Unicode tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_key(text: Column) -> Column:
    """Lower-cased letters and digits with single blanks between runs: a Catalyst stand-in for the Unicode keys below."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the trimmed text; a shorter text is its own only gram."""
    body = F.trim(text)
    chars = F.split(body, "")
    last = F.length(body) - F.lit(n)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(chars, i + 1, n), ""))
    return F.when(last < 0, F.array(body)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 20, "short").when(n <= 50, "medium").when(n <= 100, "long").otherwise("very_long")


def min_length(scene: Column, language: Column, long_scenes: list[str]) -> Column:
    """Least number of content characters of a record, by language and scene."""
    return F.when(language.isin("zh", "mix"), 4).when(language == "en", 6).when(scene.isin(*long_scenes), 8).otherwise(10)


def language_default(item: Column, meta: Column, scene: Column) -> Column:
    return F.coalesce(item, meta, F.when(scene.startswith("english_"), "en").otherwise("zh"))


def namespaced_id(id_: Column, scene: Column) -> Column:
    """Purely numeric ids get their scene in front."""
    return F.when(id_.rlike("^[0-9]+$"), F.concat_ws("_", scene, id_)).otherwise(id_)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def intent_key(expected: Column, fragment: Column, refined: Column) -> Column:
    """Group key of a record's meaning: the first text there is, without trailing full stops and blanks."""
    return F.regexp_replace(F.trim(F.coalesce(blank_to_null(expected), blank_to_null(fragment), refined)), r"[。\s]+$", "")


# -- Unicode keys.  Each metric depends on its own; they are not to be merged.

#: profile: (fold case, categories whose characters go, categories that become blanks, drop white space, collapse it)
PROFILES = {
    "metric": (True, "", "PSZ", False, True),
    "entity_score": (True, "PZC", "", False, False),
    "gate_pair": (True, "PSZ", "", True, False),
    "leakage": (True, "P", "", True, False),
    "ledger": (False, "", "", False, True),
    "matcher": (True, "PZ", "", False, False),
    "layout": (True, "", "", True, False),
}


def key_of(text: str | None, profile: str, simplify: dict[str, str] | None = None) -> str | None:
    """NFKC, then the profile's rules.  ``simplify`` maps traditional to simplified characters where a table is given."""
    if text is None:
        return None
    fold, drop, blank, spaceless, collapse = PROFILES[profile]
    text = unicodedata.normalize("NFKC", text)
    if simplify:
        text = "".join(simplify.get(c, c) for c in text)
    if fold:
        text = text.casefold()
    out = []
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind in drop or spaceless and c.isspace():
            continue
        out.append(" " if kind in blank else c)
    joined = "".join(out)
    return " ".join(joined.split()) if collapse else joined


def text_key(text: Column, profile: str, simplify: dict[str, str] | None = None) -> Column:
    @F.pandas_udf("string")
    def keys(column: pd.Series) -> pd.Series:
        return column.map(lambda t: key_of(t, profile, simplify))

    return keys(text)
