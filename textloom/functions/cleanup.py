"""Deterministic cleanup of transcripts: exact rules of low ambiguity, in fixed order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules' patterns (valid in Python and Java).
FILLER_MIDDLE = r"([，,、；;])\s*(?:呃+|额+)\s*[，,、；;]"
FILLER_START = r"^\s*(?:呃+|额+)\s*(?:[，,、；;]|$)"
FILLER_END = r"(?:^|[，,、；;])\s*(?:呃+|额+)\s*([。！？!?]|$)"
AFTER_SENTENCE = r"([。！？!?；;\n])\s*嗯[，,、：:]"
PRONOUN = r"([我你您他她它这那])\1+"
SENTENCE_ECHO = r"([㐀-鿿])[。！？!?；;]\1(?=[㐀-鿿])"
RULES = [(FILLER_START, ""), (FILLER_MIDDLE, r"\1"), (FILLER_END, r"\1"), (AFTER_SENTENCE, r"\1"), (PRONOUN, r"\1"), (SENTENCE_ECHO, r"\1")]


def cleaned(text: str) -> str:
    for pattern, new in RULES:
        text = re.sub(pattern, new, text)
    return text


def clean(text: Column) -> Column:
    """The same rules in Catalyst."""
    for pattern, new in RULES:
        text = F.regexp_replace(text, pattern, new.replace("\\", "$"))
    return text
