"""Routing of segments: cleanup signals and first-match decision lists, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.numbers import COUNTERS, MEASURES

# Signal patterns (Java syntax), sentence ends and thresholds.
_CJK = "\\u3400-\\u9fff"
_PUNCT = "[\\u3000-\\u303f\\uff01-\\uff65!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]"
_UNITS = "|".join(sorted({*COUNTERS, *MEASURES, "座"}, key=len, reverse=True))
SIGNALS = {
    "repeated_character": f"([{_CJK}])\\1{{2,}}|(?:^|[，,、。！？!?；;\\s])([{_CJK}])(?:\\2|[，,、。！？!?；;\\s]+\\2)+",
    "repeated_phrase": f"([{_CJK}]{{2,8}})(?:[，,、 ]?\\1){{1,}}",
    "disfluency": "(?:^|[，,。！？!?；;、\\s])(?:嗯+|呃+|额+|啊+|哎+|呀+|嘿+|呼+|喂|这个|那个|就是)(?=$|[，,。！？!?；;、\\s])",
    "embedded_disfluency": "嗯+(?!嗯|哼)|呃+(?!呃|逆)",
    "self_correction": "不对|哦不|我说错了|说错了|应该是|应该说|准确地说|我是说|改成|更正一下",
    "numeric_normalization": f"百分之[零〇一二三四五六七八九十百千万亿两0-9]+|第[零〇一二三四五六七八九十百千万亿两]+|[零〇一二三四五六七八九十百千万亿两]{{2,}}(?:点[零〇一二三四五六七八九]+)?|[零〇一二三四五六七八九两](?:{_UNITS})",
    "malformed_spacing_or_punctuation": "  |，，|。。",
    "isolated_single_character_clause": f"^\\s*[{_CJK}]\\s*{_PUNCT}\\s*(?=[{_CJK}])|[{_CJK}]\\s*{_PUNCT}\\s*[{_CJK}]\\s*{_PUNCT}\\s*(?=[{_CJK}])",
    "boundary_anomaly": "[的地得了着过][。！？；][的地得了着过]",
}
SENTENCE_END = "[。！？!?；;]$"
HIGH, LOW, REVISED, MUCH_REVISED, YOUNG_MS = 0.92, 0.80, 0.12, 0.20, 600.0


def cleanup_signals(text: Column) -> Column:
    """Names of the signals a text shows, in fixed order."""
    # all signals but one need a CJK character, and one quick look at the text settles that
    cjk = text.rlike(f"[{_CJK}]")
    tests = {name: text.rlike(p) if name == "malformed_spacing_or_punctuation" else cjk & text.rlike(p) for name, p in SIGNALS.items()}
    # a filler counts as embedded only if something visible is left without it
    filler = F.regexp_extract(text, SIGNALS["embedded_disfluency"], 0)
    tests["embedded_disfluency"] &= F.length(F.regexp_replace(text, f"[^\\w{_CJK}]", "")) > F.length(filler)
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def _decide(*rules: tuple[Column, str, str], otherwise: tuple[str, str]) -> Column:
    make = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    first, *rest = rules
    chain = F.when(F.coalesce(first[0], F.lit(False)), make(first[1], first[2]))
    for test, action, reason in rest:
        chain = chain.when(F.coalesce(test, F.lit(False)), make(action, reason))
    return chain.otherwise(make(*otherwise))


def conservative_gate(text: Column, confidence: Column, calibrated: Column, covered: Column, hints: Column, high: float = HIGH) -> Column:
    """struct(action, reason): keep only complete, confident text without a signal."""
    source = F.trim(text)
    return _decide(
        (source == "", "keep", "empty_segment"),
        (F.size(hints) > 0, "refine", "entity_hint_present"),
        (F.size(cleanup_signals(source)) > 0, "refine", "cleanup_signal_present"),
        (confidence.isNull(), "refine", "confidence_unavailable"),
        (~calibrated, "refine", "confidence_uncalibrated"),
        (~covered, "refine", "confidence_coverage_incomplete"),
        (confidence < high, "refine", "confidence_below_skip_threshold"),
        (~source.rlike(SENTENCE_END), "refine", "sentence_incomplete"),
        otherwise=("keep", "high_confidence_clean_segment"),
    )


def tri_state_gate(text: Column, confidence: Column, calibrated: Column, covered: Column, hints: Column, is_final: Column, stable: Column, age_ms: Column, revised: Column, cooling: Column, same: Column, high: float = HIGH, unverified_refines: bool = True) -> Column:
    """struct(action, reason) with a third action: unstable text that is not final is deferred."""
    source = F.trim(text)
    usable = confidence.isNotNull() & calibrated & covered
    open_ = ~is_final & (cooling | ~stable)
    strict = F.lit(unverified_refines)
    return _decide(
        (source == "", "keep", "empty_segment"),
        (same, "keep", "already_refined_hypothesis"),
        (~is_final & cooling, "defer", "refinement_cooldown"),
        (open_ & (age_ms < YOUNG_MS), "defer", "tail_too_young"),
        (open_ & (revised > REVISED), "defer", "revision_ratio_high"),
        (open_, "defer", "unstable_hypothesis"),
        (F.size(hints) > 0, "refine", "entity_hint_present"),
        (F.size(F.array_remove(cleanup_signals(source), "numeric_normalization")) > 0, "refine", "cleanup_signal_present"),
        (usable & (confidence < LOW), "refine", "confidence_below_refine_threshold"),
        (usable & (confidence >= high), "keep", "high_confidence_clean_segment"),
        (is_final & strict, "refine", "final_uncertain"),
        (is_final & ~source.rlike(SENTENCE_END), "refine", "sentence_incomplete"),
        (is_final, "keep", "confidence_unverified_safe_keep"),
        (confidence.isNull() & strict, "refine", "confidence_unavailable"),
        (~calibrated & strict, "refine", "confidence_uncalibrated"),
        (~covered & strict, "refine", "confidence_coverage_incomplete"),
        (revised > MUCH_REVISED, "refine", "revision_ratio_high"),
        otherwise=("keep", "stable_clean_segment"),
    )


def veto(action: Column, score: Column, threshold: float) -> Column:
    """A learned score may turn refine into keep; a missing score changes nothing."""
    return F.when((action == "refine") & (score >= threshold), "keep").otherwise(action)


def confidence_scope(tokens: Column, covered: Column, suffix_only: Column) -> Column:
    return F.when(tokens.isNull() | (tokens == 0), "unavailable").when(covered, "full_text").when(suffix_only, "generated_suffix").otherwise("current_state")


def rotate(duration: Column, soft: float, hard: float, sentence_end: Column, silent: Column) -> Column:
    """Whether a segment ends here: hard limit, soft limit at a sentence end, or silence."""
    return (duration >= hard) | ((duration >= soft) & sentence_end) | silent


def rms(samples: Column) -> Column:
    """Root mean square of an array; 0 for an empty one."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) == 0, F.lit(0.0)).otherwise(F.sqrt(total / F.size(samples)))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0))
