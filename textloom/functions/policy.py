"""Decisions on records: audit verdicts, label evidence, origin, names kept, actions by probability, verified choices."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that may differ at the end, label codes of public sets, correction words, fillers.
SEPARATORS = "，。；、："
VERDICTS = ("source_valid", "meaning_preserved", "cleanup_complete")
NATIVE = [
    ("CS2W", "A01", "disfluency_label", "1"),
    ("CS2W", "C02", "grammatical_error_label", "1"),
    ("CS2W", "C03", "grammatical_error_label", "2"),
    ("FCGEC", "C02", "error_type", "CR"),
    ("FCGEC", "C03", "error_type", "CM"),
    ("FCGEC", "C04", "error_type", "IWO"),
    ("FCGEC", "E07", "error_type", "*"),
]
GENERATED = "Gemma4"
PUBLIC = ("cs2w", "fcgec", "chinesehp", "chft")
CORRECTIONS = "不对|哦不|噢不|改成|换成|改用|换用|更正为|准确地说|应该用|还是用"
FILLERS = ("呃", "嗯", "额", "啊", "那个", "这个", "然后", "就是", "那", "就是说", "那个那个", "嗯嗯")
GUARDED = "没有|并非|不能|不会|只有|除非|只要|至少|至多|以上|以下|左右|以内|以外|超过|大约|不|没|未|无|仅|只"
LONE = ("有", "不", "没", "未", "无", "仅", "只", "都", "也", "还", "才", "再", "的")


def audit_verdict(audit: Column, target: Column) -> Column:
    """Reason of an audit struct (the three verdicts, ``issues``, ``cleaned_target``): passed only if all verdicts are true, no
    issue is told and the cleaned target is the target, or differs by one closing separator."""
    cleaned = audit["cleaned_target"]
    bare = F.left(target, F.length(target) - 1)
    closes = target.rlike(f"[^.。！？!?,，;；、：:…][{SEPARATORS}]$")
    alike = closes & ((cleaned == bare) | (F.left(cleaned, F.length(cleaned) - 1) == bare) & F.right(cleaned, F.lit(1)).isin(*SEPARATORS))
    out = F.when(audit.isNull(), "audit_not_object")
    for v in VERDICTS:
        out = out.when(audit[v].isNull(), f"audit_missing_boolean:{v}").when(~audit[v], f"audit_failed:{v}")
    out = out.when(audit["issues"].isNull() | (F.size(audit["issues"]) > 0), "audit_reports_issues")
    return out.when(cleaned == target, "typed_audit_passed").when(F.coalesce(alike, F.lit(False)), "typed_audit_passed_terminal_punctuation_equivalent").otherwise("audit_target_not_clean_or_not_exact")


def native_label(dataset: Column, category: Column, labels: Column) -> Column:
    """struct(category, eligible, status) by explicit native labels (map field -> value): a public record's class counts only if
    the set's own label says the same; a generated record keeps its own."""
    says = F.lit(False)
    for name, cat, field, code in NATIVE:
        value = F.coalesce(labels[field], F.lit(""))
        match = F.contains(value, F.lit(code)) if name == "CS2W" else value == code
        says = says | ((dataset == name) & (category == cat) & match)
    known = (dataset == GENERATED) | says
    status = F.when(dataset == GENERATED, "generated").when(says, "explicit_native_mapping").otherwise("no_explicit_matching_native_subclass_label")
    return F.struct(F.when(known, category).otherwise("unclassified").alias("category"), known.alias("eligible"), status.alias("status"))


def source_kind(dataset: Column, provenance: Column) -> Column:
    """public, synthetic or unconfirmed, by the set's name and provenance (map of texts)."""
    told = F.exists(F.map_entries(provenance), lambda e: (F.lower(e["key"]).isin("is_public", "public", "public_dataset") & (F.lower(e["value"]) == "true")) | (F.lower(e["key"]).rlike("public|source") & F.lower(e["value"]).isin("public", "公开", "open", "open_source")))
    return F.when(F.lower(dataset).isin(*PUBLIC) | F.coalesce(told, F.lit(False)), "public").when(F.lower(dataset) == GENERATED.lower(), "synthetic").otherwise("unconfirmed")


def second_audit(needs_review: Column, passed: Column, issues: Column, own_target: Column, reference: Column) -> Column:
    return F.when(needs_review, "needs_review").when(~passed | (F.size(issues) > 0), "flagged").when(~own_target.eqNullSafe(reference), "target_disagreement").otherwise("passed_second_model_audit")


# -- Latin names in Chinese text

_TOKEN = r"[-/]*[A-Za-z0-9_]+(?:[.+#/-]+[A-Za-z0-9_]+)*[+#]*"
_NAME = re.compile(rf"(?<![A-Za-z0-9_]){_TOKEN}(?:[ \t]+{_TOKEN})*")
_CLAUSE = re.compile(r"[^，,。；;！？!?\n]+")
_FILLER = re.compile(r"(?:嗯+|呃+|啊+|那个|就是|呃嗯|嗯呃)[，,、 ]*")
_SPELLED = re.compile(r"(?:拼音|英文拼写|拼写)\s*(?:是|为|写作|叫做)?\s*$")


def names(text: str) -> list[tuple[int, int, str]]:
    """Latin names and identifiers, with their case, marks and inner blanks."""
    return [(*m.span(), m.group()) for m in _NAME.finditer(text) if any(c.isascii() and c.isalpha() for c in m.group())]


class _Clauses:
    """A text's clauses, and the names that a rewrite may drop: superseded by a correction, spelled out, or said again."""

    def __init__(self, source: str, target: str):
        self.source, self.flat = source, "".join(target.split())
        self.wanted = {n for *_, n in names(target)}
        self.spans = [m.span() for m in _CLAUSE.finditer(source)]

    def text(self, i: int) -> str:
        return self.source[slice(*self.spans[i])] if 0 <= i < len(self.spans) else ""

    def corrected(self) -> Iterable[tuple[int, int]]:
        for i, (a, b) in enumerate(self.spans):
            for m in re.finditer(CORRECTIONS, self.source[a:b]):
                old = (a, a + m.start()) if names(self.source[a : a + m.start()]) else self.spans[i - 1] if i else None
                new = names(self.source[a + m.end() : b].strip() or self.text(i + 1))
                if old and new and all(n in self.wanted for *_, n in new):
                    yield old

    def spelled(self) -> Iterable[tuple[int, int]]:
        for i, (a, _) in enumerate(self.spans):
            yield from ((a + x, a + y) for x, y, _ in names(self.text(i)) if _SPELLED.search(self.text(i)[:x].strip()))

    def restarted(self) -> Iterable[tuple[int, int]]:
        for i, (a, _) in enumerate(self.spans[:-2]):
            mine, later = names(self.text(i)), {n for *_, n in names(self.text(i + 2))}
            if mine and _FILLER.fullmatch(self.text(i + 1).strip()) and all(n in later for *_, n in mine) and "".join(self.text(i + 2).split()) in self.flat:
                yield from ((a + x, a + y) for x, y, _ in mine)

    def repeated(self) -> Iterable[tuple[int, int]]:
        for i, (one, two) in enumerate(zip(self.spans, self.spans[1:], strict=False)):
            same = "".join(self.text(i).split())
            if re.fullmatch("[。！？!?]+", self.source[one[1] : two[0]]) and same == "".join(self.text(i + 1).split()) and same in self.flat and names(self.text(i)):
                yield from (one, two)


def names_kept(source: str, target: str) -> bool:
    """Whether the target's names are the source's, verbatim and in order, but for those that may go."""
    clauses = _Clauses(source, target)
    loose = [*clauses.corrected(), *clauses.spelled(), *clauses.restarted(), *clauses.repeated()]
    wanted = [n for *_, n in names(target)]
    reached = {0}  # how many of the target's names the source's names so far can have given
    for a, b, n in names(source):
        reached = {i + 1 for i in reached if wanted[i : i + 1] == [n]} | (reached if any(x <= a and b <= y for x, y in loose) else set())
    return len(wanted) in reached


# -- edits between a text and its cleaned form


def explained(kind: str, before: str, left: str, right: str) -> bool:
    """Whether an edit only takes a filler or a copy of what stands next to it."""
    return kind == "delete" and (before in FILLERS or left.endswith(before) or right.startswith(before))


def edit_flags(source: str, target: str, recognition: bool = False) -> list[str]:
    """Suspicions on a cleaned pair (texts without blanks and marks): changed numbers, negations or Latin words, and content that
    goes or comes without being a filler or a copy."""
    from textloom.functions.edits import align

    edits = align(source, target)
    odd = [e for e in edits if not explained(e["kind"], e["source"], source[: e["start"]], source[e["end"] :])]
    if not odd:
        return []
    flags = set()
    for flag, pattern in (("number_or_range_change_check", r"\d+(?:[.,:/%-]\d+)*|[零〇一二两三四五六七八九十百千万亿]+"), ("negation_condition_range_check", GUARDED), ("english_or_placeholder_change_check", r"[A-Za-z][A-Za-z0-9_+/#-]*")):
        if re.findall(pattern, source) != re.findall(pattern, target):
            flags.add(flag)
    for e in odd:
        if recognition and e["kind"] == "replace" and max(len(e["source"]), len(e["target"])) <= 4:
            continue
        if len(e["source"]) >= 2 or e["source"] in LONE:
            flags.add("unexplained_unique_content_deletion_check")
        if e["target"]:
            flags.add("unexplained_addition_or_replacement_check")
    return sorted(flags)


def local_reorder(source: str, target: str, most: int = 16) -> bool:
    """Whether the target is the source with its characters moved within one stretch of 2 to ``most``."""
    if source == target or Counter(source) != Counter(target):
        return False
    differ = [i for i, (a, b) in enumerate(zip(source, target, strict=True)) if a != b]
    return 2 <= differ[-1] - differ[0] + 1 <= most


def grammar_gate(category: str, source: str, target: str) -> str | None:
    """Why a pair of a grammar set needs review, or None: one local deletion, a local reorder, or no edit at all."""
    from textloom.functions.edits import align

    edits = align(source, target)
    negations = [re.findall("没有|并非|不|没|未|无", t) for t in (source, target)]
    if category == "E07":
        return "native_correct_sentence_has_edits" if edits else "native_written_correctness_not_clean_oral_guarantee" if re.search("呃|嗯|额", source) else None
    if negations[0] != negations[1]:
        return "negation_changed_requires_semantic_review"
    if category == "C02":
        return None if [e["kind"] for e in edits] == ["delete"] and len(edits[0]["source"]) <= 8 else "not_one_local_grammar_deletion"
    if category == "C04":
        return None if local_reorder(source, target) else "word_order_not_local"
    return "missing_word_requires_semantic_review" if category == "C03" else "unsupported_category"


# -- actions


def _probabilities(p: Column, n: int) -> Column:
    sound = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)) & (F.abs(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) - 1) <= 1e-4)
    return F.coalesce((F.size(p) == n) & sound, F.lit(False))


def chosen_action(p: Column, benefit: float, harm: float) -> Column:
    """refine if the benefit (first) is likely enough and the harm (third) unlikely enough, else keep."""
    return F.when(_probabilities(p, 3) & (F.try_element_at(p, F.lit(1)) >= benefit) & (F.try_element_at(p, F.lit(3)) <= harm), "refine").otherwise("keep")


def vetoed_action(p: Column, native: Column, neutral: float, harm: float) -> Column:
    """The native action, but keep in place of refine where neutral or harm is likely."""
    veto = (F.try_element_at(p, F.lit(2)) >= neutral) | (F.try_element_at(p, F.lit(3)) >= harm)
    return F.when((native == "refine") & _probabilities(p, 3) & veto, "keep").otherwise(native)


def gained_action(p: Column, native: Column, threshold: float) -> Column:
    """The native action, but keep in place of refine where the benefit (first of two) is below the threshold."""
    return F.when((native == "refine") & _probabilities(p, 2) & (F.try_element_at(p, F.lit(1)) < threshold), "keep").otherwise(native)


def verified_choices(text: str, candidates: Sequence[Mapping], threshold: float, margin: float = 0.25) -> tuple[str, list[Mapping]]:
    """The text with accepted candidates (start, end, observed, canonical, entity_id, score) put in: the best first, none that
    overlaps an accepted one or has a rival of another entity within ``margin``."""
    ranked = sorted((c for c in candidates if c["score"] >= threshold and 0 <= c["start"] < c["end"] and text[c["start"] : c["end"]] == c["observed"]), key=lambda c: (-c["score"], c["start"], c["end"], c["entity_id"]))
    meets = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
    accepted: list[Mapping] = []
    for c in ranked:
        rival = max((o["score"] for o in candidates if o["entity_id"] != c["entity_id"] and meets(o, c)), default=None)
        if not any(meets(c, a) for a in accepted) and (rival is None or c["score"] - rival >= margin):
            accepted.append(c)
    out, at = [], 0
    for c in sorted(accepted, key=lambda c: c["start"]):
        out += [text[at : c["start"]], c["canonical"]]
        at = c["end"]
    return "".join([*out, text[at:]]), accepted


def echo_supported(heard: Column, replayed: Column, signatures: Sequence[str]) -> Column:
    """Whether glossary phrases that a transcript holds are held as often by one made without the glossary: else it echoes."""
    flat = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")
    times = lambda t, s: F.regexp_count(flat(t), F.lit(re.escape(s)))
    out = F.lit(True)
    for s in ("".join(c for c in x.lower() if c.isalnum()) for x in signatures):
        out = out & (times(replayed, s) >= times(heard, s))
    return out


def plausible(original: Column, edited: Column, margin: float) -> Column:
    """Verdict on a local edit by mean pseudo-log-likelihoods of both sentences (input columns): remove where the edited one is
    likelier by ``margin``, keep where it is less likely by that, else unresolved."""
    gain = edited - original
    known = original.isNotNull() & edited.isNotNull() & ~F.isnan(gain)
    return F.when(known & (gain >= margin), "remove").when(known & (gain <= -margin), "keep").otherwise("unresolved")
