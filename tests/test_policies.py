"""Marks, pieces, policies, selections and windows: literal cases, brute force and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import guard, pieces, policy, repeats
from textloom.operators import select, simjoin
from textloom.sources import records
from textloom.streaming import windows


def _all(spark, rows, schema, *columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_marks(spark):
    cases = [("好，走。", "好，走吧。", False), ("好，走。", "好走。", True), ("3.5米。", "3.5米。", False), ("3.5米。", "35米。", False), ("a.b", "ab", True), ("走", "", False)]
    got = spark.createDataFrame(cases, "a string, b string, w boolean").select("w", repeats.marks_lost(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.w == r.g for r in got)
    text = "好的。的确，是了。了不起，他走着。着急，来了！了"
    (row,) = _all(spark, [(text,)], "t string", repeats.boundary_anomalies(F.col("t")).alias("a"))
    assert [(x.position, x.pattern) for x in row["a"]] == [(text.index("着。着"), "着。着"), (text.index("了！了"), "了！了")]
    kept = _all(spark, [("好，", "好"), ("好", "好。"), ("真？！", "真。"), ("x。", "")], "a string, b string", repeats.terminal_marks_kept(F.col("a"), F.col("b")).alias("k"))
    assert [r["k"] for r in kept] == ["好，", "好。", "真？！", ""]


def test_repetitions(spark):
    found = repeats.repetitions("我我知道，喂，喂，我们我们去看一个个")
    assert [(r["source"], r["target"], r["kind"]) for r in found] == [("我我", "我", "character_run"), ("喂，喂", "喂", "punctuated_run"), ("我们我们", "我们", "phrase_run")]
    assert repeats.repetitions("") == [] and len(repeats.repetitions("天天，" * 40)) == 24
    none = lambda a, b: []
    assert repeats.apply_decisions("我我知道，我们我们去", found := repeats.repetitions("我我知道，我们我们去"), [1, 2], none) == ("我知道，我们去", [1, 2])
    assert repeats.apply_decisions("我我知道，我们我们去", found, [1, 2], lambda a, b: ["x"] if len(a) - len(b) == 2 else []) == ("我知道，我们我们去", [1])
    assert repeats.apply_decisions("改了", found, [1], none) == ("改了", [])
    assert repeats.apply_decisions("我我知道这件事情", repeats.repetitions("我我知道这件事情"), [1], guard.reject_reasons)[0] == "我知道这件事情"
    assert repeats.deletes_doubled_classifier("一个个", 2, 3) and not repeats.deletes_doubled_classifier("首首先", 1, 2)
    rows = _all(spark, [("一个个", 1), ("首首先", 0), ("一个人", 1), ("二个个", 1)], "t string, i int", repeats.doubled_classifier(F.col("t"), F.col("i")).alias("d"))
    assert [r["d"] for r in rows] == [True, False, False, False]
    (row,) = _all(spark, [("正义就是那种。最好",)], "t string", repeats.known_repairs(F.col("t"), [("那种。最", "那种最"), ("种。", "种")]).alias("r"))
    assert row["r"] == "正义就是那种最好"


def test_pieces(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("字句，。！ab 1") for _ in range(rnd.randint(0, 300))) for _ in range(150)] + [None, "  "]
    got = _all(spark, [(t,) for t in texts], "t string", "t", pieces.bounded_pieces(F.col("t"), 40).alias("p"))
    for r in got:
        if r["t"] is not None:
            assert r["p"] == pieces.split_bounded(r["t"].strip(" "), 40) or "\n" in r["t"]
            assert "".join(r["p"]) == r["t"].strip(" ") and all(len(p) <= 40 for p in r["p"])
    with pytest.raises(ValueError):
        pieces.split_bounded("x", 31)
    (row,) = _all(spark, [(["好", " ok", "go ", "4.", "5万", ""],)], "p array<string>", pieces.joined(F.col("p")).alias("j"))
    assert row["j"] == "好ok go 4. 5万"
    (row,) = _all(spark, [("你 好 ， 世界 ok . 3 %",)], "t string", pieces.cjk_spacing(F.col("t")).alias("c"), pieces.compact_offsets(F.lit("a b\tc")).alias("o"))
    assert row["c"] == "你好，世界 ok. 3%" and row["o"] == [0, 2, 4]
    assert pieces.project_span("我去北京", "我要去北京", 2, 4) == (3, 5) and pieces.project_span("我去北京", "我去南京", 2, 4) is None
    assert pieces.natural_prefixes("今天天气很好，价格1,000元，（明天，再说）完", 4) == ["今天天气很好，", "今天天气很好，价格1,000元，"]


def test_byte_scores():
    text, spans = pieces.ledger([], "", "", "你好吗", [{"start": 0, "end": 6, "logprob": -0.1}, {"start": 6, "end": 9, "logprob": -0.4}], 1)
    score = pieces.byte_score(text, spans, 0, 3)
    assert score["coverage"] == 1 and score["score"] == pytest.approx(math.exp(-0.25))
    text, spans = pieces.ledger(spans, text, "你", "们好", [{"start": 0, "end": 3, "logprob": -0.2}, {"start": 3, "end": 6, "logprob": None}], 2)
    assert text == "你们好" and [s["logprob"] for s in spans] == [None, -0.2, None]
    score = pieces.byte_score(text, spans, 0, 3)
    assert score["score"] is None and score["coverage"] == pytest.approx(1 / 3) and score["covered_score"] == pytest.approx(math.exp(-0.2))
    assert pieces.ledger(spans, text, "别", "x", [{"start": 0, "end": 2, "logprob": -1.0}], 3) == ("别x", [])
    assert pieces.byte_score("。", [], 0, 1) == {"score": None, "covered_score": None, "coverage": None, "tokens": 0}


def test_names_kept():
    kept = policy.names_kept
    assert kept("我用 Java 写", "我用 Java 写。") and not kept("用 Java 写", "用 java 写") and not kept("用它写", "用 Java 写")
    assert kept("我用 Java，不对，Python 写", "我用 Python 写") and not kept("我用 Java，Python 写", "我用 Python 写")
    assert kept("他叫林，拼音是 Lin", "他叫林") and kept("打开 Word，嗯，打开 Word 文件", "打开 Word 文件")
    assert kept("用 C++。用 C++。", "用 C++。") and not kept("A B 走", "A 走") and kept("", "")


def test_audits(spark):
    row = lambda target, cleaned, issues=(), ok=True: ((ok, True, True, list(issues), cleaned), target)
    cases = [(row("好。", "好。"), "typed_audit_passed"), (row("好，", "好"), "typed_audit_passed_terminal_punctuation_equivalent"), (row("好，", "好。"), "typed_audit_passed_terminal_punctuation_equivalent"), (row("好。。", "好。"), "audit_target_not_clean_or_not_exact"), (row("好。", "坏。"), "audit_target_not_clean_or_not_exact"), (row("好", "好", ["x"]), "audit_reports_issues"), (row("好", "好", ok=False), "audit_failed:source_valid"), (row("好", "好", ok=None), "audit_missing_boolean:source_valid"), ((None, "好"), "audit_not_object")]
    schema = "a struct<source_valid:boolean,meaning_preserved:boolean,cleanup_complete:boolean,issues:array<string>,cleaned_target:string>, t string"
    got = _all(spark, [c for c, _ in cases], schema, policy.audit_verdict(F.col("a"), F.col("t")).alias("v"))
    assert [r["v"] for r in got] == [w for _, w in cases]
    second = _all(spark, [(True, True, [], "x"), (False, False, [], "x"), (False, True, ["i"], "x"), (False, True, [], "y"), (False, True, [], "x")], "n boolean, p boolean, i array<string>, o string", policy.second_audit(F.col("n"), F.col("p"), F.col("i"), F.col("o"), F.lit("x")).alias("s"))
    assert [r["s"] for r in second] == ["needs_review", "flagged", "flagged", "target_disagreement", "passed_second_model_audit"]


def test_edit_flags():
    flags = policy.edit_flags
    assert flags("我我去", "我去") == [] and flags("呃我去", "我去") == []
    assert flags("我有三个", "我有四个") == ["number_or_range_change_check", "unexplained_addition_or_replacement_check"]
    assert flags("我不去那里", "我去那里") == ["negation_condition_range_check", "unexplained_unique_content_deletion_check"]
    assert flags("用word写", "用excel写")[0] == "english_or_placeholder_change_check"
    assert flags("北京天汽好", "北京天气好", recognition=True) == []
    gate = policy.grammar_gate
    assert gate("E07", "好", "好") is None and gate("E07", "好", "好的") == "native_correct_sentence_has_edits"
    assert gate("C02", "大约十个左右", "大约十个") is None and gate("C02", "他不去", "他去") == "negation_changed_requires_semantic_review"
    assert gate("C04", "我去北京昨天", "我昨天去北京") is None and gate("C04", "我去", "他去") == "word_order_not_local"
    assert gate("C03", "a", "ab") == "missing_word_requires_semantic_review" and gate("X", "a", "b") == "unsupported_category"


def test_verified_choices():
    c = lambda a, b, observed, canonical, entity, score: {"start": a, "end": b, "observed": observed, "canonical": canonical, "entity_id": entity, "score": score}
    text = "去北经和上害"
    rows = [c(1, 3, "北经", "北京", 1, 0.9), c(1, 3, "北经", "背景", 2, 0.5), c(4, 6, "上害", "上海", 3, 0.8), c(4, 6, "上害", "伤害", 4, 0.7)]
    assert policy.verified_choices(text, rows, 0.6) == ("去北京和上害", [rows[0]])
    assert policy.verified_choices(text, rows, 0.6, 0.1)[0] == "去北京和上海"
    assert policy.verified_choices(text, [c(0, 2, "北经", "x", 1, 1.0)], 0.5) == (text, [])


def _greedy(rows, quotas, heldout, threshold):
    jac = lambda a, b: (lambda x, y: len(x & y) / len(x | y) if x and y else 0.0)(*(simjoin.gram_set(t) if t.strip() else set() for t in (a, b)))
    state, taken, chosen = {}, dict.fromkeys(quotas, 0), []
    several = {s for s in {r[3] for r in rows} if len({r[4] for r in rows if r[3] == s}) > 1}
    for id_, _, category, source, target, grp in sorted(rows, key=lambda r: (r[1], r[0])):
        if source in several:
            state[id_] = "quarantined"
        elif any(h in (source, target) or jac(h, source) >= threshold or jac(h, target) >= threshold for h in heldout):
            state[id_] = "heldout_overlap"
        elif any(source == s or grp == g for s, _, g in chosen):
            state[id_] = "duplicate"
        elif any(jac(x, y) >= threshold for s, t, _ in chosen for x in (source, target) for y in (s, t)):
            state[id_] = "near_duplicate"
        elif taken[category] >= quotas[category]:
            state[id_] = "reserve"
        else:
            state[id_] = "selected"
            taken[category] += 1
            chosen.append((source, target, grp))
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_balanced_selection(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(12))
    base = [word() for _ in range(12)]
    near = lambda t: t[: rnd.randint(9, 11)] + rnd.choice("xyz") if rnd.random() < 0.4 else t
    rows = []
    for i in range(45):
        s = near(rnd.choice(base))
        rows.append((i, f"{rnd.randint(0, 99):02d}", rnd.choice("AB"), s, "to " + s if rnd.random() < 0.9 else "to other", rnd.randint(0, 60)))
    quotas, heldout = {"A": 4, "B": 3}, [base[0], word()]
    frame = spark.createDataFrame(rows, "id long, rank string, category string, source string, target string, grp int").repartition(3)
    got = select.balanced_selection(frame, spark.createDataFrame(list(quotas.items()), "category string, quota int"), spark.createDataFrame([(h,) for h in heldout], "text string"), 0.6)
    assert {r.id: r.state for r in got.collect()} == _greedy(rows, quotas, heldout, 0.6)


def test_copies_are_compared_once(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(6)]
    texts = [rnd.choice([b, f" {b} ", b[:-1] + "z", b[:20] + "yyyyyyyyyy"]) for b in base for _ in range(12)] + ["", " ", None, "a", "a"]
    rnd.shuffle(texts)
    jac = lambda a, b: (lambda x, y: len(x & y) / len(x | y) if x and y else 0.0)(*(simjoin.gram_set(t) if t and t.strip() else set() for t in (a, b)))
    for t in (0.75, 1.0):
        kept, want = [], {}
        for i, x in enumerate(texts):
            want[i] = not any(jac(x, y) >= t for y in kept)
            kept += [x] if want[i] else []
        frame = spark.createDataFrame([(i, "p", x) for i, x in enumerate(texts)], "id long, part string, text string")
        assert {r.id: r.kept for r in simjoin.near_dedup(frame, t).collect()} == want
    items = spark.createDataFrame([(1, base[0]), (2, "other words"), (3, None)], "id long, text string")
    seen = spark.createDataFrame([(base[0][:-1] + "q",), (None,)], "text string")
    assert {r.id: r.duplicate for r in simjoin.is_duplicate(items, seen).collect()} == {1: True, 2: False, 3: False}


def test_guards():
    basis = select.same_basis(None, {"a": 1, "b": 2})
    assert select.same_basis(basis, {"b": 2, "a": 1}) == basis
    with pytest.raises(ValueError):
        select.same_basis(basis, {"a": 2, "b": 2})


def test_session_windows(spark):
    chunks = [("s", i, t) for i, t in enumerate(["一" * 30, "二" * 30, "三" * 30, "四" * 100, "五"])]
    got = windows.active_windows(spark.createDataFrame(chunks, "session_id string, chunk int, text string")).orderBy("chunk").collect()
    assert [(r.start, r.n) for r in got] == [(0, 1), (0, 2), (1, 2), (3, 1), (4, 1)]
    texts = ["一。二。三。四", "一。二。三。四。", "一。二。三。四。五。六。七", "零。二。三。四。五。六。"]
    updates = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, revision_no long, text string")
    got = windows.translation_snapshots(updates).orderBy("revision_no").collect()
    assert [(r.windows, r.stable_windows, r.calls, r.hits) for r in got] == [(2, 1, 2, 0), (2, 1, 1, 1), (3, 2, 2, 1), (2, 2, 1, 1)]
    long = spark.createDataFrame([("s", 0, "x" * 25)], "session_id string, revision_no long, text string")
    assert windows.translation_snapshots(long, limit=10).first().stable_windows == 2
    spans = [("今天。", "今天！", True), ("明天。", "明天！", False)]
    shown = _all(spark, [("今天。明天。后天", spans), ("今天。后天", spans), ("昨天", spans), (" ", [])], "t string, s array<struct<source:string,clean:string,committed:boolean>>", windows.displayed(F.col("t"), F.col("s")).alias("d"))
    assert [tuple(r["d"]) for r in shown] == [("今天！", "明天！", "后天", "今天！明天！后天"), ("今天！", "", "后天", "今天！后天"), ("", "", "昨天", "昨天"), ("", "", "", "")]
    rows = [("s", 0, list("abc"), False), ("s", 1, list("abcdef"), False), ("s", 2, list("abcdXfg"), True)]
    got = windows.grouped_reuse(spark.createDataFrame(rows, "session_id string, revision_no long, chunks array<string>, is_final boolean")).orderBy("revision_no", "grp").collect()
    joined = lambda x: " ".join(x)
    assert [(r.revision_no, r.text, r.reason) for r in got] == [(0, joined("abc"), "no_match"), (1, joined("abc"), "context_changed"), (1, joined("def"), "no_match"), (2, joined("abc"), "context_changed"), (2, joined("dXf"), "no_match"), (2, "g", "no_match")]
    merged = windows.merged_corrections(spark.createDataFrame([("s", i, t) for i, t in enumerate(["买苹果，", "不对，", "买梨。", "走吧。", "不是这样。"])], "session_id string, chunk int, text string")).orderBy("first").collect()
    assert [(r.first, r.n, r.text) for r in merged] == [(0, 3, "买苹果，不对，买梨。"), (3, 2, "走吧。不是这样。")]


def test_record_sources(spark, tmp_path):
    for kind, scene, n in (("asr_sim", "a", 1), ("clean", "a", 2), ("clean", "b", 3), ("clean", "c", 4)):
        spark.createDataFrame([(f"{scene}{i}", "x") for i in range(n)], "id string, input string").coalesce(1).write.json(f"{tmp_path}/{kind}/{scene}.jsonl")
    got = records.scene_records(spark, str(tmp_path), ["a", "b", "none"]).groupBy("scene", "kind").count().collect()
    assert {(r.scene, r.kind, r["count"]) for r in got} == {("a", "asr_sim", 1), ("b", "clean", 3)}
    schema = "source_record_id string, audio string, scene string, oral string, clean string, qa array<struct<id:string,category:string,question:string,evidence:string,options:string>>"
    good = ("q1", "content", "why", "e", "好（2）；差（0）")
    rows = [("r1", "a", "s", "o", "c", [good]), ("r2", "", "s", "o", "c", [good, good]), ("r3", "a", "s", "o", "c", [("q", "odd", "w", "e", "好（2）")]), ("r4", "a", "s", "o", "c", []), ("r5", "a", "s", "o", "c", [("q", "content", "w", "e", "好2")])]
    faults = {r.source_record_id: r.fault for r in records.rubric_faults(spark.createDataFrame(rows, schema)).collect()}
    assert faults == {"r2": "missing audio;duplicate question id;", "r3": "invalid category", "r4": "missing qa;", "r5": "invalid options"}
    pairs = records.reference_pairs(spark.createDataFrame([(1, "abc", [("ab", [2]), ("abcd", [9])]), (2, "x", [])], "id int, sentence string, references array<struct<text:string,operations:array<int>>>")).orderBy("id", "reference_no").collect()
    assert [(r.id, r.reference, r.valid) for r in pairs] == [(1, "ab", True), (1, "abcd", False), (2, "x", True)]
    spark.createDataFrame([("spk-1_003", b"x", "t")], "id string, audio binary, text string").write.parquet(str(tmp_path / "audio"))
    assert records.audio_rows(spark, str(tmp_path / "audio")).first().source_group == "spk-1"


def test_candidates_are_compared_with_the_selected_only(spark, monkeypatch):
    """Whatever the number of candidates, pairs are sought within windows; a later round's source makes a duplicate of what an
    earlier round found similar."""
    rnd = random.Random(4)
    word = lambda k: "".join(rnd.choice("abcdefghij") for _ in range(k))
    first, second = word(40), word(40)
    rows = [(0, "00", "A", first, "t0", 0), (1, "01", "B", word(40), "t1", 1), (2, "02", "A", second, "t2", 2), (3, "03", "A", second, "t2", 3), (4, "04", "B", first + "x", "t4", 2)]
    rows += [(i, f"{i:02d}", "B", "same source", "same target", 7) for i in range(10, 60)]
    quotas, sizes, pairs = {"A": 2, "B": 1}, [], select.similar_pairs
    monkeypatch.setattr(select, "similar_pairs", lambda items, *a: sizes.append(items.count()) or pairs(items, *a))
    frame = spark.createDataFrame(rows, "id long, rank string, category string, source string, target string, grp int").repartition(3)
    got = select.balanced_selection(frame, spark.createDataFrame(list(quotas.items()), "category string, quota int"), spark.createDataFrame([(word(40),)], "text string"), 0.6)
    assert {r.id: r.state for r in got.collect()} == _greedy(rows, quotas, [], 0.6)
    assert max(sizes) <= 2 * sum(quotas.values())
