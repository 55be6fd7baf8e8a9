"""Chunks, windows, cleanup, verdicts and sounds: literal cases and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import cleanup, sound, verdicts, windows


def test_chunks_follow_marks():
    c = windows.Chunker()
    assert c.update("今天很好。明天") == [(0, "今天很好。")]
    assert c.update("今天很好。明天也好。后天") == [(1, "明天也好。")]
    assert c.update("今天很好。明天也好。后天", boundary=True) == [(2, "后天")]
    with pytest.raises(ValueError):
        windows.Chunker(committed="今天很好。").update("昨天")
    assert windows.Chunker(by_mark=True).update("苹果、梨，香蕉") == [(0, "苹果、梨，")]
    assert windows.Chunker().update("苹果，不对，梨") == []
    assert [len(t) for _, t in windows.Chunker(10).update("一" * 25, boundary=True)] == [10, 10, 5]


def test_windows_are_lossless():
    rnd = random.Random(8)
    parts = ["Hello", " ", ".", "3.14", "e.g. ", "。", "！", "”", "\n", "word", "?", "a.b", "Dr. "]
    for _ in range(500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        got = windows.source_windows(text, 40, 2)
        assert "".join(got) == text and all(0 < len(w) <= 40 for w in got)
    assert list(windows.sentences("It costs 3.5 e.g. here. Next one! 好。吧")) == ["It costs 3.5 e.g. here. ", "Next one! ", "好。", "吧"]


def test_cleanup_in_python_and_catalyst(spark):
    cases = {"呃，我来了": "我来了", "我来，呃，了": "我来，了", "好的，呃。": "好的。", "调查一下。嗯，那我": "调查一下。那我", "我我我知道": "我知道", "人人都看看": "人人都看看", "呃逆": "呃逆", "看。看书": "看书"}
    assert {t: cleanup.cleaned(t) for t in cases} == cases
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.c for r in df.select("t", cleanup.clean(F.col("t")).alias("c")).collect()} == cases


def test_verdicts():
    v = verdicts.semantic_verdict
    assert v('{"pass": true, "reason": " ok "}') == {"passed": True, "reason": "ok", "valid": True}
    for bad in (None, "[]", '{"pass": 1, "reason": "x"}', '{"pass": true}', '{"pass": true, "pass": true, "reason": "x"}', '{"pass": true, "reason": "x", "n": NaN}', "nope"):
        assert not v(bad)["valid"]
    fenced = '```json\n{"answers": [{"id": "a", "option_index": 1}]}\n```'
    assert verdicts.judge_answers(fenced, {"a": 2}) == {"a": 1}
    for options in ({"a": 1}, {"b": 2}, {"a": 2, "b": 2}):
        with pytest.raises(ValueError):
            verdicts.judge_answers(fenced, options)
    assert verdicts.unsupported_edits("苹果，梨", "苹果梨。") == [] and verdicts.unsupported_edits("苹果", "苹果派") == ["派"]


def test_sounds(spark):
    assert sound.sound_similarity(["zhang", "san"], ["zhang", "san"]) == 1.0
    assert sound.sound_similarity([], ["a"]) == 0.0
    assert sound.sound_similarity(["zhang"], ["zang"]) == pytest.approx(1 - (0.15 + 0.85 / 5))
    spans = spark.createDataFrame([(1, ["zhang", "san"])], "id int, sounds array<string>")
    names = spark.createDataFrame([("A", ["zhang", "shan"]), ("B", ["li", "si"])], "name string, sounds array<string>")
    assert [(r.name, r.place) for r in sound.retrieve(spans, names).collect()] == [("A", 1)]


@pytest.mark.parametrize(
    ("raw", "refined", "want"),
    [
        ("今天天气很好。", "", ["empty_refiner_output"]),
        ("今天天气很好。", "今天天气很好。", []),
        ("一共二十三个苹果。", "一共23个苹果。", []),
        ("一共二十三个苹果。", "一共24个苹果。", ["numeric_value_mismatch"]),
        ("今天我们讨论这个计划。", "今天我们讨论这个计划。" * 3, ["repeated_sentence", "severe_content_loss"]),
        ("今天我们去公园散步然后回家吃饭看电影睡觉。", "好。", ["severe_content_loss"]),
    ],
)
def test_vetoes(raw, refined, want):
    from textloom.functions import guard

    assert guard.reject_reasons(raw, refined) == want


def test_windows_in_catalyst(spark):
    rnd = random.Random(18)
    parts = ["Hello", " ", ".", "3.14", "e.g. ", "。", "！", "”", "\n", "word", "?", "a.b", "Dr. ", "x" * 50, "\x1e"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", windows.windows_of(F.col("t"), 40, 2).alias("w"), windows.sentences_of(F.col("t")).alias("s"))
    for r in df.collect():
        assert (r.w, r.s) == ((None, None) if r.t is None else (windows.source_windows(r.t, 40, 2), windows.sentences(r.t)))
