"""Numbers kept, names that were meant, and the text classifier."""

import random

from pyspark.sql import functions as F

from textloom.functions import guard, quantities
from textloom.operators import classify, entities


def test_mentions():
    got = quantities.mentions("买了三个苹果和12.50元的梨，二十三公斤，百分之五")
    assert [(m.value, m.unit) for m in got] == [("3", "个"), ("12.50", "元"), ("23", "公斤"), ("5", "%")]
    assert [m.surface for m in got] == ["三个", "12.50元", "二十三公斤", "百分之五"]
    assert quantities.mentions("一心一意") == [] and quantities.mentions("") == []


def test_numbers_kept(spark):
    cases = [("买三个", "买3个", True), ("买三个", "买4个", False), ("三个，三个苹果", "三个苹果", True), ("三个和四个", "四个和三个", False), ("没有数", "没有", True), ("12.50元", "12.5元", True)]
    assert [quantities.preserved(a, b) for a, b, _ in cases] == [w for *_, w in cases]
    got = spark.createDataFrame(cases, "a string, b string, w boolean").select("w", quantities.numbers_preserved(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.w == r.g for r in got)
    assert quantities.range_cut("三到五个人来了", "五个人来了") and not quantities.range_cut("三到五个人来了", "三到五个人来")
    assert quantities.restored("一共二十三个苹果", "共23个苹果") == "共二十三个苹果" and quantities.restored("三个", "四个") == "四个"
    assert quantities.salvaged("我我买了二十三个好苹果", "我买了23个坏苹果", guard.reject_reasons) == "我买了23个好苹果"
    assert list(quantities.repeated_clauses("一共二十三个，一共23个，走吧，走吧")) == [(0, 6, 7, 12)]


def test_fuzzy_matches(spark):
    texts = spark.createDataFrame([(1, "请找张三峰老师"), (2, "完全无关"), (3, "张三丰来了"), (4, None)], "id int, text string")
    names = spark.createDataFrame([(1, "张三丰", "person", "general", 20), (2, "李四光", "person", "general", 0), (3, "张三李", "place", "other", 0)], "entity_id int, name string, entity_type string, domain string, priority int")
    sounds = spark.createDataFrame([("张三峰", ["zhang", "san", "feng"]), ("张三丰", ["zhang", "san", "feng"]), ("张三李", ["zhang", "san", "li"])], "text string, sounds array<string>")
    got = {(r.id, r.entity_id): r for r in entities.fuzzy_matches(texts, names, "general", sounds).collect()}
    best = got[1, 1]
    assert (best.start, best.length, best.observed, best.action) == (2, 3, "张三峰", "auto")
    assert abs(best.score - (0.55 + 0.25 * 2 / 3 + 0.10 + 0.08 + 0.02)) < 1e-9 and best.margin >= 0.12
    assert (2, 1) not in got and got[1, 3].action == "none"
    assert all(r.action != "auto" for r in entities.fuzzy_matches(texts, names, "general", sounds, allowed=["place"]).collect())
    put = entities.verified_text(texts, entities.fuzzy_matches(texts, names, "general", sounds), 0.8, 0.1)
    assert {r.id: r.text for r in put.collect()}[1] == "请找张三丰老师"
    spans = spark.createDataFrame([(1, "张三峰", ["zhang", "san", "feng"])], "id int, text string, sounds array<string>")
    known = spark.createDataFrame([("张三丰", ["zhang", "san", "feng"]), ("张三李", ["zhang", "san", "li"]), ("王五", ["wang", "wu"])], "name string, sounds array<string>")
    found = entities.phonetic_retrieval(spans, known).orderBy("place").collect()
    assert [r.name for r in found] == ["张三丰", "张三李"] and abs(found[0].score - (0.8 + 0.1 * 2 / 3 + 0.1)) < 1e-9
    edges = spark.createDataFrame([("Javascript", 0, 4), ("用Java写", 1, 4), ("x12", 1, 2), ("Java", 0, 4)], "t string, s int, n int").select(entities.at_word_edges(F.col("t"), F.col("s"), F.col("n")).alias("e"))
    assert [r.e for r in edges.collect()] == [False, True, False, True]


def test_texts_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id", "concat('a cold wigdet ', id) AS text").write.parquet(str(tmp_path / "texts"))
    names = spark.createDataFrame([(1, "cold widget")], "entity_id int, name string")
    plan = entities.places(spark.read.parquet(str(tmp_path / "texts")), names)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :|+-")) <= depth), len(lines))
            assert not any("FileScan" in x for x in lines[i:below])
    assert "BroadcastExchange" in plan and "SortMergeJoin" in plan


def test_classifier(spark):
    rnd = random.Random(4)
    words = ["river stone cloud window".split(), "invoice payment refund order".split()]
    rows = [(i, " ".join(rnd.choices(words[i % 10 == 0], k=6)), int(i % 10 == 0)) for i in range(300)]
    train = spark.createDataFrame(rows[:200], "id long, text string, label int")
    test = spark.createDataFrame(rows[200:] + [(900, None, 0), (901, "", 0)], "id long, text string, label int")
    got = {r.id: r.label for r in classify.classify(classify.fit_classifier(train), test).collect()}
    assert all(got[i] == y for i, _, y in rows[200:]) and {900, 901} <= got.keys()
