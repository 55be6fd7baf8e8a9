"""Operators against plain Python and literal cases."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import edits, gates, numbers, spans
from textloom.functions import text as T
from textloom.operators import curate, evaluate, joins, simjoin
from textloom.sources import files
from textloom.streaming import sessions


def _strings(seed=31824, n=120):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 49))) for _ in range(n)]
    return out + ["", " ", "a", out[0], out[0] + "h", out[1][1:], out[2][:-1]]


def _jaccard(a, b):
    x, y = (simjoin.gram_set(t) if t.strip() else set() for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("threshold", [0.75, 1.0, 0.5, 0.0, 1.5])
def test_similar_pairs_and_first_wins(spark, threshold):
    texts = _strings()
    items = spark.createDataFrame([(i, "full" if i % 5 else "part", t) for i, t in enumerate(texts)], "id long, part string, text string")
    same = lambda i, j: (i % 5 == 0) == (j % 5 == 0)
    linked = lambda v: v >= threshold - 1e-12 if threshold > 0 else v > 0
    want = {(i, j) for j in range(len(texts)) for i in range(j) if same(i, j) and threshold <= 1 and linked(_jaccard(texts[i], texts[j]))}
    pairs = simjoin.similar_pairs(items, threshold)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    kept = []
    for j in range(len(texts)):
        if not any((i, j) in want for i in kept):
            kept.append(j)
    assert sorted(r.id for r in simjoin.first_wins(items.select("id"), pairs).where("kept").collect()) == kept


def test_similar_pairs_of_several_blocks(spark):
    rnd = np.random.default_rng(5)
    base = ["".join(rnd.choice(list("abcd"), 60)) for _ in range(40)]
    texts = []
    for i in range(3 * simjoin.BLOCK // 2):  # all texts share most grams; edits of one base are similar
        t = list(base[i % 40])
        for at in rnd.integers(0, 60, rnd.integers(0, 12)):
            t[at] = rnd.choice(list("abcdé"))
        texts.append("".join(t))
    names = sorted(set().union(*map(simjoin.gram_set, texts)))
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(texts), len(names)), np.float32)
    for i, t in enumerate(texts):
        x[i, [at[g] for g in simjoin.gram_set(t)]] = 1
    both = x @ x.T
    size = x.sum(1)
    linked = np.triu(both >= 0.75 * (size[:, None] + size - both) - 1e-6, 1)
    items = spark.createDataFrame([(i, "full", t) for i, t in enumerate(texts)], "id long, part string, text string")
    got = np.array([(r.a, r.b) for r in simjoin.similar_pairs(items).collect()])
    assert len(got) == linked.sum() and linked[got[:, 0], got[:, 1]].all()
    # what is compared goes by blocks: nothing is joined on grams
    assert simjoin._block_pairs(items, 0.75, 3).count() <= 10


def test_fragments_do_not_meet_full_rows(spark):
    items = spark.createDataFrame([(0, "full", "abcdefgh"), (1, "part", "abcdefgh")], "id long, part string, text string")
    assert simjoin.near_dedup(items).where("kept").count() == 2


def test_lsh_pairs_are_confirmed(spark):
    texts = [t for t in _strings() if len(t) > 5]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.a, r.b) for r in simjoin.lsh_pairs(items).collect()}
    assert all(_jaccard(texts[a], texts[b]) >= 0.85 for a, b in got)
    assert all((i, j) in got for j in range(len(texts)) for i in range(j) if texts[i] == texts[j])


def test_linked_items_count_copies(spark):
    texts = [t for t in _strings() if t.strip()] + ["", "  ", None] + ["abcdefghabcdefghabcd"] * 30 + [" abcdefghabcdefghabcd ", "abcdefghabcdefghabcdx"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    linked = {i: {j for j in range(len(texts)) if j != i and texts[i] and texts[j] and _jaccard(texts[i], texts[j]) >= 0.75} for i in range(len(texts))}
    component = {}
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := linked[todo.pop()] - seen)
            seen |= new
        component[i] = min(seen)
    out = simjoin.linked_items(items, lambda x: simjoin.similar_pairs(x.withColumn("part", F.lit("full")))).collect()
    assert {(r.id, r.component_id, r.n_links) for r in out} == {(i, component[i], len(linked[i])) for i in range(len(texts))}
    assert all(r.class_id == next(j for j, t in enumerate(texts) if t == texts[r.id] or t and texts[r.id] and t.strip() == texts[r.id].strip()) for r in out if texts[r.id] and texts[r.id].strip())
    lsh = {r.id: r.n_links for r in simjoin.linked_items(items, simjoin.lsh_pairs).collect()}
    assert lsh[len(texts) - 3] >= 30 and lsh[texts.index("")] == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in simjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6} | {i: 100 for i in range(100, 141)}
    assert simjoin.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_largest_remainder():
    assert curate.largest_remainder(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert sum(curate.largest_remainder(97, {"x": 0.45, "y": 0.35, "z": 0.2}).values()) == 97


def test_grouped_split_keeps_groups_whole(spark):
    rows = [("g0", "s1", "short"), ("g0", "s2", "long")] + [(f"g{i}", "s1" if i % 2 else "s2", "short") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "grp string, scene string, bucket string")
    out = curate.grouped_split(df, "grp", ["scene", "bucket"], 0.25)
    assert out.groupBy("grp").agg(F.count_distinct("held").alias("n")).where("n > 1").count() == 0
    assert 3 <= out.where("held").count() <= 7
    assert curate.grouped_split(df, "grp", ["scene"], 0.0).where("held").count() == 0
    assert curate.grouped_split(df, "grp", ["scene"], 1.0).where("held").count() == len(rows)
    for bad in (-0.1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            curate.grouped_split(df, "grp", ["scene"], bad)


def test_ledger_status(spark):
    rows = [(1, "a", "A", "x", "t1", "pass"), (2, "b", "A", "x ", "t1", "pass"), (3, "c", "A", "y", "t1", "pass"), (4, "d", "A", "y", "t2", "pass"), (5, "e", "A", "z", "t", "pass"), (6, "f", "A", "w", "t", "pass"), (7, "g", "B", "q", "t", "fail")]
    df = spark.createDataFrame(rows, "seq long, id string, category string, source string, target string, verdict string")
    quotas = spark.createDataFrame([("A", 2), ("B", 1)], "category string, quota int")
    got = {r.seq: r.status for r in curate.ledger_status(df, quotas).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "conflict", 5: "accepted", 6: "quota_full", 7: "rejected"}


def test_ece_and_temperature(spark):
    rows = spark.createDataFrame([(0.95, 1), (0.90, 0), (0.70, 1), (0.20, 0)], "confidence double, label int")
    assert evaluate.ece(rows).first().ece == pytest.approx((2 * abs(0.925 - 0.5) + 0.3 + 0.2) / 4)
    assert 0.01 <= evaluate.temperature_fit(rows).first().temperature <= 100


def test_unique_keys_are_required(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(ValueError):
        evaluate.unique_or_raise(twice, "id")


@pytest.mark.parametrize(
    ("token", "value"),
    [("二十三", "23"), ("一百二十三", "123"), ("十", "10"), ("三点一四", "3.14"), ("两万五千", "25000"), ("一亿零三", "100000003"), ("二零二四", "2024"), ("", None), ("三点", None), ("苹果", None)],
)
def test_number_values(token, value):
    got = numbers.value_of(token)
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("百分之三十五", "35%"), ("二零二四年三月五日", "2024年3月5日"), ("下午三点二十分", "下午3点20分"), ("一共三万多个", "一共3万多个"), ("二十多个", "20多个"),
        ("三到五公里", "3到5公里"), ("十亿吨", "10亿吨"), ("四点五万条", "4.5万条"), ("五个苹果", "5个苹果"), ("二十三", "23"), ("三倍", "3倍"),
        ("二三十岁", "二三十岁"), ("二三个", "二三个"), ("万一下雨", "万一下雨"), ("十有八九", "十有八九"), ("一张张", "一张张"), ("十几米", "十几米"), ("", ""),
    ],
)
def test_number_normalization(text, want):
    assert numbers.normalize(text) == want
    assert numbers.normalize(want) == want


def test_keep_single_one():
    assert numbers.normalize("一个和三个", keep_single_one=True) == "一个和3个"


def test_edits_rebuild_their_target():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab苹 ") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert edits.apply(a, edits.align(a, b)) == b
    assert edits.distance("苹果梨", "苹果") == 1
    assert edits.distance("kitten".split(), "sitting".split()) == 1
    with pytest.raises(ValueError):
        edits.apply("abc", [{"start": 0, "end": 1, "source": "x", "target": ""}])


def test_token_distance(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), ([], ["x"]), (None, [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(edits.token_distance(F.col("a"), F.col("b"))).collect()] == [2, 1, None]


def test_masks():
    text = "see http://a.b/c on 2024-01-05 at 10:30, mail x.y@z.com or foo-bar and NASA 42"
    masked, table = spans.mask(text)
    assert spans.restore(masked, table) == text
    assert [t["kind"] for t in table] == ["URL", "DATE", "TIME", "EMAIL", "IDENTIFIER", "ACRONYM", "NUMBER"]
    assert spans.restore(masked.replace("__ENTITY_001__", ""), table) is None
    assert spans.canonical_placeholders("__ENTITY_007__ x __ENTITY_002__ __ENTITY_007__") == "__ENTITY_000__ x __ENTITY_001__ __ENTITY_000__"
    assert ["idiots and IDIOT"[a:b] for a, b, *_ in spans.literal_spans("idiots and IDIOT", [("idiot", 1)])] == ["IDIOT"]
    assert spans.Trie(["ab", "abc", "c"]).matches("abcab c") == [(0, 3, "abc"), (3, 5, "ab"), (6, 7, "c")]


def test_conservative_gate(spark):
    cases = [
        ("", 0.99, True, True, [], "keep", "empty_segment"), ("今天很好。", 0.95, True, True, ["x"], "refine", "entity_hint_present"), ("嗯，今天很好。", 0.95, True, True, [], "refine", "cleanup_signal_present"),
        ("今天很好。", None, True, True, [], "refine", "confidence_unavailable"), ("今天很好。", 0.95, False, True, [], "refine", "confidence_uncalibrated"), ("今天很好。", 0.95, True, False, [], "refine", "confidence_coverage_incomplete"),
        ("今天很好。", 0.90, True, True, [], "refine", "confidence_below_skip_threshold"), ("今天很好", 0.95, True, True, [], "refine", "sentence_incomplete"), ("今天很好。", 0.95, True, True, [], "keep", "high_confidence_clean_segment"),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "t string, p double, c boolean, v boolean, h array<string>")
    got = df.select(gates.conservative_gate(*map(F.col, "tpcvh")).alias("g")).select("g.*").collect()
    assert [tuple(r) for r in got] == [c[5:] for c in cases]


def test_text_keys():
    assert T.key_of("Ｈello， 世界！ ", "metric") == "hello 世界"
    assert T.key_of("A b。C", "leakage") == "abc"
    assert T.key_of(" A  b。", "ledger") == "A b。"
    assert T.key_of(None, "metric") is None
    assert T.key_of("說", "metric", {"說": "说"}) == "说"


def test_stability_and_memory():
    s = sessions.Stability()
    assert not s.observe("今天", 0)["stable"]
    assert s.observe("今天天气很好", 100)["revision"] > 0.2
    assert s.observe("今天天气很好呀", 200)["stable"]
    s.observe("今天天气很好呀", 300)
    assert s.observe("今天天气很好呀", 400)["unchanged"] == 2
    m = sessions.Memory()
    m.observe("A", 0, 0.9, "o1")
    assert m.observe("A", 1, 0.9, "o2")["trust"] == "accepted"
    m.observe("B", 2, 0.9, "o3")
    m.observe("V", 2, verified=True)
    m.observe("C", 2 + m.TTL_MS + 1, 0.1, "o4")
    assert set(m.entries) == {"V", "C"} and m.trusted() == ["V"]
    m.CAPACITY = 2
    m.observe("D", 3 + m.TTL_MS + 1)
    assert set(m.entries) == {"V", "D"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s1", i, i * 2, t) for i, t in enumerate(["今天", "今天天气", "今天天气好", "今天天气好", "今天天气好。", "今天天气好。"])] + [("s2", i, i, "x" * (i + 1)) for i in range(4)]
    df = spark.createDataFrame(rows, "session_id string, revision_no long, s long, text string").select("session_id", "revision_no", F.timestamp_seconds("s").alias("ts"), "text")
    source = str(tmp_path / "in")
    for part in (0, 1, 2):  # three files, so three micro-batches
        df.where(F.floor(F.col("revision_no") / 2) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = sessions.track_stability(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("tracked").collect()))
    assert {g[:2] for g in got} <= {(r[0], r[1]) for r in rows}
    if len(got) == len(rows):
        assert got == sorted(map(tuple, sessions.stability_of(df).collect()))


def test_sources(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1, "t": "a"}\n\n{"id": 2, "t": "b"}\n{"id": 3, "t"')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, path, "id int, t string").collect()
    assert [(r.line, r.value) for r in files.bad_lines(spark, path).collect()] == [(4, '{"id": 3, "t"')]
    assert [r.bad_lines for r in files.tail_losses(spark, path).collect()] == [1]
    odd = str(tmp_path / "odd.jsonl")
    with open(odd, "w") as f:
        f.write('{"id": 1}\n[2]\n{"id": 3}\n')
    assert [r.line for r in files.bad_lines(spark, odd).collect()] == [2]
    with pytest.raises(Exception, match="malformed line"):
        files.read_jsonl_tail_tolerant(spark, odd, "id int").collect()
    files.write_jsonl(spark.createDataFrame([(1, None)], "id int, t string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"id":1,"t":null}']
    files.write_document(spark.createDataFrame([(2, "b"), (1, None)], "id int, t string"), str(tmp_path / "doc"))
    assert [(r.id, r.t) for r in files.read_document(spark, str(tmp_path / "doc"), "id int, t string").collect()] == [(1, None), (2, "b")]
    assert files.read_jsonl_tail_tolerant(spark, path, "id int, t string").count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "none"), "id int").count() == 0
    marked = spark.createDataFrame([("a[bc]d[e]",), (None,)], "t string").select(files.read_markup(F.col("t")).alias("m")).collect()
    assert marked[0].m.text == "abcde" and [(s.start, s.end, s.text) for s in marked[0].m.spans] == [(1, 3, "bc"), (4, 5, "e")]
    raw = spark.createDataFrame([("好（2）；差（0）",)], "o string").select(files.rubric_options(F.col("o")).alias("o")).first().o
    assert [(x.text, x.score) for x in raw] == [("好", 2), ("差", 0)]


def test_partial_pairs_and_glossary(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(80)] + [None, "x" * 100, "x" * 64, "x" * 63]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and len(a) < len(b) and b.startswith(a)}
    got = [tuple(r) for r in joins.partial_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    surfaces = [f"{'w ' * k}end" for k in range(45)] + ["A-B c", "é", None]
    long = spark.createDataFrame([(1, "w " * 50 + "end"), (2, "a b, C"), (3, None), (4, "")], "id int, text string")
    for few in (256, 0):
        joins.FEW, kept = few, joins.FEW
        found = {(r.id, r.surface): r.n for r in joins.glossary_places(long, spark.createDataFrame([(x,) for x in surfaces], "surface string")).collect()}
        joins.FEW = kept
        assert found == {(1, s): 1 for s in surfaces[:45]} | {(2, "A-B c"): 1}


def test_overlaps(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 10, 12)], "k int, start int, stop int")
    assert joins.overlapping(a, spark.createDataFrame([(1, 4, 11)], "k int, start int, stop int"), "k").count() == 2
