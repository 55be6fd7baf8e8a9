"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, copies and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bilstm, bloom, decontaminate, egojoin, graph, licenses, lines, minhash, mixing, passages, pii, tokens, toxicity, wavelet
from textloom.llm import wordhash as wh

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, k1 string, component_id string, score string"


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdéñ") for _ in range(rnd.randint(1, 6)))
    base = [" ".join(word() for _ in range(rnd.randint(30, 120))) for _ in range(12)]
    out = [None, "", "   ", "one", "two words", base[0], base[0], base[0] + " tail", "x " * 400, "same line\n" * 5]
    for b in base:
        w = b.split()
        for edits in (1, 2, 5, 12):
            v = list(w)
            for _ in range(edits):
                v[rnd.randrange(len(v))] = word()
            out.append(" ".join(v))
        out.append(b[: len(b) // 2] + "\n" + rnd.choice(base))
    out.append(" ".join(word() for _ in range(6000)))  # a very long text
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{0 if i % 3 else i % 5}", len(t or ""), 1, "k", "c", "s") for i, t in enumerate(_texts())]
    rows += [rows[20], rows[20], (None, "no id here at all", None, None, 3, None, None, None, None), (None, rows[5][1], "en", "src1", 3, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- hashes and graphs


def test_words_and_kgrams_do_not_cross_documents():
    texts = ["a b  c", "", " \t", "é B", "d"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = wh.Words(np.frombuffer(data, np.uint8), offsets, wh.BLANKS, lower=True)
    assert [data[a:b].decode() for a, b in zip(w.starts, w.ends)] == ["a", "b", "c", "é", "B", "d"]
    assert w.counts().tolist() == [3, 0, 0, 2, 1]
    assert w.hashes[4] == w.hashes[1] and wh.hash_text("B", wh.BLANKS, lower=False)[0] != w.hashes[1]
    assert wh.inside_documents(w, 2).tolist() == [True, True, False, True, False]
    for k in (1, 2, 3, 5):
        long = wh.kgrams(w.hashes, k)
        assert len(long) == 6 - k + 1 and len(set(long.tolist())) == len({tuple(w.hashes[i : i + k]) for i in range(6 - k + 1)})


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + i, 5001 + i) for i in range(60)]
    f = graph.Forest()
    for a, b in edges:
        f.union(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: f.find(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 toxicity


def test_kernel_is_the_gap_weighted_count():
    def brute(s, z):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(s)), 3):
            for j in combinations(range(len(z)), 3):
                if all(s[a] == z[b] for a, b in zip(i, j)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    for s, z in [("^idiot", "^idiot"), ("^idxiot", "^idiot"), ("^toidi", "^idiot"), ("abcabc", "abc"), ("ab", "abc")]:
        want = brute(s, z) / (brute(s, s) * brute(z, z)) ** 0.5 if brute(s, s) else 0.0
        assert toxicity.kernel([s], [z])[0, 0] == pytest.approx(want)
    words = ["^idiot", "^idxiot", "^moron", "^stone", "^idiotic", "^xyzzy"]
    square = toxicity.kernel(words, words)
    assert np.allclose(square, square.T) and np.allclose(np.diag(square), 1) and np.linalg.eigvalsh(square).min() > -1e-9


def test_toxicity_of_odd_texts(spark):
    """Long, empty and repeated texts, and extra columns, by the same machine."""
    rnd = random.Random(6)
    plain = "stone river cloud window garden letter paper table music forest winter summer".split()
    text = lambda bad: " ".join(rnd.choice(plain) for _ in range(20)) + (" you grobnik" if bad else "")
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    odd = [(900, "grobnik " * 100_000), (901, "stone " * 100_000), (902, ""), (903, None), (904, rows[4][1]), (904, rows[4][1]), (905, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string").withColumn("predicted", F.lit("p")).withColumn("toxic", F.lit(5))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.predicted for r in got}
    assert [by[i] for i in (900, 901, 902, 903, 904, 905)] == [1, 0, 0, 0, 1, 0]
    assert len({r.score for r in got if r.doc_id == 904}) == 1
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.toxic for r in kept.collect()} == {5}


def test_toxicity_learns_gapped_insults(spark, none):
    rnd = random.Random(1)
    plain = "stone river cloud window garden letter paper table music forest winter summer".split()
    text = lambda bad: " ".join(rnd.choice(plain) for _ in range(20)) + ". " + (f"you {rnd.choice(['grobnik', 'vlatzer'])} {rnd.choice(['grobnik', 'vlatzer'])} " if bad else "") + rnd.choice(plain)
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    extra = [(1000, "a g.r.o.b.n.i.k and v l a t z e r", 1), (1001, "grobxnik vlatxzer", 1), (1002, None, 1), (1003, "", 1), (None, "stone river", 1), (1004, "river stone", 1)]
    both = docs.union(spark.createDataFrame(extra, docs.schema))
    got = {r.doc_id: r for r in toxicity.toxicity(both, labels).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert got[1000].predicted == 1 and got[1001].predicted == 1
    assert all(0 <= got[i].score < 0.5 for i in (None, 1002, 1003, 1004))
    assert toxicity.reject_toxic(both, labels).columns == both.columns
    assert toxicity.reject_toxic(both, labels).count() == 300 + 4
    no = toxicity.toxicity(none, labels.limit(0))
    assert no.count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_toxicity_reads_long_tokens_to_their_end():
    rnd = random.Random(2)
    plain = "stone river cloud window garden letter paper table music forest winter summer".split()
    words = lambda n, join: join.join(rnd.choice(plain) for _ in range(n))
    text = lambda bad: words(20, " ") + ". " + (f"you {rnd.choice(['grobnik', 'vlatzer'])} " if bad else "") + words(3, " ")
    labels = [int(i % 4 == 0) for i in range(400)]
    model = toxicity.fit([text(y) for y in labels], labels)
    scorer = toxicity.Scorer(model.landmarks)
    scores = lambda texts: [float(model.score(model.evidence(rows, n))) for rows, _, n in scorer.read(texts)]
    joins = [",", "_", "-", "/", ""]
    long = [words(15, j) + j + "grobnik" + j + words(15, j) for j in joins] + [" ".join(words(12, "") + "vlatzer" + words(3, ""))]
    assert min(scores(long)) >= 0.5
    assert max(scores([words(31, j) for j in joins] + [" ".join(words(16, ""))])) < 0.5


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(i, f"word{i % 7} other text grobnik{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda i, flip: int((i % 3 == 0) != (flip and zlib.crc32(str(i).encode()) % 5 == 0))
    fits = [toxicity.train(docs, spark.createDataFrame([(i, label(i, flip)) for i, _ in rows], "doc_id long, toxic int")) for flip in (False, True)]
    assert fits[0].landmarks == fits[1].landmarks and np.array_equal(fits[0].weights, fits[1].weights)


def test_training_stays_out_of_the_driver(spark, monkeypatch):
    """Neither the sample nor what learning takes is held by the driver: one task learns."""
    rows = [(i, f"word{i % 7} other text grobnik{i % 3}" if i % 3 == 0 else f"word{i % 7} other text") for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", None)  # tasks import the package anew
    model = toxicity.train(docs, labels)
    assert model.landmarks and len(model.weights) == len(model.landmarks)


# -- 2 embeddings


@pytest.mark.parametrize("block", [4096, 16])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 12))
    vecs = [list(map(float, b + s * rng.normal(size=12))) for b in base for s in (0, 0, 0.1, 0.15, 0.2, 0.3, 0.3)] + [[0.0] * 12, [float("nan")] + [1.0] * 11, None, [], [1.0, None] + [0.0] * 10, [1.0, 0.0], [2.0, 0.0], [float("inf")] * 12]
    ids = [100 + (i * 37) % 101 for i in range(len(vecs))]
    df = spark.createDataFrame([(i, v, 0, 5) for i, v in zip(ids, vecs)] + [(None, vecs[0], 0, 5)], "vec_id long, embedding array<double>, label int, n_links int").repartition(4)
    got = {r.vec_id: r for r in egojoin.embedding_links(df, block=block).collect()}
    good = lambda v: bool(v) and None not in v and np.isfinite(v).all() and np.any(v)
    f, want = graph.Forest(), dict.fromkeys(ids, 0)
    for a in range(len(ids)):
        for b in range(a):
            if good(vecs[a]) and good(vecs[b]) and len(vecs[a]) == len(vecs[b]):
                x, y = np.array(vecs[a]), np.array(vecs[b])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    f.union(ids[a], ids[b])
                    want[ids[a]] += 1
                    want[ids[b]] += 1
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in ids} == {i: (want[i], f.find(i), f.find(i) == i) for i in ids}
    assert got[None].n_links == 0 and got[None].kept is False
    assert egojoin.embedding_links(df.limit(0)).count() == 0


def _linked(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in egojoin.embedding_links(df, **how).collect())


@pytest.mark.parametrize("block", [32_768, 9])
def test_embedding_links_at_the_threshold(spark, block):
    """Small integer vectors, of which many pairs have a cosine of exactly 0.9, and repeated ids and rows."""
    rng = np.random.default_rng(1)
    vecs = [(1, 0, 0, 0), (9, 3, 3, 1), (3, 9, 1, 3), (0, 2, 0, 0), (10, 0, 0, 0), (9, 1, 3, 3), (81, 27, 27, 9), (1, 3, 3, 9), (0, 0, 0, 5)] + [tuple(map(int, v)) for v in rng.integers(-9, 10, (60, 4)) if v.any()]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(4, [0.0, 0.0, 1.0, 0.0]), (4, [10.0, 0.0, 0.0, 0.0]), (2, [3.0, 9.0, 1.0, 3.0])]
    f, want, exact = graph.Forest(), [0] * len(rows), 0
    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows[:a]):
            dot, size = int(np.dot(x, y)), int(np.dot(x, x)) * int(np.dot(y, y))
            exact += dot > 0 and 100 * dot * dot == 81 * size
            if dot > 0 and 100 * dot * dot >= 81 * size:
                want[a] += 1
                want[b] += 1
                f.union(i, j)
    assert exact >= 10
    assert _linked(spark, rows, block=block) == sorted((i, n, f.find(i), f.find(i) == i) for (i, _), n in zip(rows, want, strict=True))


def test_embedding_links_in_many_intervals(spark):
    """Clusters and a common vector, in blocks of 50: the tree of intervals has several levels."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    vecs = np.concatenate([c + 0.12 * rng.normal(size=(20, 24)) for c in centres] + [np.repeat(centres[:1], 150, 0), rng.normal(size=(250, 24))])
    ids = rng.permutation(5 * len(vecs))[: len(vecs)].tolist()
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    f = graph.Forest()
    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
        f.union(ids[a], ids[b])
    want = sorted((i, int(n) - 1, f.find(i), f.find(i) == i) for i, n in zip(ids, near.sum(1), strict=True))
    assert _linked(spark, [(i, v.tolist()) for i, v in zip(ids, vecs, strict=True)], block=50) == want
    boxes = [egojoin._leading(unit[a : a + 50], {}) for a in range(0, len(unit), 50)]
    frame = spark.createDataFrame([(24, k << 24, x.min(0).tolist(), x.max(0).tolist()) for k, x in enumerate(boxes)], "dim int, block long, lo array<double>, hi array<double>")
    got = {(r.a >> 24, r.b >> 24) for r in egojoin.interval_pairs(frame, float(np.sqrt(0.2))).collect()}
    gap = lambda x, y: np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
    assert got == {(i, j) for i, x in enumerate(boxes) for j, y in enumerate(boxes) if i <= j and (gap(x, y) ** 2).sum() <= 0.2 + 1e-6}


# -- 3 licences


def test_license_scan(docs, rows, none, spark):
    more = [(5000, "Under the MIT License, CC-BY and cc  by; GNU General Public License gnu general public license"), (5001, "Apache.License"), (5002, "This work is licensed under the GNU General Public License, version 3"), (5003, "gnu lesser general public license")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in licenses.license_scan(both).collect()}
    for r in both.collect():
        w, places, labels = pattern.findall(_lower(r.text or "")), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        if r.doc_id is not None:
            g = got[r.doc_id]
            assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
            assert labels <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert "gpl-3.0" in got[5002].labels and got[5003].base_labels == "" and got[5003].labels == "lgpl"
    assert licenses.license_scan(none).count() == 0


# -- 4 mixing


def test_mixing(docs, none, spark):
    out = mixing.mix_sources(docs)
    again = mixing.mix_sources(docs.repartition(5))
    key = lambda df: sorted((r.doc_id or -1, r.mix_copy, r.mix_order) for r in df.collect())
    assert key(out) == key(again)
    assert out.columns == [*docs.columns, "mix_copy", "mix_order"]
    assert mixing.mix_sources(none).count() == 0
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.lit(1).alias("mix_copy"))
    counts = {r.source: r["count"] for r in mixing.mix_sources(big, {"hot": 0.2, "s1": 0.8}, size=2.0).groupBy("source").count().collect()}
    assert set(counts) == {"hot", "s1"}
    # extra columns may have any name that the operator might use itself
    odd = big.where("doc_id < 300").withColumns({c: F.col("doc_id") + i for i, c in enumerate(["pieces", "cdf", "mix_n", "mix_source", "of", "key", "times", "copy", "order", "n", "w", "rate", "row", "mean"])})
    out = mixing.mix_sources(odd, size=3.0).collect()
    assert {c: {r[c] - r.doc_id for r in out} for c in ("pieces", "cdf", "mix_n", "mix_source", "key", "copy", "order", "mean")} == {c: {i} for i, c in [(0, "pieces"), (1, "cdf"), (2, "mix_n"), (3, "mix_source"), (5, "key"), (7, "copy"), (8, "order"), (13, "mean")]}
    assert len(out) == sum(r.mix_copy == 1 for r in out) + sum(r.mix_copy > 1 for r in out) > 600
    assert abs(counts["hot"] / 40000 - 0.2) < 0.01 and abs(counts["s1"] / 40000 - 0.8) < 0.02


# -- 5 decontamination


def test_common_subsequence():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


@pytest.mark.parametrize("block", [1000, 3])
def test_contamination(spark, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEMS", block)
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    filler = lambda n: " ".join(rnd.choice(["the", "of", "and", *rnd.sample(vocabulary, 8)]) for _ in range(n))
    items = [(i, filler(25)) for i in range(9)] + [(None, filler(20)), (50, None), (51, "")]
    rows, want = [], {}
    for d in range(80):
        text = filler(rnd.choice([10, 60, 300]))
        if d % 4 == 0:
            item = items[d // 4 % 9]
            w = item[1].split()
            if d % 8 == 0:  # a near copy: a few words fall out, others come in
                w = [x for x in w if rnd.random() > 0.1]
                w.insert(5, "inserted")
            text = f"{text} {' '.join(w).upper() if d % 16 == 4 else ' '.join(w)} {filler(40)}"
            want[d] = [item[0]]
        rows.append((d, text, "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, items[9][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {*want, 902}
    assert all(got[d]["items"] == want[d] for d in want) and got[902]["items"] == []
    clean = decontaminate.reject_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len(want) - 1
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


def test_contamination_of_long_items_and_large_tables():
    """Copies are found whatever their length and the weight of their words."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bcdfghklmn") for _ in range(7))
    around = lambda n: [word() for _ in range(n)]
    one, two = around(10), around(3000)
    items = decontaminate.Items([(0, " ".join(one)), (1, " ".join(two))])
    texts = [" ".join(around(27) + one + around(59)), " ".join(around(40) + two + around(40)), " ".join(around(100)), None, ""]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    for idf in (4.0, 9.0):
        telling = decontaminate.Telling(items, np.full(len(items.terms), idf), np.random.default_rng(1).normal(size=(1 << decontaminate.SLOT_BITS, 48)))
        got = [f for _, found in decontaminate._found(iter([batch]), telling) for f in found]
        assert [sorted(f) for f in got] == [[0], [1], [], [], []]


def _topics(rnd):
    """Documents of 40 topics; each has words that stand for one another.  An item, and a document that says the same in other
    words of its topic, with the item's rare words and a few more in order."""
    made = lambda n: ["".join(rnd.choice("bcdfghklmn") for _ in range(7)) for _ in range(n)]
    topics = [made(30) for _ in range(40)]
    docs = [" ".join(rnd.choices(rnd.choice(topics), k=rnd.randint(40, 90))) for _ in range(1500)]
    answer = made(5)
    words = rnd.sample(topics[7], 30)
    one, other = words[:15], words[15:]
    item, said = list(one), list(one[:3]) + other[:12]
    for i, x in enumerate(answer):
        item.insert(4 * i, x)
        said.insert(4 * i, x)
    return docs, " ".join(item), " ".join(said)


def test_a_paraphrase_is_found_in_the_latent_space(spark, monkeypatch):
    rnd = random.Random(3)
    docs, item, said = _topics(rnd)
    frame = spark.createDataFrame([*enumerate(docs), (9000, said), (9001, item), (9002, " ".join(rnd.sample(said.split(), 20)))], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    contaminated = lambda: {r.doc_id for r in decontaminate.contamination(frame, bench).where("contaminated").collect()}
    assert contaminated() == {9000, 9001}
    telling = decontaminate.telling_words(frame, [(1, item)])
    slots = decontaminate._slots(wh.hash_text(said, wh.NOT_ALNUM, lower=True))
    a, b = (np.bincount(decontaminate._slots(wh.hash_text(t, wh.NOT_ALNUM, lower=True)), minlength=1 << decontaminate.SLOT_BITS) for t in (item, said))
    assert telling.cosine(0, slots) > 0.7 > 0.6 > (a @ b) / np.sqrt((a @ a) * (b @ b))
    # without singular vectors, each column a direction of its own, the paraphrase is lost
    monkeypatch.setattr(decontaminate, "latent_words", lambda docs, idf, halves: np.random.default_rng(2).normal(size=(len(idf), 256)).astype(np.float32))
    assert contaminated() == {9001}


def test_singular_vectors_against_numpy(spark):
    """The space is that of a dense singular value decomposition of the same TF-IDF matrix, where the spectrum falls off."""
    docs, *_ = _topics(random.Random(4))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    columns = 1 << decontaminate.SLOT_BITS
    rows = []
    for t in docs:
        slots = decontaminate._slots(wh.hash_text(t, wh.NOT_ALNUM, lower=True))
        rows += [np.bincount(slots[i : i + decontaminate.HALF], minlength=columns) for i in range(0, len(slots), decontaminate.HALF)]
    a = np.array(rows, float)
    seen = np.flatnonzero(a.any(0))
    idf = np.where(a.any(0), np.log((len(a) + 1) / ((a > 0).sum(0) + 1)) + 1, 0)
    _, sigma, v = np.linalg.svd(a[:, seen] * idf[seen], full_matrices=False)
    got = decontaminate.latent_words(frame, idf, len(a))
    # of the 40 leading directions, one for each topic, each is within the found space
    scaled = np.linalg.qr(got[seen] / idf[seen][:, None])[0]
    assert np.linalg.norm(scaled.T @ v[:40].T, axis=0).min() > 0.9
    assert np.allclose(np.sort(1 / np.linalg.norm(got[seen] / idf[seen][:, None], axis=0))[::-1][:40], sigma[:40], rtol=0.15)


def test_items_do_not_depend_on_other_items(spark):
    """The same finds among 10, 224 and 1,000 items."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("bcdfghklmn") for _ in range(7)) for _ in range(3000)]
    filler = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    first = [(i, filler(rnd.choice([12, 30, 80]))) for i in range(10)]
    rows = [(i, filler(rnd.choice([5, 70, 300]))) for i in range(280)] + [(1000 + i, f"{filler(40)} {t} {filler(60)}") for i, t in first[::2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    more = [(100 + i, " ".join("".join(rnd.choice("opqrstuvw") for _ in range(7)) for _ in range(20))) for i in range(990)]
    results = []
    for n in (10, 224, 1000):
        bench = spark.createDataFrame((first + more)[:n], "item_id long, text string")
        results.append(sorted((r.doc_id, r["items"], round(r.share, 9)) for r in decontaminate.contamination(frame, bench).where("contaminated").collect()))
    assert results[0] == results[1] == results[2] and [r[0] for r in results[0]] == [1000 + i for i, _ in first[::2]]


# -- 6 personal data

_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_spans(t):
    out = []
    for kind, p in _KINDS.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(2)
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "1234567812345678"]
    parts = ["a", ".", "@", "1", "-", "+", " ", "(", ")", "5", "%", "b", "é", "10.2.3.4", "+1 (234) 555-0000", "x@y.z", *cards]
    for _ in range(20000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(t) == _plain_spans(t), t
    assert pii.base_spans("9" * 20000) == []


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    t = bilstm.Tagger(5, 3, hidden=4)
    x, y = rng.integers(0, 5, (3, 6)), rng.integers(0, 3, (3, 6))
    _, grads = t._gradients(x, y)
    for name in t.p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in t.p[name].shape)
            keep, eps = t.p[name][at], 1e-5
            t.p[name][at] = keep + eps
            up = t._gradients(x, y)[0]
            t.p[name][at] = keep - eps
            down = t._gradients(x, y)[0]
            t.p[name][at] = keep
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_personal_data(docs, none, spark):
    more = [(7000, "call (217) 555-7713 now, card 4111.1111.1111.1111 or mail ab.12@x.org é 10.0.0.1"), (7001, "no data here, version 2.0 on 2024-01-05")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.personal_data(both).collect()}
    for r in both.where("doc_id is not null").collect():
        base = _plain_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(s[0] == k for s in base) for k in _KINDS)
        assert set(joined.split(",")) - {""} <= set(g.spans.split(","))
    assert "phone" in got[7000].spans and got[7000].n_phone == 0  # found by the tagger alone
    assert got[7001].spans == ""
    assert pii.personal_data(none).count() == 0


def test_tagger_on_held_out_windows():
    rnd = random.Random(99)
    tagger = pii.train([f"plain words here {rnd.randint(1, 9)} and there" for _ in range(50)])
    made = [pii._made_up(rnd) for _ in range(400)]
    found = pii.tagged_spans(tagger, [f"some words before {v} and after it" for v, _ in made])
    kinds = [k for (v, k), f in zip(made, found) if k and any(s[0] == k for s in f)]
    assert len(kinds) >= 0.7 * sum(k is not None for _, k in made)
    assert sum(bool(f) for (v, k), f in zip(made, found) if k is None) <= 0.1 * len(made)


def test_addresses_without_digits_are_read(spark):
    """Spelled-out addresses in texts without a digit or @, long ones too, at both ends of a text and inside."""
    rnd = random.Random(8)
    plain = "the stone of a river and cloud over window in garden letter paper table music forest".split()
    words = lambda n: " ".join(rnd.choice(plain) for _ in range(n))
    w = lambda a, b: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randint(a, b)))
    rows, want = [], {}
    for i in range(60):
        at, dot = rnd.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        local = f"{w(4, 9)}.{w(4, 9)}" if i % 2 else w(4, 9)
        value = f"{local}{at}{w(5, 9)}{dot}{rnd.choice(['com', 'org', 'net'])}"
        left = words(rnd.randint(2, 30)) + " "
        rows.append((i, f"{left}{value} {words(20)}"))
        want[i] = f"email:{len(left)}:{len(left) + len(value)}"
    rows += [(100 + i, f"{words(9)} call {rnd.randint(10, 99)} or write a{i}@example.com {words(9)}") for i in range(60)]
    rows += [(200, words(40)), (201, "so [at"), (202, "(dot)")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].spans for i in want} == want
    # spelled out without brackets: the tagger alone finds these
    spelled = {i: f"{w(4, 9)} at {w(5, 9)} dot {rnd.choice(['com', 'org', 'net'])}" for i in range(300, 360)}
    more = [(i, f"{(left := words(rnd.randint(3, 20)))} {v} {words(12)}") for i, v in spelled.items()] + [(400 + i, f"{words(9)} at {words(2)} dot {words(1)} {words(5)}") for i in range(5)]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
    texts = dict(more)
    right = sum(any(x.startswith("email:") and texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] == v for x in found[i].split(",")) for i, v in spelled.items())
    assert right >= 0.8 * len(spelled), right
    assert all(got[i].n_email == 0 for i in want) and all(got[i].spans == "" for i in (200, 201, 202))
    long = f"{'n' * 60} [at] {'h' * 60} [dot] com"
    assert pii.segments(f"{'x ' * 99}{long}{' x' * 99}")[0] <= (198, 198 + len(long)) and pii.segments("(at)" + "y" * 99 + "7") == [(0, 76), (79, 104)]


def test_spans_are_merged_in_one_sweep():
    rnd = random.Random(2)
    for _ in range(200):
        base = sorted((rnd.choice(pii.KINDS), a, a + rnd.randint(1, 9)) for a in rnd.sample(range(80), rnd.randint(0, 8)))
        own = [(rnd.choice(pii.KINDS), a, a + rnd.randint(1, 12)) for a in rnd.choices(range(80), k=rnd.randint(0, 10))]
        taken, extra = [(a, b) for _, a, b in base], []
        for kind, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
            if all(b <= x or y <= a for x, y in taken):
                extra.append((kind, a, b))
                taken.append((a, b))
        assert pii._merged(base, own) == sorted(base + extra, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
    many = [("ip", 20 * i, 20 * i + 9) for i in range(100_000)]
    assert len(pii._merged(many, [("phone", 20 * i + 9, 20 * i + 18) for i in range(100_000)])) == 200_000


def test_very_long_stretches_are_decoded_in_cuts(monkeypatch):
    """A long stretch gives the same spans in cuts of bounded size as in one piece."""
    for stretch in ((3, 10, 9000), (0, 0, 4096), (1, 5, 4097), (2, 0, 100_000)):
        cuts = list(pii._cuts(*stretch))
        assert [c[3] for c in cuts[1:]] == [c[4] for c in cuts[:-1]] and cuts[0][3] == stretch[1] and cuts[-1][4] == stretch[2]
        assert all(c[2] - c[1] <= pii.CUT and c[1] <= c[3] and c[4] <= c[2] for c in cuts)
    rnd = random.Random(3)
    tagger = pii.train([f"words here {rnd.randint(1, 9)} and there" for _ in range(50)])
    value = "10.0.0.17"
    text = " ".join(f"call {"x" * rnd.randint(1, 9)} {value} or more" for _ in range(3000))
    (spans,) = pii.tagged_spans(tagger, [text])
    monkeypatch.setattr(pii, "CUT", 1 << 30)
    (whole,) = pii.tagged_spans(tagger, [text])
    assert len(set(spans)) == len(spans) > 500
    assert len(set(spans) ^ set(whole)) <= 0.01 * len(whole)


# -- 7 passages


@pytest.mark.parametrize("window", [20, 4])
def test_remove_repeats(docs, rows, none, window):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(docs, window).collect()))
    seen, want, done = set(), [], {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")):
        if (r.doc_id, r.text) not in done:
            w = BLANKS.findall(r.text or "")
            keep = [True] * len(w)
            for i in range(len(w) - window + 1):
                if (k := tuple(w[i : i + window])) in seen:
                    keep[i : i + window] = [False] * window
                seen.add(k)
            kept = [x for x, k in zip(w, keep) if k]
            done[r.doc_id, r.text] = (r.doc_id is None, r.doc_id or 0, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        want.append(done[r.doc_id, r.text])
    assert got == sorted(want)
    assert passages.remove_repeats(none).count() == 0


# -- 8 MinHash


@pytest.mark.parametrize(("shingle", "percent", "listed"), [(3, 85, 16), (5, 80, 16), (1, 60, 0), (3, 50, 0)])
def test_near_duplicates(docs, rows, none, shingle, percent, listed, monkeypatch):
    monkeypatch.setattr(minhash._Linker, "LISTED", listed)
    named = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=lambda x: x[0])
    sets = {}
    for i, t in named:
        w = BLANKS.findall(_lower(t or ""))
        sets[i] = {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    f = graph.Forest()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                f.union(a, b)
    got = minhash.near_duplicates(docs, shingle, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (len(s), f.find(i), f.find(i) == i) for i, s in sets.items()}
    assert all(not r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(none).count() == 0


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 850).astype(np.uint64)
    one, two = (np.concatenate([common, rng.integers(0, 1 << 62, 75).astype(np.uint64)]) for _ in range(2))
    tiny = common[:1]
    s = minhash.sketches(np.concatenate([one, two, tiny]), np.array([len(one), len(two), 1]), 1000)
    assert (s != minhash._TOP).all()
    assert abs((s[0] == s[1]).mean() - 0.85) < 0.05


def test_keep_one(docs, rows):
    kept = minhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {0, 1, 2, 5} <= set(ids) and 6 not in ids
    assert sum(r.doc_id is None for r in kept) == 2


def test_keep_one_of_an_id_with_several_texts(spark):
    rows = [(1, "a b c d e f g", 1), (1, "other words that stand here now", 2), (1, "a b c d e f g", 1), (2, "a b c d e f g", 3), (3, "h i j k l m n", 4), (None, "x", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rows long").withColumn("hash", F.lit(0)).withColumn("id", F.lit("z"))
    hashes = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    for n in (1, 4):
        out = minhash.keep_one(frame.repartition(n))
        assert out.columns == frame.columns
        assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "x"), (1, min(rows[0][1], rows[1][1], key=hashes.get)), (3, rows[4][1])]


def test_recall_on_a_table(spark):
    """Links of the driver's small table against all pairs of shingle sets at 0.8, with five words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = BLANKS.findall(_lower(r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    f, ids = graph.Forest(), sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                f.union(i, j)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    linked = [i for i in ids if f.find(i) != i]
    assert len(linked) >= 5
    assert sum(got[i] == f.find(i) for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == i for i in ids if f.find(i) == i)


def test_pairs_that_agree_in_few_bands_are_compared(spark):
    """Only sizes rule a pair out before its sets are compared."""
    band = lambda i, same: [k if k < same else 100 * i + k for k in range(32)]
    classes = spark.createDataFrame([(1, 100, band(1, 2)), (2, 90, band(2, 2)), (3, 100, band(3, 0)), (4, 70, band(4, 32))], "rep long, n long, bands array<long>")
    linker, seen = minhash._Linker(None, classes, 5, 80), []

    def compared(near):
        seen.extend(sorted(map(tuple, near.collect())))
        return near.withColumn("linked", F.lit(True))

    linker._compared = compared
    linker._check(spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 4)], "a long, b long"))
    assert seen == [(1, 2), (1, 3)]


# -- 9 lines


def test_dedup_lines(spark, none):
    long = "the quick brown foxes jumped happily over seventeen sleeping greyhounds near riverbanks yesterday evening before sunset"
    rows = [(3, f"{long}\nunique one\n\n"), (1, f"Hello,  world\n{long}"), (2, "hello world!\nother"), (4, long.replace("evening", "evenings")), (5, None), (6, ""), (6, ""), (None, "hello WORLD\nlast"), (7, "a\nA\na.")]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1))).collect()}
    assert out[1].kept_text == rows[1][1] and out[2].kept_text == "other" and out[3].kept_text == "unique one\n\n"
    assert (out[5].n_lines, out[6].n_lines, out[6].n_kept) == (0, 1, 1)
    assert out[None].kept_text == "last" and out[7].kept_text == "a"
    assert lines.dedup_lines(none).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_simhash_of_lines():
    """Each block by its definition: the weighted vote of a line's grams, weights halved from gram to gram in the block's order;
    length classes let no near-equal pair part."""
    texts = ["Some, words: HERE\n\n\nno", "a", "żółć x-y " + "long " * 40, "twelve letters make this one line of middling length here"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    found = lines._Lines(data, offsets)
    forms = [n for t in texts for x in t.split("\n") if (n := lines.normalised(x))]
    hashes = lines.SimHashes(*found.spelled(np.arange(len(forms))), 0.9)
    for row, (at, length, block, place) in enumerate(zip(hashes.line, hashes.length, hashes.block, hashes.place, strict=True)):
        b = b" " + forms[at].encode() + b" "
        assert length == len(forms[at])
        cls = int(lines.length_class(np.array([length]), 0.9)[0])
        band = cls // lines.BAND + (row >= len(forms))
        width = min(int(lines.gram_bytes(np.array([band]), 0.9)[0]), len(b))
        grams = [b[i : i + width] for i in range(len(b) - width + 1)]
        g = wh.hash_spans(np.frombuffer(b, np.uint8), np.arange(len(grams)), np.arange(len(grams)) + width, lower=False)
        salt = wh.mix(wh.mix(np.array([band], np.uint64) + np.uint64(0x632BE59BD9B4E019)) + np.arange(1, lines.BLOCKS + 1, dtype=np.uint64))
        for j in range(lines.BLOCKS):
            mine = sorted((int(x) >> lines._PLACE, i) for i, x in enumerate(g) if int(x) % (1 << lines._PLACE) % lines.BLOCKS == j)
            assert (place[j] < 0) == (not mine)
            if mine:
                # weights 1, 1/2, 1/4, ... of the ranks' bits: the sum's sign, bit by bit
                vote = sum((sum((2 * (x >> bit & 1) - 1) * 2.0**-r for r, (x, _) in enumerate(mine[:50])) > 0) << bit for bit in range(64 - lines._PLACE))
                assert block[j] == wh.mix(np.array([vote << lines._PLACE], np.uint64) ^ salt[j : j + 1])[0]
                assert place[j] == sum(c & 0xC0 != 0x80 for c in b[: mine[0][1]])
    n = np.arange(1, 3000)
    least = n - np.floor(n * (1 - 0.9) + 1e-9).astype(int)
    classes = lines.length_class(n, 0.9)
    assert (classes - classes[least - 1] <= 1).all()


def _edited(rnd, line, edits):
    out = list(line)
    for _ in range(edits):
        at, how = rnd.randrange(len(out)), rnd.randrange(3)
        out[at : at + (how > 0)] = rnd.choice("abcdeghinorst") if how < 2 else ""
    return "".join(out)


def test_edit_distances():
    rnd = random.Random(12)
    for _ in range(600):
        one = "".join(rnd.choice("abż") for _ in range(rnd.randint(0, 40)))
        two = _edited(rnd, one, rnd.randint(0, 9)) if len(one) > 9 and rnd.random() < 0.9 else "".join(rnd.choice("abż") for _ in range(rnd.randint(0, 40)))
        want = _distance(one, two)
        assert lines.edit_distance(one, two) == want
        for most in (0, 1, 3, 7, 20):
            assert lines._near_by_diagonals(one, two, most) == (want <= most), (one, two, most)
        for similarity in (0.9, 0.7, 0.5):
            assert lines.near(one, two, similarity) == (want <= int(max(len(one), len(two)) * (1 - similarity) + 1e-9))
    long = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    for edits in (10, 30, 60, 200):
        two = _edited(rnd, long, edits)
        assert lines.near(long, two, 0.95) == (_distance(long, two) <= int(max(len(long), len(two)) * 0.05 + 1e-9))


def test_recall_of_near_equal_lines():
    """Of pairs of lines of 3 to 20 words at an edit similarity of 0.9 or more, at least nine in ten meet in a block, and what is
    asked before the edit distance turns none of those away that an alignment through the shared gram allows."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghinorstu") for _ in range(rnd.randint(2, 9)))
    for words in (3, 4, 5, 6, 8, 10, 14, 20):
        pairs = []
        while len(pairs) < 80:
            one = " ".join(word() for _ in range(words))
            two = lines.normalised(_edited(rnd, one, rnd.randint(1, max(1, int(0.1 * len(one))))))
            if one != two and _distance(one, two) <= 0.1 * max(len(one), len(two)):
                pairs.append((one, two))
        met = 0
        for one, two in pairs:
            data = np.frombuffer(f"{one}\n{two}".encode(), np.uint8)
            found = lines._Lines(data, np.array([0, len(data)]))
            own = lines.SimHashes(*found.spelled(np.arange(2)), 0.9)
            rows = [(int(k), int(i), int(n), int(p), *map(int, c)) for k4, i, n, p4, c in zip(own.block, own.line, own.length, own.place, own.kinds.view(np.int64), strict=True) for k, p in zip(k4, p4, strict=True)]
            table = pa.record_batch([pa.array([r[c] for r in rows], pa.int64() if c else pa.uint64()) for c in range(6)], names=["key", "id", "size", "place", "kinds", "more_kinds"])
            a, b = ([i for i, r in enumerate(rows) if r[1] == x] for x in (0, 1))
            same = [(i, j) for i in a for j in b if rows[i][0] == rows[j][0]]
            met += bool(same) and bool(lines.may_link(table, np.array([i for i, _ in same]), np.array([j for _, j in same]), 0.9).any())
        assert met >= 0.9 * len(pairs), (words, met)


@pytest.mark.parametrize("part", [4096, 3])
def test_dedup_lines_against_brute_force(spark, monkeypatch, part):
    """Lines with a few edits, of which every pair meets in a block: groups by edit similarity alone, first occurrences kept."""
    from textloom.llm import links

    monkeypatch.setattr(links, "PART", part)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghinorstu") for _ in range(rnd.randint(3, 9)))
    base = [" ".join(word() for _ in range(rnd.randint(12, 25))) for _ in range(14)]
    pool = [x for b in base for x in (b, b, b.upper() + "!", *(_edited(rnd, b, k) for k in (1, 1, 2, 2, 3)))] + ["", "...", "x"]
    docs = [(rnd.choice([i, i, None]) if i % 7 == 0 else i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 9)))) for i in range(40)] + [(3, None)]
    docs += [docs[5], docs[5]]  # a repeated row is one document
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k1", F.lit(0))
    order = {r.text: r.k for r in frame.select("text", F.xxhash64("text").alias("k")).collect()}
    forms = sorted({n for _, t in docs if t is not None for x in t.split("\n") if (n := lines.normalised(x))})
    group = graph.Forest()
    for i, one in enumerate(forms):
        for j in range(i):
            if _distance(one, forms[j]) <= 0.1 * max(len(one), len(forms[j])) + 1e-9:
                group.union(i, j)
    seen, kept = set(), {}
    for doc_id, text in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0, order[d[1]])):
        left = []
        for x in text.split("\n"):
            n = lines.normalised(x)
            g = group.find(forms.index(n)) if n else None
            if n and g in seen:
                continue
            seen.add(g)
            left.append(x)
        kept[doc_id, text] = "\n".join(left)
    got = lines.dedup_lines(frame).collect()
    assert len(got) == len(docs)
    rest = sorted((str(r.doc_id), r.kept_text) for r in got)
    assert rest == sorted((str(d), kept.get((d, t), "")) for d, t in docs)


def test_a_very_long_line_and_text(spark):
    word = "".join(chr(97 + i % 23) for i in range(50))
    long = " ".join(f"{word[i % 40 :]}{i}" for i in range(4_000))
    rows = [(1, long), (2, long.replace("a40", "b40")), (3, "\n".join(f"line {i} of many that differ {i * 7919}" for i in range(3_000)))]
    out = {r.doc_id: (r.n_lines, r.n_kept) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (1, 1) and out[2] == (1, 0) and out[3][0] == 3_000


def test_near_equal_lines_are_linked_in_any_table(spark):
    """A typo in a line of twelve words: of such pairs nearly all are linked, as many in a small table as in a large one."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(5, 9)))
    first = [" ".join(word() for _ in range(12)) for _ in range(120)]
    second = []
    for x in first:
        at = rnd.choice([i for i, c in enumerate(x) if c != " "])
        second.append(x[:at] + "z" + x[at + 1 :])
    assert all(_distance(a, b) <= 0.1 * len(a) for a, b in zip(first, second, strict=True))
    other = [" ".join(word() for _ in range(12)) for _ in range(6000)]
    for more in ([], other):
        rows = list(enumerate(["\n".join(first), "\n".join(second), "\n".join(more)]))
        out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out[0].n_kept == len(first) and out[2].n_kept == max(1, len(more))
        assert out[1].n_kept <= 6


def test_edit_distances_in_a_band():
    """Pairs told at once in a band of diagonals, and distances that stop early, against the whole table."""
    rnd = random.Random(21)
    one = ["".join(rnd.choice("abż😀 ") for _ in range(rnd.choice([0, 1, 2, 9, 30, 60, 110]))) for _ in range(300)]
    two = [_edited(rnd, x, rnd.randint(0, 40)) if len(x) > 45 and rnd.random() < 0.9 else x[::-1][:5] for x in one]
    distance = np.array([_distance(x, y) for x, y in zip(one, two, strict=True)])
    for shift in (-1, 0, 2):
        most = np.clip(distance + shift, 0, 31)
        assert (lines.near_in_band(one, two, most) == (distance <= most)).all()
        told = [lines.edit_distance(x, y, m) for x, y, m in zip(one, two, most.tolist(), strict=True)]
        assert ((np.array(told) <= most) == (distance <= most)).all()


def test_runs_out_of_place_tell_lines_apart():
    """Never where the edits are few enough, whatever they are; and of the same words in another order always."""
    rnd = random.Random(3)
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    for _ in range(60):
        one = "".join(rnd.choice("abcż ") for _ in range(rnd.randint(3, 160)))
        two = _edited(rnd, one, rnd.randint(0, 40))
        if rnd.random() < 0.3:
            two = two[len(two) // 3 :] + two[: len(two) // 3]
        most = _distance(one, two) + rnd.choice([0, 0, 3])
        assert not lines._out_of_place(codes(one), codes(two), most) and not lines._out_of_place(codes(two), codes(one), most)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    words = [word() for _ in range(120)]
    one, two = " ".join(words), " ".join(words[60:] + words[:60])
    assert lines._out_of_place(codes(one), codes(two), 84) and not lines.near(one, two, 0.9)


def test_lines_that_may_link_share_a_part():
    """Of the packed keys, every line stays that may link with another one of its key, and few others do."""
    rng = np.random.default_rng(5)
    rows = np.zeros(4000, lines._KEYED)
    rows["key"], rows["id"], rows["size"] = rng.integers(0, 900, 4000), rng.integers(-1500, 1500, 4000), 0
    rows["size"] = 30 + rows["id"] % 700
    rows["place"] = (rows["key"].astype(np.int64) * 31 + rows["id"]) % rows["size"]
    batch = pa.record_batch([pa.array([7, 7], pa.int32()), pa.array([rows[:100].tobytes(), rows[100:].tobytes()], pa.binary())], names=["part", "packed"])
    got = {x for b in lines._shared_ids(iter([batch]), 0.9) for x in b.column(0).to_pylist()}
    none = pa.array(np.zeros(4000, np.int64))
    table = pa.record_batch([pa.array(rows["size"].astype(np.int64)), pa.array(rows["place"].astype(np.int64)), none, none], names=["size", "place", "kinds", "more_kinds"])
    a, b = np.nonzero(np.triu(rows["key"][:, None] == rows["key"][None], 1))
    other = rows["id"][a] != rows["id"][b]
    a, b = a[other], b[other]
    yes = lines.may_link(table, a, b, 0.9)
    want = {*rows["id"][a[yes]].tolist(), *rows["id"][b[yes]].tolist()}
    assert want and want <= got and len(got) < 0.8 * len(set(rows["id"].tolist()))


def test_lines_of_a_key_stay_only_with_a_partner():
    """Length, place and distance to the end must be about those of one other line, not each of another one's; the rows that stay
    carry their key, so it is not made again."""
    rows = np.array([(9, 1, 100, 50), (9, 2, 100, 10), (9, 3, 300, 50), (9, 4, 400, 350), (8, 5, 200, 60), (8, 6, 205, 62)], lines._KEYED)
    batch = pa.record_batch([pa.array([3], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["part", "packed"])
    out = pa.Table.from_batches(lines._shared_ids(iter([batch]), 0.9)).to_pylist()
    assert sorted(r["id"] for r in out) == [5, 6]
    assert {r["key"] for r in out} == {8 | 3 << 32} and sorted((r["size"], r["place"]) for r in out) == [(200, 60), (205, 62)]
    many = np.zeros(1000, lines._KEYED)  # a crowded key: none is compared one by one, none is lost
    many["key"], many["id"], many["size"], many["place"] = 4, np.arange(1000), 100, np.arange(1000) % 40
    batch = pa.record_batch([pa.array([3], pa.int32()), pa.array([many.tobytes()], pa.binary())], names=["part", "packed"])
    assert sum(b.num_rows for b in lines._shared_ids(iter([batch]), 0.9)) == 1000


def test_tiles_meet_in_rounds(spark, monkeypatch):
    """No more characters of members than all texts have meet with their texts at a time, and no link is lost by that."""
    from textloom.llm import links

    rnd = random.Random(11)
    base = [rnd.choice("abcdefghij") for _ in range(60)]
    texts = set()
    while len(texts) < 60:
        x = list(base)
        for i in rnd.sample(range(60), rnd.randint(0, 5)):
            x[i] = rnd.choice("klmnop")
        texts.add("".join(x))
    texts = sorted(texts)
    rows = [(key, i, 60) for i in range(60) for key in range(5)]
    may = lambda rows, one, two: np.ones(len(one), bool)
    seen, real = [], links.written
    monkeypatch.setattr(links, "ROUND_CHARS", 1)
    monkeypatch.setattr(links, "written", lambda df, name: seen.append(name) or real(df, name))
    from functools import partial

    got = links.link_members(spark.createDataFrame(rows, "key long, id long, size int"), spark.createDataFrame(list(enumerate(texts)), "id long, text string"), may, partial(lines._near, similarity=0.9), 1.2)
    whole = graph.Forest()
    for i in range(60):
        for j in range(i):
            if _distance(texts[i], texts[j]) <= 6:
                whole.union(i, j)
    found = dict(got.collect())
    assert [found.get(i, i) for i in range(60)] == [whole.find(i) for i in range(60)]
    assert seen.count("links") > 2  # those of the leaders, and more than one round


def test_only_lines_that_may_link_are_looked_at_again(spark, monkeypatch):
    """Neither whole documents nor lines that resemble no other are fetched for the comparison."""
    seen = {}
    real = lines.written

    def written(df, name):
        out = real(df, name)
        seen[name] = {r.words for r in out.select("words").collect()} if "words" in out.columns else None
        return out

    monkeypatch.setattr(lines, "written", written)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(5, 9)))
    first = [" ".join(word() for _ in range(12)) for _ in range(40)]
    second = [x[:30] + "z" + x[31:] for x in first]
    other = [" ".join(word() for _ in range(12)) for _ in range(3000)]
    rows = list(enumerate(["\n".join(first), "\n".join(second), "\n".join(other)]))
    out = {r.doc_id: r.n_kept for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == 40 and out[1] <= 3 and out[2] == 3000
    assert 76 <= len(seen["near"]) <= 100 and len(set(first) & seen["near"]) >= 38


def test_a_bucket_leaves_a_forest_not_its_pairs():
    """Lines of one template, in one bucket: what leaves the tasks is no more than the rows, and connects what brute force does."""
    from functools import partial

    from textloom.llm import links

    rnd = random.Random(5)
    base = [rnd.choice("abcdefghij") for _ in range(60)]
    texts = []
    for _ in range(150):
        x = list(base)
        for i in rnd.sample(range(60), rnd.randint(0, 5)):
            x[i] = rnd.choice("klmnop")
        texts.append("".join(x))
    texts = sorted(set(texts))
    n = len(texts)
    same = lambda v, kind: pa.array(np.full(n, v), kind)
    ids = pa.array(np.arange(n))
    rows = pa.record_batch([same(7, pa.int64()), ids, ids, same(60, pa.int32())], names=["key", "id", "comp", "size"])
    may = lambda rows, one, two: np.ones(len(one), bool)
    whole = graph.Forest()
    for i in range(n):
        for j in range(i):
            if _distance(texts[i], texts[j]) <= 6:
                whole.union(i, j)
    kept = pa.Table.from_batches(links._in_buckets(iter([rows]), may, 1.2, 4096)).to_batches()[0]
    assert kept.num_rows == n and set(kept["tile"].to_pylist()) == {7}
    with_text = kept.append_column("text", pa.array(texts)) if hasattr(kept, "append_column") else pa.Table.from_batches([kept]).append_column("text", pa.array(texts)).to_batches()[0]
    out = [e for b in links._linked(iter([with_text]), may, partial(lines._near, similarity=0.9), 1.2) for e in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    found = graph.Forest()
    for a, b in out:
        assert found.union(a, b)
    assert len(out) > n / 2 and [found.find(i) for i in range(n)] == [whole.find(i) for i in range(n)]
    large = pa.Table.from_batches(links._in_buckets(iter([rows]), may, 1.2, 3))  # more than a part: handed on whole
    assert large.num_rows == n and large["tile"].null_count == n


# -- 10 token files


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 511, 512, 513, 5000):
        a = (rng.zipf(1.3, n) % 300).astype(np.uint16)
        f = wavelet.WaveletFile(wavelet.encode(a, np.array([n]), [None]))
        assert (f.tokens() == a).all() and f.doc_ids == [None]
        for i in range(0, n, 97):
            assert f.access(i) == a[i]
        for token in (1, 2, 299, 400):
            at = np.flatnonzero(a == token).tolist()
            assert f.count(token) == len(at) and f.occurrences(token) == at
            assert f.count(token, n // 3, n // 2) == sum(n // 3 <= i < n // 2 for i in at)
    with pytest.raises(IndexError):
        f.access(5000)


def test_occurrences_against_brute_force():
    rng = np.random.default_rng(6)
    ids = rng.zipf(1.3, 5000).clip(0, 900).astype(np.uint32)
    file = wavelet.WaveletFile(wavelet.encode(ids, np.array([5000]), [1]))
    for token in (0, 1, 2, 7, 899, 900, 901):
        assert file.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_token_files(docs, rows, none, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = [(8000, "it's a\x1cb <|endoftext|> naïve × 12 日本語 don't,stop ½\x85x"), (8001, "Éé ÇA. x, y.\nz"), (8002, "'s 't ''s")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted(map(tuple, tokens.token_files(both, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for r in sorted(both.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.token_files(none, path).count() == 0


def test_space_is_fitted_on_all_documents(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"word{i} other{i % 7} third{i % 11}") for i in range(300)], "doc_id long, text string")
    idf = np.ones(1 << decontaminate.SLOT_BITS)
    want = decontaminate.latent_words(frame, idf, 300)
    monkeypatch.setattr(decontaminate, "FITTED", 30, raising=False)  # no number of half passages bounds the fit
    got = decontaminate.latent_words(frame, idf, 300)
    assert got.shape == want.shape and np.allclose(got @ got[:50].T, want @ want[:50].T, atol=1e-3)


def test_half_passages_are_multiplied(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 33, 200)
    slots = np.minimum(rng.zipf(1.5, int(sizes.sum())), 400).astype(np.uint16)  # some columns often enough to be dense, others rare
    counts = np.zeros((200, 401))
    np.add.at(counts, (np.repeat(np.arange(200), sizes), slots), 1)
    x, out = rng.normal(size=(401, 7)).astype(np.float32), np.ones((401, 7))
    decontaminate._multiplied(slots, sizes, x, out)
    assert np.allclose(out, 1 + counts.T @ (counts @ x), rtol=1e-4, atol=1e-3)
    # texts are cut into words once for the counts and the space
    frame = spark.createDataFrame([(i, f"word{i} other{i % 7} third{i % 11}") for i in range(300)] + [(300, None), (301, "")], "doc_id long, text string")
    seen, fit = [], decontaminate.latent_words
    monkeypatch.setattr(decontaminate, "latent_words", lambda docs, idf, halves: seen.append((docs.columns, fit(docs, idf, halves), fit(frame, idf, halves))) or seen[-1][1])
    decontaminate.telling_words(frame, [(1, "word1 other2")])
    columns, got, want = seen[0]
    assert "text" not in columns and got.shape == want.shape and np.allclose(got @ got[:50].T, want @ want[:50].T, atol=1e-3)


def test_bloom_filters_hold_all_ids(spark):
    ids = [None, 0, -1, 1 << 62, *range(10, 20_000, 7)]
    held = bloom.Bloom(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5))
    assert held.may_hold(pa.array(ids, pa.int64())).tolist() == [i is not None for i in ids]
    assert held.may_hold(pa.array(range(100_000, 200_000))).mean() < 0.01
    assert not bloom.Bloom(spark.createDataFrame([], "id long")).may_hold(pa.array(range(100))).any()
    rows = spark.range(9, 30).where(held.column(F.col("id"))).collect()
    assert {10, 17, 24} <= {r.id for r in rows}


def test_near_duplicates_move_no_text(spark, monkeypatch):
    """Large tables are joined by sorting: texts that link with nothing stay where they lie."""
    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    docs = spark.createDataFrame([*enumerate(words), (30, words[3] + " more"), (31, words[4]), (None, words[5])], "doc_id long, text string")
    plans, write = {}, minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.keep_one(docs)
        assert sorted((r.doc_id, r.text) for r in out.where("doc_id is not null").collect()) == list(enumerate(words))
        assert out.where("doc_id is null").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plans["sets"]
