"""Toxicity by a support vector machine on gap-weighted subsequence kernels, with Nyström landmarks."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Bounds of the labelled sample: documents of each label, and characters of a document in it.
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_CHARS = 1000, 2000, 20_000
#: Landmarks picked for telling labels apart, and ordinary words beside them.
LANDMARKS, BACKGROUND = 96, 8
#: Kernel: length of subsequences, and the factor for each character that one spans.
ORDER, DECAY = 3, 0.7
#: Characters of a unit that the kernel looks at (a longer unit is looked at in overlapping pieces, and in near ones wherever
#: a landmark may begin), and cached units.
UNIT, NEAR, CACHE = 40, 12, 200_000

_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[^\S\n][^\W\d_]){2,}(?!\S)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: A token that ends so ends a sentence.
_ENDS = ".!?"
#: Kernel values below this count as 0.
LEAST = 0.05


def kernel(units: list[str], landmarks: list[str], which: np.ndarray | None = None) -> np.ndarray:
    """Gap-weighted subsequence kernel of units and landmarks (Lodhi et al.), normalised: K(x, z) / sqrt(K(x, x) K(z, z)).

    All pairs, or for ``which`` (pairs of indices, one row each) those pairs only."""
    if which is None:
        which = np.stack(np.meshgrid(np.arange(len(units)), np.arange(len(landmarks)), indexing="ij"), -1).reshape(-1, 2)
        return kernel(units, landmarks, which).reshape(len(units), len(landmarks))
    own = np.array([_raw(_codes([z]), _codes([z]))[0] for z in landmarks])
    s, z = _codes(units), _codes(landmarks)
    self_ = np.concatenate([np.zeros(0), *(_raw(s[a : a + 4096], s[a : a + 4096]) for a in range(0, len(units), 4096))])
    out = np.zeros(len(which))
    for at in range(0, len(which), 4096):
        i, j = which[at : at + 4096].T
        out[at : at + 4096] = _raw(s[i], z[j])
    return out / np.sqrt(np.maximum(own[which[:, 1]] * self_[which[:, 0]], 1e-300))


def _codes(strings: list[str]) -> np.ndarray:
    width = max((len(x) for x in strings), default=0)
    out = np.zeros((len(strings), width), np.uint32)
    for i, x in enumerate(strings):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
    return out


def _raw(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The kernel for rows of s and z, by the usual recursion, one character of s at a time; padding (0) matches nothing."""
    n, width = z.shape
    # inner[i][:, j]: weight of common subsequences of length i of s so far and z[:j], gaps up to both ends counted
    inner = [np.ones((n, width + 1))] + [np.zeros((n, width + 1)) for _ in range(ORDER)]
    running = [np.zeros((n, width + 1)) for _ in range(ORDER)]
    total = np.zeros(n)
    for c in range(s.shape[1]):
        match = (z == s[:, c : c + 1]) & (z != 0)
        if not match.any():
            for i in range(1, ORDER):
                inner[i] *= DECAY
            continue
        total += (match * inner[ORDER - 1][:, :-1]).sum(1) * DECAY**2
        for i in range(ORDER - 1, 0, -1):
            step = np.zeros(n)
            fresh = running[i]
            hits = match * inner[i - 1][:, :-1] * DECAY**2
            for j in range(width):
                step = DECAY * step + hits[:, j]
                fresh[:, j + 1] = step
            inner[i] = DECAY * inner[i] + fresh
    return total


def _units(token: str) -> str:
    """A token's letters, behind a mark for its start."""
    letters = _NOT_LETTERS.sub("", token)
    return "^" + letters if letters else ""


def _parts(token: str) -> list[str]:
    """The units of a token: all its letters, and those of each stretch between other characters."""
    return list(dict.fromkeys(u for u in (_units(token), *map(_units, _NOT_LETTERS.split(token))) if u))


def _pieces(token: str, heads: frozenset[str]) -> set[str]:
    """What the kernel compares of a token: every piece has the start mark.  Within a unit longer than ``UNIT`` words have no
    marked start, so pieces of ``NEAR`` characters begin wherever a landmark's first letter stands."""
    out = set()
    for u in _parts(token):
        out.update("^" + u[a : a + UNIT - 1] for a in range(1, max(2, len(u) - UNIT // 2), UNIT // 2))
        if len(u) > UNIT:
            out.update("^" + u[a : a + NEAR - 1] for a, c in enumerate(u) if c in heads)
    return out


def tokens_of(text: str) -> list[str]:
    """Lower-cased tokens; letters spelled out with blanks between them are one more token."""
    text = text.lower()
    out = text.split()
    out.extend("".join(m.group().split()) for m in _SPACED.finditer(text))
    return out


@dataclass
class Model:
    """Landmarks and a linear machine over their kernel values; ``curve`` turns a text's evidence into a score."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 0.0, 0.0, -4.0]))

    def evidence(self, found: np.ndarray, n_tokens: int) -> np.ndarray:
        """Of the margins of a text's tokens: the three largest, how many are positive, and the text's length."""
        margins = np.sort(np.concatenate([found @ self.weights + self.bias if len(found) else np.zeros(0), np.full(3, self.bias)]))[::-1]
        return np.array([*np.clip(margins[:3], -2, 2), np.log1p((margins > 0).sum()), np.log1p(n_tokens) / 10, 1.0])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -40, 40)))


class Scorer:
    """Kernel values of tokens, each distinct token once as long as it is cached."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.bits = {c: 1 << i % 63 for i, c in enumerate(sorted({c for z in landmarks for c in z}))}
        self.masks = np.array([self._mask(z) for z in landmarks], np.int64)
        self.heads = frozenset(z[1] for z in landmarks)
        self.cache: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _mask(self, unit: str) -> int:
        out, get = 0, self.bits.get
        for c in unit:
            out |= get(c, 0)
        return out

    def forget(self) -> None:
        """Give memory back at a task's end: the worker goes on to other operators."""
        self.cache.clear()
        self.rows.clear()

    def learn(self, tokens: set[str]) -> None:
        """A landmark of which a unit lacks a letter counts 0 for it: gaps and insertions are tolerated, losses are not."""
        fresh = [t for t in tokens if t not in self.cache]
        if len(self.cache) + len(fresh) > CACHE:
            self.forget()
            fresh = list(tokens)
        units, of = [], []
        for t in fresh:
            self.cache[t] = -1
            for u in _pieces(t, self.heads):
                units.append(u)
                of.append(t)
        for a in range(0, len(units), 1 << 16):
            self._compare(units[a : a + (1 << 16)], of[a : a + (1 << 16)])

    def _compare(self, units: list[str], of: list[str]) -> None:
        held = np.array([self._mask(u) for u in units], np.int64)
        pairs = np.argwhere((held[:, None] & self.masks) == self.masks)
        if not len(pairs):
            return
        used, short = np.unique(pairs[:, 0], return_inverse=True)
        values = kernel([units[i] for i in used], self.landmarks, np.c_[short, pairs[:, 1]])
        for i, j, v in zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), values.tolist(), strict=True):
            if v >= LEAST:
                t = of[i]
                if self.cache[t] < 0:
                    self.cache[t] = len(self.rows)
                    self.rows.append(np.zeros(len(self.landmarks)))
                row = self.rows[self.cache[t]]
                row[j] = max(row[j], v)

    def _pooled(self, found: set[int]) -> np.ndarray:
        return np.max([self.rows[i] for i in found], axis=0)

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each text: kernel values of the tokens that have any, the sentence of each, and the number of tokens."""
        tokens = [tokens_of(x) for x in texts]
        self.learn(set().union(*tokens))
        cache, out = self.cache, []
        blank = np.zeros((0, len(self.landmarks)))
        for mine in tokens:
            at = [cache[t] for t in mine]
            if max(at, default=-1) < 0:
                out.append((blank, np.zeros(0, np.int64), len(mine)))
                continue
            rows, of, sentence = [], [], 0
            for t, i in zip(mine, at, strict=True):
                if i >= 0:
                    rows.append(self.rows[i])
                    of.append(sentence)
                sentence += t[-1] in _ENDS
            out.append((np.array(rows), np.array(of), len(mine)))
        return out


def _sentences(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A sentence's value for a landmark is the largest of its tokens'."""
    return np.array([rows[of == x].max(0) for x in np.unique(of)])


def _begins(text: str) -> set[str]:
    """Beginnings of a text's units, of 4 to 9 letters."""
    return {u[:k] for t in set(tokens_of(text)) for u in _parts(t) for k in range(5, min(10, len(u)) + 1)}


def _pick(toxic: list[str], clean: list[str]) -> list[str]:
    """Word beginnings that cover toxic documents and hardly any clean one, greedily, each document up to five times."""
    inside, outside = Counter(), Counter()
    for text in toxic:
        inside.update(_begins(text))
    inside = {g: n for g, n in inside.items() if n >= 3}
    for text in clean:
        outside.update(g for g in _begins(text) if g in inside)
    rate = len(toxic) / max(1, len(clean))
    good = {g for g, n in inside.items() if n >= 10 * rate * outside[g]}
    lists = [sorted(_begins(text) & good) for text in toxic]
    where: dict[str, list[int]] = {}
    for i, g in enumerate(lists):
        for x in g:
            where.setdefault(x, []).append(i)
    need, out = [5] * len(toxic), []
    while where and len(out) < LANDMARKS:
        best = max(where, key=lambda g: (sum(need[i] for i in where[g]) - 5 * rate * outside[g], len(g), g))
        if sum(need[i] for i in where[best]) < max(2, len(toxic) / 64):
            break
        for i in where.pop(best):
            need[i] = max(0, need[i] - 1)
        out.append(best)
        where = {g: x for g, x in where.items() if not (g.startswith(best) or best.startswith(g))}
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the active rows; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve(ridge * np.eye(x.shape[1]) + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on labelled texts, sentence by sentence: a toxic text's label is carried by its most toxic sentence, a clean
    text's by all of its sentences.  Witnesses are chosen again with each round's machine; each also comes with a letter put
    into its telling words, so that gaps are learned."""
    toxic = [x for x, y in zip(texts, labels, strict=True) if y]
    clean = [x for x, y in zip(texts, labels, strict=True) if not y]
    picked = _pick(toxic, clean)
    if not picked or not clean:
        return Model()
    frequent = Counter(u[:9] for x in clean[:500] for u in {u for t in tokens_of(x) for u in _parts(t)} if len(u) >= 6)
    ordinary = [u for u, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0]))[:BACKGROUND]]
    landmarks = list(dict.fromkeys(picked + ordinary))
    scorer = Scorer(landmarks)
    read = [x for a in range(0, len(texts), 200) for x in scorer.read(texts[a : a + 200])]
    # Nyström: features times the inverse root of the landmarks' own kernel matrix, which is symmetric and positive
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    put_in = _put_in(landmarks)
    blank = np.zeros(len(landmarks))
    bags = [_sentences(rows, of) if len(rows) else blank[None] for rows, of, _ in read]
    w = np.r_[np.array([1.0 if z in set(picked) else 0.0 for z in landmarks]) @ np.linalg.inv(root), 0.0]
    for _ in range(4):
        rows, y = [], []
        for bag, label in zip(bags, labels, strict=True):
            margins = bag @ root @ w[:-1]
            if label:
                top = bag[int(margins.argmax())]
                rows += [top, np.minimum(top, put_in)]
                y += [1, 1]
            else:
                rows += [bag[i] for i in np.argsort(-margins)[:4]] + [blank]
                y += [-1] * (min(4, len(bag)) + 1)
        x, sign = np.array(rows) @ root, np.array(y, float)
        cost = np.where(sign > 0, 1 / max(1, (sign > 0).sum()), 1 / max(1, (sign < 0).sum())) * 100
        w = _svm(x, sign, cost)
    model = Model(landmarks, root @ w[:-1], float(w[-1]))
    model.curve = _logistic(np.array([model.evidence(rows, n) for rows, _, n in read]), np.array(labels))
    return model


def _put_in(landmarks: list[str]) -> np.ndarray:
    """Kernel value of each landmark with one strange letter put into its middle."""
    return np.array([kernel([z[: len(z) // 2 + 1] + "¤" + z[len(z) // 2 + 1 :]], [z])[0, 0] for z in landmarks])


def _logistic(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Ridge logistic weights by Newton steps, towards Platt's smoothed targets; the last column is constant."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ w)
        w = w + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


_scorers: dict[tuple[str, ...], Scorer] = {}


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = _scorers.setdefault(tuple(model.landmarks), Scorer(model.landmarks))
    for batch in batches:
        texts = [x or "" for x in batch.column(2).to_pylist()]
        read = scorer.read(texts) if model.landmarks else [(np.zeros((0, 0)), None, 0)] * len(texts)
        score = model.score(np.array([model.evidence(rows, n) for rows, _, n in read]).reshape(-1, len(model.curve)))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    scorer.forget()


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out: at most ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE``
    documents, the first by a hash of doc_id, of at most ``SAMPLE_CHARS`` characters.  Only text and label are used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~_held_out())
    # a document with both labels teaches nothing
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").select("doc_id", "toxic")
    order = F.xxhash64("doc_id", F.lit(7))
    some = known.where("toxic = 1").orderBy(order).limit(TOXIC_SAMPLE).union(known.where("toxic = 0").orderBy(order).limit(CLEAN_SAMPLE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    # at most TOXIC_SAMPLE + CLEAN_SAMPLE ids, and so as many texts (repeated rows of an id count once)
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    # one task learns: neither the texts nor what learning takes stay in the driver
    found = map_arrow(rows.repartition(1), _fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else Model()


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine trained on all rows (doc_id, text, toxic) of the task, pickled; no row where they lack a class."""
    rows = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    labels = [y for _, _, y in rows]
    if 0 in labels and 1 in labels:
        yield pa.record_batch([pa.array([pickle.dumps(fit([x for _, x, _ in rows], labels))], pa.binary())], names=["model"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), with a machine trained on ``labels``
    (doc_id, toxic) by ``train``.

    Texts are lower-cased and split at blanks; a token counts by its letters, so characters put between them do not matter,
    by those of its stretches between other characters, and, where there are more than ``UNIT`` of them, by those from any
    letter on; letters spelled with blanks between them are one token more.  The machine is trained on sentences; a text's score
    is a logistic curve over its margins: the three largest of its tokens', how many are positive, and, as in a long text some
    are by chance, the text's length.  A null or empty text scores as one without telling words, a very long one is read whole.
    Repeated rows score alike; other columns are not read; an empty table gives none.  If the labels hold no or only one class, all scores are
    equal and below 0.5.  Rows without doc_id are scored and count as held out."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, partial(_scores, model=model), "doc_id long, held_out boolean, score double, predicted int")


def _passed(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = _scorers.setdefault(tuple(model.landmarks), Scorer(model.landmarks))
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        if not model.landmarks or not texts:
            yield batch
            continue
        score = model.score(np.array([model.evidence(rows, n) for rows, _, n in scorer.read(texts)]))
        yield batch.filter(pa.array(score < 0.5))
    scorer.forget()


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below 0.5; rows and cases as in ``toxicity``."""
    return map_arrow(docs, partial(_passed, model=train(docs, labels)), docs.schema)
