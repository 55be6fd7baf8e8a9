"""Sessions of text that is revised as it grows: stability, memory and latest-wins, for streams and for batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.edits import revision_ratio
from textloom.functions.windows import Chunker

STABLE_UPDATES, STABLE_MS, SMALL_REVISION = 2, 600.0, 0.20
_ENDS = "。！？!?；;"


class Stability:
    """How settled a session's hypothesis is, update by update."""

    def __init__(self, text: str = "", unchanged: int = 0, changed_ms: float = 0.0):
        self.text, self.unchanged, self.changed_ms = text, unchanged, changed_ms

    def observe(self, text: str, now_ms: float) -> dict:
        text = (text or "").strip()
        before, same = self.text, bool(text) and text == self.text
        self.unchanged = self.unchanged + 1 if same else 0
        self.changed_ms = self.changed_ms if same else now_ms
        self.text = text
        ratio, age = revision_ratio(before, text), max(0.0, now_ms - self.changed_ms)
        ended = text[-1:] in _ENDS and bool(text)
        grown = bool(before) and not same and ratio <= SMALL_REVISION
        settled = ended and self.unchanged >= 1 and age >= STABLE_MS
        stable = bool(text) and (self.unchanged >= STABLE_UPDATES or grown or settled)
        return {"unchanged": self.unchanged, "revision": ratio, "age_ms": age, "complete": ended, "stable": stable}


_STABILITY = "session_id string, revision_no long, text string, unchanged int, revision double, age_ms double, complete boolean, stable boolean"


def _observe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = state.get if state.exists else ("", 0, 0.0, -1)
    seen, last = Stability(*kept[:3]), kept[3]
    rows = pd.concat(list(frames)).sort_values("revision_no")
    out = []
    for r in rows.itertuples():
        if r.revision_no <= last:  # an older revision has been overtaken
            continue
        last = int(r.revision_no)
        out.append({"session_id": key[0], "revision_no": last, "text": r.text} | seen.observe(r.text, r.ts.timestamp() * 1000))
    state.update((seen.text, seen.unchanged, float(seen.changed_ms), last))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _STABILITY.split(", ")])


def track_stability(updates: DataFrame) -> DataFrame:
    """Streaming: ``updates`` (session_id, revision_no, ts, text) -> each accepted revision with its stability."""
    keyed = updates.select(F.col("session_id").cast("string"), F.col("revision_no").cast("long"), "ts", "text")
    return keyed.groupBy("session_id").applyInPandasWithState(_observe, _STABILITY, "text string, unchanged int, changed_ms double, last long", "append", GroupStateTimeout.NoTimeout)


def stability_of(updates: DataFrame) -> DataFrame:
    """The same over a finished table, session by session."""

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen, out = Stability(), []
        for r in rows.sort_values("revision_no").drop_duplicates("revision_no").itertuples():
            out.append({"session_id": key[0], "revision_no": r.revision_no, "text": r.text} | seen.observe(r.text, r.ts.timestamp() * 1000))
        return pd.DataFrame(out)

    keyed = updates.select(F.col("session_id").cast("string"), F.col("revision_no").cast("long"), "ts", "text")
    return keyed.groupBy("session_id").applyInPandas(whole, _STABILITY)


@dataclass
class Heard:
    """One name in a session: how often it came, how sure each independent observation was, and when it was heard last."""

    name: str
    times: int = 0
    sources: dict[str, float | None] = field(default_factory=dict)
    verified: bool = False
    last_ms: float = 0.0

    PROMOTE: ClassVar[int] = 2
    CONFIDENT: ClassVar[float] = 0.8

    @property
    def trust(self) -> str:
        """verified, accepted (enough independent observations, sure on average), observed (heard again), or candidate."""
        sure = [c for c in self.sources.values() if c is not None]
        accepted = min(self.times, len(sure)) >= self.PROMOTE and sum(sure) >= self.CONFIDENT * len(sure)
        return "verified" if self.verified else "accepted" if accepted else "observed" if self.times > 1 else "candidate"


class Memory:
    """What a session has heard.  Names not verified are forgotten after a while, and beyond a number of names the least
    trusted, longest unheard one goes."""

    CAPACITY, TTL_MS = 128, 20 * 60 * 1000.0

    def __init__(self, entries: dict[str, Heard] | None = None):
        self.entries = entries or {}

    def observe(self, name: str, now_ms: float, confidence: float | None = None, observation: str | None = None, verified: bool = False) -> dict:
        kept = {k: e for k, e in self.entries.items() if e.verified or now_ms - e.last_ms <= self.TTL_MS}
        heard = kept.pop(name.strip(), None) or Heard(name.strip())
        sources = heard.sources if observation is None else {observation: confidence} | heard.sources
        heard = replace(heard, times=heard.times + 1, sources=sources, verified=heard.verified or verified, last_ms=now_ms)
        self.entries = kept | {heard.name: heard}
        for _ in range(len(self.entries) - self.CAPACITY):
            worst = min(self.entries.values(), key=lambda e: (e.verified, e.trust == "accepted", e.last_ms, e.times))
            del self.entries[worst.name]
        return {"name": heard.name, "trust": heard.trust, "count": heard.times}

    def trusted(self) -> list[str]:
        return sorted(k for k, e in self.entries.items() if e.trust in ("accepted", "verified"))

    def rows(self, session: str) -> pd.DataFrame:
        return pd.DataFrame([(session, e.name, e.trust, e.times) for e in self.entries.values()], columns=["session_id", "name", "trust", "occurrences"])


def session_memory(observations: DataFrame) -> DataFrame:
    """(session_id, name, trust, occurrences) left at the end of each session of ``observations`` (session_id, ts, name,
    confidence, observation_id)."""

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        memory = Memory()
        for r in rows.sort_values(["ts", "observation_id"]).itertuples():
            memory.observe(r.name, r.ts.timestamp() * 1000, r.confidence, str(r.observation_id))
        return memory.rows(key[0])

    keyed = observations.select(F.col("session_id").cast("string"), "ts", "name", "confidence", "observation_id")
    return keyed.groupBy("session_id").applyInPandas(whole, "session_id string, name string, trust string, occurrences long")


def latest_wins(updates: DataFrame) -> DataFrame:
    """Of each session the update of highest revision; a final one is never replaced."""
    rank = F.struct(F.col("is_final").cast("int").alias("f"), F.col("revision_no").alias("r"))
    return updates.groupBy("session_id").agg(F.max_by("text", rank).alias("text"), F.max(rank).alias("m")).select("session_id", "text", F.col("m.r").alias("revision_no"))


def fixed_groups(chunks: DataFrame, k: int = 3) -> DataFrame:
    """``chunks`` (session_id, chunk, text, is_final) in groups of ``k``; the last chunk of an open session is held back."""
    own = Window.partitionBy("session_id")
    numbered = chunks.withColumn("place", F.row_number().over(own.orderBy("chunk")) - 1).withColumn("size", F.count(F.lit(1)).over(own)).withColumn("closed", F.max("is_final").over(own))
    usable = numbered.where(F.col("closed") | (F.col("place") < F.col("size") - 1))
    return usable.groupBy("session_id", F.floor(F.col("place") / k).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("c")).select("session_id", "grp", F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"), F.size("c").cast("long").alias("n"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by type and tumbling event-time window; on a stream, events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


_CHUNKS = "session_id string, revision_no long, chunk_no int, chunk string, error string"


def _chunk_updates(key: tuple, rows: pd.DataFrame, kept: tuple[str, int, int]) -> tuple[pd.DataFrame, tuple[str, int, int]]:
    """New chunks of a session's updates (revision_no, text, boundary) in order, and its state (committed, next chunk, last
    revision).  A revised committed chunk gives an error row and leaves the state as it was; overtaken revisions are skipped."""
    chunker, last, out = Chunker(committed=kept[0], index=kept[1]), kept[2], []
    for r in rows.sort_values("revision_no").itertuples():
        if r.revision_no <= last:
            continue
        last = int(r.revision_no)
        try:
            out += [(key[0], last, i, c, None) for i, c in chunker.update(r.text or "", bool(r.boundary))]
        except ValueError as error:
            out.append((key[0], last, None, None, str(error)))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _CHUNKS.split(", ")])
    return frame.astype({"chunk_no": "Int32", "revision_no": "int64"}), (chunker.committed, chunker.index, last)


def _chunk_stream(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out, kept = _chunk_updates(key, pd.concat(list(frames)), state.get if state.exists else ("", 0, -1))
    state.update(kept)
    yield out


def chunk_stream(updates: DataFrame) -> DataFrame:
    """Streaming: cumulative ``updates`` (session_id, revision_no, text, boundary) -> chunks as soon as they are complete."""
    keyed = updates.select(F.col("session_id").cast("string"), F.col("revision_no").cast("long"), "text", "boundary")
    return keyed.groupBy("session_id").applyInPandasWithState(_chunk_stream, _CHUNKS, "committed string, next int, last long", "append", GroupStateTimeout.NoTimeout)


def chunks_of_sessions(updates: DataFrame) -> DataFrame:
    """The same over a finished table."""
    keyed = updates.select(F.col("session_id").cast("string"), F.col("revision_no").cast("long"), "text", "boundary")
    return keyed.groupBy("session_id").applyInPandas(lambda key, rows: _chunk_updates(key, rows, ("", 0, -1))[0], _CHUNKS)


_MEMORY = "session_id string, name string, trust string, occurrences long"


def _remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    memory = Memory({k: Heard(**e) for k, e in json.loads(state.get[0]).items()} if state.exists else None)
    for r in pd.concat(list(frames)).sort_values(["ts", "observation_id"]).itertuples():
        memory.observe(r.name, r.ts.timestamp() * 1000, r.confidence, str(r.observation_id))
    state.update((json.dumps({k: asdict(e) for k, e in memory.entries.items()}),))
    yield memory.rows(key[0])


def memory_stream(observations: DataFrame) -> DataFrame:
    """Streaming: what each session touched by a micro-batch remembers after it; at most ``Memory.CAPACITY`` names are state."""
    keyed = observations.select(F.col("session_id").cast("string"), "ts", "name", "confidence", "observation_id")
    return keyed.groupBy("session_id").applyInPandasWithState(_remember, _MEMORY, "entries string", "update", GroupStateTimeout.NoTimeout)
