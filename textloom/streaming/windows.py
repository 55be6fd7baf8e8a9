"""Windows over sessions of growing text: what is settled, what is used again, and what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.pieces import joined
from textloom.functions.windows import sentences_of, windows_of


def _own() -> Window:
    return Window.partitionBy("session_id").orderBy("revision_no")


def stable_windows(text: Column, limit: int = 700, group: int = 3) -> Column:
    """struct(stable, active): the windows of all complete groups of sentences, which more text cannot change, and those of the
    rest; of a single overlong rest all windows but the last are settled as well."""
    all_ = sentences_of(text)
    ended = F.filter(all_, lambda s: s.rlike(r"[.!?。！？][\"'”’»)\]}）】」』]*\s*$"))
    # only the last sentence may lack its mark
    complete = F.when(F.size(ended) == F.size(all_), F.size(all_)).otherwise(F.size(all_) - 1)
    settled = (F.floor(complete / group) * group).cast("int")
    head = F.array_join(F.slice(all_, 1, F.greatest(settled, F.lit(0))), "")
    tail = F.array_join(F.slice(all_, settled + 1, F.greatest(F.size(all_) - settled, F.lit(0))), "")
    rest = windows_of(tail, limit, group)
    forced = F.when((F.size(all_) - settled == 1) & (F.length(tail) > limit), F.size(rest) - 1).otherwise(0)
    some = lambda w: F.filter(w, lambda x: F.trim(x) != "")
    stable = F.concat(windows_of(head, limit, group), F.slice(rest, 1, F.greatest(forced, F.lit(0))))
    active = F.slice(rest, forced + 1, F.greatest(F.size(rest) - forced, F.lit(0)))
    return F.struct(some(stable).alias("stable"), some(active).alias("active"))


def translation_snapshots(updates: DataFrame, limit: int = 700, group: int = 3) -> DataFrame:
    """``updates`` (session_id, revision_no, text) -> the windows of each revision, which of them the revision before had (their
    results are used again), and how many characters are new work."""
    cut = updates.select("session_id", "revision_no", stable_windows(F.col("text"), limit, group).alias("w"))
    cut = cut.select("session_id", "revision_no", "w.stable", F.concat("w.stable", "w.active").alias("windows"))
    before = F.coalesce(F.lag("windows").over(_own()), F.array().cast("array<string>"))
    fresh = F.filter("windows", lambda x: ~F.array_contains(F.col("before"), x))
    counted = cut.withColumn("before", before).withColumn("fresh", F.array_distinct(fresh))
    total = F.aggregate("fresh", F.lit(0), lambda s, x: s + F.length(x))
    return counted.select("session_id", "revision_no", F.size("windows").alias("windows"), F.size("stable").alias("stable_windows"), F.size("fresh").alias("calls"), (F.size("windows") - F.size("fresh")).alias("hits"), total.alias("source_characters"))


def active_windows(chunks: DataFrame, size: int = 3, limit: int = 80) -> DataFrame:
    """``chunks`` (session_id, chunk, text): after each chunk, the window that is rewritten as a whole: the latest chunks, at most
    ``size`` and ``limit`` characters (one chunk always), and where it starts."""
    own = Window.partitionBy("session_id").orderBy("chunk")
    recent = F.reverse(F.collect_list(F.struct("chunk", "text")).over(own.rowsBetween(-(size - 1), 0)))
    reach = F.aggregate(recent, F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("open")), _reached(limit))["n"]
    taken = F.reverse(F.slice("recent", 1, F.col("n")))
    return chunks.withColumn("recent", recent).withColumn("n", reach.cast("int")).select("session_id", "chunk", taken[0]["chunk"].alias("start"), joined(F.transform(taken, lambda x: x["text"])).alias("window"), F.col("n"))


def _reached(limit: int):  # noqa: ANN202
    def step(s: Column, x: Column) -> Column:
        more = s["open"] & ((s["n"] == 0) | (s["chars"] + F.length(x["text"]) <= limit))
        return F.struct((s["n"] + more.cast("int")).alias("n"), F.when(more, s["chars"] + F.length(x["text"])).otherwise(s["chars"]).alias("chars"), more.alias("open"))

    return step


def displayed(raw: Column, spans: Column) -> Column:
    """struct(committed, active, pending, text): accepted rewrites (array of struct(source, clean, committed)) for as long as
    their sources are what the newest text begins with, then the rest of it as it is."""
    text = F.trim(raw)
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(True).alias("fits"))

    def step(s: Column, x: Column) -> Column:
        fits = s["fits"] & (x["source"] != "") & (F.substring(text, s["at"] + 1, F.length(x["source"])) == x["source"])
        return F.struct(F.when(fits, s["at"] + F.length(x["source"])).otherwise(s["at"]).alias("at"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("fits"))

    state = F.aggregate(spans, empty, step)
    kept = F.slice(spans, 1, state["n"])
    of = lambda yes: joined(F.transform(F.filter(kept, lambda x: x["committed"] == yes), lambda x: x["clean"]))
    clean = joined(F.transform(kept, lambda x: x["clean"]))
    pending = F.substring(text, state["at"] + 1, F.length(text))
    return F.struct(of(True).alias("committed"), of(False).alias("active"), pending.alias("pending"), joined(F.array(clean, pending)).alias("text"))


def display_stream(updates: DataFrame, accepted: DataFrame) -> DataFrame:
    """What a session shows at each of ``updates`` (session_id, revision_no, text): the latest of ``accepted`` (session_id,
    revision_no, spans) that is not of a later revision, and the raw tail."""
    results = accepted.select("session_id", F.col("revision_no").alias("of"), "spans")
    best = updates.join(results, "session_id", "left").where("of is null or of <= revision_no").groupBy("session_id", "revision_no").agg(F.max_by("spans", "of").alias("spans"))
    none = F.array().cast("array<struct<source:string,clean:string,committed:boolean>>")
    shown = updates.join(best, ["session_id", "revision_no"], "left").select("session_id", "revision_no", displayed(F.col("text"), F.coalesce("spans", none)).alias("d"))
    return shown.select("session_id", "revision_no", "d.*")


def grouped_reuse(updates: DataFrame, size: int = 3) -> DataFrame:
    """``updates`` (session_id, revision_no, chunks array<string>, is_final): chunks in fixed groups of ``size``, and why each
    group is worked on: ``reuse`` where the revision before had it with the same neighbours, ``context_changed`` where only a
    neighbour is another, else ``no_match``.  An open session holds its last, incomplete group back."""
    n = F.when(F.col("is_final"), F.ceil(F.size("chunks") / size)).otherwise(F.floor(F.size("chunks") / size)).cast("int")
    whole = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: joined(F.slice(F.col("chunks"), i * size + 1, size)))).otherwise(F.array().cast("array<string>"))
    told = updates.select("session_id", "revision_no", whole.alias("groups"))
    told = told.withColumn("before", F.coalesce(F.lag("groups").over(_own()), F.array().cast("array<string>")))
    each = told.select("session_id", "revision_no", "groups", "before", F.posexplode("groups").alias("grp", "text"))
    at = lambda c, i: F.coalesce(F.try_element_at(c, i), F.lit(""))
    same = lambda d: F.when(F.col("grp") + d < 1, F.lit(True)).otherwise(at("groups", F.col("grp") + d) == at("before", F.col("grp") + d))
    reason = F.when(~same(1), "no_match").when(same(0) & same(2), "reuse").otherwise("context_changed")
    return each.select("session_id", "revision_no", "grp", "text", reason.alias("reason"))


def queue_of_latest(requests: DataFrame) -> DataFrame:
    """``requests`` (session_id, revision_no, ts, started_at, is_final): a waiting request is superseded by a newer one that comes
    before it starts; a final one never is."""
    newer = F.lead("ts").over(_own())
    gone = ~F.col("is_final") & newer.isNotNull() & (newer <= F.col("started_at"))
    return requests.select("session_id", "revision_no", F.when(gone, "superseded").otherwise("served").alias("state"))


def merged_corrections(chunks: DataFrame, limit: int = 100, back: int = 3) -> DataFrame:
    """``chunks`` (session_id, chunk, text): a chunk that begins with a correction belongs to the clause before it, as long as
    that is at most ``back`` chunks back and the group stays within ``limit`` characters; (session_id, first, n, text)."""
    from textloom.functions.windows import CUES

    own = Window.partitionBy("session_id").orderBy("chunk")
    cue = F.col("text").rlike(rf"^\s*(?:{'|'.join(CUES)})")
    # a correction opens its group at the chunk before it; the chunk behind a bare cue completes it
    bare = F.col("text").rlike(rf"^\s*(?:{'|'.join(CUES)})[\s,，、。；;]*$")
    marked = chunks.withColumn("starts", ~cue & ~F.coalesce(F.lag(bare).over(own), F.lit(False)))
    grouped = marked.withColumn("grp", F.sum(F.col("starts").cast("int")).over(own))
    sized = grouped.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "grp").orderBy("chunk")) - 1).withColumn("chars", F.sum(F.length("text")).over(Window.partitionBy("session_id", "grp").orderBy("chunk")))
    part = F.when((F.col("place") <= back) & (F.col("chars") <= limit), 0).otherwise(F.col("place"))
    whole = sized.groupBy("session_id", "grp", part.alias("part")).agg(F.min("chunk").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"))
    return whole.select("session_id", "first", "n", F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"))
