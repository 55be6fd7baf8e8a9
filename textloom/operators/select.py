"""Selection of a balanced set from ranked candidates, and what guards a run that goes on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.simjoin import Among, first_wins, similar_pairs
from textloom.operators.work import cut

#: Rounds of the cascade that may pass without an end in sight; each decides at least one candidate.
ROUNDS = 10_000


def selection_rank(tier: Column, id_: Column, seed: str) -> Column:
    """Candidates in order: a better tier first, then a hash seeded by ``seed``."""
    return F.concat(tier.cast("string"), F.sha2(F.concat(F.lit(seed), id_.cast("string")), 256))


def heldout_overlap(candidates: DataFrame, heldout: DataFrame, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """(id, overlap): exact or near, for candidates (id, source, target) of which either text is, or is similar to, one of
    ``heldout`` (text)."""
    texts = candidates.select("id", F.explode(F.array("source", "target")).alias("text"))
    exact = texts.join(heldout.select("text").distinct(), "text", "left_semi").select("id").distinct().withColumn("overlap", F.lit("exact"))
    numbered = cut(texts.select("id", "text").distinct().withColumn("n", F.monotonically_increasing_id()), "texts")
    known = cut(heldout.select("text").distinct().withColumn("id", F.monotonically_increasing_id()), "heldout")
    pairs = Among(numbered.select(F.col("n").alias("id"), "text"), threshold, n).like(known).select(F.col("b").alias("n"))
    near = numbered.join(pairs.distinct(), "n").select("id").distinct().join(exact, "id", "left_anti").withColumn("overlap", F.lit("near"))
    return exact.union(near)


def balanced_selection(candidates: DataFrame, quotas: DataFrame, heldout: DataFrame, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """(id, state) for ``candidates`` (id long, rank string, category, source, target, grp), by ``quotas`` (category, quota).

    In order of rank: what overlaps ``heldout`` (text) is ``heldout_overlap``; what has the source or group of a selected one is
    ``duplicate``; what is similar to a selected one in source or target is ``near_duplicate``; beyond the category's quota it
    is ``reserve``; else ``selected``.  Sources with several targets are ``quarantined`` before.

    That is a sequential walk, done in rounds: of each open category the next candidates, as many as it may still take, decide
    among themselves (``first_wins`` over shared sources, groups and similarity), up to the rank where the first of these
    windows ends, beyond which a category might offer others.  Only the selected are compared with all candidates, so the work
    is the quotas' sum times the candidates', and copies are joined on what they share with a selected one, never in pairs."""
    ranked = candidates.withColumn("place", F.struct("rank", "id"))
    several = ranked.groupBy("source").agg(F.min("target").alias("low"), F.max("target").alias("high")).where("low <> high").select("source")
    quarantined = cut(ranked.join(several, "source", "left_semi").select("id", F.lit("quarantined").alias("state")), "quarantined")
    open_ = ranked.join(quarantined, "id", "left_anti")
    overlap = cut(heldout_overlap(open_.select("id", "source", "target"), heldout, threshold, n).select("id", F.lit("heldout_overlap").alias("state")), "overlap")
    # numbered by rank, so that earlier is smaller
    left = open_.join(overlap, "id", "left_anti").repartitionByRange("rank", "id").sortWithinPartitions("rank", "id")
    left = cut(left.select("id", "category", "source", "target", "grp", F.monotonically_increasing_id().alias("no")), "ranked")
    texts = cut(left.select("no", F.explode(F.array_distinct(F.array("source", "target"))).alias("text")).withColumn("t", F.monotonically_increasing_id()), "texts")
    among = Among(texts.select(F.col("t").alias("id"), "text"), threshold, n)
    state = left.select("no", "category", F.lit(False).alias("chosen"), F.lit(None).cast("int").alias("kind"))
    for _ in range(ROUNDS):
        taken = state.where("chosen").groupBy("category").agg(F.count("no").alias("taken"))
        spare = state.where("not chosen and kind is null").join(F.broadcast(quotas.select("category", "quota")), "category", "left").join(F.broadcast(taken), "category", "left")
        spare = spare.withColumn("spare", F.coalesce("quota", F.lit(0)) - F.coalesce("taken", F.lit(0))).where("spare > 0")
        turns = cut(spare.withColumn("turn", F.row_number().over(Window.partitionBy("category").orderBy("no"))).where(F.col("turn") <= F.col("spare")).select("no", "category"), "turns")
        horizon = turns.groupBy("category").agg(F.max("no").alias("last")).agg(F.min("last")).first()[0]
        if horizon is None:
            break
        window = turns.where(F.col("no") <= horizon).select("no")
        open_ = cut(left.join(window, "no", "left_semi").select("no", "source", "grp"), "window")
        inside = [open_.select(F.col("no").alias("a"), c).join(open_.select(F.col("no").alias("b"), c), c).where("a < b").select("a", "b") for c in ("source", "grp")]
        own = cut(texts.join(window, "no", "left_semi"), "own")
        alike = similar_pairs(own.select(F.col("t").alias("id"), F.lit("").alias("part"), "text"), threshold, n)
        alike = alike.join(own.select(F.col("t").alias("a"), F.col("no").alias("x")), "a").join(own.select(F.col("t").alias("b"), F.col("no").alias("y")), "b")
        links = cut(inside[0].union(inside[1]).union(alike.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "links")
        won = cut(first_wins(window.select(F.col("no").alias("id")), links).where("kept").select(F.col("id").alias("no")), "won")
        # what these settle, whatever the quotas: candidates behind them with their source or group, or similar
        chosen = open_.join(won, "no", "left_semi")
        same = [left.select("no", c).join(chosen.groupBy(c).agg(F.min("no").alias("a")), c).where("a < no").select("no", F.lit(0).alias("kind")) for c in ("source", "grp")]
        winners = own.join(won, "no", "left_semi")
        near = among.like(winners.select(F.col("t").alias("id"), "text")).join(winners.select(F.col("t").alias("a"), F.col("no").alias("x")), "a")
        near = near.join(texts.select(F.col("t").alias("b"), "no"), "b").where("x < no").select("no", F.lit(1).alias("kind"))
        beaten = same[0].union(same[1]).union(near).groupBy("no").agg(F.min("kind").alias("by"))
        state = state.join(beaten, "no", "left").join(won.withColumn("now", F.lit(True)), "no", "left")
        state = cut(state.select("no", "category", (F.col("chosen") | F.coalesce("now", F.lit(False))).alias("chosen"), F.least("kind", "by").alias("kind")), "state")
    # what is left of full categories was never beaten
    named = F.when(F.col("chosen"), "selected").when(F.col("kind") == 0, "duplicate").when(F.col("kind") == 1, "near_duplicate").otherwise("reserve")
    done = left.select("no", "id").join(state, "no").select("id", named.alias("state"))
    return done.union(overlap).union(quarantined)


def paired_bootstrap(groups: DataFrame, replicates: int, seed: str = "p") -> DataFrame:
    """(replicate, gain): ``groups`` (grp, hits_a, total_a, hits_b, total_b) resampled as wholes, both arms in one draw; the gain
    is rate b minus rate a."""
    from textloom.operators.evaluate import cluster_bootstrap

    arm = lambda x: cluster_bootstrap(groups.select("grp", F.col(f"hits_{x}").alias("hits"), F.col(f"total_{x}").alias("total")), replicates, seed).toDF("replicate", f"rate_{x}")
    return arm("a").join(arm("b"), "replicate").select("replicate", (F.col("rate_b") - F.col("rate_a")).alias("gain"))


def grouped_interval(rates: DataFrame, by: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the column ``rate`` for each group."""
    return rates.groupBy(by).agg(F.percentile("rate", F.lit(low)).alias("low"), F.percentile("rate", F.lit(high)).alias("high"))


def plan_slots(slots: DataFrame, choices: Mapping[str, Mapping[str, float]], seed: str = "plan") -> DataFrame:
    """A seeded categorical choice for every slot (id) and field: equal seeds give equal plans."""
    out = slots
    for field, weights in choices.items():
        total, below = sum(weights.values()), 0.0
        u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(field), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
        pick = None
        for name, w in weights.items():
            below += w / total
            pick = F.when(u < below, name) if pick is None else pick.when(u < below, name)
        out = out.withColumn(field, F.coalesce(pick, F.lit(list(weights)[-1])))
    return out


def config_basis(config: Mapping) -> str:
    """A hash of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def same_basis(stored: str | None, config: Mapping) -> str:
    """The basis under which a run may go on; a run begun under another one must not."""
    now = config_basis(config)
    if stored not in (None, now):
        raise ValueError("this run was begun with another configuration")
    return now
