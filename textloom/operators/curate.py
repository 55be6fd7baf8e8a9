"""Quotas, splits, samples and status rules of dataset curation."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*parts: Column, seed: str = "s") -> Column:
    """A stable pseudo-random order: the hex SHA-256 of the seed and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def hash_split(category: Column, scene: Column, key: Column, cuts: Sequence[tuple[str, int]] = (("train", 900), ("dev", 950), ("test", 1000))) -> Column:
    """Split by the first 48 bits of a SHA-256 modulo 1000, so that equal keys always fall together."""
    bucket = F.conv(F.substring(F.sha2(F.concat_ws("|", category, scene, key), 256), 1, 12), 16, 10).cast("long") % 1000
    out = F.lit(cuts[-1][0])
    for name, below in reversed(cuts[:-1]):
        out = F.when(bucket < below, F.lit(name)).otherwise(out)
    return out


def largest_remainder(total: int, weights: Mapping[str, float]) -> dict[str, int]:
    """Whole quotas that add up to ``total``: floors first, then one each by largest remainder, ties in given order."""
    parts = {k: Fraction(str(w)) for k, w in weights.items()}
    all_ = sum(parts.values())
    exact = {k: total * w / all_ for k, w in parts.items()}
    out = {k: int(x) for k, x in exact.items()}
    left = total - sum(out.values())
    for k in sorted(exact, key=lambda k: -(exact[k] - out[k]))[:left]:
        out[k] += 1
    return out


def largest_remainder_quotas(weights: DataFrame, total: int) -> DataFrame:
    """``weights`` (name, weight, position) -> (name, quota)."""
    whole = weights.withColumn("exact", F.lit(total) * F.col("weight") / F.sum("weight").over(Window.partitionBy()))
    ranked = whole.withColumn("base", F.floor("exact")).withColumn("rank", F.row_number().over(Window.orderBy((F.col("exact") - F.floor("exact")).desc(), "position")))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    return ranked.select("name", (F.col("base") + F.when(F.col("rank") <= left, 1).otherwise(0)).cast("long").alias("quota"))


def take_until(rows: DataFrame, by: str, order: str, passed: str, targets: DataFrame) -> DataFrame:
    """Of each group the first rows in order that passed, up to the group's target (``targets``: group, target)."""
    ranked = rows.where(passed).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return ranked.join(targets, by).where("rank <= target").drop("rank", "target")


def stratified_split(rows: DataFrame, strata: Sequence[str], id_: str, ratio: float, seed: str = "s") -> DataFrame:
    """``held`` is true for int(n * ratio) rows of each stratum, and for one at least where it has five or more."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must lie in [0, 1]")
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(F.col(id_), seed=seed), id_))
    want = F.floor(n * F.lit(ratio))
    want = F.when((want == 0) & (n >= 5) & F.lit(ratio > 0), 1).otherwise(want)
    return rows.withColumn("held", rank <= want)


def grouped_split(rows: DataFrame, group: str, strata: Sequence[str], ratio: float, seed: str = "s") -> DataFrame:
    """``held`` by whole groups: larger groups first, ties by hash, a group is held out iff that brings the strata's counts
    closer to their targets in squares.

    What reaches the driver is one row for each group and stratum; rows get their side by a join."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must lie in [0, 1]")
    counts = rows.groupBy(group, *strata).agg(F.count(F.lit(1)).alias("n")).withColumn("order", hash_order(F.col(group), seed=seed)).collect()
    groups: dict = {}
    total: dict[tuple, int] = {}
    for r in counts:
        stratum = tuple(r[s] for s in strata)
        groups.setdefault((r[group], r["order"]), {})[stratum] = r["n"]
        total[stratum] = total.get(stratum, 0) + r["n"]
    target, now, held = {s: n * ratio for s, n in total.items()}, dict.fromkeys(total, 0), []
    for (name, _), sizes in sorted(groups.items(), key=lambda g: (-sum(g[1].values()), g[0][1])):
        gain = sum((now[s] + n - target[s]) ** 2 - (now[s] - target[s]) ** 2 for s, n in sizes.items())
        if gain < 0:
            held.append((name,))
            for s, n in sizes.items():
                now[s] += n
    side = rows.sparkSession.createDataFrame(held, rows.select(group).schema).withColumn("held", F.lit(True))
    return rows.join(side, group, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def ledger_status(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """``status`` of ``rows`` (seq, id, category, source, target, verdict): rejected if not passed; conflict if the
    normalised source has several targets among passed rows; duplicate after the first of equal source; quota_full beyond the
    category's quota (``quotas``: category, quota); else accepted.  Conflicts are found before quotas are filled."""
    norm = F.trim(F.regexp_replace(F.col("source"), r"\s+", " "))
    rows = rows.withColumn("norm", norm)
    passed = rows.where("verdict = 'pass'")
    clash = passed.groupBy("category", "norm").agg((F.count_distinct("target") > 1).alias("clash"), F.min("seq").alias("first"))
    marked = rows.join(clash, ["category", "norm"], "left").withColumn("candidate", (F.col("verdict") == "pass") & ~F.coalesce("clash", F.lit(False)) & (F.col("seq") == F.col("first")))
    rank = F.sum(F.col("candidate").cast("int")).over(Window.partitionBy("category").orderBy("seq"))
    status = (
        F.when(F.col("verdict") != "pass", "rejected").when(F.col("clash"), "conflict").when(~F.col("candidate"), "duplicate")
        .when(F.col("rank") > F.coalesce("quota", F.lit(0)), "quota_full").otherwise("accepted")
    )
    return marked.withColumn("rank", rank).join(F.broadcast(quotas), "category", "left").select("seq", "category", "norm", status.alias("status"))


def round_robin(rows: DataFrame, stratum: str, id_: str, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows, one of each stratum in turn, strata in order and rows of a stratum by hash."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(id_), seed=seed), id_))
    return rows.withColumn("turn", turn).orderBy("turn", stratum).limit(n)


def spaced(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows evenly spaced in order (all, if there are no more)."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy())
    numbered = rows.withColumn("place", place).withColumn("size", size)
    step = F.floor(F.col("place") * F.lit(n) / F.col("size"))
    before = F.floor((F.col("place") - 1) * F.lit(n) / F.col("size"))
    return numbered.where((F.col("size") <= n) | (F.col("place") == 0) | (step > before)).drop("place", "size")


def set_cover(memberships: DataFrame, limit: int) -> list:
    """Greedy cover of ``memberships`` (clip, term): ``limit`` clips at most, each the one with most terms not yet covered,
    ties by clip.  Counting and removing terms are joins; the driver sees one row a round."""
    chosen, left = [], memberships.select("clip", "term").distinct()
    for _ in range(limit):
        best = left.groupBy("clip").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "clip").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["clip"])
        left = left.join(left.where(F.col("clip") == F.lit(best[0]["clip"])).select("term"), "term", "left_anti")
    return chosen


def plan_batch(quotas: Mapping[str, int], retained: Mapping[str, int], size: int, first: int, seed: str = "s") -> list[tuple[int, str]]:
    """(serial, scene) of the next candidates: always the scene with the largest share of its quota still open, and no more
    than that; the order of a batch is that of a hash."""
    left = {s: n - retained.get(s, 0) for s, n in quotas.items()}
    picked: list[str] = []
    for _ in range(min(size, sum(max(0, n) for n in left.values()))):
        scene = max(left, key=lambda s: left[s] / max(1, quotas[s]))
        left[scene] -= 1
        picked.append(scene)
    order = sorted(range(len(picked)), key=lambda i: hashlib.sha256(f"{seed}|{first}|{i}".encode()).digest())
    return [(first + i, picked[j]) for i, j in enumerate(order)]
