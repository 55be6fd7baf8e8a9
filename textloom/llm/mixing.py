"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest mean of one Poisson draw; a larger mean is the sum of several draws. Values that a draw can take: the tail beyond
#: them is below 2**-53, the grain of the hash.
PIECE, VALUES = 32.0, 128
#: Sources up to which their table is broadcast; it has one row for each source.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """A double in (0, 1) from the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, targets: Mapping[str, float] | None = None, size: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """(source, rate): the mean number of times a row of each source is wanted.

    The output's expected size is ``size`` times the input's rows, shared out by weight: ``targets`` by source (sources not
    named get none), or each source's number of rows to the power ``alpha``."""
    counts = docs.groupBy(F.col("source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        weighed = counts.withColumn("w", F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("source", F.lit(""))), F.lit(0.0)))
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    return weighed.crossJoin(F.broadcast(total)).select("source", F.when(F.col("all_w") > 0, F.lit(size) * F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, targets: Mapping[str, float] | None = None, size: float = 1.0, alpha: float = 0.5, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` (doc_id, source, ...) as often as its Poisson draw says, in a global random order.

    The draw inverts the distribution function at a uniform number hashed from the seed and doc_id (from the text where
    doc_id is null), so runs repeat and equal rows get equal counts.  Adds ``mix_copy`` (from 1) and ``mix_order``, a hash by
    which rows are dealt over partitions and sorted in each; read in the order of partitions, any prefix is a fair sample.
    A null source is a source of its own; a null or empty text is mixed like any other, and an empty table gives none.  Other
    columns pass through whatever their names; only columns of the two added names are replaced.

    One pass counts rows by source (pre-aggregated, so a source with a third of all rows costs no more); the second explodes
    and shuffles by a uniform key.  Text moves once."""
    docs = docs.drop("mix_copy", "mix_order")
    rates = source_rates(docs, targets, size, alpha).withColumn("pieces", F.ceil(F.col("rate") / PIECE).cast("int")).withColumn("mean", F.col("rate") / F.greatest("pieces", F.lit(1)))
    # the distribution function of one piece, by adding up terms
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(VALUES)),
        F.struct(F.exp(-F.col("mean")).alias("term"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda s, k: F.struct((s["term"] * F.col("mean") / k).alias("term"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["term"] * F.col("mean") / k)).alias("cdf")),
        lambda s: s["cdf"],
    )
    table = rates.select(F.col("source").alias("of"), "pieces", grown.alias("cdf"))
    if table.select("of").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    # the row travels as one struct, so that none of its columns can be taken for one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("row.text"), F.lit("")))))
    draws = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda i: _uniform(F.lit(seed), F.col("key"), i.cast("string")))
    times = F.aggregate(draws, F.lit(0), lambda s, u: s + F.size(F.filter("cdf", lambda c: c < u)))
    drawn = rows.join(table, F.col("row.source").eqNullSafe(F.col("of"))).where("pieces > 0").withColumn("key", key).withColumn("times", times).where("times > 0")
    copies = drawn.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("key"), F.col("copy").cast("string")))
    dealt = copies.select("row", "copy", order.alias("order")).repartition("order").sortWithinPartitions("order")
    return dealt.select("row.*", F.col("copy").alias("mix_copy"), F.col("order").alias("mix_order"))


#: ``mix_sources`` with its defaults, for DuckDB.
MIX_SQL = """
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT source, CAST(ceil(rate / 32.0) AS INT) AS pieces, rate / greatest(ceil(rate / 32.0), 1) AS mean FROM r),
t AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS term FROM p, range(0, 129) x(k) WHERE pieces > 0),
c AS (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
d AS (SELECT documents.*, pieces, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key
      FROM documents JOIN p ON documents.source IS NOT DISTINCT FROM p.source WHERE pieces > 0),
k AS (SELECT DISTINCT key, source, pieces FROM d),
u AS (SELECT key, source, (CAST('0x' || substr(md5('mix:' || key || ':' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
      FROM (SELECT key, source, unnest(range(1, pieces + 1)) AS i FROM k)),
m AS (SELECT u.key, u.source, count(c.k) AS times FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u GROUP BY u.key, u.source)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INT) AS mix_copy, md5('mix:order:' || key || ':' || i) AS mix_order
FROM (SELECT d.*, unnest(range(1, times + 1)) AS i FROM d JOIN m ON d.key = m.key AND d.source IS NOT DISTINCT FROM m.source)
"""
