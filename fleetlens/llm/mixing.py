"""Mixing sources to target weights.

Sizes are summed per source; each source's target follows from its weight, never above
`most` times its own size (the excess goes to the others by weight until none is above);
rate = target / size. A document is emitted floor(rate) times and once more if a number
hashed from its id is below the fraction, so reruns agree and no sample is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import words_pattern

#: Weights dealt in turn to sources in code-point order (null last); share of all sizes to take; most repeats.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2

#: A table of sources with at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Water-filling: sources in ascending order of most * size / weight reach their cap first.
    With the first k capped the level is (total - caps) / (weights left); the smallest k whose
    level is no higher than the next source's ratio is the fixed point of resharing. One row per
    source: that table, not the documents, passes through single-task windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    ratio = F.col("cap") / F.col("w")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (F.col("total") * F.lit(float(share)) - F.col("caps")) / F.col("w_left")
    stepped = (
        weighed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", ratio)
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", level)
    )
    settled = stepped.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull() | (F.col("w") * F.col("level") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return settled.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the md5 of an id's decimal text (null id: of the text, or of 'null')."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("null"))), 1, 8)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs' columns + mix_size, mix_source_size, mix_target, mix_copies (how often to emit the row).

    Null source is a source of its own, null text has size 0; a source of size 0 has target 0
    and its documents are taken 0 times. Repeated rows are separate documents that share
    their luck; rows with a null id take theirs from the text. Only the sums per source are shuffled.
    """
    sized = docs.withColumn("mix_size", n_words(F.col("text")))
    targets = source_targets(sized.select("source", F.col("mix_size").alias("size")), weights, share, most)
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = targets.select(F.col("source").alias("__src"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    joined = sized.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (chance(F.col("doc_id"), F.col("text")) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("mix_copies", copies.cast("int"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, each as often as mix() says."""
    mixed = mix(docs, **how).where("mix_copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), text, 'null') AS own, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
c AS (SELECT *, CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS caps, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS w_left
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(total AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(caps AS DOUBLE)) / CAST(w_left AS DOUBLE) AS lv FROM c),
f AS (SELECT arg_min(lv, ratio) FILTER (lv <= ratio) AS lv FROM l),
t AS (SELECT source, source_size, CASE WHEN f.lv IS NULL OR w * f.lv > cap THEN CAST(cap AS DOUBLE) ELSE w * f.lv END AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS rate,
        CAST(('0x' || substr(md5(d.own), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS luck
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CAST(luck < rate - floor(rate) AS INT)) AS BIGINT) AS taken FROM p
"""
