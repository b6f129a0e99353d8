"""Mixing sources to target weights, with DataFrame operations only.

Sources share `share` times all words by weight. No target goes above `most` times its source: sources are range-sorted by the ratio
of that cap to their weight, and prefix sums of caps and weights tell which are cut, and what is left for the others. Documents get
hash-random keys, are range-sorted by source and key, and prefix sums of their words give every document its place within its
source. A source of s words with a budget of b takes every document b // s times whole (epochs), and of the next epoch the words
before place b % s: the budget is met to the word, and the document at the cut gives its first words.

A prefix sum is made of two sums: a running one within each range, and one over the ranges' totals (one row a range). Ranges are cut
by source and key, so a source of any share of the rows is spread over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.llm.common import fresh, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 0


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum of its expression over all earlier rows in the order, which ought to be total."""
    (part,) = fresh([*df.columns, *sums], "__range")
    ranged = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "mix-ranges")
    inside = W.partitionBy(part).orderBy(*order)
    totals = ranged.groupBy(part).agg(*(F.sum(e).alias(n) for n, e in sums.items()))  # one row a range
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col(part).alias("r"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o{k}") for k, n in enumerate(sums)))
    local = ranged.withColumns({n: F.sum(e).over(inside.rowsBetween(W.unboundedPreceding, 0)) - e for n, e in sums.items()})
    return local.join(offsets, F.col(part) == F.col("r")).withColumns({n: F.col(n) + F.col(f"o{k}") for k, n in enumerate(sums)}).drop(part, "r", *(f"o{k}" for k in range(len(sums))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources: source, source_size. They with start (words of the sources before), weight and target (double)."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running(sources, by_name, {"start": F.col("source_size"), "rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    capped = ranked.select("source", "source_size", "start", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    every = capped.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, total = every.size or 0, every.weight or 0
    placed = running(capped, [F.col("cap") / F.col("weight"), *by_name], {"gone_cap": F.col("cap"), "gone_weight": F.col("weight")})
    left = F.lit(share * size) - F.col("gone_cap")
    placed = placed.withColumn("cut", F.col("cap") * (F.lit(total) - F.col("gone_weight")) < left * F.col("weight"))
    taken = placed.filter("cut").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    rest, weighs = share * size - (taken.cap or 0), total - (taken.weight or 0)
    even = F.col("weight") * F.lit(rest) / F.lit(max(weighs, 1))
    return placed.select("source", "source_size", "start", "weight", F.when(F.col("cut"), F.col("cap").cast("double")).otherwise(even).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, tie (a hash of the text), source, size, source_size, target, epochs (times the whole text is
    taken) and part (words of its beginning taken once more); taken is epochs * size + part.

    Null texts have no words. Null sources are one source, the last; the empty name is one of its own. Null ids and repeated ids are
    rows like others; rows alike in id, source and text are interchangeable, and the mix of a table is the same in every run.
    Documents without words take none. A budget is the target rounded to whole words. An empty table gives an empty one.
    Other columns are not read, whatever their names."""
    text = F.col(text_col).cast("string")
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    narrow = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    narrow = stored(narrow, "mix-sizes")  # texts are read once; the numbers of repeated rows stay what they are
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("id"), F.col("tie"), F.col("row")]
    placed = running(narrow, order, {"place": F.col("size")})
    found = placed.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    cut = budget - whole * F.col("source_size")
    part = F.least(F.greatest(cut - (F.col("place") - F.col("start")), F.lit(0)), F.col("size"))
    return found.select("id", "tie", "source", "size", "source_size", "target", F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("epochs"), part.cast("long").alias("part"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epoch_col: str = "epoch", **options) -> DataFrame:
    """The mix itself: rows of docs, once for each epoch that takes them (epoch_col, from 1), the text cut where only its beginning
    is taken. Options as of mix()."""
    id_, tie, source, epochs, part, size, span = fresh([*docs.columns, epoch_col], "__id", "__tie", "__source", "__epochs", "__part", "__size", "__span")
    plan = mix(docs, id_col, text_col, source_col, **options).filter("epochs > 0 or part > 0")
    # Rows alike in id, source and text are taken together: their takes are lists of equal length, matched by rank.
    rank = lambda df, keys: df.withColumn(size, F.row_number().over(W.partitionBy(*keys).orderBy(*keys)))
    plan = rank(plan.select(F.col("id").alias(id_), F.col("tie").alias(tie), F.col("source").alias(source), F.col("epochs").alias(epochs), F.col("part").alias(part)), [id_, tie, source]).withColumnRenamed(size, span)
    text = F.col(text_col).cast("string")
    rows = docs.withColumns({f"{id_}d": F.col(id_col), f"{tie}d": F.xxhash64(text), f"{source}d": F.col(source_col).cast("string")})
    keys = [id_, tie, source]
    rows = rank(rows, [f"{k}d" for k in keys])
    on = F.col(size) == F.col(span)
    for k in keys:
        on &= F.col(f"{k}d").eqNullSafe(F.col(k))
    both = rows.join(plan, on).withColumn(epoch_col, F.explode(F.sequence(F.lit(1), (F.col(epochs) + F.when(F.col(part) > 0, 1).otherwise(0)).cast("int"))))
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col(part).cast("int")), "")
    return both.withColumn(text_col, F.when(F.col(epoch_col) <= F.col(epochs), F.col(text_col)).otherwise(begun)).select(*docs.columns, epoch_col)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1
), w AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS gone_cap, coalesce(sum(weight) OVER b, 0) AS gone_weight, 1.5 * sum(source_size) OVER () AS share, sum(weight) OVER () AS total
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (
  SELECT *, cap * (total - gone_weight) < (share - gone_cap) * weight AS cut FROM c
), r AS (
  SELECT coalesce(sum(cap) FILTER (cut), 0) AS cap, coalesce(sum(weight) FILTER (cut), 0) AS weight FROM k
), t AS (
  SELECT source, source_size, CASE WHEN cut THEN CAST(k.cap AS DOUBLE) ELSE k.weight * CAST(share - r.cap AS DOUBLE) / greatest(total - r.weight, 1) END AS target FROM k, r
), p AS (
  SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) - size AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - place, 0), size) END AS BIGINT) AS taken FROM p
"""
