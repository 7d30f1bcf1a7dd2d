"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Source k in code point order (null last) weighs WEIGHTS[k mod 3]. The sources share `share` times all words by weight;
none gets more than `max_epochs` times its own words, and what it gives up goes to the others by weight
until none is above. A source's documents are all taken floor(target / words) times; what is left is taken
in the order of a seeded hash, whole documents first, and a fraction of the one at the edge.

Only SQL functions are used. The order within a source goes by 4096 hash buckets (sums of buckets, then an
order inside each), so a source that holds a third of all rows is spread over tasks like any other.

Defined cases: a null text has no words; documents without words take 0. A null source is a source of its
own, after the others; the empty string is another. Repeated rows are rows of their own. Sources without
words have the target 0. Extra columns pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, one_of_each, table

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(text: str):
    """A null text and an empty one have different keys."""
    return F.xxhash64(F.col(text).cast("string"), F.col(text).isNull())


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, the seeded order and a key of the text of each row; cut, for its scan and count of words is used twice."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), order.alias("draw"), key_of("text").alias("text_key")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target. The sources (not the documents) are put in order in one task, after they were summed."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    own = own.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(max_epochs))})
    # Filled from the source that reaches its cap first; level: what a weight of 1 gets if this and all later ones are not capped.
    by_fill = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    everywhere = W.partitionBy(F.lit(0))
    budget = F.least(F.sum("source_size").over(everywhere) * F.lit(float(share)), F.sum("cap").over(everywhere))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    own = own.withColumns({"level": level})
    own = own.withColumn("free", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everywhere))
    return own.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target"))


def draws(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """sizes with source_size, target, whole (repetitions of every document) and taken (words)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = sizes.withColumns({"key": key, "bucket": F.substring("draw", 1, 3)})
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")
    goals = goals.withColumns({"key": key, "whole": whole}).withColumn("extra", extra).drop("source")
    starts = sums.withColumn("start", F.coalesce(before, F.lit(0))).drop("bucket_size").join(goals, "key")
    inside = F.sum("size").over(W.partitionBy("key", "bucket").orderBy("draw", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1))
    found = rows.join(starts, ["key", "bucket"]).withColumn("at", F.col("start") + F.coalesce(inside, F.lit(0)))
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("extra") - F.col("at")))
    return found.withColumns({"part": part, "taken": F.col("whole") * F.col("size") + part}).drop("key", "bucket", "start", "at", "extra", "draw")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_key, source_size, target, whole, part, taken for every row of docs."""
    sizes = sized(docs, seed)
    return draws(sizes, targets(sizes, weights, share, max_epochs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, and at a source's edge the first `part` words of one more.

    Rows that agree in id, source and text are taken as one row with the copies of all; rows that differ in one of them by what each is planned.
    """
    names, size, part = docs.columns, F.col("size"), F.col("part")
    edge = (part > 0) & (part < size)
    plan = mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("text_key").alias("_key"))
    plan = cut(plan.agg(F.sum(F.col("whole") + F.when((part > 0) & ~edge, 1).otherwise(0)).alias("_copies"), F.max(F.when(edge, part)).alias("_part"), F.count(F.lit(1)).alias("_rows")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_from")) & (key_of("text") == F.col("_key"))
    again = plan.filter("_rows > 1").select("_id", "_from", "_key")
    if not again.isEmpty():
        docs = docs.join(again, same, "left_anti").unionByName(one_of_each(docs.join(again, same, "left_semi"), "source"))
    held = docs.join(plan, same).withColumn("_last", F.col("_copies") + F.col("_part").isNotNull().cast("long")).filter("_last > 0")
    held = held.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last")))).withColumn("_cut", F.col("_copy") > F.col("_copies"))
    # The words are cut by their count only where a document is partial.
    pieces = F.slice(F.regexp_extract_all("text", F.lit(rf"(?s)[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("_part").cast("int"))
    held = held.withColumn("text", F.when(F.col("_cut"), F.array_join(pieces, "")).otherwise(F.col("text")))
    return held.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*names) if "n_chars" in names else held.select(*names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1:' || doc_id) AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), g AS (
  SELECT source, source_size, least(cap, coalesce((max(CASE WHEN level * weight <= cap THEN level END) OVER ()) * weight, cap)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g
), p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, floor(e.target - e.whole * e.source_size + 0.5)::BIGINT AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + least(size, greatest(0, extra - ahead)))::BIGINT AS taken FROM p
"""
