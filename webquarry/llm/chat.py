"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is written once with that speaker as the assistant, the
others as named users, and spans that bear loss: the speaker's own texts with their end marks. System turns
are context in every rendering, not a participant; a conversation of system turns only has one rendering
for the participant "" without loss.

A rendering comes in parts of at most PART_TURNS turns, so one conversation with a third of all turns is
many rows, put together in many tasks: turns are ordered by ranges over the whole table, numbered within
ranges, and the ranges' counts are added up.

Defined cases: null texts and roles are empty strings; a null conv_id is one conversation; turns are ordered by
turn (null first), then role, then text, and repeated rows are turns of their own. An end or start mark
inside a text gets a backslash, which can be undone. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

PART_TURNS = 64
BROADCAST_SPEAKERS = 50_000
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text):
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, at (0, 1, ... within the conversation), role, text."""
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("range", "conv_id").orderBy("turn", "role", "text")) - 1
    found = ranged.withColumn("inside", inside).join(starts, (F.col("range") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return found.select("conv_id", (F.col("start") + F.col("inside")).alias("at"), "role", "text")


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, n_chars, loss_spans ("begin-end;..." in code points of the part), loss_chars."""
    rows = numbered(turns)
    speakers = rows.groupBy("conv_id", "role").agg(F.lit(1).alias("one")).drop("one")
    others = F.max((F.col("role") != SYSTEM).cast("int")).over(W.partitionBy("conv_id"))
    speakers = speakers.withColumn("others", others).filter((F.col("role") != SYSTEM) | (F.col("others") == 0))
    speakers = speakers.select(F.col("conv_id").alias("c"), F.when(F.col("others") == 0, F.lit("")).otherwise(F.col("role")).alias("perspective"), (F.col("others") == 0).alias("alone"))
    # A table of its own, broadcast up to a checked size; beyond, a conversation with most of the turns is a skewed join that Spark splits.
    speakers = cut(speakers)
    speakers = F.broadcast(speakers) if speakers.count() <= BROADCAST_SPEAKERS else speakers
    met = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = (F.col("role") == F.col("perspective")) & ~F.col("alone")
    name = escaped(F.translate("role", "\r\n", "  "))
    head = F.concat(F.lit(START), F.when(F.col("role") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))
    body = F.concat(escaped(F.col("text")), F.lit(END))
    turn = F.struct("at", F.concat(head, body).alias("piece"), F.when(own, F.length(body)).otherwise(F.lit(0)).alias("loss"))
    parts = met.withColumns({"part": F.floor(F.col("at") / part_turns), "turn": turn}).groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Ends of the pieces, then the loss-bearing tails of the pieces.
    ends = F.aggregate("turns", F.array(F.lit(0)), lambda ends, t: F.concat(ends, F.array(F.element_at(ends, -1) + F.length(t["piece"]))))
    parts = parts.withColumn("ends", ends)
    spans = F.transform("turns", lambda t, k: F.when(t["loss"] > 0, F.concat((F.get("ends", k + 1) - t["loss"]).cast("string"), F.lit("-"), F.get("ends", k + 1).cast("string"))))
    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("rendered"),
        F.element_at("ends", -1).cast("long").alias("n_chars"),
        F.array_join(F.filter(spans, lambda s: s.isNotNull()), ";").alias("loss_spans"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["loss"]).alias("loss_chars"),
    )


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, coalesce(role, '') AS role,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
  UNION ALL SELECT conv_id, '' FROM t GROUP BY conv_id HAVING max(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) = 0
), m AS (
  SELECT t.conv_id, perspective, pos // 64 AS part, pos, t.role = perspective AND t.role <> 'system' AS own,
         '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = perspective THEN 'assistant' ELSE 'user name=' || t.role END || chr(10) AS head,
         body || '<|im_end|>' || chr(10) AS tail
  FROM t JOIN s ON t.conv_id = s.conv_id
), e AS (
  SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) AS stop FROM m
)
SELECT conv_id, perspective, part::BIGINT AS part, count(*)::BIGINT AS n_turns, string_agg(head || tail, '' ORDER BY pos) AS rendered, max(stop)::BIGINT AS n_chars,
       coalesce(string_agg(CASE WHEN own THEN (stop - length(tail))::BIGINT || '-' || stop::BIGINT END, ';' ORDER BY pos), '') AS loss_spans,
       sum(CASE WHEN own THEN length(tail) ELSE 0 END)::BIGINT AS loss_chars
FROM e GROUP BY conv_id, perspective, part
"""
