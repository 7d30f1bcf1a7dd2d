"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line, a section a run of paragraphs between blank lines. A paragraph's node is the SHA-256
of its text, a section's of its paragraphs' nodes, the root of the sections' nodes: roots are equal exactly when
texts are (for all but a SHA-256 collision). Below the paragraphs are marks: stretches up to the end of a
clause or MARK characters, each with a hash and its length, which say how much two texts share. A
fingerprint is written root:marks; `differing` locates an edit by the branches that differ.

Only DataFrame functions are used. Documents go to blocks of neighbouring places, where each meets the next one; the
last of a block meets the first of the next block by a join. A document's place is its id; where ids are null, repeat
or lie far apart, it is the number of its row in their order, found by ranges.

Defined cases: null text is empty; an empty text has one empty paragraph and no marks; two texts without marks
are alike (1) if their roots are equal. Every row is a document of its own: rows that repeat a doc_id follow each
other by the SHA-256 of their texts, and null ids come after all others. A single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, stored, table, text_or_empty

#: Documents in a block of neighbouring places, on average; ids are taken for close together if they spread over so many times their number.
BLOCK, SPREAD, BROADCAST_IDS = 512, 16, 200_000
MARK = 48
MARKS = rf"[^.!?,;\n]{{1,{MARK}}}[.!?,;\n]*|[.!?,;\n]+"


def paragraph_nodes(text):
    """Per section, the nodes of its paragraphs. Nothing of a text is lost by the splits: a blank line is the first paragraph of the section after it."""
    return F.transform(F.split(text, r"(?<=\n)(?=[ \t]*\n)"), lambda section: F.transform(F.split(section, "\n"), lambda p: F.sha2(p.cast("binary"), 256)))


def root_of(nodes):
    # Lengths are part of what is hashed, so no two trees are written alike.
    sections = F.transform(nodes, lambda own: F.sha2(F.concat_ws(",", own).cast("binary"), 256))
    return F.sha2(F.concat_ws(";", sections).cast("binary"), 256)


def marks_of(text):
    """Per mark: 40 bits of its hash, 8 bits of its length."""
    found = F.regexp_extract_all(text, F.lit(MARKS), F.lit(0))
    return F.transform(found, lambda m: F.shiftleft(F.shiftrightunsigned(F.xxhash64(m), 24), 8).bitwiseOR(F.least(F.length(m), F.lit(255)).cast("long")))


def tree(text):
    """text_sha, root, nodes (60 bits of each paragraph's node, by section), marks of a text column."""
    def branches(sections):
        brief = F.transform(sections, lambda own: F.transform(own, lambda node: F.conv(F.left(node, F.lit(15)), 16, 10).cast("bigint")))
        return F.struct(root_of(sections).alias("root"), brief.alias("nodes"))

    found = F.get(F.transform(F.array(paragraph_nodes(text)), branches), F.lit(0))
    return F.struct(F.sha2(text.cast("binary"), 256).alias("text_sha"), found.alias("tree"), marks_of(text).alias("marks"))


def written(t):
    return F.concat(t["tree"]["root"], F.lit(":"), F.array_join(F.transform(t["marks"], lambda m: F.hex(m)), "."))


def likeness(a, b):
    """Share of characters in common marks, 0 to 1; 1 for equal roots."""
    def size(marks):
        return F.aggregate(F.array_distinct(marks), F.lit(0).cast("long"), lambda total, m: total + m.bitwiseAND(F.lit(255)))

    both, one, other = size(F.array_intersect(a["marks"], b["marks"])), size(a["marks"]), size(b["marks"])
    return F.when(a["tree"]["root"] == b["tree"]["root"], F.lit(1.0)).when(one + other == 0, F.lit(0.0)).otherwise(2.0 * both / (one + other)).cast("double")


def differing(a, b, kind: str = "array<string>"):
    """For two columns of paragraph nodes: the sections, and the paragraphs in them, whose branches differ (numbers from 0). kind: type of a section's nodes."""
    none = F.array().cast(kind)
    sections = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda k: ~F.get(a, k).eqNullSafe(F.get(b, k)))

    def paragraphs(k):
        x, y = F.coalesce(F.get(a, k), none), F.coalesce(F.get(b, k), none)
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda p: ~F.get(x, p).eqNullSafe(F.get(y, p)))

    return F.transform(sections, lambda k: F.struct(k.alias("section"), paragraphs(k).alias("paragraphs")))


def numbered(texts: DataFrame) -> DataFrame:
    """doc_id, place, text: place is the number of a row, from 0, by id (null last) and the SHA-256 of its text. Equal rows are dealt by their place in the input, so none of them makes a range large."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("sha"), F.col("salt")]
    keyed = texts.withColumns({"sha": F.sha2(F.col("text").cast("binary"), 256), "salt": F.monotonically_increasing_id()})
    ranged = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    # One row a range; the ranges are as many as the tasks of the exchange.
    before = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "range").select("doc_id", (F.col("start") + F.col("at")).alias("place"), "text")


def following(firsts: DataFrame) -> DataFrame:
    """block, place: the first place of the next block, and round, from (block, place). Ranges of blocks are ordered by themselves; their edges are joined."""
    ranged = cut(firsts.repartitionByRange("block").select("block", "place", F.spark_partition_id().alias("range")))
    order = W.partitionBy(F.lit(0)).orderBy("range")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = ranged.groupBy("range").agg(F.min("place").alias("low"))
    edges = edges.select("range", F.coalesce(F.lead("low").over(order), F.first("low").over(whole)).alias("after"))
    inside = ranged.withColumn("next", F.lead("place").over(W.partitionBy("range").orderBy("block")))
    return inside.join(F.broadcast(edges), "range").select("block", F.coalesce("next", "after").alias("place"))


def finished(met: DataFrame) -> DataFrame:
    """The result for rows (doc_id, n, head, tail, a: own tree, c: the next document's tree)."""
    met = met.select("doc_id", F.col("n").cast("long").alias("n_chars"), "a", "c", tree(F.concat("head", "tail")).alias("b"))
    return met.select(
        "doc_id",
        "n_chars",
        F.col("b.text_sha").alias("edited_sha256"),
        written(F.col("a")).alias("fingerprint"),
        written(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
        differing(F.col("a.tree.nodes"), F.col("b.tree.nodes"), "array<bigint>").alias("differs"),
    )


def half(n):
    return F.floor(n / 2).cast("int")


def by_blocks(texts: DataFrame, low: int, width: int) -> DataFrame:
    """The result for (doc_id, place, text). Texts cross the network once, to blocks of places next to each other; a block's last document gets the next block's first by a join on the block."""
    block = F.floor((F.col("place") - low) / F.lit(width)).cast("long")
    firsts = cut(texts.groupBy(block.alias("block")).agg(F.min("place").alias("place")))
    few = firsts.count() <= BROADCAST_IDS
    starts = firsts.select("place")
    edges = texts.join(F.broadcast(starts) if few else starts, "place", "left_semi").join(following(firsts), "place")
    edges = edges.select("block", F.col("text").alias("edge_text"), tree(F.col("text")).alias("edge_tree"))
    # The exchange goes by the block, before the trees are made, so that these are not moved.
    rows = texts.withColumn("block", block).repartition("block").withColumns({"a": tree(F.col("text")), "n": F.length("text")})
    order = W.partitionBy("block").orderBy("place")
    rows = rows.withColumn("next", F.lead(F.struct("text", "a")).over(order)).join(edges, "block", "left")
    last = F.col("next").isNull()
    after = F.when(last, F.col("edge_text")).otherwise(F.col("next.text"))
    return finished(rows.select("doc_id", "n", F.left("text", F.col("n") - half(F.col("n"))).alias("head"), F.left(after, half(F.col("n"))).alias("tail"), "a", F.when(last, F.col("edge_tree")).otherwise(F.col("next.a")).alias("c")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row, and differs: the sections and paragraphs whose branches the edit changed."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    low, high, n, most, known = ids.agg(F.min("doc_id"), F.max("doc_id"), F.sum("rows"), F.max("rows"), F.count("doc_id")).first()
    if n and (most > 1 or known < n or high - low + 1 > SPREAD * n):
        return by_blocks(numbered(texts), 0, BLOCK)
    return by_blocks(texts.withColumn("place", F.col("doc_id")), low or 0, max(1, BLOCK * ((high or 0) - (low or 0) + 1) // max(n or 0, 1)))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
