"""Exact dedup by content-defined chunk recipes.

Texts are cut where a rolling hash of the last 16 bytes says so. Every distinct chunk crosses the network
once, to verify that its 64-bit identifier stands for one content only; an identifier that doesn't is
extended by the SHA-256 of the content. Texts are then equal exactly when their ordered lists of
identifiers (recipes) are, and only recipes, not texts, are grouped.

Of equal texts the row with the largest doc_id stays (of repeated rows with that id, one). Defined cases: a
null text counts as empty, so nulls and empty texts are one group; a null doc_id is smaller than any
other. Extra columns are not read by `exact_dedup`, and pass through `stage`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mapped, one_of_each, pieces, table, text_or_empty

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 8192, 10
#: More identifiers than these with two contents (expected: none below 10^10 chunks) would not be broadcast.
MAX_COLLIDED = 100_000
#: Rows of a group that are joined to it in one task. Groups beyond are broadcast, as keys, up to so many; joined beyond.
HEAVY, BROADCAST_GROUPS = 256, 20_000


def gear() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([k])) for k in range(256)], np.uint32)


class Chunker:
    def __init__(self):
        self.gear = gear()

    def cuts(self, data: bytes) -> np.ndarray:
        """Places in data where the hash of the 16 bytes before allows a cut."""
        h = self.gear[np.frombuffer(data, np.uint8)]
        for k in (1, 2, 4, 8):
            shifted = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += shifted
        return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1

    def chunks(self, texts: list):
        """For each text: its bytes, and the ends of its chunks. Cuts of a text depend on that text only."""
        whole = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        places = self.cuts(b"".join(whole)) if any(map(len, whole)) else np.zeros(0, np.int64)
        start = 0
        bounds = np.searchsorted(places, np.cumsum([0, *map(len, whole)]))
        for k, data in enumerate(whole):
            ends, last = [], 0
            for place in (places[bounds[k] : bounds[k + 1]] - start).tolist():
                while place - last > MAX_CHUNK:
                    last += MAX_CHUNK
                    ends.append(last)
                if place - last >= MIN_CHUNK and place < len(data):
                    last = place
                    ends.append(last)
            while len(data) - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if len(data) > last:
                ends.append(len(data))
            start += len(data)
            yield data, ends


def distinct_chunks(docs: DataFrame) -> DataFrame:
    """h, content: each distinct chunk of all texts."""

    def run(batches):
        chunker = Chunker()
        for b in batches:
            for _, texts in pieces(b.column(0)):
                found: dict = {}
                for data, ends in chunker.chunks(texts):
                    last = 0
                    for end in ends:
                        found[data[last:end]] = None
                        last = end
                hashes = np.array([xxhash.xxh3_64_intdigest(c) for c in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found.keys(), pa.binary())], ["h", "content"])

    return mapped(docs.select(text_or_empty().alias("text")), run, "h long, content binary").distinct()


def collided(docs: DataFrame) -> list[int]:
    """Identifiers that stand for more than one content."""
    rows = distinct_chunks(docs).groupBy("h").count().filter("count > 1").select("h").limit(MAX_COLLIDED + 1).collect()
    if len(rows) > MAX_COLLIDED:
        raise ValueError("too many chunk identifiers with two contents; use wider identifiers")
    return [r[0] for r in rows]


def recipes(docs: DataFrame, doubtful: list[int]) -> DataFrame:
    """doc_id, row, recipe, text_sha256 for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(h & (2**64 - 1) for h in doubtful))

    def run(batches):
        chunker, doubt = Chunker(), shared.value
        for b in batches:
            out, shas = [], []
            for _, texts in pieces(b.column(2)):
                for data, ends in chunker.chunks(texts):
                    last, ids = 0, []
                    for end in ends:
                        h = xxhash.xxh3_64_intdigest(data[last:end])
                        ids.append(h.to_bytes(8, "big") + (hashlib.sha256(data[last:end]).digest() if h in doubt else b""))
                        last = end
                    out.append(b"".join(ids))
                    shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(shas, pa.string())], ["doc_id", "row", "recipe", "text_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, row long, recipe binary, text_sha256 string")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = cut(recipes(docs, collided(docs)))
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # Only groups of several rows are joined. A group of more than HEAVY rows (there are few of them) meets its rows in parts of that size.
    groups = cut(groups.filter("group_size > 1").withColumn("parts", F.ceil(F.col("group_size") / HEAVY).cast("int")))
    heavy = groups.filter("parts > 1").select("recipe", "parts")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_GROUPS else heavy
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")
    parted = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = rows.join(heavy, "recipe", "left").withColumn("part", part).join(parted, ["recipe", "part"], "left")
    kept = F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True))
    keep_id = F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with the columns that it came with."""
    decided = exact_dedup(docs)
    decided = cut(decided.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "kept"))
    gone = decided.filter("not kept").select("gone_id", "gone_sha").distinct()
    others = gone.withColumnsRenamed({"gone_id": "i", "gone_sha": "s"})
    kept_too = decided.filter("kept").select("gone_id", "gone_sha").join(others, F.col("gone_id").eqNullSafe(F.col("i")) & (F.col("gone_sha") == F.col("s")), "left_semi")
    sha = F.sha2(text_or_empty().cast("binary"), 256)
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha"))
    left = docs.join(gone, same, "left_anti")
    if kept_too.isEmpty():
        return left
    # Rows repeated with their id (null and empty texts are equal): one of them stays.
    return left.unionByName(one_of_each(docs.join(kept_too, same, "left_semi")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""
