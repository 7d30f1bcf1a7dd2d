"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder (spark.checkpoint.dir) if it is set; a folder of our own only where it is not (tests)."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None):
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir"))
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="webquarry-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors don't bring its lineage back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(spark: SparkSession) -> None:
    """Has the driver drop what nothing refers to any more, so that Spark's cleaner removes the shuffle files of steps that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Like cut, as Parquet: less room, read by column, and known by its own size, where the size of a checkpoint is guessed from the plan before it (a guess that joins multiply at each step of a loop)."""
    spark = df.sparkSession
    path = f"{folder or scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder for `stored` in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder of `stored` tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that goes to Python, so that a batch of long texts stays small; a smaller setting of the session is kept.
BATCH_ROWS = 1000


def tidy(function):
    """function over batches, after which the worker, which Spark keeps for other tasks, gives its memory back."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with small batches and tidy workers."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(tidy(function), schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def one_of_each(docs: DataFrame, *more: str) -> DataFrame:
    """One row for each doc_id and text (and more columns); a null text is the empty one. Which of such rows stays, does not depend on their order."""
    names, plain = docs.columns, [f.name for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col("text").isNull(), F.xxhash64(*plain) if plain else F.lit(0))
    keys = [F.col(c).alias(f"_{k}") for k, c in enumerate(("doc_id", *more))]
    best = docs.groupBy(*keys, text_or_empty().alias("_text")).agg(F.min_by(F.struct(*names), order).alias("_row"))
    return best.select("_row.*")


#: Stripped from both ends of a word before it is hashed.
EDGES = " \t\n\r.,;:!?\"'()[]{}<>|*%&$#@~^_=+-/\\`«»„“”‚‘’…·"


class WordHashes(dict):
    """Raw word -> 64-bit hash of the word without the punctuation around it; bounded by starting anew when full."""

    def __init__(self, limit: int = 200_000, stem: int = 0):
        super().__init__()
        self.limit, self.stem = limit, stem

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        core = word.strip(EDGES) or word
        if self.stem:
            core = "^" + core[: self.stem]
        found = self[word] = xxhash.xxh64_intdigest(core.encode("utf-8", "surrogatepass"))
        return found


def word_lists(texts: list) -> tuple[list, np.ndarray]:
    """All lower-case words of some texts after each other, and how many each text has; null is empty."""
    words: list = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            before = len(words)
            words += text.lower().split()
            counts[k] = len(words) - before
    return words, counts


def pieces(column, limit: int = 2_000_000):
    """Runs of rows of an Arrow string column with about `limit` bytes each: (first row, list of texts)."""
    texts, first, size = [], 0, 0
    for k, value in enumerate(column):
        text = value.as_py()
        texts.append(text)
        size += len(text) if text else 0
        if size >= limit:
            yield first, texts
            texts, first, size = [], k + 1, 0
    if texts:
        yield first, texts
