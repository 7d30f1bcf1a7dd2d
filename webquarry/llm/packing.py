"""Packing: vector bin packing with the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens.

Each task packs the rows of its own input split, so nothing is shuffled and a task that is run again gives
the same sequences. A piece goes to the open sequence in which it fits and whose remaining room has the
largest dot product with the piece's demand. If it fits nowhere and enough sequences are open, it is cut to
fill the best one. What is left open at the end is cut to powers of two, which need no padding.

Defined cases: a null or empty text has the closing id only. Repeated rows are packed one by one. A document
of any length is cut to as many sequences as it needs. No rows give no sequences.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, text_or_empty

MAX_TOKENS, MAX_SEGMENTS, END_ID = 4096, 512, 2
OPEN_BINS = 24
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Part of a text (run of letters, digit, run of other signs) -> its ids as little-endian unsigned 32-bit.

    The tokenizer splits lower-cased text into such parts and encodes each by itself, so a text's ids are those of its
    parts after each other. Texts with characters for which that was not checked, or with special tokens, are encoded whole.
    """

    LETTERS = "a-zß-öø-ÿ"
    PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+").findall
    ODD = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ«»·–—‘’“”„…€£§©®°]|<\\|").search

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a part
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def of(self, text: str) -> bytes:
        if self.ODD(text):
            return self.encoded(text).tobytes()
        parts = self.PART(text.lower())
        new = set(parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = set(parts)
            names = list(new)
            ids = self.encoded(" ".join(names))
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(names):
                return self.encoded(text).tobytes()
            data, start = ids.tobytes(), 0
            for name, end in zip(names, ends):
                self.known[name] = data[start:end]
                start = end
        return b"".join(map(self.known.__getitem__, parts))


#: The parts that a Python worker knows, by tokenizer: Spark uses a worker for many tasks.
KNOWN: dict[str, Ids] = {}


def known(path: str) -> Ids:
    if path not in KNOWN:
        KNOWN[path] = Ids(path)
    return KNOWN[path]


class Bin:
    __slots__ = ("loss", "pieces", "tokens")

    def __init__(self):
        self.tokens, self.loss, self.pieces = 0, 0, []


class Packer:
    """Takes items (key, tokens, loss tokens per token) and gives closed sequences: lists of (key, start, length)."""

    def __init__(self, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=MAX_TOKENS, open_bins=OPEN_BINS):
        self.limits, self.open_bins, self.bins = (max_tokens, max_segments, max_loss), open_bins, []

    def room(self, b: Bin, loss: float) -> int:
        """Tokens of a kind with so much loss each that still fit."""
        tokens, segments, most = self.limits
        if len(b.pieces) >= segments:
            return 0
        return min(tokens - b.tokens, int((most - b.loss) / loss) if loss else tokens)

    def put(self, b: Bin, key, start: int, n: int, loss: float):
        b.pieces.append((key, start, n, loss))
        b.tokens += n
        b.loss += n * loss

    def add(self, key, n: int, loss: float = 1.0, start: int = 0):
        """Yields the sequences that this closes."""
        tokens, segments, most = self.limits
        full = min(tokens, int(most / loss) if loss else tokens)
        if full < 1:
            raise ValueError("a single token is beyond the limit of loss-bearing tokens")
        while n:
            if n >= full:
                b = Bin()
                self.put(b, key, start, full, loss)
                start, n = start + full, n - full
                yield [p[:3] for p in b.pieces]
                continue
            best, score = None, -1.0
            for b in self.bins:
                if self.room(b, loss) >= n:
                    dot = n / tokens * (tokens - b.tokens) / tokens + 1 / segments * (segments - len(b.pieces)) / segments + n * loss / most * (most - b.loss) / most
                    if dot > score:
                        best, score = b, dot
            if best is None and len(self.bins) < self.open_bins:
                best = Bin()
                self.bins.append(best)
            take = n
            if best is None:  # cut to fill the one with most room
                best = max(self.bins, key=lambda b: self.room(b, loss))
                take = self.room(best, loss)
                if not take:
                    yield from self.shut(best)
                    continue
            self.put(best, key, start, take, loss)
            start, n = start + take, n - take
            if best.tokens == tokens or len(best.pieces) == segments or best.loss > most - loss:
                yield from self.shut(best)

    def shut(self, b: Bin):
        """Closes a sequence; one that is not full is cut to powers of two, largest first."""
        if b in self.bins:
            self.bins.remove(b)
        at, left = 0, b.tokens
        pieces = list(b.pieces)
        while left:
            size = left if left == self.limits[0] else 1 << (left.bit_length() - 1)
            out, need = [], size
            while need:
                key, start, n, loss = pieces[at]
                if n <= need:
                    out.append((key, start, n))
                    at += 1
                else:
                    out.append((key, start, need))
                    pieces[at] = (key, start + need, n - need, loss)
                need -= min(n, need)
            left -= size
            yield out

    def finish(self):
        """The open sequences, joined to full ones first."""
        rest = [p for b in self.bins for p in b.pieces]
        self.bins, self.open_bins = [], 1
        for key, start, n, loss in rest:
            yield from self.add(key, n, loss, start)
        for b in list(self.bins):
            yield from self.shut(b)


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, loss: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    loss: a column with the share of a document's ids that bear loss, 0 to 1 (null: all); without it every id does. A sequence bears at most max_loss.
    """
    path = path or tokenizer_path()

    def run(batches):
        packer = Packer(max_tokens, max_segments, max_loss)
        ids = known(path)
        first = TaskContext.get().partitionId() << 36
        held: dict[int, list] = {}  # by key: doc_id, ids, those not yet out
        count, rows = 0, []

        def emit(sequence):
            nonlocal count
            offset = 0
            for key, start, n in sequence:
                entry = held[key]
                rows.append((entry[0], start, n, zlib.crc32(entry[1][4 * start : 4 * (start + n)]), len(entry[1]) // 4, first + count, offset))
                offset += n
                entry[2] -= n
                if not entry[2]:
                    del held[key]
            count += 1

        def flush():
            columns = list(zip(*rows)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

        key, end = 0, np.array([END_ID], "<u4").tobytes()
        for b in batches:
            for doc_id, text, share in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                data = ids.of(text.as_py()) + end
                held[key] = [doc_id.as_py(), data, len(data) // 4]
                for sequence in packer.add(key, len(data) // 4, share):
                    emit(sequence)
                key += 1
                if len(rows) >= 20_000:
                    yield flush()
        for sequence in packer.finish():
            emit(sequence)
        yield flush()

    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(loss).cast("double"), F.lit(1.0)))) if loss else F.lit(1.0)
    return mapped(docs.select("doc_id", text_or_empty().alias("text"), share.alias("share")), run, SCHEMA)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
