"""Quality classifier by co-training: a view of the text's content and a view of the page's metadata.

The content view is logistic regression on the mean of hashed words and of the signs around them. The metadata
view is logistic regression on binned figures (length, lines, line length, repeated lines, shares of letters,
digits, signs and capitals) and on hashed language and source. In each round every row of the pool is scored by
both views, and what one view is sure of, the other learns: the surest row of each of `exchanged` strata of the
pool, by class. Margins are then calibrated on held-in folds, the calibrated views combined by stacking, and every
whole document is scored.

A map turns each text once into counts of its numbers (at most 2**15 words and 2**10 signs, however long it is) and
its figures; that table, in the shared checkpoint folder, is what the rounds and the scoring read. Edges of bins are
quantiles over all rows. The pool is all rows without a label outside of the held-out third (crc32 of the id
mod 3 is 1). Bounded are, whatever the size of the corpus: the labelled rows, about `train_rows` by a hash of the id, and what
the views exchange in a round. A stratum is by a hash of text and metadata, so that copies compete for one place.

Defined cases: null text counts as empty; null metadata is a value of its own. Without labels of both
classes every score is the share of good labels (0.5 without any). Of repeated labels the largest counts, of rows
that repeat a labelled id the least by that hash; rows without an id are scored, but not learned from. Extra columns are not read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EDGES, discard, mapped, pieces, scratch, stored, table, text_or_empty
from .toxicity import bucket

TRAIN_ROWS, EXCHANGED, ROUNDS, STEPS = 4_000, 400, 3, 60
WORD_BITS, SIGN_BITS, NAME_BITS, BINS, FIGURES = 15, 10, 8, 12, 9
META_SIZE = FIGURES * BINS + (2 << NAME_BITS)
#: How sure a view must be of what the other learns, as a margin and as a probability.
SURE = 0.9
LEAST = math.log(SURE / (1 - SURE))
#: Figures are counted by cells of this width for the edges of bins.
CELL = 1 / 4096
#: Learners: of each half of the labelled rows, which calibrate, and of all.
LEARNERS = 3

TRAITS = "doc_id long, same long, ids binary, often binary, figures array<double>, names array<int>"


class Tokens(dict):
    """Raw word -> number of its letters part (low 16 bits) and of the signs around it (high bits)."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        core = raw.strip(EDGES)
        word = xxhash.xxh32_intdigest(core.lower().encode("utf-8", "surrogatepass")) >> (32 - WORD_BITS) if core else 0
        at = raw.find(core) if core else 0
        signs = raw[:at] + "_" + raw[at + len(core) :]
        found = self[raw] = word | (xxhash.xxh32_intdigest(signs.encode("utf-8", "surrogatepass")) >> (32 - SIGN_BITS)) << 16
        return found


KINDS = np.zeros(256, np.uint8)  # other ASCII signs: 0
KINDS[[*range(97, 123)]], KINDS[[*range(65, 91)]], KINDS[[*range(48, 58)]] = 1, 2, 3
KINDS[[9, 10, 11, 12, 13, 32]], KINDS[128:] = 4, 5


class Views:
    def __init__(self):
        self.tokens = Tokens()

    def content(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All token numbers, and tokens of each text."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                own = text.split()
                counts[k] = len(own)
                words += own
        return np.fromiter(map(self.tokens.__getitem__, words), np.int64, len(words)), counts

    def metadata(self, texts: list, langs: list, sources: list, lengths: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Figures, the numbers of the names, and a hash of all that is read."""
        figures, names, same = np.zeros((len(texts), FIGURES)), np.zeros((len(texts), 2), np.int32), np.zeros(len(texts), np.uint64)
        for k, text in enumerate(texts):
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            same[k] = xxhash.xxh64_intdigest(repr((lengths[k], langs[k], sources[k])).encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest(data))
            kinds = np.bincount(KINDS[np.frombuffer(data, np.uint8)], minlength=6)
            lines = text.split("\n")
            n, filled = max(1, int(kinds.sum())), [x for x in lines if x]
            length = lengths[k] if lengths[k] is not None else len(text)
            figures[k] = (math.log1p(max(0, length)), math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(filled)) / max(1, len(filled)), *(kinds[[0, 1, 2, 3, 4]] / n))
            for c, name in enumerate((langs[k], sources[k])):
                names[k, c] = (c << NAME_BITS) + (xxhash.xxh32_intdigest(repr(name).encode("utf-8", "surrogatepass")) >> (32 - NAME_BITS))
        return figures, names, same.view(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression by Adam on mean (content) or sum (metadata) of looked-up weights."""

    def __init__(self, size: int, rate: float, penalty: float):
        self.w, self.b, self.rate, self.penalty = np.zeros(size), 0.0, rate, penalty

    def fit(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS):
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        n = len(y)
        for k in range(1, steps + 1):
            p = sigmoid(np.bincount(rows, self.w[ids] * values, n) + self.b)
            g = weight * (p - y)
            grad = np.append(np.bincount(ids, g[rows] * values, len(self.w)) + self.penalty * self.w, g.sum()) / weight.sum()
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            step = self.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            self.w -= step[:-1]
            self.b -= step[-1]
        return self


class Sparse:
    """Rows of looked-up numbers with values: those of a row after each other."""

    def __init__(self, ids, counts, values):
        self.ids, self.counts, self.values = ids, counts, values
        self.starts = np.cumsum(counts) - counts

    def take(self, chosen: np.ndarray):
        counts = self.counts[chosen]
        at = np.repeat(self.starts[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.repeat(np.arange(len(chosen)), counts), self.ids[at], self.values[at]

    def margins(self, model: Linear) -> np.ndarray:
        rows = np.repeat(np.arange(len(self.counts)), self.counts)
        return np.bincount(rows, model.w[self.ids] * self.values, len(self.counts)) + model.b


def both_kinds(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers of words and signs, those of a text after each other; how many each text has; how often each stands there."""
    rows = np.repeat(np.arange(len(counts)), counts)
    keys, often = np.unique(np.concatenate([rows << 20 | numbers & 0xFFFF, rows << 20 | (1 << 16) + (numbers >> 16)]), return_counts=True)
    return keys & 0xFFFFF, np.bincount(keys >> 20, minlength=len(counts)), often


def binned(figures: np.ndarray, names: np.ndarray, edges: list) -> Sparse:
    cells = [c * BINS + np.searchsorted(edges[c], figures[:, c]) for c in range(figures.shape[1])]
    first = figures.shape[1] * BINS
    ids = np.stack([*cells, first + names[:, 0], first + names[:, 1]], 1)
    return Sparse(ids.ravel(), np.full(len(ids), ids.shape[1]), np.ones(ids.size))


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, penalty: float) -> np.ndarray:
    """Weights for the columns of x, drawn to start by the penalty; Newton steps, halved until they help."""
    def loss(w):
        m = x @ w
        return np.logaddexp(0, m).sum() - (y * m).sum() + penalty / 2 * ((w - start) ** 2).sum()

    w = start.astype(float).copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * (w - start))
        before, size = loss(w), 1.0
        while size > 1e-4 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b)."""
    scale = margin.std() or 1.0
    a, b = logistic(np.stack([margin / scale, np.ones_like(margin)], 1), y, np.array([1.0, 0.0]), 1.0)
    return float(a / scale), float(b)


def traits(docs: DataFrame) -> DataFrame:
    """TRAITS: what the views see of each row, by one pass over its whole text."""

    def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<i4"))])

    def run(batches):
        views = Views()
        for b in batches:
            for first, texts in pieces(b.column(1)):
                ids, counts, often = both_kinds(*views.content(texts))
                figures, names, same = views.metadata(texts, *(b.column(k).slice(first, len(texts)).to_pylist() for k in (2, 3, 4)))
                lists = [pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1], x.ravel()) for x in (figures, names)]
                found = [b.column(0).slice(first, len(texts)), pa.array(same), binaries(ids, counts), binaries(often, counts), *lists]
                yield pa.RecordBatch.from_arrays(found, ["doc_id", "same", "ids", "often", "figures", "names"])

    return mapped(columns(docs), run, TRAITS)


def bin_edges(found: DataFrame) -> list:
    """Quantiles of each figure over all rows, from counts by cells of fixed width."""
    cells = found.select(F.posexplode("figures").alias("figure", "value")).groupBy("figure", F.floor(F.col("value") / CELL).alias("cell")).count()
    edges = [np.zeros(0)] * FIGURES
    of = {}
    for figure, cell, n in cells.collect():
        of.setdefault(figure, []).append((cell, n))
    for figure, counted in of.items():
        cell, n = np.array(sorted(counted)).T
        upto = np.cumsum(n)
        edges[figure] = np.unique(cell[np.searchsorted(upto, np.arange(1, BINS) / BINS * upto[-1])] * CELL)
    return edges


def seen(batch, edges: list) -> tuple[Sparse, Sparse]:
    """The two views of rows of TRAITS."""
    parts = batch.column("ids").to_pylist()
    counts = np.array([len(x) >> 2 for x in parts], np.int64)
    ids = np.frombuffer(b"".join(parts), "<i4")
    often = np.frombuffer(b"".join(batch.column("often").to_pylist()), "<i4")
    rows = np.repeat(np.arange(len(counts)), counts)
    total = np.maximum(np.bincount(rows, often, len(counts)), 1)
    figures, names = (np.array(batch.column(c).to_pylist()).reshape(len(counts), -1) for c in ("figures", "names"))
    return Sparse(ids, counts, often / total[rows]), binned(figures, names, edges)


class Learners:
    """Both models of each learner, and the rows that the views labelled for each other."""

    def __init__(self, meta_size: int = META_SIZE):
        self.models = [(Linear((1 << 16) + (1 << SIGN_BITS), 2.0, 1e-6), Linear(meta_size, 0.1, 1e-3)) for _ in range(LEARNERS)]
        self.taught = [({}, {}) for _ in range(LEARNERS)]  # hash of a row -> label, of each view
        self.rounds, self.share = 0, None

    def fit(self, views: tuple, y: np.ndarray, same: np.ndarray) -> None:
        """y: 0, 1, or -1 for rows of the pool. Later rounds go on from the models of the one before."""
        labelled = np.flatnonzero(y >= 0)
        self.share = float(y[labelled].mean())
        for learner, own in enumerate((labelled[::2], labelled[1::2], labelled)):
            for v in (0, 1):
                label = np.array([self.taught[learner][v].get(k, -1) if t < 0 else -1 for k, t in zip(same.tolist(), y)])
                more = np.flatnonzero(label >= 0)
                chosen = np.concatenate([own, more])
                weight = np.concatenate([np.ones(len(own)), np.full(len(more), 0.5)])
                self.models[learner][v].fit(*views[v].take(chosen), np.concatenate([y[own], label[more]]).astype(float), weight, STEPS if not self.rounds else STEPS // 3)
        self.rounds += 1

    def strata(self, exchanged: int) -> tuple[int, int]:
        return max(1, round(exchanged * (1 - self.share))), max(1, round(exchanged * self.share))

    def combined(self, views: tuple, y: np.ndarray):
        """The models that saw all labels, their calibrations, and the stacking weights."""
        labelled = np.flatnonzero(y >= 0)
        held = np.zeros((2, len(labelled)))
        for v in (0, 1):
            for fold in (0, 1):
                held[v, 1 - fold :: 2] = views[v].margins(self.models[fold][v])[labelled[1 - fold :: 2]]
        truth = y[labelled].astype(float)
        scales = [platt(held[v], truth) for v in (0, 1)]
        logits = np.stack([scales[v][0] * held[v] + scales[v][1] for v in (0, 1)] + [np.ones(len(labelled))], 1)
        return self.models[2], scales, logistic(logits, truth, np.array([0.5, 0.5, 0.0]), 1.0)


def surest(learners: Learners, exchanged: int, edges: list):
    """A map over the pool: for each learner, view, class and stratum the row of the partition that the view is surest of and that the other view has not learned."""
    sizes = learners.strata(exchanged)
    known = [[np.fromiter(of, np.int64, len(of)) for of in pair] for pair in learners.taught]
    names = ["learner", "view", "label", "stratum", "less", "same", "doc_id"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches):
        best = {}
        for b in batches:
            if not b.num_rows:
                continue
            views, same, ids = seen(b, edges), b.column("same").to_numpy(), b.column("doc_id").to_numpy()
            for learner in range(LEARNERS):
                for v in (0, 1):
                    margins = views[v].margins(learners.models[learner][v])
                    free = ~np.isin(same, known[learner][1 - v])
                    for label, sure in ((0, -margins), (1, margins)):
                        at = np.flatnonzero(free & (sure >= LEAST))
                        stratum = same[at] % sizes[label]
                        order = np.lexsort((ids[at], same[at], -sure[at], stratum))
                        at, stratum = at[order], stratum[order]
                        first = np.flatnonzero(np.diff(stratum, prepend=-1))
                        for k, place in zip(at[first].tolist(), stratum[first].tolist()):
                            key, found = (learner, v, label, place), (-float(sure[k]), int(same[k]), int(ids[k]))
                            if key not in best or found < best[key]:
                                best[key] = found
        rows = [key + found for key, found in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    return run


def fitted(learners: Learners, rows: list, last: bool, edges: list):
    """The learners after a round, or the model once it is the last; rows: batches of TRAITS and label. Without labels of both classes in each half, a share."""
    data = pa.Table.from_batches(rows).to_pylist() if rows else []
    own = sorted((r for r in data if r["label"] >= 0), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & (2**64 - 1), r["doc_id"]))
    pool = sorted((r for r in data if r["label"] < 0), key=lambda r: (r["same"], r["doc_id"]))
    pool = [r for k, r in enumerate(pool) if not k or r["same"] != pool[k - 1]["same"]]
    y = np.array([r["label"] for r in own + pool], np.int64)
    known = y[y >= 0]
    if len(known) < 8 or min(known[::2].sum(), known[1::2].sum(), (1 - known[::2]).sum(), (1 - known[1::2]).sum()) < 1:
        return float(known.mean()) if len(known) else 0.5
    views = seen(pa.Table.from_pylist(own + pool, schema=rows[0].schema), edges)
    learners.fit(views, y, np.array([r["same"] for r in own + pool], np.int64))
    return (*learners.combined(views, y), edges) if last else learners


def score(model, batch):
    """text_score, meta_score, score of rows of TRAITS."""
    if isinstance(model, float):
        return (np.full(batch.num_rows, model),) * 3
    models, scales, stack, edges = model
    logits = [a * view.margins(own) + c for own, (a, c), view in zip(models, scales, seen(batch, edges))]
    return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(stack[0] * logits[0] + stack[1] * logits[1] + stack[2])


def columns(docs: DataFrame) -> DataFrame:
    def of(name, kind):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(of("doc_id", "long"), text_or_empty().alias("text"), of("lang", "string"), of("source", "string"), of("n_chars", "long"))


def train(found: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exchanged: int = EXCHANGED, rounds: int = ROUNDS):
    """The model, from all rows of TRAITS: a table that is read once or twice a round, so it should be stored."""
    spark = found.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    whole = 1 << 30
    n = known.count()
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < F.lit(math.ceil(whole * min(1.0, train_rows / max(n, 1)))))
    folder = scratch(spark)
    known = stored(known, folder)
    edges = bin_edges(found)

    def one_of(rows: DataFrame, *keys: str) -> DataFrame:
        return stored(rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), "same").alias("row")).select("row.*"), folder)

    own = found.join(F.broadcast(known), "doc_id").select(*found.columns, "label")
    material = one_of(own, "doc_id")
    pool = found.filter(F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 1)).join(F.broadcast(known), "doc_id", "left_anti")
    learners = Learners()
    for k in range(rounds + 1):
        before = spark.sparkContext.broadcast(learners)

        def learn(batches, before=before, last=k == rounds):
            after = fitted(before.value, [b for b in batches if b.num_rows], last, edges)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(after)], pa.binary())], ["model"])

        after = mapped(material.repartition(1), learn, "model binary").collect()
        learners = pickle.loads(after[0][0]) if after else 0.5  # no row for an empty table
        before.unpersist()
        if not isinstance(learners, Learners):
            break
        chosen = mapped(pool, surest(learners, exchanged, edges), "learner int, view int, label int, stratum long, less double, same long, doc_id long")
        best = F.min(F.struct("less", "same", "doc_id")).alias("best")
        chosen = chosen.groupBy("learner", "view", "label", "stratum").agg(best).select("learner", "view", "label", "best.same", "best.doc_id").collect()
        for learner, view, label, same, _ in chosen:
            learners.taught[learner][1 - view][same] = label
        wanted = spark.createDataFrame(sorted({(r["doc_id"], r["same"]) for r in chosen}), "doc_id long, same long")
        more = pool.join(F.broadcast(wanted), ["doc_id", "same"], "left_semi").select(*found.columns, F.lit(-1).alias("label"))
        material = material.unionByName(one_of(more, "doc_id", "same"))
    discard(spark, folder)
    return learners


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exchanged: int = EXCHANGED, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (0 to 1, higher: better), predicted (1: score of 0.5 or more).

    The result reads the table of traits, which is in `folder` (by default a new one in the checkpoint folder).
    """
    found = stored(traits(docs), folder)
    shared = docs.sparkSession.sparkContext.broadcast(train(found, labels, train_rows, exchanged))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, score(shared.value, b))], ["doc_id", "text_score", "meta_score", "score"])

    scored = mapped(found, run, "doc_id long, text_score double, meta_score double, score double")
    return scored.select("doc_id", (bucket(F.col("doc_id")) == 1).alias("held_out"), "text_score", "meta_score", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
