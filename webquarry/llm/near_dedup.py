"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, verification, classes.

A shingle is five words (lower case, without punctuation around them), its weight how often the text has
it. Each shingle is a Poisson process whose arrivals, at a rate of its weight, fall on random components of
the signature; the earliest arrival wins a component, and a text stops when no later arrival can win. Two
texts agree in a component with the probability Jaccard similarity J_P of their weights. Bands of the
signature give candidates; J_P of every candidate pair is then computed exactly from the whole texts, and
pairs of 0.8 or more are links.

Texts with equal weights are one text from the start, so copies never make pairs. In two first turns the texts of a band's bucket meet
in hands of bounded size, a large bucket's smallest text in each hand. Of the texts of its hands each is verified against the most alike
one and the one with the smallest id, at most two pairs for each text, which joins most of what is similar; links are joined to labels, by
propagation in tables that are cut at each step. Then, of the buckets that still have several labels, each text apart from the main label
meets the whole bucket, a tile of the ones against a tile of the others at a time: signatures are compared, and every likely
pair of two labels is verified exactly where it stands, in the first band that the two share. So no pairs are written, only links that join
labels, no pair is left out, and the work of n unlike texts in a bucket is n * n / 2 signature comparisons.
A class keeps its smallest doc_id. Ties go by id, so a run again gives the same rows.

Defined cases: a null text counts as empty. Texts without words are alike only if their characters are the
same. A text of one to four words has one shingle, all its words. Repeated rows are copies of each other;
one stays. A row without doc_id is a document like any other; it stays only if its class has none with an id, and class_id is null then. An empty table gives an empty result. Extra columns are not read by `near_dedup`, and pass
through `stage`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard, mapped, one_of_each, pieces, scratch, settle, stored, table, text_or_empty, word_lists, WordHashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
#: Texts of a bucket that meet at once in the first turns; a larger bucket is dealt to hands of so many in DEALT_TURNS turns.
HAND, DEALT_TURNS = 256, 2
#: Texts, and bytes of their weights, on each side of a unit after that.
TILE, TILE_BYTES = 512, 8 << 20
#: Least share of agreeing components of a likely pair: four standard deviations under SIMILAR.
LIKELY = 0.68
#: Pairs of one text that meet in one task; a text with more of them is copied to several tasks.
SALT_PAIRS = 256
#: Ids of candidates that are broadcast to filter the texts (8 bytes each); more are joined.
BROADCAST_IDS = 200_000
U = np.uint64
LOW52, LOW24 = U(2**52 - 1), U(2**24 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingles:
    def __init__(self):
        self.words = WordHashes()

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row << 52 | 52-bit shingle) distinct and sorted, how often each; where each of the (at most 4096) texts begins."""
        words, counts = word_lists(texts)
        h = np.fromiter(map(self.words.__getitem__, words), U, len(words))
        rows = np.repeat(np.arange(len(texts), dtype=U), counts)
        parts = []
        if len(h) >= SHINGLE:
            n = len(h) - SHINGLE + 1
            s = np.full(n, 0x9E3779B97F4A7C15, U)
            for k in range(SHINGLE):
                s = (s + h[k : n + k]) * U(0xD6E8FEB86659FD93)
                s ^= s >> U(32)
            same = rows[:n] == rows[SHINGLE - 1 :]
            parts.append(rows[:n][same] << U(52) | mixed(s[same]) >> U(12))
        starts = np.cumsum(counts) - counts
        few = [(k << 52) | int(mixed(np.array([hash_few(h[starts[k] : starts[k] + counts[k]])], U))[0]) >> 12 for k in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist()]
        parts.append(np.array(few, U))
        keys, often = np.unique(np.concatenate(parts), return_counts=True)
        return keys, often, np.searchsorted(keys >> U(52), np.arange(len(texts) + 1, dtype=U))


def hash_few(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * 0x100000001B3 ^ v) & (2**64 - 1)
    return x


def signatures(keys: np.ndarray, often: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """n x size winners (24 bits of the winning shingle); arrivals by rounds, each shingle until it can't win any more."""
    best = np.full(n * size, 2**64 - 1, U)
    row, element, t = (keys >> U(52)).astype(np.int64), keys & LOW52, np.zeros(len(keys))
    weight = often.astype(float)
    k = 0
    while len(row):
        r = mixed(element + U((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        t = t - np.log1p(-((r >> U(11)).astype(np.float64) * 2.0**-53)) / weight
        component = (mixed(r) >> U(33)).astype(np.int64) % size
        np.minimum.at(best, row * size + component, t.view(U) & ~LOW24 | mixed(element) & LOW24)
        latest = (best.reshape(n, size).max(axis=1) | LOW24).view(np.float64)
        latest[~(latest < 1e300)] = np.inf  # components that nothing has won yet
        on = t <= latest[row]
        row, element, t, weight, k = row[on], element[on], t[on], weight[on], k + 1
    return (best & LOW24).reshape(n, size)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    n = len(signature)
    out = np.empty((n, BANDS), U)
    for b in range(BANDS):
        x = np.full(n, (b + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), U)
        for c in range(ROWS):
            x = mixed(x ^ signature[:, b * ROWS + c]) + U(c)
        out[:, b] = x
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, each (sorted keys, weights): sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    keys = np.union1d(a[0], b[0])
    if not len(keys):
        return 0.0
    w, v = np.zeros(len(keys)), np.zeros(len(keys))
    w[np.searchsorted(keys, a[0])], v[np.searchsorted(keys, b[0])] = a[1], b[1]
    both = (w > 0) & (v > 0)
    if (w[both] == v[both]).all():
        # equal weights where common: the sum is max(w, v) over d's weight
        return float((w[both]).sum() / np.maximum(w, v).sum())
    with np.errstate(divide="ignore"):
        ratio = np.where(v > 0, w / np.where(v > 0, v, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, w, v, both = ratio[order], w[order], v[order], both[order]
    above = np.concatenate([np.cumsum(w[::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(v)])
    first = np.searchsorted(ratio, ratio[both], "left")
    return float((1 / (above[first] / w[both] + below[first] / v[both])).sum())


def text_key():
    return F.xxhash64(text_or_empty())


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, row, text_key, same (16 bytes, equal for equal weights), bands, signature (a byte for each component) for each row."""

    def run(batches):
        shingles = Shingles()
        for b in batches:
            same, keys, brief = [], [], []
            for _, texts in pieces(b.column(3)):
                for first in range(0, len(texts), 2048):
                    some = texts[first : first + 2048]
                    found, often, starts = shingles(some)
                    signature = signatures(found, often, len(some))
                    keys.append(bands(signature))
                    brief += [row.tobytes() for row in signature.astype(np.uint8)]
                    for k, text in enumerate(some):
                        own = slice(starts[k], starts[k + 1])
                        wordless = starts[k] == starts[k + 1]
                        data = b"text:" + text.encode("utf-8", "surrogatepass") if wordless else (found[own] & LOW52).tobytes() + often[own].tobytes()
                        same.append(hashlib.sha256(data).digest()[:16])
                        if wordless:
                            keys[-1][k] = 0
            flat = np.concatenate(keys).view(np.int64).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(same, pa.binary()), lists, pa.array(brief, pa.binary())], ["doc_id", "row", "text_key", "same", "bands", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_key().alias("text_key"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, row long, text_key long, same binary, bands array<long>, signature binary")


def verified(pairs: DataFrame, texts: DataFrame, folder: str | None = None) -> DataFrame:
    """pairs (a, b) with their J_P. texts: id, text. A text with many pairs is copied to as many tasks as they need."""
    heavy = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_PAIRS)).cast("int").alias("parts")).filter("parts > 1")
    heavy = small(stored(heavy, folder))
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    left = pairs.join(heavy, "b", "left").withColumn("part", part).drop("parts").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(heavy, "b", "left").withColumn("part", parts).drop("parts")

    def run(batches):
        shingles = Shingles()

        def weights(text):
            keys, often, _ = shingles([text])
            return keys, often

        last, second = None, None
        for b in batches:
            out = []
            for one, key, other in zip(b.column(2), b.column(1), b.column(3)):
                if key.as_py() != last:
                    last, second = key.as_py(), weights(other.as_py())
                out.append(probability_jaccard(weights(one.as_py()), second))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return mapped(left.join(right, ["b", "part"]).select("a", "b", "text_a", "text_b"), run, "a long, b long, similarity double")


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is a checked size; a join of the same result beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def members_of(rows: DataFrame, folder: str) -> DataFrame:
    """band, id, n, hub, signature: texts in buckets of n > 1 texts, the smallest of which is the hub."""
    keyed = rows.select("id", F.explode("bands").alias("band")).filter("band != 0")
    # Tables of their own, so that a large bucket is a skewed join that Spark splits, and is not held together by an earlier partitioning.
    shared = stored(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).filter("n > 1"), folder)
    return stored(keyed.join(shared, "band").join(rows.select("id", "signature"), "id"), folder)


def partners(units: DataFrame) -> DataFrame:
    """id, partner, alike: for each text of a unit, of those that may be similar to it by their signatures, the most alike and the one with the smallest id.

    Only partners of other labels that it has not been verified against. units: band, own, an array of (id, label, signature, met).
    """

    def run(batches):
        for batch in batches:
            out: list = [[], [], []]
            for unit in batch.column(1):
                own = sorted(unit.as_py(), key=lambda x: x["id"])  # no order of arrival decides anything
                ids, labels = np.array([x["id"] for x in own]), np.array([x["label"] for x in own])
                brief = np.frombuffer(b"".join(x["signature"] for x in own), np.uint8).reshape(len(own), -1)
                for k, x in enumerate(own):
                    others = np.flatnonzero(labels != x["label"])
                    alike = (brief[others] == brief[k]).mean(axis=1) - 1 / 256 if len(others) else np.zeros(0)
                    likely = alike >= LIKELY
                    if x["met"]:
                        likely &= ~np.isin(ids[others], x["met"])
                    others, alike = others[likely], alike[likely]
                    if len(others):
                        chosen = sorted({0, int(alike.argmax())})
                        for column, values in zip(out, ([x["id"]] * len(chosen), ids[others[chosen]].tolist(), alike[chosen].tolist())):
                            column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], ["id", "partner", "alike"])

    return mapped(units.select("band", "own"), run, "id long, partner long, alike double")


def dealt(named: DataFrame, turn: int) -> DataFrame:
    """Units of a first turn: a bucket of up to HAND texts, or hands of a larger one, dealt by a hash that is new each turn, with the hub in each."""
    hands = F.ceil(F.col("n") / HAND).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(turn)), hands).cast("int")
    hand = F.explode(F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), hands - 1)).otherwise(F.array(own)))
    own = F.collect_list(F.struct("id", "label", "signature", "met")).alias("own")
    return named.withColumn("hand", hand).groupBy("band", "hand").agg(own).filter(F.size("own") > 1).select("band", "own")


def weights_of(texts: DataFrame) -> DataFrame:
    """id, keys (sorted, 8 bytes each), often (2 bytes each; empty if all are 1): the weighted shingles of texts (id, text)."""

    def run(batches):
        shingles = Shingles()
        for b in batches:
            keys, often = [], []
            for text in b.column(1):
                found, n, _ = shingles([text.as_py()])
                keys.append((found & LOW52).tobytes())
                often.append(b"" if (n == 1).all() else n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(often, pa.binary())], ["id", "keys", "often"])

    return mapped(texts.select("id", "text"), run, "id long, keys binary, often binary")


def open_buckets(named: DataFrame) -> DataFrame:
    """band, main (the label that most of its texts have), rest (texts of other labels), of buckets with several labels."""
    sizes = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("band")
    sizes = sizes.agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), (F.sum("size") - F.max("size")).alias("rest"))
    return sizes.filter("labels > 1").drop("labels")


def whole_buckets(named: DataFrame) -> DataFrame:
    """Units in which each text that is not of its bucket's main label meets every text of the bucket.

    Of a bucket with several tiles' worth of texts, each tile of those at home meets each tile of those that look.
    named: band, n, main, rest, bytes (of all weights of the bucket), id, label, signature, bands, keys, often.
    """
    hands = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    rest_of = F.ceil(F.col("rest") * hands / F.col("n")).cast("int")
    named = named.withColumns({"hands": hands, "rest_of": rest_of})
    looks, whole = F.col("label") != F.col("main"), F.col("hands") == 1
    here, there = F.pmod(F.xxhash64("id"), F.col("hands")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("rest_of")).cast("int")

    def place(hand, part, home, looking):
        return F.struct(hand.alias("hand"), part.alias("part"), home.alias("home"), looking.alias("looks"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    as_home = F.transform(F.sequence(zero, F.col("rest_of") - 1), lambda part: place(here, part, yes, no))
    as_looking = F.transform(F.sequence(zero, F.col("hands") - 1), lambda hand: place(hand, there, no, yes))
    at = F.when(whole, F.array(place(zero, zero, yes, looks))).when(looks, F.concat(as_home, as_looking)).otherwise(as_home)
    placed = named.withColumn("at", F.explode(at)).select("band", "id", "label", "signature", "bands", "keys", "often", "at.*")
    own = F.collect_list(F.struct("id", "label", "home", "looks", "signature", "bands", "keys", "often")).alias("own")
    return placed.groupBy("band", "hand", "part").agg(own).filter(F.size("own") > 1).select("band", "own")


class Met:
    """The texts of a unit, and which of them are joined by now."""

    def __init__(self, own: list):
        own = sorted(own, key=lambda x: (x["id"], not x["home"]))  # no order of arrival decides anything
        self.own, self.ids = own, np.array([x["id"] for x in own])
        self.brief = np.frombuffer(b"".join(x["signature"] for x in own), np.uint8).reshape(len(own), -1)
        self.bands = np.array([x["bands"] for x in own], np.int64)
        self.root = {x["label"]: x["label"] for x in own}
        self.sets = [(np.frombuffer(x["keys"], U), np.frombuffer(x["often"], np.uint32)) for x in own]
        self.home = np.flatnonzero([x["home"] for x in own])
        self.of = np.array([x["label"] for x in own])

    def top(self, label):
        while self.root[label] != label:
            label = self.root[label]
        return label

    def alike(self, k: int, others: np.ndarray) -> np.ndarray:
        """J_P of text k and each of some others."""
        keys, often = self.sets[k]
        sizes = np.array([len(self.sets[j][0]) for j in others])
        flat = np.concatenate([self.sets[j][0] for j in others])
        at = np.searchsorted(keys, flat)
        hit = keys[np.minimum(at, len(keys) - 1)] == flat
        both = np.bincount(np.repeat(np.arange(len(others)), sizes)[hit], minlength=len(others))
        found = both / (len(keys) + sizes - both)
        for n, j in enumerate(others.tolist()):
            if len(often) or len(self.sets[j][1]):
                found[n] = probability_jaccard((keys, often if len(often) else np.ones(len(keys))), (self.sets[j][0], self.sets[j][1] if len(self.sets[j][1]) else np.ones(sizes[n])))
        return found

    def links(self, band: int, similar: float):
        """(a, b, similarity): enough links to join what links of this band's pairs join; a pair belongs to the first band that its texts share."""
        for k, x in enumerate(self.own):
            if not x["looks"]:
                continue
            others = self.home[self.of[self.home] != x["label"]]
            same = self.bands[others] == self.bands[k]
            others = others[same.any(axis=1) & (self.bands[k][same.argmax(axis=1)] == band)]
            alike = (self.brief[others] == self.brief[k]).mean(axis=1) - 1 / 256 if len(others) else np.zeros(0)
            others, alike = others[alike >= LIKELY], alike[alike >= LIKELY]
            others = others[np.argsort(-alike, kind="stable")]
            step = 8
            while len(others):
                now, others = others[:step], others[step:]
                step = min(step * 2, 256)
                for j, similarity in zip(now.tolist(), self.alike(k, now).tolist()):
                    one, other = self.top(x["label"]), self.top(self.own[j]["label"])
                    if similarity >= similar and one != other:
                        self.root[max(one, other)] = min(one, other)
                        a, b = sorted((x["id"], self.own[j]["id"]))
                        yield b, a, similarity
                one = self.top(x["label"])
                others = others[[self.top(label) != one for label in self.of[others].tolist()]] if len(others) else others


def last_links(units: DataFrame, similar: float) -> DataFrame:
    """a, b, similarity: every likely pair of two classes of a unit is verified exactly where it stands, so no pairs are written; links that join classes are."""

    def run(batches):
        for batch in batches:
            rows = [x for band, unit in zip(batch.column(0).to_pylist(), batch.column(1)) for x in Met(unit.as_py()).links(band, similar)]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return mapped(units, run, "a long, b long, similarity double")


def links(rows: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b, similarity: verified links between distinct texts, enough of them to join every class. rows: id, bands, signature."""
    spark = rows.sparkSession
    folder, result = scratch(spark), scratch(spark)
    members = members_of(rows, folder)
    ids = stored(members.select("id").distinct(), folder)
    texts = stored(texts.join(small(ids), "id", "left_semi"), folder)
    none = F.array().cast("array<long>")
    named, found = members.withColumns({"label": F.col("id"), "met": none}), None
    for turn in range(DEALT_TURNS):
        offers = stored(partners(dealt(named, turn)).distinct(), folder)
        whose = W.partitionBy("id")
        best = offers.withColumns({"first": F.row_number().over(whose.orderBy(F.col("alike").desc(), "partner")), "least": F.min("partner").over(whose)})
        best = best.filter("first = 1 or partner = least").select(F.greatest("id", "partner").alias("a"), F.least("id", "partner").alias("b"))
        new = stored(verified(best.distinct(), texts, folder), folder)
        found = new if found is None else found.unionByName(new)
        labels = small(stored(classes(found.filter(F.col("similarity") >= similar), folder), folder))
        failed = found.filter(F.col("similarity") < similar)
        met = failed.select(F.col("a").alias("id"), F.col("b").alias("with")).unionByName(failed.select(F.col("b").alias("id"), F.col("a").alias("with")))
        met = small(stored(met.groupBy("id").agg(F.collect_list("with").alias("met")), folder))
        named = members.join(labels, F.col("id") == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", "id")).join(met, "id", "left")
        buckets = stored(open_buckets(named), folder)
        named = stored(named.join(small(buckets), "band"), folder)
        settle(spark)
    ids = small(stored(named.select("id").distinct(), folder))
    weights = stored(weights_of(texts.join(ids, "id", "left_semi")), folder)
    sizes = weights.select("id", (F.octet_length("keys") + F.octet_length("often")).alias("own_bytes"))
    sizes = stored(named.select("band", "id").join(sizes, "id").groupBy("band").agg(F.sum("own_bytes").alias("bytes")), folder)
    named = named.drop("met").join(small(sizes), "band").join(rows.select("id", "bands"), "id").join(weights, "id")
    last = stored(last_links(whole_buckets(named), similar), folder)
    done = stored(found.filter(F.col("similarity") >= similar).unionByName(last), result)
    discard(spark, folder)
    return done


def nearby(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """node, label: the smallest id within a few links. Texts of one class may still differ in it, those of one label are of one class."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Tables of their own, so that a text with many links is a skewed join that Spark splits.
    low = stored(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), folder)
    near = both.join(low.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("near"))
    low = stored(low.join(near, "a").select("a", F.least("low", "near").alias("low")), folder)
    jump = low.filter("low < a").select(F.col("a").alias("low"), F.col("low").alias("lower"))
    return low.join(jump, "low", "left").select(F.col("a").alias("node"), F.coalesce("lower", "low").alias("label"))


def classes(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """node, label: the smallest id that can be reached, for each end of a link (a, b). Nodes are joined by what is nearby first; the labels that links still join are few."""
    near = stored(nearby(edges, folder), folder)
    one, other = near.select(F.col("node").alias("a"), F.col("label").alias("x")), near.select(F.col("node").alias("b"), F.col("label").alias("y"))
    between = edges.select("a", "b").join(one, "a").join(other, "b").filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    between = stored(between, folder)
    if between.isEmpty():
        return near
    both = stored(between.unionByName(between.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), folder)
    moved = not labels.isEmpty()
    while moved:
        step = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(step, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = stored(step.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")), folder)
        moved = not step.filter("label < before").isEmpty()
        labels = step.select("node", "label")
        settle(labels.sparkSession)
    last = labels.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return near.join(last, "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def near_dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, copy_of, group_size, kept, text_key for each row of docs (doc_id, text).

    class_id: smallest doc_id of the class. copy_of: smallest doc_id among texts of the same weights.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(sketched(docs))
    repeated = cut(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again")))
    # Rows without an id, or with one that several rows have, go by a hash of id and text.
    hashed = F.xxhash64("doc_id", "text_key")
    texts = docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))
    if repeated.isEmpty():
        own = F.coalesce("doc_id", hashed)
        nameless = not rows.filter("doc_id is null").isEmpty()
        rows, texts = rows.withColumn("id", own), texts.withColumn("id", own).select("id", "text")
    else:
        own, nameless = F.when(F.col("hit") | F.col("doc_id").isNull(), hashed).otherwise(F.col("doc_id")), True

        def with_id(df):
            return df.join(small(repeated).withColumn("hit", F.lit(True)), F.col("doc_id") == F.col("again"), "left").withColumn("id", own).drop("again", "hit")

        rows, texts = cut(with_id(rows)), with_id(texts).select("id", "text")
    if nameless:
        texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    # One row for each distinct text; a null id comes after any other.
    keep = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    first = rows.groupBy("same").agg(F.min(F.struct("id", "row")).alias("first"), F.min("doc_id").alias("copy_of"), F.min(keep).alias("keep"), F.count(F.lit(1)).alias("size"))
    first = cut(first.select("same", "copy_of", "keep", "size", F.col("first.id").alias("head"), F.col("first.row").alias("row")))
    heads = rows.join(first.select("row"), "row", "left_semi").select("id", "bands", "signature")
    labels = cut(classes(links(heads, texts, similar)))
    # Only classes of several texts are summed; the tables are cut, so that a large class or group of copies is a skewed join that Spark splits.
    named = cut(first.join(labels, F.col("head") == F.col("node")).select("same", "label", "keep", "size"))
    groups = cut(named.groupBy("label").agg(F.min("keep").alias("class_keep"), F.sum("size").alias("class_size")))
    named = cut(named.join(groups, "label").select("same", "class_keep", "class_size"))
    final = cut(first.join(named, "same", "left").select("same", "copy_of", F.coalesce("class_keep", "keep").alias("keep"), F.coalesce("class_size", "size").alias("group_size")))
    found = rows.select("doc_id", "row", "text_key", "same").join(final, "same")
    return found.select("doc_id", F.col("keep.doc_id").alias("class_id"), "copy_of", "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, with the columns that it came with."""
    decided = cut(near_dedup(docs))
    keys = [F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")]
    gone = decided.filter("not kept").select(*keys).distinct()
    stays = decided.filter("kept").select(*keys).join(gone.withColumnsRenamed({"gone_id": "i", "gone_key": "k"}), F.col("gone_id").eqNullSafe(F.col("i")) & (F.col("gone_key") == F.col("k")), "left_semi")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (text_key() == F.col("gone_key"))
    left = docs.join(gone, same, "left_anti")
    if stays.isEmpty():
        return left
    return left.unionByName(one_of_each(docs.join(stays, same, "left_semi")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_size", "kept")
