"""Exact and near dedup against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webquarry.llm import exact_dedup, near_dedup
from webquarry.llm.common import EDGES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "x") for i, t in rows], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(400)) for _ in range(n)]


def test_exact(spark):
    rng = random.Random(1)
    base = [" ".join(words(rng.randrange(0, 3000), k)) for k in range(20)]
    rows = [(k, rng.choice(base)) for k in range(150)] + [(200, None), (201, ""), (202, base[3] + " "), (203, base[4]), (203, base[4]), (204, "ä" * 20_000), (205, "ä" * 20_000)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    texts = {}
    for i, t in rows:
        texts[i] = t or ""
    assert len(got) == len(rows)
    for r in got:
        own = groups[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (max(own), len(own), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    assert Counter(r["keep_id"] for r in got if r["kept"]) == Counter(max(g) for g in groups.values())
    out = exact_dedup.stage(spark, docs(spark, rows), "")
    assert out.columns == docs(spark, []).columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(max(g) for g in groups.values())


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []
    assert exact_dedup.stage(spark, docs(spark, []), "").collect() == []


def test_chunks_join_to_the_text_and_follow_content():
    chunker = exact_dedup.Chunker()
    text = " ".join(words(8000, 5))
    (data, ends), (other, shifted) = chunker.chunks([text, "new start " + text])
    assert ends[-1] == len(data) and ends == sorted(ends) and max(np.diff([0, *ends])) <= exact_dedup.MAX_CHUNK
    one = {data[a:b] for a, b in zip([0, *ends], ends)}
    two = {other[a:b] for a, b in zip([0, *shifted], shifted)}
    assert len(one & two) > 0.8 * len(one)
    assert list(chunker.chunks([text, ""]))[0][1] == ends


def test_collided_identifiers_are_told_apart(spark):
    one = docs(spark, [(1, "abc"), (2, "abd"), (3, "abc")])
    doubtful = [h for h in (np.array([__import__("xxhash").xxh3_64_intdigest(b"abc")], np.uint64).view(np.int64).tolist())]
    rows = {r["doc_id"]: bytes(r["recipe"]) for r in exact_dedup.recipes(one.select("doc_id", "text"), doubtful).collect()}
    assert rows[1] == rows[3] and len(rows[1]) == 40 and len(rows[2]) == 8


def shingles(text):
    own = [w.strip(EDGES) or w for w in (text or "").lower().split()]
    return Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4)) if len(own) > 4 else Counter([tuple(own)] if own else [])


def jp(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a if d in b)


def test_probability_jaccard_is_exact():
    rng = random.Random(3)
    for _ in range(60):
        a = Counter({k: rng.randrange(1, 4) for k in rng.sample(range(30), rng.randrange(0, 20))})
        b = Counter({k: rng.randrange(1, 4) for k in rng.sample(range(30), rng.randrange(0, 20))})
        arrays = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        assert near_dedup.probability_jaccard(*arrays) == pytest.approx(jp(a, b))


def test_signatures_estimate_it():
    base = words(400, 9)
    texts = [" ".join(base), " ".join(base[:330] + words(70, 10)), " ".join(base + base[:100]), " ".join(words(300, 11))]
    sketch = near_dedup.Shingles()
    keys, often, _ = sketch(texts)
    signature = near_dedup.signatures(keys, often, 4, 2048)
    for i, j in itertools.combinations(range(4), 2):
        assert abs((signature[i] == signature[j]).mean() - jp(shingles(texts[i]), shingles(texts[j]))) < 0.05
    alone = near_dedup.signatures(*sketch([texts[1]])[:2], 1, 2048)
    assert (alone[0] == signature[1]).all()


def want_classes(rows):
    own = {i: shingles(t) for i, t in rows}
    root = {i: i for i in own}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(own.items(), 2):
        same = a == b and (a or dict(rows)[i] == dict(rows)[j] or not (dict(rows)[i] or dict(rows)[j]))
        if same or (a and b and jp(a, b) >= 0.8):
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in own}


def edited(base, n, seed):
    rng, own = random.Random(seed), list(base)
    for _ in range(n):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return " ".join(own)


def test_near_against_brute_force(spark):
    rows = []
    for g in range(12):
        base = words(120, 50 + g)
        rows += [(len(rows) + k, edited(base, k % 4, g * 100 + k)) for k in range(6)]
    rows += [(100, None), (101, ""), (102, " "), (103, "one two"), (104, "One, two!"), (105, "one three"), (106, rows[0][1]), (107, rows[0][1].upper())]
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs(spark, rows)).collect()}
    want = want_classes(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["group_size"] == sizes[want[i]] for i, r in got.items())
    assert {i for i, r in got.items() if r["kept"]} == set(want.values())
    out = near_dedup.stage(spark, docs(spark, rows), "")
    assert out.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in out.collect()) == sorted(set(want.values()))


def by_all_pairs(rows):
    """The class of each row, by J_P of all pairs."""
    sketch = near_dedup.Shingles()
    arrays = {i: sketch([t])[:2] for i, t in rows}
    root = {i: i for i in arrays}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(arrays, 2):
        if i // 1000 == j // 1000 and near_dedup.probability_jaccard(arrays[i], arrays[j]) >= 0.8:
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root}


@pytest.mark.parametrize("few,many,hand,tile", [(3, 6, 256, 1024), (4, 7, 16, 24), (5, 9, 256, 1024)])
def test_near_loses_no_link_around_the_threshold(spark, monkeypatch, few, many, hand, tile):
    """One base of 300 words with a few changed, so that from all to hardly any of the pairs are links; in one hand, and dealt to hands and tiles."""
    monkeypatch.setattr(near_dedup, "HAND", hand)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    base = words(300, 5)
    rows = [(k, edited(base, random.Random(k).randrange(few, many), k)) for k in range(150)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs(spark, rows).repartition(5)).collect()}
    assert got == by_all_pairs(rows)


def test_near_gives_the_same_rows_again(spark):
    base = words(300, 6)
    rows = [(k, edited(base, random.Random(k).randrange(4, 8), k)) for k in range(80)]
    one = near_dedup.near_dedup(docs(spark, rows).repartition(3)).drop("copy_of").collect()
    two = near_dedup.near_dedup(docs(spark, rows[::-1]).repartition(7)).drop("copy_of").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_units_of_unlike_texts(spark, monkeypatch):
    """A bucket of n unlike texts: units hold no text more often than their tiles ask for, and no pair comes of them."""
    monkeypatch.setattr(near_dedup, "HAND", 32)
    monkeypatch.setattr(near_dedup, "TILE", 64)
    signature = np.random.default_rng(1).integers(0, 256, (300, near_dedup.BANDS * near_dedup.ROWS)).astype(np.uint8)
    bands = [5] + [0] * (near_dedup.BANDS - 1)
    rows = [(5, k, 300, 0, bytearray(signature[k].tobytes()), bands, 2400, bytearray(np.arange(k, k + 9, dtype=np.uint64).tobytes()), bytearray()) for k in range(300)]
    members = spark.createDataFrame(rows, "band long, id long, n long, hub long, signature binary, bands array<long>, bytes long, keys binary, often binary")
    members = members.withColumns({"label": F.col("id"), "met": F.array().cast("array<long>")})
    first = [len(r["own"]) for r in near_dedup.dealt(members, 0).collect()]
    assert sum(first) == 300 + len(first) - 1
    members = members.join(near_dedup.open_buckets(members), "band")
    last = [len(r["own"]) for r in near_dedup.whole_buckets(members).collect()]
    assert len(last) == 25 and sum(last) == 300 * 5 + 299 * 5
    assert near_dedup.partners(near_dedup.dealt(members, 0)).collect() == near_dedup.last_links(near_dedup.whole_buckets(members), 0.8).collect() == []


def test_near_large_groups(spark):
    """Groups beyond one hand, in which about half of the pairs are links, against all pairs."""
    rows = [(g * 1000 + k, edited(words(150, 77 + g), 2 + k % 4, g * 1000 + k)) for g in range(2) for k in range(150)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs(spark, rows)).collect()}
    want = by_all_pairs(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(set(want.values())) > 2 and not wrong, wrong


def one_bucket(spark, more, band):
    """rows and texts for `links`: 1 is most like 2 by its signature and alike to 3 alone; 3 and those from 4 on are one text, 2 is alike to them."""
    base = words(100, 31)
    one, two = list(base), list(base)
    one[20], one[70], two[35], two[85] = "a1", "a2", "b1", "b2"
    signature = np.zeros((4, near_dedup.BANDS * near_dedup.ROWS), np.uint8)
    signature[1, 186:], signature[2, 140:], signature[3, 120:] = 1, 1, 1
    ids = range(1, 4 + more)
    bands = [band] + [0] * (near_dedup.BANDS - 1)
    rows = spark.createDataFrame([(k, bands, bytearray(signature[min(k, 4) - 1].tobytes())) for k in ids], "id long, bands array<long>, signature binary")
    return rows, spark.createDataFrame([(k, " ".join({1: one, 2: two}.get(k, base))) for k in ids], "id long, text string")


def test_links_go_on_after_the_most_alike(spark):
    """The likeliest pair of a text is none; its link is its next likely one, which no forest needs."""
    found = near_dedup.links(*one_bucket(spark, 8, 4)).collect()
    assert (3, 1) in {(r["a"], r["b"]) for r in found}


@pytest.mark.parametrize("band", [4, 5, 6, 7])
def test_large_buckets_of_each_band_are_dealt(spark, monkeypatch, band):
    """A bucket of several hands, whichever its band: no band is left out."""
    monkeypatch.setattr(near_dedup, "HAND", 16)
    found = near_dedup.links(*one_bucket(spark, 100, band)).collect()
    assert (3, 1) in {(r["a"], r["b"]) for r in found}


def test_null_ids_are_documents(spark):
    """A null id with a copy and a near copy is in their class; alone, it is compared like any other."""
    base = words(80, 8)
    near = edited(base, 1, 3)
    rows = [(1, " ".join(base)), (2, near), (None, " ".join(base)), (None, edited(base, 1, 4)), (None, "q r"), (None, "q r"), (5, None), (5, "")]
    got = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["group_size"], r["kept"]) for r in got) == [
        (0, 0, 2, False), (0, 0, 2, True), (0, 1, 4, False), (0, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (5, 5, 2, False), (5, 5, 2, True),
    ]
    assert sorted((r["doc_id"] or 0) for r in near_dedup.stage(spark, docs(spark, rows), "").collect()) == [0, 1, 5]


def test_near_repeated_ids_and_empty(spark):
    base = words(60, 5)
    rows = [(1, " ".join(base)), (1, " ".join(base)), (1, "quite another text of six words"), (2, edited(base, 1, 3)), (None, "x y z")]
    got = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 3
    assert len(near_dedup.stage(spark, docs(spark, rows), "").collect()) == 3
    assert near_dedup.near_dedup(docs(spark, [])).collect() == []


def test_classes_of_long_chains(spark):
    edges = [(k + 1, k) for k in range(100, 140)] + [(7, 3), (9, 7), (3, 9), (500, 2), (501, 500), (501, 2)]
    got = {r["node"]: r["label"] for r in near_dedup.classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 3: 3, 7: 3, 9: 3, 2: 2, 500: 2, 501: 2}
    assert near_dedup.classes(spark.createDataFrame([], "a long, b long")).collect() == []
