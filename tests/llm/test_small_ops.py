"""Quality, fingerprints, chat, mixing, packing, extraction, toxicity, url filters: results, and the cases that each docstring defines."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webquarry.llm import chat, fingerprint, html_extract, mixing, packing, quality, toxicity, url_filter
from webquarry.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, score double, rule string"


def docs(spark, rows):
    """rows: (doc_id, text, source); with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 9.0, "y") for i, t, s in rows], DOCS)


AWKWARD = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one", ""), (5, "word " * 30_000, "a"), (6, "one", "b"), (6, "one", "b"), (7, "x.y? z!\n\nä ö\u2003ü", None)]


# ---- toxicity ---------------------------------------------------------------------------------------------


def toxic_rows(n=600):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        own = list(rng.choice(words, 60))
        bad = k % 6 == 0
        if bad:
            own[int(rng.integers(60))] = ["vile", "vilest", "nasty"][k % 3]
        rows.append((k, " ".join(own), "s"))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(found) == len(rows)
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(found[i]["predicted"], t) for i, _, t in labels if found[i]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_toxicity_order_of_arrival_does_not_matter():
    rows, labels = toxic_rows(120)
    one = toxicity.fit([r[0] for r in rows], [r[1] for r in rows], [x[2] for x in labels])
    two = toxicity.fit([r[0] for r in rows[::-1]], [r[1] for r in rows[::-1]], [x[2] for x in labels[::-1]])
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and one[2] == two[2]


def test_ftrl_against_the_plain_rules():
    """Weights of the vectorised learner against the update rules, one coordinate at a time."""
    import math

    rng = np.random.default_rng(9)
    model = toxicity.Ftrl(6, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n, bias_z, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.3 else -(z[i] - math.copysign(0.3, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.1)

    for _ in range(200):
        found, label = np.unique(rng.integers(0, 64, 8)), int(rng.integers(2))
        bias = -bias_z * 0.5 / (1 + math.sqrt(bias_n))
        g = 1 / (1 + math.exp(-(sum(weight(i) for i in found.tolist()) + bias))) - label
        for i in found.tolist():
            w = weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w
            n[i] += g * g
        bias_z, bias_n = bias_z + g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / 0.5 * bias, bias_n + g * g
        model.learn(found, label)
    assert model.weights(np.arange(64)).tolist() == pytest.approx([weight(i) for i in range(64)], abs=1e-4)


def test_toxicity_rows_that_repeat_an_id_teach_once(spark):
    rows, labels = toxic_rows(200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = toxicity.train(docs(spark, rows), known)
    two = toxicity.train(docs(spark, [*rows, *[(i, t + "~", s) for i, t, s in rows[:40] * 5]]), known)
    assert len(one[0]) and all(np.array_equal(x, y) for x, y in zip(one, two, strict=True))


def test_toxicity_awkward(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        assert toxicity.toxicity(docs(spark, AWKWARD), labels).count() == len(AWKWARD)
    assert toxicity.toxicity(docs(spark, []), none).collect() == []


# ---- quality ----------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(700):
        good = k % 3 > 0
        own = [f"w{x}" + ("" if good else "%%%") for x in rng.integers(0, 200, 50)]
        rows.append((k, (" " if good else "\n").join(own), "s"))
        if k % 2:
            labels.append((k, int(good), 0))
    found = {r["doc_id"]: r for r in quality.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(found) == 700 and all(0 <= r["score"] <= 1 for r in found.values())
    assert np.mean([found[k]["predicted"] == int(k % 3 > 0) for k in range(700) if found[k]["held_out"]]) > 0.95


def taught_in_memory(views, meta_size, y, same, ids, free, rounds, exchanged):
    """Co-training by plain loops over all rows."""
    learners = quality.Learners(meta_size)
    for k in range(rounds + 1):
        learners.fit(views, y, same)
        if k == rounds:
            return learners.combined(views, y), learners
        sizes, found = learners.strata(exchanged), []
        for own in range(quality.LEARNERS):
            for v in (0, 1):
                margins = views[v].margins(learners.models[own][v])
                best = {}
                for row in range(len(y)):
                    if y[row] < 0 and free[row] and int(same[row]) not in learners.taught[own][1 - v]:
                        label = int(margins[row] > 0)
                        if 1 / (1 + np.exp(-abs(margins[row]))) >= quality.SURE:
                            place = (label, int(same[row]) % sizes[label])
                            best[place] = min(best.get(place, (9.0,)), (-abs(margins[row]), int(same[row]), int(ids[row])))
                found += [(own, 1 - v, row[1], label) for (label, _), row in best.items()]
        for own, v, row, label in found:
            learners.taught[own][v][row] = label


def test_views_teach_each_other():
    """A small case by hand: the text view tells only some rows, the metadata view, by the pool, the others."""
    rng = np.random.default_rng(2)
    n = 400
    truth = rng.integers(0, 2, n)
    told = rng.random(n) < 0.5
    ids = np.where(told, truth, 2)
    text = quality.Sparse(ids, np.ones(n, np.int64), np.ones(n))
    meta = quality.Sparse(truth + 2 * rng.integers(0, 5, n), np.ones(n, np.int64), np.ones(n))
    y, rows = np.where(np.arange(n) < 20, truth, -1), np.arange(n)
    right = lambda model: ((meta.margins(model) > 0) == truth).mean()
    ((_, meta_model), _, _), _ = taught_in_memory((text, meta), 10, y, rows, rows, rows >= 0, 3, 400)
    ((_, alone), _, _), _ = taught_in_memory((text, meta), 10, y, rows, rows, rows >= 0, 0, 400)
    assert right(meta_model) == 1.0 and right(meta_model) >= right(alone)


def test_co_training_against_plain_loops(spark):
    """The same models as by loops over all rows: copies, repeated ids, rows without an id, and a few strata."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        own = [f"w{x + (0 if good else 60)}" for x in rng.integers(0, 120, 40)]
        rows.append((k, (" " if k % 2 else "\n").join(own), "s" if good else None))
        if k < 150:
            labels.append((k, int(good), 0))
    rows += [(400 + k, rows[200][1], "s") for k in range(100)] + [rows[5], rows[300], (None, rows[210][1], "s"), (5, "another text", "s")]
    rows += [(900 + i, t, s) for i, t, s in AWKWARD]
    found = cut(quality.traits(docs(spark, rows).repartition(5)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    (models, scales, stack, edges) = quality.train(found, known, exchanged=30, rounds=2)

    data = found.toArrow().to_pylist()
    assert len(data) == len(rows)
    for c in range(quality.FIGURES):
        values = np.array([r["figures"][c] for r in data])
        exact = np.unique(np.floor(np.quantile(values, np.arange(1, quality.BINS) / quality.BINS, method="inverted_cdf") / quality.CELL) * quality.CELL)
        assert np.array_equal(edges[c], exact)
    held = lambda r: r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
    truth = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    own = {}
    for r in data:
        if r["doc_id"] in truth and (r["doc_id"] not in own or r["same"] < own[r["doc_id"]]["same"]):
            own[r["doc_id"]] = r
    own = sorted(own.values(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & (2**64 - 1), r["doc_id"]))
    pool = sorted((r for r in data if not held(r) and r["doc_id"] not in truth), key=lambda r: (r["same"], r["doc_id"]))
    pool = [r for k, r in enumerate(pool) if not k or r["same"] != pool[k - 1]["same"]]
    y = np.array([truth[r["doc_id"]] for r in own] + [-1] * len(pool))
    every = own + pool
    table = found.toArrow().schema
    views = quality.seen(quality.pa.Table.from_pylist(every, schema=table), edges)
    same, ids = np.array([r["same"] for r in every]), np.array([r["doc_id"] for r in every])
    (plain, plain_scales, plain_stack), learners = taught_in_memory(views, quality.META_SIZE, y, same, ids, same == same, 2, 30)
    assert sum(len(x) for pair in learners.taught for x in pair) > 30
    for one, two in zip(models, plain):
        assert np.allclose(one.w, two.w, atol=1e-9) and abs(one.b - two.b) < 1e-9
    assert np.allclose(scales, plain_scales) and np.allclose(stack, plain_stack)


def test_quality_awkward(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, AWKWARD), none).collect()
    assert len(got) == len(AWKWARD) and {r["score"] for r in got} == {0.5}
    assert quality.classify(docs(spark, []), none).collect() == []


# ---- fingerprints -----------------------------------------------------------------------------------------


def edited(rows):
    order = sorted(rows)
    out = {}
    for k, (i, text) in enumerate(order):
        n = len(text)
        out[i] = text[: n - n // 2] + order[(k + 1) % len(order)][1][: n // 2]
    return out


def branches_apart(a, b):
    """Sections and paragraphs in which two texts differ, from the texts themselves."""
    one, two = ([s.split("\n") for s in re.split(r"(?<=\n)(?=[ \t]*\n)", t)] for t in (a, b))
    out = []
    for k in range(max(len(one), len(two))):
        x, y = one[k] if k < len(one) else None, two[k] if k < len(two) else None
        if x != y:
            x, y = x or [], y or []
            out.append((k, [p for p in range(max(len(x), len(y))) if x[p : p + 1] != y[p : p + 1]]))
    return out


def alike(a, b):
    """Share of characters in stretches that both texts have."""
    one, two = (set(re.findall(r"[^.!?,;\n]{1,48}[.!?,;\n]*|[.!?,;\n]+", t)) for t in (a, b))
    if a == b:
        return 1.0
    size = lambda found: sum(min(255, len(x)) for x in found)
    return 2 * size(one & two) / (size(one) + size(two)) if one or two else 0.0


@pytest.mark.parametrize("spread", [1, 10_000])
def test_fingerprints(spark, spread):
    rng = np.random.default_rng(1)
    rows = [(int(k) * spread, "\n".join(" ".join(rng.choice(["äa", "bb", "cc. ", "dd", "ee"], 30)) for _ in range(int(rng.integers(1, 5)))) * int(rng.integers(0, 3))) for k in range(1, 1200)]
    rows[3] = (rows[3][0], rows[7][1])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    want = edited(rows)
    assert {i: r["edited_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert all(r["n_chars"] == len(dict(rows)[i]) for i, r in got.items())
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("near_edited", "near_next"))
    order = [i for i, _ in sorted(rows)]
    for k, i in enumerate(order[:300]):
        text, next_text = dict(rows)[i], dict(rows)[order[k + 1]]
        assert [(d["section"], list(d["paragraphs"])) for d in got[i]["differs"]] == branches_apart(text, want[i])
        assert got[i]["near_edited"] == pytest.approx(alike(text, want[i])) and got[i]["near_next"] == pytest.approx(alike(text, next_text))


def test_fingerprints_awkward(spark):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(spark, AWKWARD)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and fingerprint.fingerprints(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert fingerprint.fingerprints(docs(spark, [])).collect() == []
    alone = fingerprint.fingerprints(docs(spark, [(9, "abcd", "s")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0


def test_fingerprints_of_null_and_repeated_ids(spark):
    """Each row has its own result, in the order of id (null last) and the SHA-256 of the text."""
    rng = np.random.default_rng(5)
    ids = [None if k % 9 == 0 else 4 if k % 3 == 0 else int(rng.integers(0, 500)) * 1000 for k in range(1500)]
    rows = [(i, None if k % 50 == 0 else "same" if k % 4 == 0 else " ".join(rng.choice(["äa", "bb.", "cc"], int(rng.integers(0, 12))))) for k, i in enumerate(ids)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, sha(r[1])))
    nexts = order[1:] + order[:1]
    want = Counter((i, len(t), sha(t[: len(t) - len(t) // 2] + u[: len(t) // 2]), round(alike(t, u), 9)) for (i, t), (_, u) in zip(order, nexts, strict=True))
    got = fingerprint.fingerprints(docs(spark, [(i, t, "s") for i, t in rows]).repartition(7)).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_next"], 9)) for r in got) == want


def test_separators_are_part_of_the_root(spark):
    texts = ["a\n\nb", "a\n \nb", "a\nb", "a\n\n\nb", "a\n\nb\n", "ab"]
    got = docs(spark, [(k, t, "s") for k, t in enumerate(texts)]).select(fingerprint.root_of(fingerprint.paragraph_nodes(F.col("text"))).alias("r")).collect()
    assert len({r["r"] for r in got}) == len(texts)


def test_differing_branches(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nX\n\nc\nd"), ("a", "a"), ("a", "a\n\nb")], "x string, y string")
    nodes = [fingerprint.paragraph_nodes(F.col(c)) for c in "xy"]
    got = [[(d["section"], list(d["paragraphs"])) for d in r["d"]] for r in df.select(fingerprint.differing(*nodes).alias("d")).collect()]
    assert got[0] == [(0, [1])] and got[1] == []
    assert [s for s, _ in got[2]] == [0, 1]


# ---- chat -------------------------------------------------------------------------------------------------


def test_chat_rotation(spark):
    turns = spark.createDataFrame([(1, 2, "bob", "yo"), (1, 0, "system", "be"), (1, 1, "ann", "hi <|im_end|>"), (2, 0, "system", "x")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "")}
    ann = got[1, "ann"]
    assert ann["rendered"] == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>assistant\nhi <\\|im_end|><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n"
    begin, end = map(int, ann["loss_spans"].split("-"))
    assert ann["rendered"][begin:end] == "hi <\\|im_end|><|im_end|>\n" and ann["loss_chars"] == end - begin
    assert got[2, ""]["loss_chars"] == 0


def test_chat_clashing_columns_and_long_texts(spark):
    rows = [(1, k, f"r{k % 3}", "long " * 20_000, "x", 1, "y") for k in range(9)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string, part int, rendered string")).collect()
    assert len(got) == 3 and all(r["n_turns"] == 9 and r["n_chars"] == len(r["rendered"]) > 900_000 for r in got)


def test_chat_long_conversation_in_parts(spark):
    rows = [(7, k // 2, f"r{k % 2}", f"t{k}") for k in range(1000)] + [(None, None, None, None)] * 3
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for who in ("r0", "r1"):
        parts = sorted((r["part"], r) for r in got if r["perspective"] == who)
        assert [p for p, _ in parts] == list(range(16)) and sum(r["n_turns"] for _, r in parts) == 1000
        whole = "".join(r["rendered"] for _, r in parts)
        assert re.findall(r"t(\d+)<", whole) == [str(k) for k in range(1000)]
    lost = [r for r in got if r["conv_id"] is None]
    assert len(lost) == 1 and lost[0]["n_turns"] == 3
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# ---- mixing -----------------------------------------------------------------------------------------------


def filled(sizes, weights, share, cap):
    """Water-filling by repeated clamping."""
    budget, free, target = share * sum(sizes), set(range(len(sizes))), {}
    while True:
        left = budget - sum(cap * sizes[k] for k in target)
        total = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / total > cap * sizes[k]]
        if not over:
            return [target.get(k, left * weights[k] / total if k in free else 0) for k in range(len(sizes))]
        for k in over:
            target[k] = cap * sizes[k]
            free.discard(k)


def test_mixing_against_repeated_clamping(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(0, 40)), "abcdefghij"[min(9, int(rng.exponential(3)))]) for k in range(800)] + [(900, "a b c", None), (901, None, None)]
    got = mixing.mix(docs(spark, rows)).collect()
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, filled(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)))
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[n] - want[n]) <= 1 for n in names)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in got)


def test_mixing_awkward(spark):
    got = mixing.mix(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, "", "a"), (2, None, "b")])).collect()] == [0, 0]


def test_mixing_stage_repeats_and_cuts(spark):
    rows = [(k, " ".join(f"w{k}.{j}" for j in range(20)), "ab"[k % 2]) for k in range(40)]
    source = docs(spark, rows)
    out = mixing.stage(spark, source, "").collect()
    assert list(out[0].asDict()) == source.columns
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(source).collect()}
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(r["text"].split())
        assert dict((i, t) for i, t, _ in rows)[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert {i: n for i, n in plan.items() if n} == dict(words)


# ---- packing ----------------------------------------------------------------------------------------------


def checked(rows, by_doc):
    """Pieces of each document cover it once; sequences are gapless; returns (ids, padding)."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, ids in by_doc.items():
        own = sorted(pieces[i], key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return sum(map(len, by_doc.values())), padding


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(["Über", "it's", "don't", "x9", "naïve—ok", "word", "<|endoftext|>", "Σας"], int(rng.integers(0, 900)))), "s") for k in range(300)]
    rows += [(500, None, "s"), (501, "", "s"), (502, "tail " * 20_000, "s"), (503, "\x1cx y\u2003z", "s")]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by_doc = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    total, padding = checked(packing.pack(docs(spark, rows)).collect(), by_doc)
    assert padding <= 0.01 * total
    assert packing.pack(docs(spark, [])).collect() == []


def test_packing_takes_loss_from_a_column(spark):
    """A sequence bears no more loss than the limit, which binds before the tokens do."""
    rows = [(k, "word " * 300, "s", [0.0, 0.5, 1.0, None][k % 4]) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, masked double").coalesce(2)
    got = packing.pack(df, max_loss=1000, loss="masked").collect()
    shares = {k: 1.0 if x is None else x for k, _, _, x in rows}
    bears, tokens = Counter(), Counter()
    for r in got:
        bears[r["sequence_id"]] += r["length"] * shares[r["doc_id"]]
        tokens[r["sequence_id"]] += r["length"]
    assert max(bears.values()) <= 1000 and max(tokens.values()) <= 4096
    free = Counter(r["sequence_id"] for r in packing.pack(df).collect())
    assert len(bears) > len(free)


def test_packer_holds_every_limit():
    rng = np.random.default_rng(6)
    packer, out, items = packing.Packer(100, 5, 60), [], {}
    for key in range(400):
        n, loss = int(rng.integers(1, 140)), float(rng.choice([0.0, 0.5, 1.0]))
        items[key] = (n, loss)
        out += packer.add(key, n, loss)
    out += packer.finish()
    seen = Counter()
    for sequence in out:
        assert sum(n for _, _, n in sequence) <= 100 and len(sequence) <= 5 and sum(n * items[k][1] for k, _, n in sequence) <= 60
        seen.update({k: 0 for k, _, _ in sequence})
        for k, _, n in sequence:
            seen[k] += n
    assert dict(seen) == {k: n for k, (n, _) in items.items()}


# ---- html -------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href="/a">A</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>One  two<br><p>Three&nbsp;four<ul><li>five<li>six</ul><div class="share">Share {n}</div><div class="x">Repeated line</div><p>own text {n}</p></article>
<section id="comments"><p>First!</p></section><form><input>Send</form><script>var a="</p><p>no";</script><footer>F</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(k, f"https://h.net/{k}", PAGE.replace("{n}", str(k))) for k in range(30)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, r in got.items():
        assert "Site" not in r["text"] and "Buy" not in r["text"] and "First" not in r["text"] and "Share" not in r["text"] and "no" not in r["text"].split()
        assert f"own text {k}" in r["text"].split("\n") and r["n_chars"] == len(r["text"])
        assert "Repeated line" not in r["text"]  # the same in all pages of the host, and no style of its own


def test_html_single_page_keeps_its_article(spark):
    got = html_extract.extract(spark.createDataFrame([(1, "https://one.net/", PAGE)], "page_id long, url string, html string")).first()
    assert got["text"].split("\n") == ["Head & line", "One two", "Three four", "five", "six", "Repeated line", "own text {n}"]


def site(spark, n, hosts=1):
    """Pages of hosts without any tag or class that a list knows: a menu, notices, an article of varied length, an end; all from pools."""
    rng = np.random.default_rng(7)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 5000, k))
    menus, ends = [word(6) for _ in range(20)], [word(9) for _ in range(20)]
    rows = []
    for k in range(n):
        text = [word(int(rng.integers(30, 120))) for _ in range(int(rng.integers(1, 9)))]
        top, end = menus[int(rng.integers(20))], ends[int(rng.integers(20))]
        body = "".join(f"<p>{t}</p>" for t in text)
        rows.append((k, f"https://h{k % hosts}.net/{k}", f"<body><div class=q><ul>{''.join(f'<li>{w}</li>' for w in top.split())}</ul></div><div class=r>Our offer: {end}</div><div class=s><h2>Title {k}</h2>{body}<div class=z>Always here</div></div><div class=t>End {end}</div></body>", [f"Title {k}", *text]))
    return spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"), {r[0]: r[3] for r in rows}


def test_html_tree_alone_finds_the_article(spark):
    """No list helps here: the tree removes menus, notices and ends, and loses no block of the articles."""
    pages, want = site(spark, 40, 2)
    got = {r["page_id"]: r["text"].split("\n") for r in html_extract.extract(pages, prior=False).collect()}
    assert got == want
    assert got == {r["page_id"]: r["text"].split("\n") for r in html_extract.extract(pages).collect()}
    without = html_extract.extract(pages, tree=False).first()["text"]
    assert "Our offer" in without and "Always here" in without


def test_html_tree_against_brute_force(spark):
    import math

    pages, _ = site(spark, 12)
    hosted = html_extract.with_parts(pages).drop("path")
    got = {r["node"]: r for r in html_extract.importance(hosted).collect()}
    parsed = [(r["host"], html_extract.Page(r["html"])) for r in hosted.collect()]
    paths = {branch for _, p in parsed for path, *_ in p.blocks for branch in html_extract.branches(path)}
    assert len(got) == len(paths)
    for path in paths:
        r = got[html_extract.key_of(f"{parsed[0][0]}\0{path}")]
        styles, contents, shares, m = Counter(), {}, 0.0, 0
        for k, (_, p) in enumerate(parsed):
            below = [b for b in p.blocks if b[0] == path or b[0].startswith(path + "/")]
            if not below:
                continue
            m += 1
            styles[" ".join(p.styles.get(path, []))] += 1
            shares += sum(len(b[1].split()) for b in below) / sum(len(b[1].split()) for b in p.blocks)
            for b in p.blocks:
                if b[0] == path:
                    contents.setdefault(b[1], Counter())[k] += 1
        entropy = lambda c: -sum(v / sum(c.values()) * math.log(v / sum(c.values())) for v in c.values())
        presentation = entropy(styles) / math.log(m)
        content = 1 - (np.mean([entropy(c) for c in contents.values()]) / math.log(m) if contents else 0)
        joined = (1 - 0.9 ** len(styles)) * presentation + 0.9 ** len(styles) * content
        assert r["pages"] == m and r["presentation"] == pytest.approx(presentation, abs=1e-9) and r["content"] == pytest.approx(content, abs=1e-9)
        assert r["share"] == pytest.approx(shares / m) and r["importance"] == pytest.approx(joined * shares / m, abs=1e-9)


def test_html_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>line {k} of it</p>" for k in range(20_000)) + "</article>"
    rows = [(k, "https://l.net/a", "<nav>menu</nav>" + long) for k in range(6)] + [(9, None, long)]
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"].split("\n") == [f"line {k} of it" for k in range(20_000)]


def test_html_awkward(spark):
    bad = [None, "", "<", "<p", "a < b", "<p>x<script>y", "<!-- open", "<div class='", "&amp;&#x41;&nope;", "<p>" * 3000 + "deep", "</p></div>text"]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame([(k, None if k % 2 else "u://h/p", h, "z") for k, h in enumerate(bad)], "page_id long, url string, html string, text string")).collect()}
    assert got[0] == got[1] == "" and got[5] == "x" and got[8] == "&A&nope;" and got[9] == "deep" and got[10] == "text"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_low_nodes_by_join_are_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"https://h{k % 3}.net/{k}", PAGE.replace("{n}", str(k))) for k in range(30)], "page_id long, url string, html string")
    one = {tuple(r) for r in html_extract.extract(pages).collect()}
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", -1)
    assert {tuple(r) for r in html_extract.extract(pages).collect()} == one


# ---- url filter -------------------------------------------------------------------------------------------


def judged(url, rules):
    """Brute force: the longest rule that fits."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


RULES = [("block", "net", "/"), ("allow", "a.net", "/en/"), ("block", "a.net", "/en/x"), ("allow", "b.a.net", "/"), ("block", "org", "/d"), ("allow", "org", "/d"), ("block", "c.org", "/d/e/f")]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_RULES, 2])
def test_url_filter_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    hosts, paths = ["a.net", "B.A.net", "x.net", "xa.net", "net", "org", "c.org", "z.c.org", "com", "", ".net", "a.net:80"], ["", "/", "/en", "/en/", "/en/xy", "/d", "/dx", "/d/e/fg", "/d/e", "?q", "#f", "/en/?a=/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "//", "") for h in hosts for p in paths] + [None, "", "://", "x://://a.net/en/"]
    got = url_filter.filter_urls(spark.createDataFrame([(k, u, "q", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string"), RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(urls[r["page_id"]], RULES), r


def test_url_filter_awkward_urls_and_rules(spark, monkeypatch):
    """Repeated rows, very long urls, many rules under one segment, paths of many lengths; a rule without host is refused by both ways."""
    rules = [("block", "x.net", f"/{k}") for k in range(300)] + [("allow", "x.net", "/" + "a" * n) for n in range(1, 200)]
    urls = ["https://x.net/299/z", "https://x.net/299/z", "https://y.x.net/" + "a" * 150 + "b", "https://x.net/" + "q" * 50_000, "https://x.net/" + "a" * 50_000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    one = sorted(tuple(r) for r in url_filter.filter_urls(frame, rules).select("page_id", "rule", "verdict").collect())
    assert [r[1] for r in one] == ["x.net/299", "x.net/299", "x.net/" + "a" * 150, None, "x.net/" + "a" * 199]
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 2)
    assert one == sorted(tuple(r) for r in url_filter.filter_urls(frame, rules).select("page_id", "rule", "verdict").collect())
    with pytest.raises(ValueError):
        url_filter.filter_urls(frame, [*rules, ("block", "", "/")]).collect()


def test_url_filter_awkward(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    with pytest.raises(ValueError):
        url_filter.Trie([("block", "", "/")])


def test_cut_keeps_rows(spark):
    assert cut(spark.range(5)).count() == 5
