"""The pipeline's contract, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import both

import corpus_pipeline
from webquarry.llm.common import cut
from webquarry.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@needs
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    found, wanted = both(spark, FOLDER, QUERIES[name], ORACLES[name])
    assert found == wanted


@needs
def test_each_stage_takes_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[5] > 0


@needs
def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


ROWS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, keep string"


@pytest.mark.parametrize("name,stage", [(n, s) for n, s in corpus_pipeline.STAGES if n in ("exact_dedup", "near_dedup")])
def test_null_and_empty_text_under_one_id_are_one_row(spark, name, stage):
    rows = [(5, None, "en", "a", 0, "x", "y"), (5, "", "en", "a", 0, "x", "y"), (6, "some text of six words here", "en", "a", 9, "x", "y"), (6, "some text of six words here", "en", "a", 9, "x", "y"), (None, "only this", "en", "a", 9, "x", "y")]
    got = stage(spark, spark.createDataFrame(rows, ROWS), "").collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 5, 6]


def test_mixing_takes_what_is_planned_for_rows_that_repeat_an_id(spark):
    from collections import Counter

    from webquarry.llm import mixing

    for seed in range(3):
        rows = [(k % 7 or None, " ".join(["w"] * (3 * k * (seed + 1) % 41)), "en", "abc"[k % 3], 1, "x", "y") for k in range(60)] + [(1, None, "en", "a", 0, "x", "y"), (1, "", "en", "a", 0, "x", "y"), (2, "w w w", "en", None, 0, "x", "y"), (2, "w w w", "en", None, 0, "x", "y")]
        docs = spark.createDataFrame(rows, ROWS)
        planned, taken = Counter(), Counter()
        for r in mixing.mix(docs).collect():
            planned[r["doc_id"], r["source"]] += r["taken"]
        out = mixing.stage(spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            taken[r["doc_id"], r["source"]] += len((r["text"] or "").split())
        assert {k: v for k, v in planned.items() if v} == {k: v for k, v in taken.items() if v}


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls in each column, repeated ids, then no rows at all, through all stages."""
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None, None, None, None, None, None), (None, "a b", None, "s", 3, "x", "y"), (None, None, None, None, None, None, None), (2, "word " * 5000, "en", "s", 9, "x", "y"), (2, "other", "en", "s", 9, "x", "y"), (3, "", "", "", 0, "", "")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, ROWS)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
                docs = cut(out)
        assert (out.count() > 0) == bool(some)
