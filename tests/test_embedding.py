"""Word vectors, their index and neighbours of the whole vocabulary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.operators import embedding as V
from veilspark.operators import similarity as S
from veilspark.plans import domain


@pytest.fixture(scope="module")
def vocabulary(spark):
    # words of two parts, so that neighbours share one
    rows = spark.range(6000).select("id", F.concat(F.element_at(F.array(*map(F.lit, ["copper", "velvet", "gravel", "meadow", "falcon", "harbor"])), (F.col("id") % 6 + 1).cast("int")), F.lit("_"), F.sha2(F.floor(F.col("id") / 7).cast("string"), 256).substr(1, 5), (F.col("id") % 7).cast("string")).alias("word"))
    return rows.cache()


def test_recall_of_the_index(spark, vocabulary):
    words = vocabulary.select("word")
    asked = vocabulary.filter("id % 100 = 0").select("word")
    model = V.fit(words)
    got = {(r["query"], r["word"]) for r in V.neighbours(asked, words, 10, model).collect()}
    whole = V.neighbours(asked, words, 10, model, probes=V.CELLS).collect()
    all_words = sorted(r["word"] for r in words.distinct().collect())
    v = model.embed(all_words)
    want = set()
    for q in {r["word"] for r in asked.collect()}:
        near = np.round(model.embed([q])[0] @ v.T, 6)
        order = sorted((-s, w) for s, w in zip(near, all_words, strict=True) if w != q)[:10]
        want |= {(q, w) for _, w in order}
    assert len({(r["query"], r["word"]) for r in whole} & want) >= 0.999 * len(want)
    assert len(got & want) >= 0.9 * len(want)


def test_vectors_tell_words_apart(spark, vocabulary):
    model = V.fit(vocabulary.select("word"))
    a, b, c, none = model.embed(["copper_12345", "copper_12346", "velvet_abcde", ""])
    assert a @ b > 0.8 > a @ c + 0.2
    assert np.isfinite(none).all()


def test_nulls_and_empty(spark):
    words = spark.createDataFrame([(None,), ("",), ("same",), ("same",), ("sane",)], "word string")
    got = V.neighbours(words, words, 3).collect()
    assert {(r["query"], r["word"]) for r in got} == {(a, b) for a in ("", "same", "sane") for b in ("", "same", "sane") if a != b}
    none = spark.createDataFrame([], "word string")
    assert V.neighbours(none, none, 3).count() == 0


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_blocks_change_nothing(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "ROWS", blocks[0])
    monkeypatch.setattr(S, "QUERIES", blocks[1])
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.array(*(F.round(F.sin(F.col("id") * k + k), 1) for k in (1, 2, 3))).alias("embedding"))
    got = S.nearest(v.filter("vec_id % 4 = 0"), v, 5).collect()
    rows = {r["vec_id"]: np.array(r["embedding"]) for r in v.collect()}
    for q in range(0, 40, 4):
        unit = lambda x: x / np.linalg.norm(x)
        order = sorted((-round(float(unit(rows[q]) @ unit(x)), 9), i) for i, x in rows.items() if i != q)[:5]
        assert [(r["vec_id"], r["similarity"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in order]


def test_hybrids_take_the_whole_vocabulary(spark, small):
    rows = catalog.QUERIES["hybrid_decoys"](spark, small).collect()
    known = {r["password"] for r in domain.passwords(spark, small).collect()} | {r["password"] for r in domain.users(spark, small).collect()}
    assert {r["base"] for r in rows} <= known
    assert len({r["base"] for r in rows}) > 100
