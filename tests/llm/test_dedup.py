"""Exact and near dedup, with ties, copies and clusters."""

import random

import numpy as np
import pytest

from veilspark.llm import exact, neardup, queries

from .common import ODD, components, documents, frame


def test_exact_is_sql(same):
    same(queries.QUERIES["op8_exact_dedup"], queries.SQL["op8_exact_dedup"])


def test_exact_cases(spark):
    rows = [*ODD, *[(i, "copy") for i in range(50)], (3, "copy")]
    got = exact.label_copies(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    copies = [r for r in got if r["text"] == "copy"]
    assert {(r["keep_id"], r["group_size"]) for r in copies} == {(49, 51)} and sum(r["kept"] is True for r in copies) == 1
    empty = [r for r in got if not r["text"]]
    assert {r["keep_id"] for r in empty} == {9002} and all(r["text_sha256"].startswith("e3b0c442") for r in empty)
    kept = exact.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert kept.count() == len({t or "" for _, t in rows})
    assert exact.label_copies(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def near(spark, small):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = documents(spark, small, 80) + [r for r in ODD if r[0] != 9011]
    # words on which polynomials modulo 2**64 vanish
    morse = ["".join("ab"[bin(i).count("1") % 2 ^ f] for i in range(1024)) for f in (0, 1)]
    rows += [(30000 + f, " ".join([morse[f]] * 4 + ["w"])) for f in (0, 1)]
    for g in range(4):
        base = [rnd.choice(vocabulary) for _ in range(150)]
        for c in range(40):
            x = list(base)
            for _ in range(rnd.randrange(14)):
                x[rnd.randrange(150)] = rnd.choice(vocabulary)
            rows.append((20000 + 100 * g + c, " ".join(x)))
    return rows


def test_near_is_every_pair(spark, near):
    want = components(near)
    got = neardup.label(frame(spark, near), 75).collect()
    assert len(got) == len(near)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.keep_one(frame(spark, near))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {c for _, c in want.values()} | {None}


def test_near_rows_of_one_id(spark):
    rnd = random.Random(2)
    x, y, z = (" ".join(f"v{rnd.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(5, x), (5, y), (7, x + " more"), (8, y + " more"), (9, z), (5, x)]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.label(frame(spark, rows)).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 9)}
    assert sorted(r["doc_id"] for r in neardup.keep_one(frame(spark, rows)).collect()) in ([5, 9], [5, 5, 9])


def chain(rnd, n, words):
    """Texts of which each differs a little from the one before."""
    out, x = [], [f"c{rnd.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        x = list(x)
        for _ in range(rnd.randrange(3)):
            x[rnd.randrange(words)] = f"c{rnd.randrange(10**6)}"
        out.append(" ".join(x))
    return out


def test_near_chained_cluster(spark, monkeypatch):
    rnd = random.Random(9)
    rows = list(enumerate(chain(rnd, 500, 60) + chain(rnd, 60, 12)))
    base = [f"b{i}" for i in range(80)]
    for i in range(500):  # copies around the threshold from one text, most of them far from each other
        x = list(base)
        for j in rnd.sample(range(80), rnd.randrange(1, 5)):
            x[j] = f"n{rnd.randrange(10**6)}"
        rows.append((10000 + i, " ".join(x)))
    monkeypatch.setattr(neardup, "BLOCK", 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.label(frame(spark, rows)).collect()}
    assert got == components(rows)


def test_forest_spans_the_links():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 40, rnd.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    part = np.arange(60) // 2
    h = np.concatenate(sets)
    got = neardup.forest(h, h, off, part, 50)
    links = {(i, j) for i in range(60) for j in range(i) if part[i] != part[j] and 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}
    assert {(max(p), min(p)) for p in got} <= links and links

    def groups(pairs):
        up = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert groups(got) == groups(links)


def test_near_empty(spark):
    assert neardup.label(frame(spark, [])).count() == 0


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(3)
    a, b, both = (rnd.integers(0, 2**63, n).astype(np.uint64) for n in (300, 300, 900))
    x, y = np.unique(np.concatenate([a, both])), np.unique(np.concatenate([b, both]))
    off = np.array([0, len(x), len(x) + len(y)])
    k = neardup.registers(np.concatenate([x, y]), off)
    whole = neardup.registers(np.union1d(x, y), np.array([0, len(np.union1d(x, y))]))
    assert (np.maximum(k[0], k[1]) == whole[0]).all()
    j = neardup.estimate(k[:1], k[1:], np.array([len(x)], float), np.array([len(y)], float))[0]
    assert abs(j - 900 / 1500) < 0.12
