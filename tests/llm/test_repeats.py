"""Substring and suffix dedup against every window compared."""

import hashlib
import random

import pytest

from veilspark.llm import substring, suffixes
from veilspark.llm.repeats import pick
from veilspark.llm.textcore import sliding_min

from .common import ODD, documents, frame, repeats


def planted():
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(60)}" for _ in range(300)]
    cuts = [" ".join(base[a : a + n]) for a, n in ((0, 300), (20, 90), (50, 36), (50, 35), (51, 34), (100, 120))]
    rows = [(5000 + i, f"lead{i} " + c + f" tail{i}") for i, c in enumerate(cuts)]
    return [*rows, (5100, cuts[2] + " mid " + cuts[2]), (5101, "é" * 150 + cuts[1])]


@pytest.fixture(scope="module")
def rows(spark, small):
    return documents(spark, small, 60) + ODD + planted()


def morse(k, flip=0, signs="ab"):
    return "".join(signs[bin(i).count("1") % 2 ^ flip] for i in range(1 << k))


def test_words_on_which_polynomials_vanish(spark):
    rest = [f"u{i}" for i in range(34)]
    rows = [(i, " ".join([morse(10, i), *rest])) for i in (0, 1)]
    assert [r["n_removed"] for r in substring.remove_repeats(frame(spark, rows)).collect()] == [0, 0]
    rows = [(i, morse(7, i) + "x" * 30 + morse(6, i) + "tail of many letters" * 5) for i in (0, 1)]
    want = [sum(m) for m in repeats([t.encode() for _, t in rows], 200)]
    assert [r["n_removed"] for r in suffixes.remove_repeats(frame(spark, rows)).orderBy("doc_id").collect()] == want


def test_long_texts_and_many_equal_rows(spark, monkeypatch):
    from veilspark.llm import repeats as R

    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(n))
    shared = text(60)
    long = " ".join([text(30_000), shared, text(60_000), shared, text(100)])
    rows = [(1, long), (2, text(20) + " " + shared), *[(3, "equal rows " + shared)] * 400, *[(None, "equal rows " + shared)] * 200]
    monkeypatch.setattr(R, "CHUNK", 1 << 14)
    got = {}
    for r in substring.remove_repeats(frame(spark, rows)).collect():
        got.setdefault((r["doc_id"], r["n_words"], r["n_removed"]), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {(1, 90_220, 120): 1, (2, 80, 60): 1, (3, 62, 62): 400, (None, 62, 62): 200}
    assert sum(r["n_spans"] for r in suffixes.remove_repeats(frame(spark, rows)).filter("doc_id = 1").collect()) == 2


def digest(x):
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize(("length", "k"), [(35, 8), (6, 3)])
def test_words(spark, rows, length, k):
    units = [(t or "").encode().split() for _, t in rows]
    want = sorted(((i, len(u), sum(g), digest(b" ".join(w for w, x in zip(u, g) if not x))) for (i, _), u, g in zip(rows, units, repeats(units, length))), key=str)
    got = substring.remove_repeats(frame(spark, rows), length, k, digest=True)
    assert sorted((tuple(r)[:4] for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == want


@pytest.mark.parametrize(("length", "k"), [(200, 24), (40, 9)])
def test_bytes(spark, rows, length, k):
    units = [(t or "").encode() for _, t in rows]
    masks = repeats(units, length)
    runs = [sum(g and not p for g, p in zip(m, [False, *m])) for m in masks]
    want = sorted(((i, len(u), sum(g), n, digest(bytes(b for b, x in zip(u, g) if not x))) for (i, _), u, g, n in zip(rows, units, masks, runs)), key=str)
    got = suffixes.remove_repeats(frame(spark, rows), length, k, digest=True)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == want


def test_empty_tables(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def test_texts_come_back(spark):
    r = substring.remove_repeats(frame(spark, [(1, "a b c d x"), (2, "a b c d y")]), 4, 2).orderBy("doc_id").collect()
    assert [(bytes(x["kept"]), [tuple(s) for s in x["spans"]]) for x in r] == [(b"x", [(0, 4)]), (b"y", [(0, 4)])]


def test_loser_tree_merges_and_knows_prefixes():
    rnd = random.Random(1)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(12))) for _ in range(7)]
    coded = [suffixes.front_decode(*suffixes.front_code(r), [(i,) for i in range(len(r))]) if r else iter(()) for r in runs]
    got = list(suffixes.LoserTree(coded))
    assert [x[1] for x in got] == sorted(x for r in runs for x in r)
    for (_, a, _), (c, b, _) in zip(got, got[1:]):
        assert c == suffixes.common(a, b)


def test_every_window_has_its_smallest_gram():
    import numpy as np

    rnd = np.random.default_rng(2)
    values = rnd.integers(0, 5, 400).astype(np.uint64)
    bounds = np.array([0, 3, 3, 150, 400])
    doc, lo, hi, at, *_ = pick((values, values), bounds, 3, 12)
    starts = sorted((d, s) for d, a, b in zip(doc, lo, hi) for s in range(a, b + 1))
    assert starts == [(d, s) for d in range(4) for s in range(max(0, bounds[d + 1] - bounds[d] - 11))]
    assert all(b <= x and x + 3 <= a + 12 for a, b, x in zip(lo, hi, at))
    assert sliding_min(values, 7).tolist() == [values[i : i + 7].min() for i in range(394)]
