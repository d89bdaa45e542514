"""Guesses in model order against plain enumeration."""

import itertools
import random

import pytest

from veilspark import catalog
from veilspark.operators import guesses as E
from veilspark.operators import markov as M


def plain(probs, n):
    """Every product, sorted."""
    import re

    by = {}
    for t, k, item, p in probs:
        by.setdefault((t, k), []).append((item, p))
    out = []
    for s, p in by.get(("S", 0), []):
        slots = [x for t, k in re.findall("([A-Z])([0-9]+)", s) for x in ([(t, int(k)), ("C", int(k))] if t == "A" else [(t, int(k))])]
        for combo in itertools.product(*(by.get(x, []) for x in slots)):
            word, q = "", p
            for (t, _), (item, r) in zip(slots, combo, strict=True):
                q *= r
                word = word[: -len(item)] + "".join(c.upper() if m == "U" else c for c, m in zip(word[-len(item) :], item, strict=True)) if t == "C" else word + item
            out.append((word, s, q))
    return sorted(out, key=lambda r: (-r[2], r[0], r[1]))[:n]


@pytest.mark.parametrize("n", [1, 37, 100_000])
def test_best_first(spark, n):
    rnd = random.Random(8)
    probs = []
    for t, k, items in (("A", 3, ["abc", "abd", "xyz", "qqq"]), ("A", 1, ["z"]), ("C", 3, ["LLL", "ULL", "UUU"]), ("C", 1, ["L", "U"]), ("D", 2, [f"{i:02d}" for i in range(40)]), ("O", 1, ["!", "#"]), ("S", 0, ["A3D2", "A3O1A3", "D2A1", "A3D9", "O1"])):
        w = [rnd.choice([1, 1, 2, 5, 40]) for _ in items]
        probs += [(t, k, x, v / sum(w)) for x, v in zip(items, w, strict=True)]
    probs.append(("S", 0, "M", 0.4))
    df = spark.createDataFrame(probs, "type string, len int, item string, prob double").repartition(3)
    got = [tuple(r) for r in E.best_first(df, n).orderBy("rank").collect()]
    assert got == [(i, *r) for i, r in enumerate(plain(probs[:-1], n), 1)]


def test_no_grammar(spark):
    none = spark.createDataFrame([], "type string, len int, item string, prob double")
    assert E.best_first(none, 5).count() == 0


def test_a_slice_of_ranks(spark, small):
    from veilspark.plans import domain

    ranks = M.letter_ranks(domain.passwords(spark, small).filter("pid < 60")).cache()
    whole = [tuple(r) for r in E.rank_words(ranks, 9, 24, longest=5).orderBy("position").collect()]
    assert [r[0] for r in whole] == list(range(len(whole))) and len(whole) > 150
    assert [r[1:] for r in whole] == sorted(((w, r) for _, w, r in whole), key=lambda x: (x[1], len(x[0]), x[0]))
    some = [tuple(r) for r in E.rank_words(ranks, 9, 24, longest=5, first=50, last=149).orderBy("position").collect()]
    assert some == whole[50:150]
    rows = ranks.collect()
    own = {(r["prev"], r["c"]): r["rank"] for r in rows}
    letters = sorted({r["c"] for r in rows})
    frontier, want = [("", 0)], []
    for _ in range(5):
        frontier = [(w + c, r + own[w[-1:] or None, c]) for w, r in frontier for c in letters if (w[-1:] or None, c) in own and r + own[w[-1:] or None, c] <= 24]
        want += [x for x in frontier if x[1] >= 9]
    assert sorted(r[1:] for r in whole) == sorted(want)


@pytest.mark.parametrize("name", ["pcfg_guesses"])
def test_whole_grammar(spark, small, name):
    from veilspark.operators import pcfg as P
    from veilspark.plans import domain, guess_queries

    probs = P.probabilities(P.items(P.parsed(domain.passwords(spark, small)))).select("type", "len", "item", "prob")
    got = [tuple(r) for r in catalog.QUERIES[name](spark, small).orderBy("rank").collect()]
    assert got == [(i, *r) for i, r in enumerate(plain([tuple(r) for r in probs.collect()], guess_queries.TOP), 1)]
