"""Strength and chunks against every way to cut a word."""

import math
import random

import pytest

from veilspark import catalog
from veilspark.operators import chunks as K
from veilspark.operators import strength as T
from veilspark.plans import domain


def chains(n):
    """Every way to cut n places into parts."""
    if not n:
        yield []
    for i in range(n):
        for c in chains(i):
            yield [*c, (i, n)]


RANK = {"pass": 1, "word": 2, "password": 3, "dragon": 4, "ass": 900}


@pytest.mark.parametrize("word", ["password", "PassWord1", "aaaa12", "qwert1990", "Xq9!", "01121987", "zyxdragon", "", "é漢x"])
def test_cheapest_is_the_least_of_all_chains(word):
    cost = {}
    for i, j, _, g in T.parts(word, RANK):
        cost[i, j] = min(cost.get((i, j), math.inf), math.log10(max(g, 1) + 1))
    want = min((sum(cost.get(p, math.inf) if p[1] - p[0] > 1 else min(1.0, cost.get(p, 1.0)) for p in c) for c in chains(len(word))), default=0.0)
    got, kinds = T.cheapest(word, RANK)
    assert got == pytest.approx(want)
    assert (not word) == (kinds == [])


def test_strength_goldens():
    assert T.cheapest("password", RANK) == (pytest.approx(math.log10(4)), ["word"])
    assert T.cheapest("dragon1990", RANK)[1] == ["word", "year"]
    assert T.cheapest("abcdef", {})[1] == ["sequence"]
    assert T.cheapest("1qaz2wsx", {})[1].count("keys") >= 1
    assert [T.score(x) for x in (0, 3, 6, 8, 10.5)] == [0, 1, 2, 3, 4]
    assert T.cases("word") == 1 and T.cases("Word") == T.cases("WORD") == 2 and T.cases("wOrD") == 10


def test_strength_query(spark, small):
    rows = catalog.QUERIES["password_strength"](spark, small).collect()
    assert len(rows) == domain.passwords(spark, small).count()
    assert all(0 <= r["score"] <= 4 and r["guesses"] > 0 for r in rows)
    best = [r["password"] for r in catalog.QUERIES["strongest_by_guesses"](spark, small).collect()]
    order = sorted({(-r["guesses"], r["password"]) for r in rows})
    assert sorted(best) == sorted(w for _, w in order[:200])


def test_nulls(spark):
    words = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "id long, password string")
    ranking = spark.createDataFrame([("Word", 5), ("WORD", 2)], "password string, rank int")
    got = {r["id"]: (r["guesses"], r["score"], r["parts"]) for r in T.scored(words, ranking).collect()}
    assert got == {1: (None, None, None), 2: (0.0, 0, []), 3: (round(math.log10(3), 6), 0, ["word"])}
    assert {r["id"]: r["chunks"] for r in K.cut_words(words, {}).collect()} == {1: None, 2: [], 3: list("word")}
    assert K.fit(words.filter("id < 3").selectExpr("password", "1 AS cnt")) == {}


def test_expected_uses_and_chains():
    rnd = random.Random(3)
    logp = {p: math.log(rnd.uniform(0.01, 0.3)) for p in ("a", "b", "c", "ab", "bc", "abc", "ca", "aa")}
    for _ in range(40):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 8)))
        ways = []
        for c in chains(len(word)):
            p = [logp.get(word[i:j], K.UNKNOWN if j - i == 1 else None) for i, j in c]
            if None not in p:
                ways.append((sum(p), [word[i:j] for i, j in c]))
        total = sum(math.exp(p) for p, _ in ways)
        want = {}
        for p, c in ways:
            for x in c:
                want[x] = want.get(x, 0) + math.exp(p) / total
        got = K.expected(word, logp, 12)
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
        best = sum(logp.get(x, K.UNKNOWN) for x in K.likeliest(word, logp, 12))
        assert best == pytest.approx(max(p for p, _ in ways))


def test_chunks_are_the_parts(spark):
    rnd = random.Random(9)
    stems = ["dragon", "silver", "monkey", "castle", "winter"]
    rows = [(rnd.choice(stems) + rnd.choice(["_", "!"]) + rnd.choice(stems) + str(rnd.randrange(10, 99)), 1) for _ in range(800)]
    words = spark.createDataFrame(rows, "password string, cnt long").repartition(3)
    logp = K.fit(words)
    got = K.cut_words(words, logp).collect()
    assert sum(any(s in r["chunks"] for s in stems) for r in got) > 0.9 * len(got)
    assert all("".join(r["chunks"]) == r["password"] for r in got)
