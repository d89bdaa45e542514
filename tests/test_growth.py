"""Steps that grow with the input do the whole job by their shorter ways too."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import attack as A
from veilspark.plans import domain


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_words_meet_users_in_place_or_by_a_shuffle(spark, small):
    held, dealt = domain.counted_sweetwords(spark, small), domain.counted_sweetwords(spark, small, held=0)
    assert rows(held) == rows(dealt)
    cnt = {r["password"]: r["cnt"] for r in domain.word_counts(spark, small).collect()}
    assert all(r["cnt"] == cnt[r["word"]] for r in held.collect())
    # dealt by user once: no list is shuffled for its users' windows
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(user_id" not in plan.replace("user_id#", "user_id")


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(5)
    made = [(u, i, f"w{i}", i == u % 7, float(rng.choice([0, 1, 1, 2, 3, 8]))) for u in range(60) for i in range(8)]
    return A.attempts(spark.createDataFrame(made, "user_id long, idx int, word string, is_real boolean, p double"), 5).cache()


@pytest.mark.parametrize("key", [A.index_key, A.fifo_key])
@pytest.mark.parametrize("t2", [0, 1, 7, 61, 10_000])
def test_leading_guesses_give_the_same_curve(lists, key, t2):
    some = A.leading(lists, t2)
    assert rows(A.curve(key(some), t2)) == rows(A.curve(key(lists), t2))
    if t2 == 7:
        assert some.count() < lists.count()


def test_leading_guesses_by_raw_probability(lists):
    some = A.leading(lists, 9, F.col("p"))
    assert rows(A.curve(A.raw_key(some), 9)) == rows(A.curve(A.raw_key(lists), 9))
    assert some.count() < lists.count()


@pytest.mark.parametrize("coded", [False, True])
def test_wide_types_are_looked_up_alike(spark, small, coded):
    from veilspark.operators import pcfg as P
    from veilspark.plans import more_queries as Q

    if coded:
        u, corpus = Q._coded(spark, small)
        probs = P.probabilities(P.items(P.parsed_coded(corpus, "pid"))).cache()
    else:
        u = domain.users(spark, small)
        probs = P.probabilities(P.items(P.parsed(domain.passwords(spark, small)))).cache()
    whole = rows(P.sample(u, probs, 5, 67))
    assert len(whole) == 5 * u.count()
    assert rows(P.sample(u, probs, 5, 67, held=0)) == whole
    assert rows(P.sample(u, probs, 5, 67, held=60)) == whole


def test_drawn_words_meet_in_place_or_by_a_shuffle(spark):
    from veilspark.operators import corpus as C

    counted = spark.createDataFrame([(f"w{i}", 1 + i * i % 7) for i in range(200)], "password string, cnt long")
    asked = spark.range(500).selectExpr("cast(id as string) as id")
    assert rows(C.weighted_draws(counted, asked, 3)) == rows(C.weighted_draws(counted, asked, 3, held=0))


def test_rounds_change_no_list(spark):
    from veilspark.operators import decoys as G

    users = spark.range(40).selectExpr("id as user_id", "'x' as password")
    # user u can have u words
    make = lambda some, at: some.select("user_id", F.explode(F.sequence(F.lit(at.start), F.lit(at.stop - 1))).alias("draw")).withColumn("word", F.format_string("w%d", F.xxhash64("user_id", "draw") % (F.col("user_id") + 1)))
    for tries in (200, None):
        found = {(r["user_id"], r["word"]): r["draw"] for r in G.in_rounds(users, make, 6, tries, 4).collect()}
        whole = make(users, range(200)).groupBy("user_id", "word").agg(F.min("draw").alias("draw")).collect()
        for u in range(40):
            want = sorted((r["draw"], r["word"]) for r in whole if r["user_id"] == u)[:5]
            assert sorted((at, w) for (v, w), at in found.items() if v == u)[:5] == want


def test_only_values_in_the_password_are_placed(spark):
    from veilspark.functions import pii

    tags = "array(struct('N1' as tag, 'anna' as value), struct('N2' as tag, 'zz' as value), struct('B1' as tag, '9' as value))"
    df = spark.range(1).selectExpr("'xanna9<anna' as pw", f"{tags} as tags").withColumn("segs", pii.tagged(F.col("pw"), F.col("tags")))
    r = df.select("segs", pii.substituted(F.col("segs"), F.col("tags")).alias("back")).first()
    assert r["segs"] == ["x", "<N1>", "9<", "<N1>"] and r["back"] == "xanna9<anna"
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "contains(" in plan.lower()


def test_starts_followed_as_far_as_pieces_go():
    from veilspark.operators import chunks as K

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    logp = {word(rng.randrange(1, 6)): -rng.random() * 9 for _ in range(40)}
    begun = K.beginnings(logp)
    for w in [word(n) for n in range(20)]:
        assert K.lattice(w, logp, 12, begun) == K.lattice(w, logp, 12)
        assert K.likeliest(w, logp, 12, begun) == K.likeliest(w, logp, 12)
        assert K.expected(w, logp, 12, begun) == K.expected(w, logp, 12)


def test_watched_outcomes_take_every_number_of_logins(spark, small):
    from veilspark.plans import other_queries as Q

    found = Q.watched_outcomes(spark, small).groupBy("l", "delta").agg(F.sum("n")).collect()
    assert sorted(map(tuple, found)) == [(l, delta, 150) for l in (0, 5, 10, 15, 20) for delta in (1, 6, 11, 16, 21)]


def test_watched_accounts_are_walked_in_place(spark, small, monkeypatch):
    from veilspark.operators import bernoulli as B
    from veilspark.plans import other_queries as Q

    monkeypatch.setattr(B, "cut", lambda df: pytest.fail("accounts cut off between steps"))
    monkeypatch.setattr(Q, "cut", lambda df: pytest.fail("outcomes cut off"), raising=False)
    users, a = Q._marked(spark, small)
    # nested marks: a word that was struck out never comes back
    lists = B.watched_lists(a, Q._ranking(spark, small), Q.SEEN, Q.MORE, 67).collect()
    assert len(lists) == users.count() and all(len(r["steps"]) == 5 for r in lists)
    assert all([s["rank"] or 10**9 for s in r["steps"]] == sorted(s["rank"] or 10**9 for s in r["steps"]) for r in lists)
    assert Q.watched_detection(spark, small).count() == 25


def test_profile_lists_in_place_are_those_of_rounds(spark, small):
    from veilspark.functions.strings import parse_pattern, pattern
    from veilspark.operators import decoys as G

    made = [(1, "anna!12"), (2, "x"), (3, "Sun_rise77#"), (4, "12!!"), (5, "!!??"), (6, "#1")] + [(i, f"{w}{'!_#'[i % 3]}{i}") for i, w in enumerate(["bea", "carl", "doro", "emil"] * 5, 7)]
    rows = [(i, w, ["sun", "anna", "moon", f"w{i}"][: i % 5], ["12", "77", "345", str(i)][: i % 4], ["!", "@.", "#"][: i % 3]) for i, w in made]
    users = spark.createDataFrame(rows, "user_id long, password string, A array<string>, D array<string>, S array<string>").cache()
    slots = users.select("user_id", "A", "D", "S", F.posexplode(parse_pattern(pattern(F.col("password")))).alias("slot", "part"))
    pools = slots.select("user_id", "slot", F.when(F.col("part.kind") == "A", F.col("A")).when(F.col("part.kind") == "D", F.col("D")).otherwise(F.col("S")).alias("pool"))
    own = users.select("user_id", "password")
    patterns = own.select("user_id", F.array(pattern(F.col("password"))).alias("patterns"))
    want = G.assemble(G.in_rounds(own, lambda some, draws: G.from_tokens(some, pools, patterns, draws, 67, max_shared=1), 8, 200, 100), own, 8, 67)
    found = G.in_place(users, G.own_tokens(67, 200, 1), 8, 67)
    assert rows_of(found) == rows_of(want) and {r["n"] for r in found.groupBy("user_id").agg(F.count("*").alias("n")).collect()} >= {1, 8}
    assert "Exchange hashpartitioning(user_id" not in G.in_place(users, G.own_tokens(67, 200, 1), 8, 67).groupBy("is_real").count()._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_bounded_edits_are_those_of_the_whole_distance(spark):
    from veilspark.operators import decoys as G

    rng = random.Random(3)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randrange(7))), "".join(rng.choice("ab") for _ in range(rng.randrange(7)))) for _ in range(400)]
    whole = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("n")).collect()
    assert all(G._within(r["a"], r["b"], most) == (r["n"] <= most) for r in whole for most in (0, 1, 2))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("user_id", "idx", "word", "is_real")) for r in df.collect())


@pytest.mark.parametrize("words", [40, 9])
def test_walked_lists_are_those_of_rounds(spark, monkeypatch, words):
    from veilspark.operators import decoys as G
    from veilspark.operators import markov as M

    monkeypatch.setattr(G, "LAST", 60)
    corpus = spark.createDataFrame([(f"ab{i}" if i % 3 else "a" * (i % 5 + 1),) for i in range(words)], "password string")
    chain, first = M.transitions(corpus).cache(), M.starts(corpus).cache()
    users = spark.createDataFrame([(i, f"ab{i}") for i in range(40)], "user_id long, password string").cache()
    make = lambda some, at: M.sample(some, chain, first, at, 5)
    walk = M.walker(chain, first, 5)
    want = G.assemble(G.in_rounds(users, make, 8, None, 9), users, 8, 5)
    found = G.walked(users, lambda r, draws: walk(r["user_id"], draws), make, 8, 9, 5)
    assert rows_of(found) == rows_of(want)
    assert M.walker(chain, first, 5, small=3) is None
    drawn = {(r["user_id"], r["draw"]): r["word"] for r in make(users, range(12)).collect()}
    assert drawn == {(i, n): w for i in range(40) for n, w in enumerate(walk(i, 12))}


def test_evolving_patterns_meet_in_place_or_by_a_shuffle(spark, small, monkeypatch):
    from veilspark.operators import decoys as G
    from veilspark.operators import freqdb as D

    u = domain.users(spark, small).select("user_id", "password")
    freqs = D.token_counts(domain.passwords(spark, small).unionByName(u.withColumnRenamed("user_id", "pid"))).cache()
    held = rows(G.evolving(u, freqs, 67)(u, range(3)))
    monkeypatch.setattr(G, "HELD", 0)
    assert held and rows(G.evolving(u, freqs, 67)(u, range(3))) == held
