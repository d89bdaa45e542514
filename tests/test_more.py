"""Goldens and plain versions of analyses, dataset building, watched breaches and targeted models."""

import hashlib

from pyspark.sql import functions as F

from veilspark.functions import pii
from veilspark.functions.bloom import indices, salted_hash
from veilspark.operators import attack as A
from veilspark.operators import bernoulli as B
from veilspark.operators import corpus as C
from veilspark.operators import guesses as E
from veilspark.operators import decoys as G
from veilspark.operators import markov as M
from veilspark.operators import pcfg as P
from veilspark.sources import files


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "password string")


def test_letter_ranks_golden(spark):
    # by hand: letters a 4, b 2, c 1 of 7; after a: a, b, c once each of 4 steps but b twice
    c = words(spark, "ab", "aac", "ab")
    got = {(r["prev"], r["c"]): (r["n"], r["rank"]) for r in M.letter_ranks(c).collect()}
    assert got == {(None, "a"): (4, 2), (None, "b"): (2, 5), (None, "c"): (1, 8), ("a", "b"): (2, 3), ("a", "a"): (1, 6), ("a", "c"): (1, 6)}
    hist = {r["total_rank"]: r["n"] for r in M.rank_histogram(M.word_ranks(c, M.letter_ranks(c))).collect()}
    assert hist == {5: 2, 14: 1}
    sizes = {r['rank']: int(r['size']) for r in E.rank_sizes(M.letter_ranks(c), longest=2, most=20).collect()}
    # a 2, b 5, ab 5, aa and ac 8, c 8
    assert {k: v for k, v in sizes.items() if v} == {2: 1, 5: 2, 8: 3}
    assert max((r['rank'], int(r['size'])) for r in E.rank_sizes(M.letter_ranks(c), longest=2, most=20, stop=2).collect()) == (5, 2)
    rolled = M.rollup_ranks(M.rank_histogram(M.word_ranks(c, M.letter_ranks(c))), spark.createDataFrame(list(sizes.items()), "rank long, size long"))
    assert [(r["rank"], r["n"], r["size"], round(r["p"], 9)) for r in rolled.orderBy("rank").collect()] == [(5, 2, 3, round(2 / 9, 9)), (14, 1, 3, round(1 / 9, 9))]


def test_weighted_draws_follow_weights(spark):
    counted = spark.createDataFrame([("hot", 900), *[(f"w{i}", 1) for i in range(100)]], "password string, cnt long")
    got = C.weighted_draws(counted, spark.range(5000).select(F.col("id").cast("string").alias("id")), 3).collect()
    assert len(got) == 5000 and 0.87 < sum(r["password"] == "hot" for r in got) / 5000 < 0.93
    assert len({r["password"] for r in got}) > 80


def test_parts_differ_by_one(spark):
    for n in (0, 1, 7, 1000):
        sizes = [r["count"] for r in C.equal_parts(spark.range(n), 1, 3, "id").groupBy("part").count().collect()]
        assert sum(sizes) == n and (not sizes or max(sizes) - min(sizes) <= 1)


def test_first_place_and_choice(spark):
    rows = [(1, 0, "b", False, 2.0), (1, 1, "a", False, 2.0), (1, 2, "b", True, 2.0), (2, 0, "x", False, 0.0), (2, 1, "y", True, 0.0)]
    probs = spark.createDataFrame(rows, "user_id long, idx int, word string, is_real boolean, p double")
    assert {r["user_id"]: r["rank"] for r in A.first_place(probs).collect()} == {1: 1, 2: 2}
    assert {(r["user_id"], r["word"]) for r in A.choice(probs, True).collect()} == {(1, "b"), (2, "x")}
    assert {(r["user_id"], r["word"]) for r in A.choice(probs, False).collect()} == {(1, "b"), (2, None)}


def u(*keys):
    return int(hashlib.sha256(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32


def positions(salt, word):
    hexed = hashlib.sha256((salt + word).encode()).hexdigest()
    return {int(hashlib.sha256(f"{i}:{hexed}".encode()).hexdigest(), 16) % 128 + 1 for i in range(20)}


def test_watched_breach_is_a_plain_loop(spark):
    seed = 5
    users = spark.createDataFrame([(i, f"pw{i % 7}") for i in range(60)], "user_id long, password string")
    ranking = spark.createDataFrame([(r, f"pw{r}" if r < 8 else f"word{r}") for r in range(1, 700)], "rank long, password string")
    accounts = B.register(users, 0.2, seed, p_mark=0.9).cache()
    seen, more = [0, 3], [1, 6]
    got = {(r["user_id"], r["l"], r["delta"]): (r["rank"], r["outcome"]) for r in B.watched_breach(accounts, ranking, users, seen, more, seed, 0.9, 0.4).collect()}
    ranked = [r["password"] for r in ranking.orderBy("rank").collect()]
    real = {r["user_id"]: r["password"] for r in users.collect()}
    want = {}
    for a in accounts.collect():
        i, true, filled = a["user_id"], set(a["true"]), set(a["b"])
        for l in seen:
            for delta in more:
                marks, viable = set(a["m"]), None
                snapshots = [marks]
                for t in range(1, l + 1):
                    if u(seed, i, "renew", t) < 0.4:
                        marks = true | {x for x in filled if u(seed, i, t, x) < 0.9}
                    snapshots.append(marks)
                for rank, w in enumerate(ranked, 1):
                    at = positions(a["salt"], w)
                    if all(at <= s for s in snapshots):
                        viable = rank, w, at
                        break
                if viable is None:
                    want[i, l, delta] = None, "no_candidate"
                    continue
                for t in range(l + 1, l + delta + 1):
                    assert viable[2] <= marks  # the attacker's logins succeed
                    if u(seed, i, "renew", t) < 0.4:
                        marks = viable[2] | {x for x in filled if u(seed, i, t, x) < 0.9}
                want[i, l, delta] = viable[0], "undetected" if true <= marks else "detected"
    assert got == want and len({o for _, o in want.values()}) > 1 and real
    first = spark.createDataFrame([(i, want[i, 0, 1][0]) for i in real], "user_id long, rank long")
    rows = spark.createDataFrame([(i, l, d, r, o) for (i, l, d), (r, o) in want.items()], "user_id long, l int, delta int, rank long, outcome string")
    table = {(r["l"], r["delta"]): r["tdp"] for r in B.watched_detection(rows, first, 6, seed).collect()}
    trials = {}
    for i in real:
        trials.setdefault(int(u(seed, i) * 2**32) % 6, []).append(i)
    for l in seen:
        for d in more:
            hits = [any(want[i, l, d][1] == "detected" for i in sorted(own, key=lambda i: (want[i, 0, 1][0] or 10**9, i))[: max(len(own) // 2, 1)]) for own in trials.values()]
            assert abs(table[l, d] - sum(hits) / len(hits)) < 1e-12


def test_contained_is_within(spark):
    rows = spark.createDataFrame([(f"w{i}",) for i in range(300)], "w string")
    h = salted_hash(F.encode(F.lit("s"), "utf-8"), F.col("w"))
    filled = F.sequence(F.lit(1), F.lit(120))
    from veilspark.functions.bloom import contained, within

    assert rows.filter(contained(h, filled) != within(indices(h), filled)).count() == 0
    assert 0 < rows.filter(contained(h, filled)).count() < 300


def test_coded_words_round_trip(spark):
    tags = [("N4", "anna"), ("B5", "1990"), ("U1", "anna90")]
    one = spark.createDataFrame([(1, "xanna1990!", tags)], "user_id long, password string, tags array<struct<tag:string,value:string>>")
    coded = one.withColumn("coded", F.array_join(pii.coded(pii.tagged(F.col("password"), F.col("tags"))), ""))
    r = coded.withColumn("back", pii.filled(F.col("coded"), F.col("tags"))).collect()[0]
    assert r["coded"] == "x" + pii.CODES["N4"] + pii.CODES["B5"] + "!" and r["back"] == "xanna1990!"
    s = P.parsed_coded(coded, "user_id").collect()[0]
    assert s["structure"] == "A1T1T1O1" and [x["value"] for x in s["segs"]] == ["x", pii.CODES["N4"], pii.CODES["B5"], "!"]


def test_grammar_hybrid_has_k_words_with_their_bases(spark):
    users = spark.createDataFrame([(1, "real#1"), (2, "other#2")], "user_id long, password string")
    near = spark.createDataFrame([(1, "n1", 0.9), (1, "n2", 0.8), (1, "n3", 0.7), (2, "n1", 0.5)], "user_id long, neighbour string, similarity double")
    make = lambda some, draws: some.select("user_id", F.explode(F.sequence(F.lit(draws.start), F.lit(draws.stop - 1))).alias("draw")).withColumn("word", F.concat(F.lit("g"), "draw"))
    rows = G.grammar_hybrid(users, near, 9, 3, make).collect()
    for i, bases in ((1, {"real#1", "n1", "n2"}), (2, {"other#2", "n1"})):
        own = [r for r in rows if r["user_id"] == i]
        assert len({r["word"] for r in own}) == len(own) == 9 and {r["base"] for r in own} == bases
        assert [r["word"] for r in own if r["is_real"]] == [{1: "real#1", 2: "other#2"}[i]]


def test_models_come_back(spark, tmp_path):
    c = words(spark, "abcde", "abcdx", "ab")
    files.write_chain(M.transitions(c), M.starts(c), f"{tmp_path}/chain")
    t, s = files.read_chain(spark, f"{tmp_path}/chain")
    assert sorted(t.collect()) == sorted(M.transitions(c).collect()) and sorted(s.collect()) == sorted(M.starts(c).collect())
    rolled = spark.createDataFrame([(5, 2, 3, 0.2), (3, 1, 1, 0.4)], "rank long, n long, size long, p double")
    files.write_rank_model(M.letter_ranks(c), rolled, f"{tmp_path}/ranks")
    assert [r["rank"] for r in files.read_rank_model(spark, f"{tmp_path}/ranks")[1].collect()] == [3, 5]
    f = spark.createDataFrame([("A", "x", 3), ("D", "1", 2)], "type string, token string, freq long")
    files.write_frequency_json(f, f"{tmp_path}/f")
    assert sorted(files.read_frequency_json(spark, f"{tmp_path}/f").collect()) == sorted(f.collect())
    lists = spark.createDataFrame([(1, 0, "a", False), (1, 1, "r", True), (2, 0, "r", True), (2, 1, "b", False)], "user_id long, idx int, word string, is_real boolean")
    files.write_word_map(lists, f"{tmp_path}/m")
    assert [tuple(r) for r in files.read_word_map(spark, f"{tmp_path}/m").collect()] == [("r", ["r", "b"])]
    files.write_csv(lists.groupBy("user_id").agg(F.array_sort(F.collect_list("word")).alias("w")), f"{tmp_path}/c")
    assert spark.read.option("header", True).option("escape", "\"").csv(f"{tmp_path}/c").count() == 2
