"""Fitted models: probabilities add up, samples follow the model, smoothing of the worked example."""

from pyspark.sql import functions as F

from veilspark.operators import decoys as G
from veilspark.operators import freqdb as D
from veilspark.operators import markov as M
from veilspark.operators import pcfg as P
from veilspark.operators import report as R


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "password string")


def test_chain(spark):
    c = words(spark, "abcde", "abcdx", "ab", "abcde")
    t = M.transitions(c)
    assert all(abs(r["s"] - 1) < 1e-12 for r in t.groupBy("ctx").agg(F.sum("p").alias("s")).collect())
    got = {r["password"]: r["logp"] for r in M.log_probability(words(spark, "abcde", "ab", "zzzz"), t, M.starts(c)).collect()}
    assert abs(got["abcde"] - F_log(3 / 4 * 2 / 3)) < 1e-9 and got["zzzz"] is None and abs(got["ab"] - F_log(1 / 4)) < 1e-9
    u = spark.createDataFrame([(i,) for i in range(50)], "user_id long")
    drawn = {r["word"] for r in M.sample(u, t, M.starts(c), 4, 1).collect()}
    assert drawn == {"abcde", "abcdx", "ab"}


def F_log(x):
    import math

    return math.log(x)


def test_smoothing(spark):
    p = spark.createDataFrame([("D", 1, str(i), 1, x) for i, x in enumerate((0.5, 0.3, 0.1, 0.099, 0.001))], "type string, len int, item string, num long, prob double")
    got = [round(r["prob"], 6) for r in P.smoothed(p, 0.02).orderBy("item").collect()]
    assert got == [0.5, 0.3, 0.0995, 0.0995, 0.001]


def test_grammar(spark):
    c = words(spark, "pass12", "Pass34", "word#1", "tab\tbad", "x.com")
    probs = P.probabilities(P.items(P.parsed(c)), 0.6)
    structures = {r["item"]: r["prob"] for r in probs.filter("type = 'S'").collect()}
    assert abs(sum(structures.values()) - 1) < 1e-12 and abs(structures["M"] - 0.4) < 1e-12
    full = P.probabilities(P.items(P.parsed(c)))
    score = {r["password"]: r["prob"] for r in P.score(words(spark, "pass12", "nope99"), full).collect()}
    assert abs(score["pass12"] - 2 / 3 * 2 / 3 * 2 / 3 * 1 / 2) < 1e-9 and score["nope99"] == 0.0
    u = spark.createDataFrame([(i,) for i in range(40)], "user_id long")
    assert {len(r["word"]) for r in P.sample(u, full, 3, 5).collect()} == {6}


def test_lists_are_distinct_and_hold_the_real_word(spark):
    u = spark.createDataFrame([(1, "real#1"), (2, "other#2")], "user_id long, password string")
    drawn = spark.createDataFrame([(1, i, f"d{i % 3}") for i in range(9)] + [(2, i, f"e{i}") for i in range(9)], "user_id long, draw int, word string")
    got = G.as_lists(G.assemble(drawn, u, 5, 1)).collect()
    by = {r["user_id"]: r for r in got}
    assert len(by[1]["sweetwords"]) == 4 and len(by[2]["sweetwords"]) == 5
    assert by[2]["sweetwords"][by[2]["sugar_index"] - 1] == "other#2"
    made = G.tweaks(u.select("user_id", F.col("password").alias("base")), 4, 9)
    assert made.groupBy("user_id").agg(F.countDistinct("word").alias("n")).filter("n = 4").count() == 2


def test_evolving_draws_from_the_whole_bucket(spark):
    # 300 letters of frequency 1, a hot one and specials without partners
    c = words(spark, *(f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvw"), *["hotword#"] * 40, *["else#"] * 9, *["hotword!"] * 20)
    freqs = D.token_counts(c)
    numbered = D.members(freqs)
    seen = [(r["type"], r["g"], r["key"], r["pos"]) for r in numbered.collect()]
    assert len(seen) == len(set(seen)) == 2 * freqs.count()
    for g in (1, -1):
        pos = sorted(p for t, h, _, p in seen if t == "A" and h == g)
        assert pos == list(range(len(pos))) and len(pos) >= 300
    u = spark.createDataFrame([(1, "aku"), (2, "hotword#")], "user_id long, password string")
    got = G.evolving(u, freqs, 7)(u, range(3000)).collect()
    cold, hot = ({r["word"] for r in got if r["user_id"] == i} for i in (1, 2))
    vocabulary = {r["token"] for r in freqs.filter("type = 'A'").collect()}
    # an edit distance of three to aku needs other letters at every place
    far = {w for w in vocabulary if len(w) == 3 and all(x != y for x, y in zip(w, "aku", strict=True))}
    assert len(far) == 162 and cold == far
    # both tokens of the hot word have no partner: any other word, any special
    assert {w[-1] for w in hot} <= {"#", "!"} and "!" in {w[-1] for w in hot}
    assert {w[:-1] for w in hot} <= vocabulary - {"hotword"} and not {w[:-1] for w in hot} & set(G.COMMON)


def test_rounds_go_on_for_short_lists(spark):
    # one password holds nine tenths of the rows; one is longer than 28 characters
    long = "".join(chr(97 + i % 26) + str(i % 10) for i in range(25))
    c = words(spark, *["mainmain"] * 270, *(f"{chr(97 + i) * 4}{i}" for i in range(24)), *[long] * 6)
    u = spark.createDataFrame([(i, "real#1") for i in range(6)], "user_id long, password string")
    t, s = M.transitions(c), M.starts(c)
    make = lambda some, draws: M.sample(some, t, s, draws, 3)
    size = lambda draws: {r["user_id"]: r["count"] for r in G.assemble(draws, u, 20, 1).groupBy("user_id").count().collect()}
    assert min(size(make(u, range(30))).values()) < 20
    drawn = G.in_rounds(u, make, 20, None, 30)
    assert set(size(drawn).values()) == {20}
    assert long in {r["word"] for r in drawn.select("word").distinct().collect()}
    # the same list as from all draws at once, and no more draws than the limit
    row = lambda x: {tuple(r) for r in G.assemble(x, u, 20, 1).collect()}
    fixed = lambda some, draws: some.select("user_id", F.explode(F.sequence(F.lit(draws.start), F.lit(draws.stop - 1))).alias("draw")).withColumn("word", F.concat(F.lit("w"), F.floor(F.sqrt("draw")).cast("string")))
    assert row(G.in_rounds(u, fixed, 20, 2000, 10)) == row(fixed(u, range(2000)))
    assert set(size(G.in_rounds(u, fixed, 20, 50, 10)).values()) == {9}


def test_table_sink(spark):
    t = spark.createDataFrame([("b", 0.5, 0.1), ("a", 0.25, 0.2)], "method string, epsilon double, success double")
    assert R.latex(t).split("\n")[1].startswith("a & 0.2500 & 20.0000")
