"""Small tables that much work follows on are dealt over many tasks; steps of growing size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.plans import domain


@pytest.mark.parametrize("make", [domain.users, domain.passwords])
def test_one_row_group_is_many_tasks(spark, small, make):
    assert make(spark, small).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_snapshots_share_a_walk(spark):
    """Accounts with one salt and unlike filters, words beyond the first block, an account without a word; against a plain loop."""
    from hashlib import sha256

    from veilspark.operators import bernoulli as B

    words = [f"w{i}" for i in range(700)]

    def places(salt: str, word: str) -> set[int]:
        hexed = sha256((salt + word).encode()).hexdigest()
        return {int(sha256(f"{i}:{hexed}".encode()).hexdigest(), 16) % 128 + 1 for i in range(20)}

    own = [(u, n, f"salt{u}", sorted(set().union(*(places(f"salt{u}", words[i]) for i in at)))) for u in range(3) for n, at in enumerate([(5, 300, 650), (300, 650), (650,), ()])]
    accounts = spark.createDataFrame(own, "user_id long, l int, salt string, b array<int>")
    ranking = spark.createDataFrame(list(enumerate(words, 1)), "rank long, password string")
    got = {(r["user_id"], r["l"]): (r["rank"], r["password"]) for r in B.best_candidates(accounts, ranking, keys=("user_id", "l")).collect()}
    want = {(u, n): next(((i, w) for i, w in enumerate(words, 1) if places(s, w) <= set(b)), (None, None)) for u, n, s, b in own}
    assert got == want
    assert any(x[0] is None for x in want.values()) and any((x[0] or 0) > 256 for x in want.values())


def test_filter_is_not_made_for_each_position(spark, small, monkeypatch):
    """The walk begins with accounts that are cut off, so no lambda holds the making of a filter."""
    from veilspark.operators import bernoulli as B

    seen = []
    monkeypatch.setattr(B, "cut", lambda df, own=B.cut: seen.append(df.columns) or own(df))
    accounts = B.register(domain.users(spark, small).limit(5), 0.05, 67)
    ranking = spark.createDataFrame([(1, "a")], "rank long, password string")
    B.best_candidates(accounts, ranking).count()
    assert ["user_id", "salt", "filled"] in seen


def test_small_chain_walks_without_shuffles(spark, small, monkeypatch):
    """The steps of a draw join a chain that each task holds; a chain too large for that gives the same words."""
    from veilspark.operators import markov as M

    words = domain.passwords(spark, small)
    chain, first = M.transitions(words), M.starts(words)
    u = domain.users(spark, small).limit(20)
    plans = []
    monkeypatch.setattr(M, "cut", lambda df, own=M.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df))
    got = {tuple(r) for r in M.sample(u, chain, first, 5, 67).collect()}
    assert all("SortMergeJoin" not in p for p in plans[2:]) and len(plans) > 2
    monkeypatch.setattr(M, "SMALL", 0)
    assert {tuple(r) for r in M.sample(u, chain, first, 5, 67).collect()} == got


def test_overlap_meets_each_password_once(spark, small, monkeypatch):
    """Users with one password are one row of the other side, and no user is a decoy of their own."""
    from veilspark import catalog

    rows = [(1, "ab#1", "01011990"), (2, "ab#1", "01011990"), (3, "cd#1", "02021990"), (4, "ab#1", "01011991")]
    u = spark.createDataFrame([(i, p, "ab", "x", "e", b, "n") for i, p, b in rows], "user_id long, password string, first_name string, last_name string, email string, birthday string, username string")
    monkeypatch.setattr(domain, "users", lambda spark, d: u)
    df = catalog.QUERIES["token_overlap_filter"](spark, small)
    assert {tuple(r) for r in df.collect()} == {(1, "ab#1", 3, 1), (2, "ab#1", 3, 1), (1, "cd#1", 2, 1), (2, "cd#1", 2, 1), (3, "ab#1", 2, 2)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1 and "Join" in df._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_variants_come_in_rounds(spark, monkeypatch):
    """Only a base with few variants is tried again, and the variants are those of all tries at once."""
    from pyspark.sql import Window as W

    from veilspark.operators import decoys as G

    left = []
    monkeypatch.setattr(G, "cut", lambda df, own=G.cut: (left.append(df.count()) if df.columns == ["user_id", "base"] else None, own(df))[1])
    bases = spark.createDataFrame([(1, "shadow_moon#1963"), (2, "1")], "user_id long, base string")
    got = {tuple(r) for r in G.tweaks(bases, 4, 67).collect()}
    more = F.floor(F.col("variant") / F.lit(16)) * 0.1
    rows = bases.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(79))))
    word = G.tweak(F.col("base"), 67, F.concat_ws("/", F.col("user_id").cast("string"), "base"), F.col("variant"), 0.3 + more, 0.03 + more, 0.05 + more)
    once = rows.withColumn("word", F.when(F.col("variant") == 0, F.col("base")).otherwise(word)).groupBy("user_id", "base", "word").agg(F.min("variant").alias("variant"))
    first = once.withColumn("r", F.row_number().over(W.partitionBy("user_id", "base").orderBy("variant", "word"))).filter("r <= 4")
    assert got == {tuple(r) for r in first.select("user_id", "base", "variant", "word").collect()}
    assert left[0] == 2 and left[-1] < 2
