"""Corpus profiling: counts, histograms, overlaps, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import draw32, uniform
from ..session import cut

#: Rows of a list of words that may go to every task.
HELD = 500_000


def counts(corpus: DataFrame, word: str = "password") -> DataFrame:
    """word, cnt: combined within tasks before the shuffle."""
    return corpus.groupBy(word).agg(F.count(F.lit(1)).alias("cnt"))


def counts_descending(corpus: DataFrame, word: str = "password") -> DataFrame:
    return counts(corpus, word).orderBy(F.desc("cnt"), word)


def merge_counts(parts: DataFrame, word: str = "password") -> DataFrame:
    """Sums of several count tables; bad and non-positive counts are gone before."""
    return parts.filter("cnt > 0").groupBy(word).agg(F.sum("cnt").alias("cnt"))


def most_common(corpus: DataFrame, n: int, word: str = "password") -> DataFrame:
    """A top-n that each task cuts before the merge; ties by word."""
    return counts_descending(corpus, word).limit(n)


def argmax(corpus: DataFrame, word: str = "password") -> DataFrame:
    return counts(corpus, word).agg(F.max(F.col("cnt")).alias("cnt"), F.max_by(word, F.struct("cnt", (-F.xxhash64(word)).alias("h"))).alias(word))


def length_histogram(corpus: DataFrame, word: str = "password") -> DataFrame:
    """len, n, share."""
    found = corpus.groupBy(F.length(word).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(found.agg(F.sum("n").alias("total")))).select("len", "n", (F.col("n") / F.col("total")).alias("share"))


def overlap(a: DataFrame, b: DataFrame, word: str = "password", fold: bool = False) -> DataFrame:
    """One row: distinct sizes, intersection and Jaccard of two corpora (0 if both are empty)."""
    key = F.lower(word) if fold else F.col(word)
    both = a.select(key.alias("w"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(key.alias("w"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    flags = both.groupBy("w").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    n = flags.agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.sum(F.col("in_a") * F.col("in_b")).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return n.select(zero("n_a"), zero("n_b"), zero("n_both"), F.when(F.col("n_any") > 0, F.col("n_both") / F.col("n_any")).otherwise(0.0).alias("jaccard"))


def rows_in_train(test: DataFrame, train: DataFrame, word: str = "password") -> DataFrame:
    """Rows of test whose word is in train, duplicates counting."""
    return test.join(train.select(word).distinct(), word, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def first_seen(rows: DataFrame, *order: str, word: str = "password") -> DataFrame:
    """One row per word, the first by the given order: its word and order columns."""
    return rows.groupBy(word).agg(F.min(F.struct(*order)).alias("_o")).select(word, *[F.col(f"_o.{c}").alias(c) for c in order])


def expand(counted: DataFrame, word: str = "password") -> DataFrame:
    """word, copy: a row for each occurrence, copies counted from 0. Weights do the same job without the rows."""
    return counted.filter("cnt > 0").select(word, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1)).alias("copy"))


def extremes(rows: DataFrame, score: Column, n: int, strongest: bool = True, word: str = "password") -> DataFrame:
    """The n strongest or weakest words by a scorer of the caller's choice; ties by word."""
    scored = rows.select(word).distinct().withColumn("score", score)
    return scored.orderBy(F.desc("score") if strongest else F.asc("score"), word).limit(n)


def equal_parts(rows: DataFrame, seed: int, parts: int, *keys: str) -> DataFrame:
    """rows with `part`: a shuffle by hash dealt into parts whose sizes differ by one at most.

    Positions come from hash ranges and the sizes of those before, so no task holds all rows.
    """
    from pyspark.sql import Window as W

    h = draw32(seed, *keys)
    placed = rows.withColumns({"_h": h, "_r": F.floor(h / F.lit(1 << 20))})
    sizes = placed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)  # 4096 rows at most
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(W.partitionBy(F.lit(1))))
    own = placed.withColumn("_i", F.row_number().over(W.partitionBy("_r").orderBy("_h", *keys)) - 1).join(F.broadcast(sizes), "_r")
    return own.withColumn("part", F.floor((F.col("_before") + F.col("_i")) * parts / F.col("_total")).cast("int")).drop("_h", "_r", "_n", "_before", "_total", "_i")


def random_words(rows: DataFrame, seed: int, length: int, *keys: str) -> DataFrame:
    """rows with `word`: letters and digits drawn by hash."""
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    one = lambda i: F.substr(F.lit(signs), (draw32(seed, *keys, i) % len(signs) + 1).cast("int"), F.lit(1))
    return rows.withColumn("word", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), one), ""))


def split_rows(rows: DataFrame, seed: int, share: float, *keys: str) -> DataFrame:
    """A boolean `train` by hash; the same on any partitioning."""
    return rows.withColumn("train", uniform(seed, *keys) < share)


def sample_rows(rows: DataFrame, seed: int, n: int, *keys: str) -> DataFrame:
    """n rows without replacement, those of the smallest hash."""
    return rows.orderBy(draw32(seed, *keys), *keys).limit(n)


def halves(rows: DataFrame, pos: str, total: int | Column) -> DataFrame:
    """second: whether a row lies in the second half by position."""
    return rows.withColumn("second", F.col(pos) >= F.floor((total if isinstance(total, Column) else F.lit(total)) / 2))


def weighted_draws(counted: DataFrame, draws: DataFrame, seed: int, slots: int = 1024, keep: list[str] | None = None, held: int = HELD) -> DataFrame:
    """draws(id), or their columns `keep`, with a word each, with replacement and by weight.

    Words get cumulative intervals, summed up by hash slots. The total is cut into as many cells as
    there are words; a word is listed in every cell that its interval meets and a draw looks into
    its own one, so it meets two words or so whatever their number. A list of up to `held` rows goes to every task.
    """
    from pyspark.sql import Window as W

    local = counted.select("password", "cnt").withColumn("slot", draw32(0, "password") % slots)
    per = local.groupBy("slot").agg(F.sum("cnt").alias("mass"), F.count(F.lit(1)).alias("words"))
    upto = W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)  # a row per slot
    base = per.withColumn("before", F.coalesce(F.sum("mass").over(upto), F.lit(0))).select("slot", "before")
    whole = F.broadcast(per.agg(F.sum("mass").alias("total"), F.sum("words").alias("cells")))  # one row
    run = F.sum("cnt").over(W.partitionBy("slot").orderBy("password").rowsBetween(W.unboundedPreceding, 0))
    placed = local.withColumn("upto", run).join(F.broadcast(base), "slot").crossJoin(whole)
    placed = placed.withColumns({"low": F.col("before") + F.col("upto") - F.col("cnt"), "high": F.col("before") + F.col("upto")})
    cell = lambda x: F.floor(x / F.col("total") * F.col("cells"))
    listed = cut(placed.select("password", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell")))
    if listed.count() <= held:
        listed = F.broadcast(listed)
    wanted = draws.crossJoin(whole).withColumn("x", F.floor(uniform(seed, "id") * F.col("total"))).withColumn("cell", cell(F.col("x")))
    own = keep or ["id"]
    return wanted.select(*own, "x", "cell").join(listed, "cell").filter("x >= low AND x < high").select(*own, "password")
