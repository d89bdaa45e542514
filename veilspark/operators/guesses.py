"""Guesses in the order of a model, without a queue: grammars by probability levels, letter ranks by unranking.

Both count first and expand afterwards what the counts say is wanted, so every row that is made
on the way leads to a guess that is returned or stands within rounding of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import apply_mask
from ..session import cut

#: Levels of a factor of two in probability; guesses that one row of a pre-terminal expands at once.
FINE, CHUNK = 8, 4096
ITEM = ["type", "len", "level"]


def _level(prob: Column, fine: int) -> Column:
    return F.floor(-F.log2(prob) * fine).cast("int")


def _numbered(terms: DataFrame, parts: int = 64) -> DataFrame:
    """terms with idx from 0 within (type, len, level); numbered in hash parts with offsets, so no group goes to one task."""
    rows = terms.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    sizes = rows.groupBy(*ITEM, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*ITEM).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = rows.withColumn("r", F.row_number().over(W.partitionBy(*ITEM, "part").orderBy("item")) - 1)
    return own.join(sizes.withColumn("before", before).drop("n"), [*ITEM, "part"]).select(*ITEM, (F.col("before") + F.col("r")).alias("idx"), "item", "prob")


def slots_of(structures: DataFrame) -> DataFrame:
    """structure, i, type, len, k: the slots of each structure; letters have a mask (C) behind them."""
    parts = F.transform(F.regexp_extract_all("structure", F.lit("([A-Z][0-9]+)"), F.lit(1)), lambda x: F.struct(F.substring(x, 1, 1).alias("type"), F.substring(x, 2, 9).cast("int").alias("len")))
    both = lambda s: F.when(s["type"] == "A", F.array(s, F.struct(F.lit("C").alias("type"), s["len"].alias("len")))).otherwise(F.array(s))
    whole = structures.withColumn("all", F.flatten(F.transform(parts, both)))
    return whole.select("structure", F.size("all").alias("k"), F.posexplode("all").alias("i", "s")).select("structure", "i", "s.type", "s.len", "k")


def best_first(probs: DataFrame, n: int, fine: int = FINE) -> DataFrame:
    """rank, word, structure, prob: the n likeliest guesses of a grammar (type, len, item, prob), ties by word and structure.

    A guess is a structure and an item for each slot; its probability is their product. Probabilities
    are cut into levels; a convolution over the slots counts the guesses of each level, which
    bounds the level of the n-th. Level combinations within the bound (pre-terminals) are laid out, cut
    into chunks and their guesses decoded from their positions, then sorted by exact probability. Structures
    with a slot that has no item, and those of probability 0, give none; a guess that two structures
    make comes twice.
    """
    spark = probs.sparkSession
    known = probs.filter(F.col("prob") > 0).withColumn("level", _level(F.col("prob"), fine))
    terms = cut(known.filter("type <> 'S'").select(*ITEM, "item", "prob"))
    structures = known.filter("type = 'S' AND item <> 'M'").select(F.col("item").alias("structure"), F.col("level").alias("used"), F.col("prob").alias("own"))
    sizes = cut(terms.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("m")))
    least = sizes.groupBy("type", "len").agg(F.min("level").alias("least"))
    slots = slots_of(structures.select("structure")).join(least, ["type", "len"])
    rest = F.coalesce(F.sum("least").over(W.partitionBy("structure").orderBy("i").rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    slots = slots.withColumns({"rest": rest, "there": F.count(F.lit(1)).over(W.partitionBy("structure"))}).filter("there = k")
    slots = cut(slots.select("structure", "i", "type", "len", "k", "rest"))
    first = slots.filter("i = 0").select("structure", "k")
    structures = cut(structures.join(first, "structure"))
    longest = structures.agg(F.max("k")).first()[0]
    if longest is None or n <= 0:
        return structures.filter("false").select(F.lit(0).alias("rank"), F.lit("").alias("word"), "structure", F.col("own").alias("prob"))

    # shorter structures are filled up with slots of one empty item, so a round is one chain of joins
    every = structures.select("structure", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("i"))
    filled = every.join(slots.drop("k"), ["structure", "i"], "left")
    slots = cut(filled.select("structure", "i", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("rest", F.lit(0).cast("long")).alias("rest")))
    sizes = sizes.unionByName(spark.createDataFrame([("", 0, 0, 1)], "type string, len int, level int, m long"))

    def at(state: DataFrame, i: int) -> DataFrame:
        """Rows with slot i and the levels of its items."""
        return state.join(slots.filter(F.col("i") == i).drop("i"), "structure").join(sizes, ["type", "len"])

    # how many guesses there are of each level, over all structures
    state = structures.select("structure", F.col("used").alias("sum"), F.lit(1.0).alias("ways"))
    for i in range(longest):
        state = at(state, i).groupBy("structure", (F.col("sum") + F.col("level")).alias("sum")).agg(F.sum(F.col("ways") * F.col("m")).alias("ways"))
    counts = state.groupBy("sum").agg(F.sum("ways").alias("ways")).orderBy("sum").collect()  # a row per level
    bound, upto = counts[-1]["sum"], 0.0
    for r in counts:
        upto += r["ways"]
        if upto >= n:
            # the n-th guess costs less than one level more for each factor
            bound = r["sum"] + longest + 1
            break

    picks = "array<struct<type:string,len:int,level:int,m:bigint,stride:bigint>>"
    state = structures.select("structure", "own", F.col("used").alias("sum"), F.lit(1).cast("long").alias("ways"), F.array().cast(picks).alias("picks"))
    for i in range(longest):
        met = at(state, i).filter(F.col("sum") + F.col("level") + F.col("rest") <= bound)
        pick = F.struct("type", "len", "level", "m", F.col("ways").alias("stride"))
        picked = F.when(F.col("type") == "", F.col("picks")).otherwise(F.concat("picks", F.array(pick)))
        state = met.select("structure", "own", (F.col("sum") + F.col("level")).alias("sum"), (F.col("ways") * F.col("m")).alias("ways"), picked.cast(picks).alias("picks"))
    chunks = state.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ways") - 1) / CHUNK).cast("long"))))
    levels = F.array_join(F.transform("picks", lambda p: p["level"].cast("string")), ",")
    chunks = chunks.withColumn("levels", levels).repartition("structure", "levels", "c")  # a pre-terminal of many guesses is dealt out
    each = chunks.withColumn("pos", F.explode(F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("ways")) - 1)))
    asked = each.select("structure", "own", "levels", "pos", F.posexplode(F.expr("transform(picks, p -> named_struct('type', p.type, 'len', p.len, 'level', p.level, 'idx', (pos div p.stride) % p.m))")).alias("i", "p"))
    met = asked.select("structure", "own", "levels", "pos", "i", "p.*").join(_numbered(terms), [*ITEM, "idx"])
    parts = F.array_sort(F.collect_list(F.struct("i", "type", "item", "prob")))
    whole = met.groupBy("structure", "levels", "pos").agg(F.first("own").alias("own"), parts.alias("parts"))
    value = F.transform("parts", lambda x, i: F.when(x["type"] == "C", F.lit("")).when(x["type"] == "A", apply_mask(x["item"], F.get(F.col("parts"), i + 1)["item"])).otherwise(x["item"]))
    prob = F.aggregate("parts", F.col("own"), lambda p, x: p * x["prob"])
    best = whole.select(F.array_join(value, "").alias("word"), "structure", prob.alias("prob")).orderBy(F.desc("prob"), "word", "structure").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("prob"), "word", "structure"))).select("rank", "word", "structure", "prob")  # n rows


def completions(ranks: DataFrame, longest: int, most: int) -> DataFrame:
    """left, prev, rank, ways: how many ways there are to go on from a letter by `left` letters of that total rank.

    ranks: prev (null for the first letter), c, rank; prev is "" in the result where a word begins.
    One grouped join a length, on rows of letters times ranks; every letter ends a word in one way.
    """
    step = cut(ranks.select(F.coalesce("prev", F.lit("")).alias("prev"), "c", F.col("rank").cast("int").alias("own")).filter(F.col("own") <= most))
    now = step.select("c").distinct().select(F.lit(0).alias("left"), F.col("c").alias("prev"), F.lit(0).alias("rank"), F.lit(1).cast("decimal(38,0)").alias("ways"))
    out = now
    for left in range(1, longest + 1):
        after = now.select(F.col("prev").alias("c"), "rank", "ways")
        met = step.join(after, "c").withColumn("rank", F.col("rank") + F.col("own")).filter(F.col("rank") <= most)
        now = met.groupBy("prev", "rank").agg(F.sum("ways").cast("decimal(38,0)").alias("ways")).select(F.lit(left).alias("left"), "prev", "rank", "ways")
        now = cut(now)
        out = out.unionByName(now)
    return out


def rank_words(ranks: DataFrame, low: int, high: int, longest: int = 16, first: int = 0, last: int | None = None) -> DataFrame:
    """position, word, rank: the words of total rank low..high and at most `longest` letters, of which those at positions first..last.

    Positions count from 0 in the order of rank, length and word. An interval of positions belongs to each beginning of words; it is cut among
    the letters that may follow, by their completions, and cuts outside first..last go, so a share of a large space costs
    what it returns. No beginning is kept that has no word.
    """
    ways = cut(completions(ranks, longest, high))
    # what may follow a letter, with `left` letters and a rank still to go: one array a state
    step = ranks.select(F.coalesce("prev", F.lit("")).alias("prev"), "c", F.col("rank").cast("int").alias("own"))
    after = ways.select((F.col("left") + 1).alias("left"), F.col("prev").alias("c"), "rank", "ways").filter(F.col("left") <= longest)
    following = step.join(after, "c").withColumn("rank", F.col("rank") + F.col("own")).filter(F.col("rank") <= high)
    following = following.groupBy("left", "prev", "rank").agg(F.array_sort(F.collect_list(F.struct("c", "own", "ways"))).alias("steps"))  # an alphabet at most
    following = cut(following)
    whole = ways.filter(f"prev = '' AND left > 0 AND rank BETWEEN {int(low)} AND {int(high)}")
    # a row per rank and length
    start = F.coalesce(F.sum("ways").over(W.orderBy("rank", "left").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    end = (1 << 62) if last is None else last
    state = whole.select(F.lit("").alias("word"), "prev", "left", "rank", F.col("rank").alias("total"), start.cast("decimal(38,0)").alias("at"), "ways")
    state = state.filter((F.col("at") <= end) & (F.col("at") + F.col("ways") > first)).drop("ways")
    done = None
    for _ in range(longest):
        met = state.join(following, ["left", "prev", "rank"])
        begun = F.aggregate("steps", F.struct(F.col("at").alias("at"), F.array().cast("array<struct<c:string,own:int,at:decimal(38,0),ways:decimal(38,0)>>").alias("out")), lambda s, x: F.struct((s["at"] + x["ways"]).cast("decimal(38,0)").alias("at"), F.concat(s["out"], F.array(F.struct(x["c"].alias("c"), x["own"].alias("own"), s["at"].alias("at"), x["ways"].alias("ways")))).alias("out")))
        each = met.select("word", "left", "rank", "total", F.explode(begun["out"]).alias("x")).filter((F.col("x.at") <= end) & (F.col("x.at") + F.col("x.ways") > first))
        moved = each.select(F.concat("word", "x.c").alias("word"), F.col("x.c").alias("prev"), (F.col("left") - 1).alias("left"), (F.col("rank") - F.col("x.own")).alias("rank"), "total", F.col("x.at").alias("at"))
        moved = cut(moved)  # it is read twice
        ended = moved.filter("left = 0")
        done = ended if done is None else done.unionByName(ended)
        state = moved.filter("left > 0")
    return done.select(F.col("at").cast("long").alias("position"), "word", F.col("total").alias("rank"))


def rank_sizes(ranks: DataFrame, longest: int = 16, most: int = 1000, stop: float = 1e12) -> DataFrame:
    """rank, size: how many words of at most `longest` letters have each rank, up to the first rank up to which there are more than `stop`."""
    ways = completions(ranks, longest, most).filter("prev = '' AND left > 0").groupBy("rank").agg(F.sum("ways").alias("size"))
    every = ranks.sparkSession.range(1, most + 1).select(F.col("id").alias("rank"))
    sizes = every.join(ways.withColumn("rank", F.col("rank").cast("long")), "rank", "left").select("rank", F.coalesce("size", F.lit(0)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per rank
    return sizes.withColumn("before", before).filter(F.col("before") <= stop).select("rank", F.col("size").cast("decimal(38,0)").alias("size"))
