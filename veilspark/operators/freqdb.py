"""Frequency tables of tokens and patterns, candidates of equal frequency, and registration history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import is_ascii, pattern, shape, tokens
from ..session import cut

SMALL = 64  # buckets of so many tokens are also held as an array


def occurrences(corpus: DataFrame, word: str = "password") -> DataFrame:
    """The columns of corpus with one row for each token (A lower-cased, D, S) and pattern (P) of ASCII words."""
    ascii_ = corpus.filter(is_ascii(F.col(word)) & (F.col(word) != ""))
    own = F.transform(tokens(F.col(word)), lambda t: F.struct(t["kind"].alias("type"), F.when(t["kind"] == "A", F.lower(t["value"])).otherwise(t["value"]).alias("token")))
    whole = F.array(F.struct(F.lit("P").alias("type"), pattern(F.col(word)).alias("token")))
    return ascii_.withColumn("o", F.explode(F.concat(own, whole))).select(*corpus.columns, "o.type", "o.token")


def token_counts(corpus: DataFrame, word: str = "password") -> DataFrame:
    """type, token, freq."""
    return occurrences(corpus, word).groupBy("type", "token").agg(F.count(F.lit(1)).alias("freq"))


def vocabulary(freqs: DataFrame) -> DataFrame:
    return freqs.groupBy("type").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("freq").alias("n_total"))


def distances(wanted: DataFrame, freqs: DataFrame, width: int = 5) -> DataFrame:
    """type, token, f, delta of each wanted (type, token): its frequency and the least distance up to `width` with other tokens.

    An unseen token counts as frequency 1. Every wanted token is joined to the few frequency values
    it may have, never to a range of the table. delta is null where nothing is found.
    """
    asked = wanted.select("type", "token").distinct().join(freqs, ["type", "token"], "left").select("type", "token", F.coalesce("freq", F.lit(1)).cast("long").alias("f"))
    tried = asked.withColumn("g", F.explode(F.sequence(F.col("f") - width, F.col("f") + width)))
    # the frequencies that exist, without their tokens, decide the distance first
    there = freqs.groupBy("type", F.col("freq").alias("g")).agg(F.count(F.lit(1)).alias("size"), F.min("token").alias("lone"))
    near = tried.join(there, ["type", "g"]).filter("size > 1 OR lone <> token")
    best = near.groupBy("type", "token", "f").agg(F.min(F.abs(F.col("g") - F.col("f"))).alias("delta"))
    return asked.join(best.select("type", "token", "delta"), ["type", "token"], "left")


def candidates(wanted: DataFrame, freqs: DataFrame, width: int = 5) -> DataFrame:
    """Tokens of the same type and frequency as each wanted (type, token), with the distance used.

    Tokens without an equal partner take the nearest distance up to `width` at which there are any.
    delta is -1 where nothing is found.
    """
    used = distances(wanted, freqs, width)
    found = used.filter("delta IS NOT NULL").withColumn("g", F.explode(F.sequence(F.col("f") - F.col("delta"), F.col("f") + F.col("delta"))))
    other = freqs.select("type", F.col("freq").alias("g"), F.col("token").alias("candidate"))
    hit = found.join(other, ["type", "g"]).filter("candidate <> token").select("type", "token", "candidate", F.col("delta").cast("int").alias("delta"))
    none = used.filter("delta IS NULL").select("type", "token", F.lit(None).cast("string").alias("candidate"), F.lit(-1).alias("delta"))
    return hit.unionByName(none)


def bucket_sizes(freqs: DataFrame, width: int = 5) -> DataFrame:
    """type, token, freq, delta, n: how many tokens a token may be replaced by, at the least distance up to `width` (else delta -1, n 0).

    Members are never paired: tokens of a bucket share its frequency, so sizes follow from counts per frequency.
    """
    used = distances(freqs, freqs, width)
    there = freqs.groupBy("type", F.col("freq").alias("g")).agg(F.count(F.lit(1)).alias("size"))
    met = used.filter("delta IS NOT NULL").withColumn("g", F.explode(F.sequence(F.col("f") - F.col("delta"), F.col("f") + F.col("delta")))).join(there, ["type", "g"])
    sizes = met.groupBy("type", "token").agg((F.sum("size") - 1).alias("n"))
    return used.join(sizes, ["type", "token"], "left").select("type", "token", F.col("f").alias("freq"), F.coalesce("delta", F.lit(-1)).cast("int").alias("delta"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def members(freqs: DataFrame, parts: int = 64) -> DataFrame:
    """type, g, key, pos, token: the tokens of each bucket numbered from 0.

    g is a frequency, or -1 for the whole type; key is the length of specials, the shape of a
    pattern, else empty. A bucket is numbered in hash parts with offsets, so none goes to one task.
    """
    key = F.when(F.col("type") == "S", F.length("token").cast("string")).when(F.col("type") == "P", shape(F.col("token"))).otherwise("")
    rows = freqs.select("type", F.explode(F.array(F.col("freq").cast("long"), F.lit(-1).cast("long"))).alias("g"), key.alias("key"), "token", F.pmod(F.xxhash64("token"), F.lit(parts)).alias("part"))
    bucket = ["type", "g", "key"]
    sizes = rows.groupBy(*bucket, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*bucket).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = rows.withColumn("r", F.row_number().over(W.partitionBy(*bucket, "part").orderBy("token")) - 1)
    return own.join(sizes.withColumn("before", before).drop("n"), [*bucket, "part"]).select(*bucket, (F.col("before") + F.col("r")).alias("pos"), "token")


def pools(wanted: DataFrame, freqs: DataFrame, numbered: DataFrame, width: int = 5) -> DataFrame:
    """type, token, by: for each key a struct of what a wanted token may be replaced by.

    total (candidates, without the token), gs (its buckets g with their size n), own (the token's
    own pos in them, null if it isn't there) and pool (the candidates if total is at most SMALL,
    else null). A token without partners up to `width` takes its whole type.
    """
    used = distances(wanted, freqs, width)
    far = F.array(F.lit(-1).cast("long"))
    gs = F.when(F.col("delta").isNull(), far).when(F.col("delta") == 0, F.array("f")).otherwise(F.array(F.col("f") - F.col("delta"), F.col("f") + F.col("delta")))
    used = used.withColumn("g", F.explode(gs)).select("type", "token", "g")
    # pos of the token itself, where it lies in its bucket
    used = used.join(numbered.select("type", "g", "token", F.col("key").alias("home"), F.col("pos").alias("at")), ["type", "g", "token"], "left")
    sizes = numbered.groupBy("type", "g", "key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") <= SMALL, F.col("token")))).alias("some"))
    met = used.join(sizes, ["type", "g"])
    met = met.withColumn("own", F.when(F.col("key") == F.col("home"), F.col("at")))
    listed = F.array_sort(F.collect_list(F.struct("g", "n")))
    per = met.groupBy("type", "token", "key").agg(listed.alias("gs"), F.max("own").alias("own"), F.sum("n").alias("n"), F.flatten(F.array_sort(F.collect_list("some"))).alias("some"))
    total = F.col("n") - F.col("own").isNotNull().cast("long")
    pool = F.when(total <= SMALL, F.filter("some", lambda x: x != F.col("token")))
    entry = F.struct("key", F.struct(total.alias("total"), "gs", "own", pool.alias("pool")).alias("e"))
    return per.groupBy("type", "token").agg(F.map_from_entries(F.collect_list(entry)).alias("by"))


def history(base: DataFrame, registered: DataFrame) -> DataFrame:
    """Frequency of each token as registrations come in: type, token, freq, from_reg, to_reg.

    freq holds for registrations reg with from_reg <= reg < to_reg (null: open). Several occurrences
    in one password count together.
    """
    steps = occurrences(registered).groupBy("type", "token", "reg").agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy("type", "token").orderBy("reg")
    grown = steps.withColumns({"upto": F.sum("k").over(w), "to_reg": F.lead("reg").over(w)})
    known = base.select("type", "token", F.col("freq").alias("f0"))
    later = grown.join(known, ["type", "token"], "left").select("type", "token", (F.coalesce("f0", F.lit(0)) + F.col("upto")).alias("freq"), F.col("reg").alias("from_reg"), "to_reg")
    first = steps.groupBy("type", "token").agg(F.min("reg").alias("to_reg"))
    before = known.join(first, ["type", "token"], "left").select("type", "token", F.col("f0").alias("freq"), F.lit(None).cast("long").alias("from_reg"), "to_reg")
    return before.unionByName(later)


def evolving_candidates(base: DataFrame, registered: DataFrame) -> DataFrame:
    """reg, type, token, candidate: tokens whose frequency, right after registration reg, equals that of its token.

    The sequence of registrations is an interval join on (type, freq); no loop over users.
    """
    spans = history(base, registered)
    own = spans.filter("from_reg IS NOT NULL").select("type", "token", "freq", F.col("from_reg").alias("reg"))
    other = spans.select("type", F.col("token").alias("candidate"), "freq", "from_reg", "to_reg")
    hit = own.join(other, ["type", "freq"])
    live = (F.coalesce("from_reg", F.lit(-1)) <= F.col("reg")) & (F.col("to_reg").isNull() | (F.col("reg") < F.col("to_reg")))
    return hit.filter(live & (F.col("candidate") != F.col("token"))).select("reg", "type", "token", "candidate")


def frozen_candidates(base: DataFrame, registered: DataFrame) -> DataFrame:
    """As `evolving_candidates`, with each user seeing the base and the own password only."""
    own = occurrences(registered).groupBy("type", "token", "reg").agg(F.count(F.lit(1)).alias("k"))
    own = own.join(base, ["type", "token"], "left").select("type", "token", "reg", (F.coalesce("freq", F.lit(0)) + F.col("k")).alias("freq"))
    other = base.select("type", F.col("token").alias("candidate"), "freq")
    mine = own.select("reg", "type", F.col("token").alias("candidate"))
    hit = own.join(other, ["type", "freq"]).filter("candidate <> token")
    # the own password's other tokens have grown with it
    return hit.join(mine, ["reg", "type", "candidate"], "left_anti").unionByName(
        own.alias("a").join(own.alias("b"), (F.col("a.reg") == F.col("b.reg")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.freq") == F.col("b.freq")) & (F.col("a.token") != F.col("b.token"))).select("a.reg", "a.type", F.col("b.token").alias("candidate"), "a.token", "a.freq")
    ).select("reg", "type", "token", "candidate")


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """rows with `upto`: the sum of value over the rows of the group up to this one, in the given order (unique within a group).

    Rows are dealt by ranges of group and order, so one group may lie in many tasks; each sums up its own rows, and what the
    ranges before hold of a group is added, of which there is a row per range.
    """
    spark = rows.sparkSession
    dealt = cut(rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *group, *order).withColumn("part", F.spark_partition_id()))
    local = dealt.withColumn("own", F.sum(value).over(W.partitionBy("part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    totals = dealt.groupBy("part", *group).agg(F.sum(value).alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return local.join(totals.withColumn("before", before).drop("total"), ["part", *group]).withColumn("upto", F.col("own") + F.col("before")).drop("part", "own", "before")


def evolving_counts(base: DataFrame, registered: DataFrame) -> DataFrame:
    """reg, type, n, n_candidates: how many rows, and how many distinct candidates, `evolving_candidates` has for each, without making them.

    A sweep over the spans of a (type, freq): a token's span adds one where it begins and takes one where it ends; the sum up to a
    registration is the number of tokens of that frequency then. Of several own tokens of one frequency each is the others' candidate.
    """
    spans = history(base, registered)
    begun = spans.select("type", "freq", F.coalesce("from_reg", F.lit(-1)).alias("at"), F.lit(1).cast("long").alias("d"))
    ended = spans.filter("to_reg IS NOT NULL").select("type", "freq", F.col("to_reg").alias("at"), F.lit(-1).cast("long").alias("d"))
    steps = begun.unionByName(ended).groupBy("type", "freq", "at").agg(F.sum("d").alias("d"))
    live = prefix_sums(steps, ["type", "freq"], ["at"], "d").select("type", "freq", F.col("at").alias("reg"), F.col("upto").alias("live"))
    # at each registration of a token its frequency's sum has a step
    own = spans.filter("from_reg IS NOT NULL").groupBy("type", "freq", F.col("from_reg").alias("reg")).agg(F.count(F.lit(1)).alias("m"))
    met = own.join(live, ["type", "freq", "reg"])
    others = F.col("m") * (F.col("live") - 1)
    found = met.groupBy("reg", "type").agg(F.sum(others).alias("n"), F.sum(F.when(F.col("m") > 1, F.col("live")).otherwise(F.col("live") - 1)).alias("n_candidates"))
    return found.filter("n > 0")


def frozen_counts(base: DataFrame, registered: DataFrame) -> DataFrame:
    """As `evolving_counts` for `frozen_candidates`: the base's tokens of a frequency, less those that the own password moves away, and its others."""
    own = occurrences(registered).groupBy("type", "token", "reg").agg(F.count(F.lit(1)).alias("k"))
    own = cut(own.join(base, ["type", "token"], "left").select("type", "reg", F.col("freq").alias("was"), (F.coalesce("freq", F.lit(0)) + F.col("k")).alias("freq")))
    there = base.groupBy("type", "freq").agg(F.count(F.lit(1)).alias("there"))
    moved = own.filter("was IS NOT NULL").groupBy("type", "reg", F.col("was").alias("freq")).agg(F.count(F.lit(1)).alias("moved"))
    asked = own.groupBy("type", "reg", "freq").agg(F.count(F.lit(1)).alias("m"))
    met = asked.join(there, ["type", "freq"], "left").join(moved, ["type", "reg", "freq"], "left").fillna(0, ["there", "moved"])
    left = F.col("there") - F.col("moved")
    found = met.groupBy("reg", "type").agg(F.sum(F.col("m") * (left + F.col("m") - 1)).alias("n"), F.sum(left + F.when(F.col("m") > 1, F.col("m")).otherwise(0)).alias("n_candidates"))
    return found.filter("n > 0")
