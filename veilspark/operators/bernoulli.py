"""Membership-filter accounts: registration, logins, probes and detection rates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import bitmap, fill, indices, judged, mark, salted_hash, target_size
from ..functions.rng import draw32, uniform
from ..session import cut, ship_package, spread


def register(users: DataFrame, p_h: float, seed: int, p_mark: float | None = None, k: int = 20, b: int = 128) -> DataFrame:
    """user_id, salt, true (positions of the password), b (filter), and with p_mark m (marks)."""
    salt = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit("salt"), F.col("user_id").cast("string")), 256), 1, 32)
    rows = users.select("user_id", "password").withColumn("salt", salt)
    rows = rows.withColumn("true", indices(salted_hash(F.encode("salt", "utf-8"), F.col("password")), k, b))
    rows = rows.withColumn("b", fill(F.col("true"), p_h, seed, F.col("user_id"), F.lit("b"), k=k, b=b))
    if p_mark is not None:
        rows = rows.withColumn("m", mark(F.col("b"), F.col("true"), p_mark, seed, F.col("user_id"), F.lit("m")))
    return rows.drop("password")


def login(attempts: DataFrame, accounts: DataFrame, k: int = 20, b: int = 128) -> DataFrame:
    """attempts with outcome: failure (unknown user or not in the filter), success, alarm."""
    own = accounts.select("user_id", "salt", "true", "b")
    found = judged(salted_hash(F.encode("salt", "utf-8"), F.col("word")), F.col("true"), F.col("b"), k, b)
    tried = attempts.join(own, "user_id", "left").withColumn("found", found)
    return tried.withColumn("outcome", F.when(F.col("found") == 0, "failure").when(F.col("found") == 2, "success").otherwise("alarm")).drop("salt", "true", "b", "found")


#: Ends of the blocks in which a ranking is walked; the longest one is the attack's length.
BLOCKS = [256, 1024, 4096, 16384, 65536, 100_000]
#: Words and accounts that meet as one row.
GROUP, TOGETHER = 256, 256


def _first_hits(keys: tuple[str, ...], schema: pa.Schema, k: int, b: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over rows of accounts and ranked words: keys, rank, password of the first word of a row that lies in each account's bitmap.

    Accounts with one salt (snapshots of one user) share the hashes; a word's hashes end where it lies in none of them.
    """
    heads = [f"{i}:".encode() for i in range(k)]

    def position(hexed: bytes, head: bytes) -> int:
        return int.from_bytes(sha256(head + hexed).digest()) % b

    def walk(salt: bytes, own: list[dict], words: list[tuple]) -> Iterator[tuple[dict, int, str]]:
        for rank, password, data in words:
            hexed = sha256(salt + data).hexdigest().encode()
            inside = own
            for head in heads:
                at = position(hexed, head)
                inside = [x for x in inside if x["bits"][at] == "1"]
                if not inside:
                    break
            else:
                for x in inside:
                    yield x, rank, password
                own = [x for x in own if x not in inside]
                if not own:
                    return

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = [(w["rank"], w["password"], w["password"].encode()) for w in batch.column("part")[i].as_py()]
                salts: dict[str, list[dict]] = {}
                for x in batch.column("some")[i].as_py():
                    salts.setdefault(x["salt"], []).append(x)
                found = [(*[x[key] for key in keys], rank, password) for salt, own in salts.items() for x, rank, password in walk(salt.encode(), own, words)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return task


def best_candidates(accounts: DataFrame, ranking: DataFrame, blocks: list[int] = BLOCKS, marks: bool = False, k: int = 20, b: int = 128, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """keys, rank, password: the first ranked word that lies in each account's filter (and marks); null if none.

    Salts differ by account, so every pair has to be hashed, up to an account's hit. The ranking is walked
    in growing blocks of bounded length, each broadcast; accounts come in hash groups, those with a hit leave
    before the next block, and the walk ends when none are left.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(accounts.sparkSession)
    ranking = cut(ranking.filter(F.col("rank") <= blocks[-1]).select(F.col("rank").cast("long").alias("rank"), "password"))
    # cut off here, or the filter would be made anew for each of its positions
    left = cut(accounts.select(*keys, "salt", F.col("m" if marks else "b").alias("filled")))
    found, low, last = None, 0, ranking.count()
    kind = left.select(*keys, F.lit(0).cast("long").alias("rank"), F.lit("").alias("password")).schema
    task = _first_hits(keys, to_arrow_schema(kind), k, b)
    for high in blocks:
        # high - low rows at most, in groups that tasks share
        block = ranking.filter((F.col("rank") > low) & (F.col("rank") <= high)).groupBy(F.floor((F.col("rank") - 1) / GROUP).alias("g")).agg(F.array_sort(F.collect_list(F.struct("rank", "password"))).alias("part"))
        groups = math.ceil(left.count() / TOGETHER)
        placed = left.select(*keys, "salt", bitmap(F.col("filled"), b).alias("bits"), F.pmod(F.xxhash64("salt"), F.lit(max(groups, 1))).alias("at"))
        rows = spread(placed, "at").groupBy("at").agg(F.collect_list(F.struct(*keys, "salt", "bits")).alias("some")).crossJoin(F.broadcast(block))
        if high - low > GROUP:
            rows = spread(rows, "at", "g")
        hit = rows.select("some", "part").mapInArrow(task, kind).groupBy(*keys).agg(F.min(F.struct("rank", "password")).alias("hit"))
        hit = cut(hit.select(*keys, "hit.rank", "hit.password"))
        found = hit if found is None else found.unionByName(hit)
        left, low = cut(left.join(hit, list(keys), "left_anti")), high
        if high >= last or left.isEmpty():
            break
    none = left.select(*keys, F.lit(None).cast("long").alias("rank"), F.lit(None).cast("string").alias("password"))
    return none if found is None else found.unionByName(none)


P_MARK, P_REMARK = 0.95, 0.065


def _renews(seed: int, t: Column, p_remark: float) -> Column:
    return uniform(seed, F.col("user_id"), F.lit("renew"), t) < p_remark


def seen_marks(accounts: DataFrame, logins: list[int], seed: int, p_mark: float = P_MARK, p_remark: float = P_REMARK) -> DataFrame:
    """accounts (with marks m) once for each number l of the owner's logins; m becomes what is marked in every snapshot so far.

    After login t the marks are drawn anew by chance; the password's own positions stay marked. An
    attacker who saw all snapshots keeps the words that lie in each, which is to lie in their intersection.
    """
    longest = max(logins)
    renewed = F.filter(F.sequence(F.lit(1), F.lit(max(longest, 1))), lambda t: _renews(seed, t, p_remark))
    rows = accounts.withColumn("_r", renewed).withColumn("l", F.explode(F.array(*[F.lit(x) for x in logins])))
    rows = rows.withColumn("_r", F.filter("_r", lambda t: t <= F.col("l")))
    kept = lambda i: F.array_contains("true", i) | F.forall("_r", lambda t: uniform(seed, F.col("user_id"), t, i) < p_mark)
    return rows.withColumn("m", F.filter("m", kept)).drop("_r")


OUTCOMES = ["no_candidate", "undetected", "detected"]


def _watched(words: object, logins: list[int], more: list[int], seed: int, p_mark: float, p_remark: float, schema: pa.Schema, k: int = 20, b: int = 128) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over accounts (user_id, salt, true, m): user_id, and for each number of logins the rank of the best word left and an outcome for each of `more`.

    Marks only get fewer with the logins, so one walk over the words serves all numbers: a number's walk begins at the word that the one before found.
    """
    heads = [f"{i}:".encode() for i in range(k)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = words.value
        for batch in batches:
            made = []
            for user, salt, true, marks in zip(*(batch.column(c).to_pylist() for c in ("user_id", "salt", "true", "m")), strict=True):
                text, own, head = f"{seed}:{user}:".encode(), set(true), salt.encode()
                chance = lambda key: int.from_bytes(sha256(text + key.encode()).digest()[:4]) / 4294967296.0  # noqa: B023, E731
                renewed = [t for t in range(1, logins[-1] + more[-1] + 1) if chance(f"renew:{t}") < p_remark]
                tables, left, at = [], marks, 0
                for l in logins:  # noqa: E741
                    fresh = [t for t in renewed if at < t <= l]
                    for t in fresh:
                        left = [i for i in left if i in own or chance(f"{t}:{i}") < p_mark]
                    at = l
                    if fresh or not tables:
                        held = bytearray(b)
                        for i in left:
                            held[i - 1] = 1
                    # by the last byte of a hash, which is what counts modulo b
                    tables.append(bytes(held) * (256 // b))
                hits, bits = [], tables[0]
                for rank, data in ranked:
                    hexed = sha256(head + data).hexdigest().encode()
                    while len(hits) < len(logins):
                        for first in heads:
                            if not bits[sha256(first + hexed).digest()[-1]]:
                                break
                        else:
                            hits.append((rank, {sha256(first + hexed).digest()[-1] % b + 1 for first in heads}))
                            bits = tables[min(len(hits), len(tables) - 1)]
                            continue
                        break
                    if len(hits) == len(logins):
                        break
                steps, lost = [], {t: {i for i in own if chance(f"{t}:{i}") >= p_mark} for t in renewed if t > logins[0]}
                for n, l in enumerate(logins):  # noqa: E741
                    rank, places = hits[n] if n < len(hits) else (None, None)
                    last = [max((t for t in renewed if l < t <= l + delta), default=None) for delta in more]
                    steps.append({"rank": rank, "codes": [0 if rank is None else 2 if t is not None and lost[t] - places else 1 for t in last]})
                made.append((user, steps))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return task


def watched_lists(accounts: DataFrame, ranking: DataFrame, logins: list[int], more: list[int], seed: int, p_mark: float = P_MARK, p_remark: float = P_REMARK) -> DataFrame:
    """user_id, steps (rank, codes): for each number of logins seen the best word left, and the outcome by each of `more` as its place in OUTCOMES.

    An account's whole work is done where it lies, so nothing of it is shuffled or cut off; every task holds the ranking, whose length is the attack's.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if logins != sorted(logins) or more != sorted(more):
        raise ValueError("numbers of logins must rise")
    spark = accounts.sparkSession
    ship_package(spark)
    top = ranking.filter(F.col("rank") <= BLOCKS[-1]).select(F.col("rank").cast("long").alias("rank"), "password").collect()
    words = spark.sparkContext.broadcast([(r["rank"], r["password"].encode()) for r in sorted(top)])
    kind = accounts.select("user_id", F.lit(None).cast("array<struct<rank:long,codes:array<tinyint>>>").alias("steps")).schema
    return accounts.select("user_id", "salt", "true", "m").mapInArrow(_watched(words, logins, more, seed, p_mark, p_remark, to_arrow_schema(kind)), kind)


def told(lists: DataFrame, logins: list[int], more: list[int], *keep: str) -> DataFrame:
    """The columns `keep` of watched_lists with l, delta, rank, outcome, a row for each pair of numbers."""
    per = lists.select(*keep, F.posexplode("steps").alias("i", "s")).select(*keep, F.array(*map(F.lit, logins))[F.col("i")].alias("l"), F.col("s.rank").alias("rank"), F.posexplode("s.codes").alias("j", "code"))
    return per.select(*keep, "l", F.array(*map(F.lit, more))[F.col("j")].alias("delta"), "rank", F.array(*map(F.lit, OUTCOMES))[F.col("code").cast("int")].alias("outcome"))


def watched_breach(accounts: DataFrame, ranking: DataFrame, users: DataFrame, logins: list[int], more: list[int], seed: int, p_mark: float = P_MARK, p_remark: float = P_REMARK) -> DataFrame:
    """user_id, l, delta, rank, outcome: an attacker who saw l logins of the owner logs in delta times with the best word left.

    The word lies in the marks, so these logins raise no alarm; one that renews the marks may leave
    out positions of the real password, and the owner's next login tells.
    """
    known = accounts.join(users.select("user_id"), "user_id", "left_semi")
    return told(watched_lists(known, ranking, logins, more, seed, p_mark, p_remark), logins, more, "user_id")


def best_half(first_ranks: DataFrame, trials: int, seed: int) -> DataFrame:
    """first_ranks (user_id, rank, more columns) with trial: the half of each trial's accounts with the best ranks; accounts without one come last."""
    from pyspark.sql import Window as W

    placed = first_ranks.withColumn("trial", (draw32(seed, "user_id") % trials).cast("int"))
    w = W.partitionBy("trial")
    placed = placed.withColumn("pos", F.row_number().over(w.orderBy(F.asc_nulls_last("rank"), "user_id"))).withColumn("size", F.count(F.lit(1)).over(w))
    return placed.filter(F.col("pos") <= F.greatest(F.floor(F.col("size") / 2), F.lit(1))).drop("pos", "size")


def detection_rates(attacked: DataFrame) -> DataFrame:
    """l, delta, tdp of attacked accounts (l, delta, trial, outcome): the share of trials that detect an attack."""
    per = attacked.groupBy("l", "delta", "trial").agg(F.max((F.col("outcome") == "detected").cast("int")).alias("hit"))
    return per.groupBy("l", "delta").agg(F.avg("hit").alias("tdp"))


def watched_detection(attacked: DataFrame, first_ranks: DataFrame, trials: int, seed: int) -> DataFrame:
    """l, delta, tdp: share of trials that detect an attack on the half of their accounts with the best first ranks.

    first_ranks: user_id, rank of the best word before any login was seen; accounts without one come last.
    """
    chosen = best_half(first_ranks.select("user_id", "rank"), trials, seed).select("user_id", "trial")
    return detection_rates(attacked.join(chosen, "user_id"))


def breach(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, rank, outcome of one login each: no_candidate, undetected (the real word) or detected."""
    both = candidates.withColumnRenamed("password", "guess").join(users.select("user_id", "password"), "user_id")
    out = F.when(F.col("guess").isNull(), "no_candidate").when(F.col("guess") == F.col("password"), "undetected").otherwise("detected")
    return both.select("user_id", "rank", out.alias("outcome"))


def outcome_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def detection_by_n(attacked: DataFrame, trials: int, most: int, seed: int) -> DataFrame:
    """n, tdp: share of trials in which one of the first n attacked accounts raises an alarm.

    A trial is a hash-chosen block of accounts in the order of their candidates' ranks.
    """
    from pyspark.sql import Window as W

    tried = attacked.filter("outcome <> 'no_candidate'").withColumn("trial", (draw32(seed, "user_id") % trials).cast("int"))
    placed = tried.withColumn("pos", F.row_number().over(W.partitionBy("trial").orderBy("rank", "user_id")))
    first = placed.groupBy("trial").agg(F.min(F.when(F.col("outcome") == "detected", F.col("pos"))).alias("first"))
    return first.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).groupBy("n").agg(F.avg(F.coalesce(F.col("first") <= F.col("n"), F.lit(False)).cast("int")).alias("tdp"))


def success_vs_alarm(attacked: DataFrame) -> DataFrame:
    """n, successes, alarms as accounts are tried by candidate rank."""
    from .attack import running

    ordered = attacked.filter("outcome <> 'no_candidate'").select("user_id", (F.col("outcome") == "undetected").alias("is_real"), F.struct(F.col("rank").alias("a"), F.col("user_id").alias("b")).alias("key"))
    return running(ordered).select("n", F.col("successes"), F.col("failures").alias("alarms"))


def false_detection(attempts: DataFrame, p_h: list[float]) -> DataFrame:
    """attempts (attempts: how many guesses) with p_h and fdp, the chance that so many blind guesses raise an alarm, for each p_h."""
    return attempts.withColumn("p_h", F.explode(F.array(*map(F.lit, p_h)))).withColumn("fdp", 1 - F.pow(1 - F.col("p_h"), F.col("attempts")))


def largest_safe(attempts: DataFrame, limit: float = 0.1, steps: int = 12) -> DataFrame:
    """attempts with p_h: the largest power of ten whose chance of a false alarm stays within limit; null if none of `steps` does."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.pow(F.lit(10.0), -i))
    return attempts.withColumn("p_h", F.array_max(F.filter(powers, lambda p: 1 - F.pow(1 - p, F.col("attempts")) <= limit)))


__all__ = ["register", "login", "best_candidates", "breach", "outcome_counts", "detection_by_n", "seen_marks", "watched_lists", "told", "watched_breach", "best_half", "detection_rates", "watched_detection", "success_vs_alarm", "false_detection", "largest_safe", "target_size"]
