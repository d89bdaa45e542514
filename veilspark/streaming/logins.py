"""Login streams: alarms against static accounts, windowed alarm counts, stores with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bloom import indices, salted_hash, within
from ..functions.rng import uniform
from ..operators.bernoulli import P_MARK, login


def alarms(attempts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Attempts (batch or stream: ts, user_id, word) joined to static accounts, with outcome."""
    return login(attempts, accounts)


def alarm_windows(outcomes: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, outcome, n per tumbling window (an extension); late rows beyond the watermark are dropped."""
    kind = outcomes.schema["ts"].dataType.simpleString()
    # watermarks need instants
    rows = outcomes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if outcomes.isStreaming else outcomes
    found = rows.groupBy(F.window("ts", every).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").cast(kind).alias("start"), "outcome", "n")


def sugar_store(changes: DataFrame) -> DataFrame:
    """Latest index of each user from (ts, user_id, op, idx) with op set or delete."""
    last = changes.groupBy("user_id").agg(F.max_by(F.struct("op", "idx"), "ts").alias("x"))
    return last.filter("x.op = 'set'").select("user_id", "x.idx")


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders kind=number under path, rising."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath() for x in fs.listStatus(at)]
    done = [p.getName() for p in names if p.getName().startswith(f"{kind}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def _latest(changes: DataFrame) -> DataFrame:
    return changes.groupBy("user_id").agg(F.max_by(F.struct("op", "idx", "ts"), F.struct("ts", "op", "idx")).alias("x")).select("user_id", "x.*")


def upsert_sugar(path: str, every: int = 16):
    """A foreachBatch function that keeps the latest change of each user under path.

    A batch is a folder of its own, written over when the batch comes again. Each `every`-th batch folds all before it
    into a new base, in which deleted users are gone; older folders are removed, so a read meets one base and fewer than `every`
    batches. A batch that comes again after it was folded changes nothing. Changes come in order of ts over
    batches; of equal ts the greatest (op, idx) counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bases = _folders(spark, path, "base")
        if bases and batch_id <= bases[-1]:
            return
        _latest(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            _latest(_parts(spark, path, upto=batch_id)).filter("op = 'set'").write.mode("overwrite").parquet(f"{path}/base={batch_id}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            # a reader of the base before this one may still be at work
            for name in [f"base={b}" for b in bases[:-1]] + [f"batch={b}" for b in _folders(spark, path, "batch") if bases and b <= bases[-1]]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, name), True)

    return write


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The changes of the newest base and of the batches after it."""
    bases = _folders(spark, path, "base")[-1:]
    batches = [b for b in _folders(spark, path, "batch") if (not bases or b > bases[0]) and (upto is None or b <= upto)]
    return spark.read.parquet(*(f"{path}/base={b}" for b in bases), *(f"{path}/batch={b}" for b in batches))


def read_sugar(spark: SparkSession, path: str) -> DataFrame:
    return sugar_store(_parts(spark, path))


def check_sugar(asked: DataFrame, store: DataFrame) -> DataFrame:
    """asked (user_id, idx) with outcome: success, alarm, or failure for a user that the store doesn't have."""
    held = asked.join(store.select("user_id", F.col("idx").alias("_own")), "user_id", "left")
    return held.withColumn("outcome", F.when(F.col("_own").isNull(), "failure").when(F.col("idx") == F.col("_own"), "success").otherwise("alarm")).drop("_own")


STATE = "marks array<int>"
REMARKED = f"user_id long, step long, outcome string, {STATE}"


def with_draws(attempts: DataFrame, accounts: DataFrame, p_remark: float, seed: int, p_mark: float = P_MARK) -> DataFrame:
    """user_id, step, known, inside, at, m and fresh (the marks that a success here would leave, null where none are renewed).

    attempts (batch or stream): user_id, step, word; accounts: user_id, salt, b, m. All hashing is done here, so what follows state is small.
    """
    own = accounts.select(F.col("user_id").alias("_id"), "salt", "b", "m")
    tried = attempts.select("user_id", "step", "word").join(own, F.col("user_id") == F.col("_id"), "left").withColumn("at", indices(salted_hash(F.encode("salt", "utf-8"), F.col("word"))))
    tried = tried.withColumns({"known": F.col("salt").isNotNull(), "inside": F.coalesce(within(F.col("at"), F.col("b")), F.lit(False))})
    renewed = F.filter("b", lambda i: F.array_contains("at", i) | (uniform(seed, F.col("user_id"), F.col("step"), i) < p_mark))
    fresh = F.when(F.col("inside") & (uniform(seed, F.col("user_id"), F.col("step"), F.lit("renew")) < p_remark), renewed)
    return tried.select("user_id", "step", "known", "inside", "at", "m", fresh.alias("fresh"))


def _advance(marks: frozenset[int], inside: bool, at, fresh) -> tuple[str, frozenset[int]]:
    """Outcome of a login and the marks after it."""
    if not inside:
        return "failure", marks
    if not marks.issuperset(at):
        return "alarm", marks
    return "success", marks if fresh is None else frozenset(fresh)


def _unknown(drawn: DataFrame) -> DataFrame:
    return drawn.filter("NOT known").select("user_id", "step", F.lit("failure").alias("outcome"), F.lit(None).cast("array<int>").alias("marks"))


def remarked_logins(attempts: DataFrame, accounts: DataFrame, p_remark: float, seed: int) -> DataFrame:
    """user_id, step, outcome, marks after the login, in order of step, of attempts on accounts with marks.

    A word in the filter whose positions are all marked is a success, in the filter otherwise an alarm; after a success
    each mark may be renewed: with chance p_remark the marks become those of the filter that the hash chooses, the word's own
    always among them. Unknown users and null words fail. A user's logins pass a task in order, which holds the marks
    of one user at a time and no more, however many logins there are.
    """
    drawn = with_draws(attempts, accounts, p_remark, seed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, marks = None, frozenset()
        for batch in batches:
            users, inside, at, m, fresh = (batch.column(c).to_pylist() for c in ("user_id", "inside", "at", "m", "fresh"))
            outcomes, shots = [], []
            for i, u in enumerate(users):
                if u != user:
                    user, marks = u, frozenset(m[i])
                result, marks = _advance(marks, inside[i], at[i], fresh[i])
                outcomes.append(result)
                shots.append(sorted(marks))
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("step"), pa.array(outcomes, pa.string()), pa.array(shots, pa.list_(pa.int32()))], names=["user_id", "step", "outcome", "marks"])

    known = drawn.filter("known").repartition("user_id").sortWithinPartitions("user_id", "step", "at")
    return known.select("user_id", F.col("step").cast("long").alias("step"), "inside", "at", "m", "fresh").mapInArrow(task, REMARKED).unionByName(_unknown(drawn))


def remarked_stream(attempts: DataFrame, accounts: DataFrame, p_remark: float, seed: int) -> DataFrame:
    """The rows of `remarked_logins` for a stream: a user's marks are keyed state, kept from batch to batch; logins of one batch go in order of step."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    drawn = with_draws(attempts, accounts, p_remark, seed)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("step", kind="stable")  # one trigger's logins of a user
        marks = frozenset(state.get[0]) if state.exists else frozenset(rows["m"].iloc[0])
        outcomes, shots = [], []
        for inside, at, fresh in zip(rows["inside"], rows["at"], rows["fresh"], strict=True):
            result, marks = _advance(marks, inside, at, fresh)
            outcomes.append(result)
            shots.append(sorted(int(x) for x in marks))
        state.update((sorted(int(x) for x in marks),))
        yield pd.DataFrame({"user_id": rows["user_id"].to_numpy(), "step": rows["step"].to_numpy(), "outcome": outcomes, "marks": shots})

    known = drawn.filter("known").select("user_id", F.col("step").cast("long").alias("step"), "inside", "at", "m", "fresh")
    return known.groupBy("user_id").applyInPandasWithState(run, REMARKED, STATE, "append", GroupStateTimeout.NoTimeout).unionByName(_unknown(drawn))


def stream_counts(outcomes: DataFrame) -> DataFrame:
    """Running alarms per user of a stream, with state in Spark's store."""
    schema = "user_id long, alarms long"

    def add(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            n += int((pdf["outcome"] == "alarm").sum())
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "alarms": [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return outcomes.groupBy("user_id").applyInPandasWithState(add, schema, "alarms long", "update", GroupStateTimeout.NoTimeout)
