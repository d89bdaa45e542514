"""The streaming forms give what the batch forms give."""

import pytest

from veilspark.operators import bernoulli as B
from veilspark.plans import domain
from veilspark.plans.other_queries import _attempts
from veilspark.streaming import logins


@pytest.fixture(scope="module")
def attempts(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("attempts"))
    _attempts(spark, small).repartition(2).write.mode("overwrite").parquet(path)
    return path


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_windows(spark, small, attempts):
    acc = B.register(domain.users(spark, small), 0.05, 67)
    batch = spark.read.parquet(attempts)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 10).parquet(attempts)
    want = sorted(map(tuple, logins.alarm_windows(logins.alarms(batch, acc)).collect()), key=str)
    got = sorted(map(tuple, drain(logins.alarm_windows(logins.alarms(stream, acc)), "w", "complete").collect()), key=str)
    assert got == want


def test_alarm_counts_keep_state(spark, small, attempts):
    acc = B.register(domain.users(spark, small), 0.05, 67)
    batch = logins.alarms(spark.read.parquet(attempts), acc)
    stream = logins.alarms(spark.readStream.schema(spark.read.parquet(attempts).schema).option("maxFilesPerTrigger", 1).parquet(attempts), acc)
    drain(logins.stream_counts(stream), "c", "update")
    got = {r["user_id"]: r["n"] for r in spark.sql("SELECT user_id, max(alarms) n FROM c GROUP BY 1").collect()}
    want = {r["user_id"]: r["n"] for r in batch.groupBy("user_id").agg({"*": "count"}).join(batch.filter("outcome = 'alarm'").groupBy("user_id").count().withColumnRenamed("count", "n"), "user_id", "left").fillna(0, ["n"]).select("user_id", "n").collect()}
    assert got == want


def test_sugar_store(spark, tmp_path):
    rows = [(1, 7, "set", 3), (2, 7, "set", 4), (3, 8, "set", 1), (4, 8, "delete", None)]
    df = spark.createDataFrame(rows, "ts long, user_id long, op string, idx int")
    write = logins.upsert_sugar(str(tmp_path / "s"))
    write(df.filter("ts <= 2"), 0)
    write(df.filter("ts > 2"), 1)
    assert [tuple(r) for r in logins.read_sugar(spark, str(tmp_path / "s")).collect()] == [(7, 4)]


def test_replayed_batches_change_nothing(spark, tmp_path):
    path, write = str(tmp_path / "s"), logins.upsert_sugar(str(tmp_path / "s"), every=3)
    rows = [(t, t % 4, "delete" if t % 5 == 4 else "set", t) for t in range(16)]
    df = spark.createDataFrame(rows, "ts long, user_id long, op string, idx int")
    for b in range(8):
        write(df.filter(f"ts DIV 2 = {b}"), b)
        if b in (2, 4, 5):
            write(df.filter(f"ts DIV 2 = {b}"), b)  # again, before and after it was folded
        want = sorted(tuple(r) for r in logins.sugar_store(df.filter(f"ts < {2 * b + 2}")).collect())
        assert sorted(tuple(r) for r in logins.read_sugar(spark, path).collect()) == want
    write(df.filter("ts DIV 2 = 1"), 1)
    assert sorted(tuple(r) for r in logins.read_sugar(spark, path).collect()) == want
    assert len(logins._folders(spark, path, "batch")) <= 6 and len(logins._folders(spark, path, "base")) <= 2
    asked = spark.createDataFrame([(u, i) for u, i in want] + [(u, i + 1) for u, i in want] + [(99, 1)], "user_id long, idx int")
    assert sorted(r["outcome"] for r in logins.check_sugar(asked, logins.read_sugar(spark, path)).collect()) == sorted(["success", "alarm"] * len(want) + ["failure"])


def test_marks_are_kept_from_batch_to_batch(spark, small, tmp_path):
    acc = B.register(domain.users(spark, small), 0.05, 67, p_mark=0.95)
    tried = _attempts(spark, small).withColumnRenamed("event_id", "step").select("user_id", "step", "word").filter("step < 600")
    # a user with many logins, so that marks are renewed again and again
    one = domain.users(spark, small).filter("user_id = 7").crossJoin(spark.range(1000, 1060)).select("user_id", "id", "password").selectExpr("user_id", "id AS step", "password AS word")
    rows = tried.unionByName(one)
    for i in range(3):
        rows.filter(f"step % 1000 >= {i * 200} AND step % 1000 < {i * 200 + 200}" if i else "step % 1000 < 200").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        (tmp_path / f"in/{i}").rename(tmp_path / f"in{i}")
    import os
    import shutil
    import time

    (tmp_path / "all").mkdir()
    for i in range(3):
        for x in (tmp_path / f"in{i}").glob("*.parquet"):
            shutil.copy(x, tmp_path / "all" / f"{i}.parquet")
            os.utime(tmp_path / "all" / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    schema = rows.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    got = drain(logins.remarked_stream(stream, acc, 0.3, 67), "marks_kept", "append").collect()
    want = logins.remarked_logins(rows, acc, 0.3, 67).collect()
    a, b = sorted(map(tuple, got), key=repr), sorted(map(tuple, want), key=repr)
    own = [r for r in b if r[0] != 7]
    assert [r for r in a if r[0] != 7] == own and len(a) == len(b)
    assert {r[2] for r in b} == {"failure", "success"} | ({"alarm"} if any(r[2] == "alarm" for r in b) else set())
    assert any(r[0] == -1 and r[2] == "failure" and r[3] is None for r in b)
    assert len({tuple(r[3]) for r in a if r[0] == 7}) > 3
