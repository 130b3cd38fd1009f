"""Streams equal their batch twins."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import reviews as R
from gradeloom.plans.adapters import Views
from gradeloom.streaming import logs as L


def drain(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def log(spark, sf, tmp_path):
    batch = Views(spark, sf).reviews.withColumn("created_at", F.col("created_at").cast("timestamp"))
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    return batch, lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def keyed(df):
    return sorted(map(tuple, df.collect()))


def test_daily_activity(log, tmp_path):
    batch, stream = log
    got = drain(L.daily_activity(stream()), "complete", "daily", tmp_path)
    assert keyed(got) == keyed(R.daily_activity(batch))


def test_once_drops_replays(log, tmp_path):
    batch, stream = log
    twice = stream().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    got = drain(L.once(twice, ["student_id", "review_id"], "60 days"), "append", "once", tmp_path)
    assert got.count() == batch.count()


def test_conflicts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "a"), (1, 1, 3, "b"), (1, 2, 4, "c")], "student_id long, submission_id long, review_id long, payload string")
    rows.write.parquet(str(tmp_path / "s"))
    got = drain(L.conflicts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))), "append", "conflicts", tmp_path)
    assert {r["review_id"]: r["verdict"] for r in got.collect()} == {1: "accepted", 2: "replay", 3: "conflict", 4: "accepted"}


def test_schedules(log, tmp_path):
    batch, stream = log
    cols = ["student_id", "card_id", "reps", "lapses", "state", "last_at"]
    got = drain(L.schedules(stream()), "update", "schedules", tmp_path).select(*cols, F.round("stability", 9).alias("s"))
    assert keyed(got) == keyed(R.fsrs_replay(batch).select(*cols, F.round("stability", 9).alias("s")))


def test_merge_totals(spark, tmp_path):
    sink = L.merge_totals(str(tmp_path / "totals"), ["k"])
    a = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "k long, n long")
    sink(a, 0)
    sink(a, 1)
    sink(a, 1)  # a retry
    assert keyed(spark.read.parquet(str(tmp_path / "totals/v1"))) == [(1, 10), (2, 2)]


def test_new_documents(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(3):
        (tmp_path / "docs" / f"{k}.txt").write_text(f"text {k}\nmore")
    got = drain(L.new_documents(spark, str(tmp_path / "docs"), 1), "append", "docs", tmp_path)
    assert {r["text"] for r in got.collect()} == {f"text {k}\nmore" for k in range(3)}


def test_sessions_and_latencies(spark, sf, tmp_path):
    events = Views(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    assert keyed(drain(L.sessions(stream()), "complete", "sessions", tmp_path)) == keyed(L.sessions(events))
    (tmp_path / "x").mkdir()
    assert keyed(drain(L.latencies(stream(), "1 day", "12 hours"), "complete", "lat", tmp_path / "x")) == keyed(L.latencies(events, "1 day", "12 hours"))
