"""Keyed state: intake, versioned schedules and totals that count an attempt once."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import reviews as R
from gradeloom.streaming import state as S


@pytest.fixture(autouse=True)
def store(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", parts)


class Files:
    """A folder of batches that a stream reads one at a time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, rows):
        self.n += 1
        df = self.spark.createDataFrame(rows, self.schema)
        if "created_at" in df.columns:
            df = df.withColumn("created_at", F.col("created_at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(self.folder)
        self.read_schema = df.schema

    def stream(self):
        return self.spark.readStream.schema(self.read_schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def run(df, mode, tmp_path, name, sink=None):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", str(tmp_path / f"out_{name}"))
    q = writer.start()
    assert q.awaitTermination(400)
    assert q.exception() is None
    return q


def states(q):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]


def test_intake_tells_replays_from_conflicts_and_forgets(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "student_id long, submission_id long, review_id long, payload string, created_at string")
    files.add([(1, 1, 1, "a", "2024-01-01 00:00:00"), (1, 1, 2, "a", "2024-01-01 00:00:01"), (1, 2, 3, None, "2024-01-01 00:00:02")])
    files.add([(1, 1, 4, "b", "2024-01-02 00:00:00"), (1, 2, 5, "", "2024-01-02 00:00:00"), (2, 1, 6, "b", "2024-01-02 00:00:00")])
    for day in range(1, 12):
        files.add([(9, 100 * day + i, 1_000 * day + i, "x", f"2024-03-{2 * day:02d} 00:00:00") for i in range(20)])
    files.add([(1, 1, 99_999, "b", "2024-03-30 00:00:00")])
    q = run(S.intake(files.stream(), keep_days=3, late="1 hour"), "append", tmp_path, "intake")
    got = {r["review_id"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out_intake")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 6)} == {1: "accepted", 2: "replay", 3: "accepted", 4: "conflict", 5: "replay", 6: "accepted"}
    assert got[99_999] == "accepted" and len(got) == 227  # the id was forgotten by then
    rows = states(q)
    # two or three days of ids at once, not all eleven: the state doesn't grow with the ids that ever came
    assert max(rows) < 6 * 20 * 3 and rows[-1] <= max(rows)


def test_schedules_reject_stale_versions_whatever_their_time(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "student_id long, card_id long, review_id long, rating int, expected_version long, created_at string")
    files.add([(1, 1, 1, 3, 0, "2024-01-01 08:00:00"), (1, 1, 2, 3, 0, "2024-01-01 08:30:00"), (1, 1, 3, 3, 1, "2024-01-01 09:00:00")])
    files.add([(1, 1, 4, 1, 1, "2024-01-09 08:00:00"), (1, 1, 5, 1, 2, "2024-01-05 08:00:00"), (1, 1, 6, 3, None, "2024-01-10 08:00:00"), (2, 1, 7, 3, 4, "2024-01-10 08:00:00")])
    files.add([(1, 1, 8 + i, 1, 3 + i, f"2024-01-{11 + i} 08:00:00") for i in range(3)])
    run(S.versioned_schedules(files.stream()), "append", tmp_path, "v")
    rows = {r["review_id"]: r for r in spark.read.parquet(str(tmp_path / "out_v")).collect()}
    assert {k: (r["verdict"], r["version"]) for k, r in rows.items()} == {1: ("applied", 1), 2: ("stale", 1), 3: ("applied", 2), 4: ("stale", 3), 5: ("applied", 3), 6: ("stale", 3), 7: ("stale", 0), 8: ("applied", 4), 9: ("applied", 5), 10: ("applied", 6)}
    assert rows[9]["status"] != "leech" and rows[10]["status"] == "leech" and rows[7]["stability"] is None


def test_applied_reviews_give_the_schedules_of_a_replay(spark, tmp_path):
    rng = random.Random(1)
    names = "student_id long, card_id long, review_id long, rating int, expected_version long, created_at string"
    files, log, version = Files(spark, tmp_path / "in", names), [], {}
    for batch in range(3):
        rows = []
        for i in range(60):
            key = (rng.randrange(5), rng.randrange(4))
            at = f"2024-0{batch + 1}-{1 + i // 3:02d} {i % 24:02d}:00:00"
            row = (*key, 100 * batch + i, rng.randrange(1, 5), version.get(key, 0), at)
            rows.append(row)
            version[key] = version.get(key, 0) + 1
            if rng.random() < 0.2:
                rows.append((*key, 10_000 + 100 * batch + i, 1, row[4], f"2024-0{batch + 1}-28 23:00:00"))  # sent again with the version it had
            log.append((*row[:4], "study", at))
        files.add(rows)
    run(S.versioned_schedules(files.stream()), "append", tmp_path, "r")
    out = spark.read.parquet(str(tmp_path / "out_r")).filter("verdict = 'applied'")
    columns = ["student_id", "card_id", "reps", "lapses", "state", "last_at", F.round("stability", 9).alias("s")]
    last = out.groupBy("student_id", "card_id").agg(F.max_by(F.struct("reps", "lapses", "state", "last_at", "stability"), "version").alias("x")).select("student_id", "card_id", "x.*")
    want = R.fsrs_replay(spark.createDataFrame(log, "student_id long, card_id long, review_id long, rating int, mode string, created_at string"))
    assert sorted(map(tuple, last.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_idle_schedules_are_archived(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "student_id long, card_id long, review_id long, rating int, expected_version long, created_at string")
    files.add([(1, 1, 1, 3, 0, "2024-01-01 00:00:00")])
    files.add([(2, 1, 2, 3, 0, "2024-03-01 00:00:00")])
    files.add([(2, 1, 3, 3, 1, "2024-03-02 00:00:00")])
    files.add([(1, 1, 4, 3, 1, "2024-03-03 00:00:00")])
    run(S.versioned_schedules(files.stream(), idle_days=20, late="1 hour"), "append", tmp_path, "idle")
    got = sorted((r["student_id"], r["verdict"], r["version"]) for r in spark.read.parquet(str(tmp_path / "out_idle")).collect())
    assert got == [(1, "applied", 1), (1, "archived", 1), (1, "stale", 0), (2, "applied", 1), (2, "applied", 2)]


def test_totals_count_an_attempt_once_and_survive_lost_folders(spark, tmp_path):
    rng = random.Random(2)
    schema = "topic string, attempt_id long, created_at string, points long, right long"
    rows = [(rng.choice("abc"), i, f"2024-01-{1 + i // 5:02d} 00:00:00", rng.randrange(10), rng.randrange(2)) for i in range(90)]
    files = Files(spark, tmp_path / "in", schema)
    for k in range(0, 90, 30):
        files.add(rows[k : k + 30] + rows[max(0, k - 10) : k])  # the last ten come again
    changed = S.attempt_totals(files.stream(), ["topic"], ["points", "right"], keep_days=4)
    path, batches = str(tmp_path / "totals"), []
    sink = S.totals_sink(path)

    def keep(df, batch_id):
        sink(df, batch_id)
        batches.append(batch_id)

    q = run(changed, "update", tmp_path, "t", keep)
    assert states(q)[-1] < 3 * 90  # attempts go once their days are over
    again = spark.read.parquet(f"{path}/batch={batches[1]}")
    sink(spark.createDataFrame(again.collect(), again.schema), batches[1])  # a batch that is tried again
    columns = ["topic", "attempts", "points", "right"]
    twin = spark.createDataFrame(rows, schema).groupBy("topic").agg(F.count("*").alias("attempts"), F.sum("points").alias("points"), F.sum("right").alias("right"))
    want = sorted(map(tuple, twin.select(columns).collect()))
    assert sorted(map(tuple, S.written_totals(spark, path, ["topic"]).select(columns).collect())) == want
    shutil.rmtree(f"{path}/batch={batches[0]}")
    assert sorted(map(tuple, S.stored_totals(spark, str(tmp_path / "c_t")).select(columns).collect())) == want
    assert len(batches) >= 3
