"""Streaming forms of the log operators. Each equals its batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.functions.relational import upsert_sum


def daily_activity(reviews: DataFrame, late: str = "2 days") -> DataFrame:
    """Reviews and correct ones by student and tumbling day of ``created_at``."""
    days = reviews.withWatermark("created_at", late).groupBy("student_id", F.window("created_at", "1 day").alias("w"))
    return days.agg(F.count("*").alias("reviews"), F.count_if(F.col("rating") >= 3).alias("correct")).select("student_id", F.to_date("w.start").alias("reviewed_on"), "reviews", "correct")


def once(submissions: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Drop replays of the same submission within the watermark."""
    return submissions.withWatermark("created_at", late).dropDuplicatesWithinWatermark(keys)


def conflicts(submissions: DataFrame) -> DataFrame:
    """Mark a submission id that comes again: ``replay`` with the same payload, ``conflict`` with another."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        for rows in frames:
            out = []
            for r in rows.sort_values("review_id").itertuples(index=False):
                out.append("accepted" if first is None else "replay" if r.payload == first else "conflict")
                first = r.payload if first is None else first
            state.update((first,))
            yield pd.DataFrame({"student_id": key[0], "submission_id": key[1], "review_id": rows.sort_values("review_id")["review_id"].to_numpy(), "verdict": out})

    return submissions.groupBy("student_id", "submission_id").applyInPandasWithState(step, "student_id long, submission_id long, review_id long, verdict string", "first string", "append", GroupStateTimeout.NoTimeout)


def schedules(reviews: DataFrame) -> DataFrame:
    """The FSRS-6 state of each student and card after each batch; a review older than the state is stale and changes nothing."""
    from gradeloom.operators.reviews import FSRS_STATE, _fsrs_step

    names = [c.split()[0] for c in FSRS_STATE.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "review_id"])
        *s, last = state.get if state.exists else (None, None)
        s, stale = tuple(s) if state.exists else None, 0
        for rating, at in zip(rows["rating"].to_numpy(), rows["at"].to_numpy()):
            if last is not None and at < last:
                stale += 1
                continue
            s = _fsrs_step(s, int(rating), 0 if last is None else int(at) // 86_400 - last // 86_400)
            last = int(at)
        state.update((*s, last))
        yield pd.DataFrame({"student_id": [key[0]], "card_id": [key[1]]} | {c: [x] for c, x in zip(names, (*s, last))} | {"stale": [stale]})

    study = reviews.filter("mode = 'study'").select("student_id", "card_id", "review_id", "rating", F.unix_timestamp("created_at").alias("at"))
    return study.groupBy("student_id", "card_id").applyInPandasWithState(step, f"student_id long, card_id long, {FSRS_STATE}, stale int", FSRS_STATE, "update", GroupStateTimeout.NoTimeout)


def merge_totals(path: str, keys: list[str]):
    """A ``foreachBatch`` sink that adds each batch's totals to a table, once for each batch id.

    Versions are folders named by batch id; a batch that is retried writes its own version again from the one before it.
    """

    def sink(delta: DataFrame, batch_id: int) -> None:
        spark = delta.sparkSession
        sums = delta.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in delta.columns if c not in keys])
        if batch_id > 0:
            sums = upsert_sum(spark.read.parquet(f"{path}/v{batch_id - 1}"), sums, keys)
        sums.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return sink


def new_documents(spark, path: str, most_files: int = 100) -> DataFrame:
    """Whole text files as they arrive, with their name; give it to the page operators."""
    return spark.readStream.option("maxFilesPerTrigger", most_files).text(path, wholetext=True).select(F.input_file_name().alias("import_id"), F.col("value").alias("text"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of a user: events with gaps below ``gap``."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "events")


def latencies(events: DataFrame, width: str = "10 minutes", step: str = "1 minute", late: str = "2 days") -> DataFrame:
    """Sliding samples, errors and approximate percentiles of a value by action."""
    out = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("samples"), F.count_if(F.col("event_type") == "error").alias("errors"), F.percentile_approx("value", [0.5, 0.95, 0.99], 100_000).alias("p"), F.max("value").alias("max"))
    return out.select("event_type", F.unix_timestamp("w.start").alias("start"), "samples", "errors", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "max")
