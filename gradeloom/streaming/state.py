"""Keyed state of the intake: submissions, versioned schedules and rollups that count an attempt once.

Each operator is one ``transformWithStateInPandas``: a batch touches the state of its own keys only, and what is kept has an end, by a timer in
event time or a time to live. State needs the RocksDB store: set ``spark.sql.streaming.stateStore.providerClass`` to ``STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeloom.functions.relational import latest_by
from gradeloom.operators.reviews import FSRS_STATE, _fsrs_step

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _milliseconds(at: pd.Series) -> list[int]:
    return (at.astype("datetime64[ms]").astype("int64")).tolist()


class _Expiring(StatefulProcessor):
    """State of a key that one event-time timer clears, ``keep`` after the key's latest row."""

    schema: str
    keep_ms: int | None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", f"{self.schema}, expires long")

    def load(self) -> tuple | None:
        return tuple(self.state.get()[:-1]) if self.state.exists() else None

    def save(self, value: tuple, at_ms: int) -> None:
        was = self.state.get()[-1] if self.state.exists() else None
        expires = None if self.keep_ms is None else max(at_ms + self.keep_ms, was or 0)
        if expires != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(expires)
        self.state.update((*value, expires))

    def last_words(self, key: Any, value: tuple) -> Iterator[pd.DataFrame]:
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self.last_words(key, self.load())
            self.state.clear()


class _Intake(_Expiring):
    schema = "payload string"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["created_at", "review_id"])
        known, verdicts = self.load(), []
        for payload in batch["payload"]:
            verdicts.append("accepted" if known is None else "replay" if known == (payload,) else "conflict")
            known = known or (payload,)
        self.save(known, max(_milliseconds(batch["created_at"])))
        yield pd.DataFrame({"student_id": key[0], "submission_id": key[1], "review_id": batch["review_id"].to_numpy(), "verdict": verdicts})


def intake(submissions: DataFrame, keep_days: float = 30, late: str = "2 days") -> DataFrame:
    """Each submission's verdict: ``accepted`` the first time its id comes, then ``replay`` with the same payload and ``conflict`` with another.

    ``submissions``: student_id, submission_id, review_id, payload, created_at. An id is forgotten ``keep_days`` after it last came, by event time.
    """
    rows = submissions.select("student_id", "submission_id", "review_id", F.coalesce("payload", F.lit("")).alias("payload"), "created_at").withWatermark("created_at", late)
    out = "student_id long, submission_id long, review_id long, verdict string"
    return rows.groupBy("student_id", "submission_id").transformWithStateInPandas(_Intake(int(keep_days * DAY_MS)), out, "append", "eventTime")


_SCHEDULE = [f.split()[0] for f in FSRS_STATE.split(", ")]
_STATUS = {0: "new", 1: "learning", 2: "review", 3: "learning"}
_VERSIONED = f"student_id long, card_id long, review_id long, verdict string, version long, status string, {FSRS_STATE}"


class _Schedules(_Expiring):
    schema = f"version long, again long, {FSRS_STATE}"

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["created_at", "review_id"])
        known, out = self.load(), []
        for review, rating, expected, at in zip(batch["review_id"], batch["rating"], batch["expected_version"], _milliseconds(batch["created_at"])):
            version, again, *state = known or (0, 0)
            if pd.isna(expected) or int(expected) != version:
                out.append(self._row(key, int(review), "stale", known))
                continue
            at //= 1_000
            days = max(0, at // 86_400 - state[-1] // 86_400) if state else 0
            state = (*_fsrs_step(tuple(state[:-1]) if state else None, int(rating), days), at)
            known = (version + 1, again + (int(rating) == 1), *_plain(state))
            out.append(self._row(key, int(review), "applied", known))
        if known:
            self.save(known, max(_milliseconds(batch["created_at"])))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _VERSIONED.split(", ")])

    def _row(self, key: Any, review: int | None, verdict: str, known: tuple | None) -> tuple:
        version, again, *state = known or (0, 0, *[None] * len(_SCHEDULE))
        status = "leech" if again >= 4 else _STATUS[state[2] or 0]
        return (key[0], key[1], review, verdict, version, status, *state)

    def last_words(self, key: Any, value: tuple) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([self._row(key, None, "archived", value)], columns=[f.split()[0] for f in _VERSIONED.split(", ")])


def _plain(state: tuple) -> tuple:
    kinds = [f.split()[1] for f in FSRS_STATE.split(", ")]
    return tuple(float(x) if kind == "double" else int(x) for x, kind in zip(state, kinds))


def versioned_schedules(reviews: DataFrame, idle_days: float | None = None, late: str = "2 days") -> DataFrame:
    """The FSRS-6 state of each student and card, changed by compare-and-set: a review counts if its ``expected_version`` is the state's version.

    An ``applied`` review raises the version by one; any other is ``stale`` and changes nothing, whatever its time. Four lapses make a card a
    ``leech``. ``reviews``: student_id, card_id, review_id, rating, expected_version, created_at. A schedule lasts as long as its card, unless
    ``idle_days`` is given: then one that had no review for so long, by event time, is handed on as ``archived`` and dropped.
    """
    rows = reviews.select("student_id", "card_id", "review_id", "rating", "expected_version", "created_at").withWatermark("created_at", late)
    processor = _Schedules(None if idle_days is None else int(idle_days * DAY_MS))
    return rows.groupBy("student_id", "card_id").transformWithStateInPandas(processor, _VERSIONED, "append", "eventTime")


class _Totals(StatefulProcessor):
    def __init__(self, keys: list[str], sums: list[str], keep_ms: int):
        self.keys, self.sums, self.keep_ms = keys, sums, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("attempts", "attempt_id long", "at long")
        self.total = handle.getValueState("total", ", ".join(f"{c} long" for c in ("version", "attempts", *self.sums)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        total, replays, days = list(self.total.get()) if self.total.exists() else [0] * (2 + len(self.sums)), 0, set()
        points = zip(*[batch[c].fillna(0).astype("int64").tolist() for c in self.sums])
        for attempt, at, own in zip(batch["attempt_id"].tolist(), _milliseconds(batch["created_at"]), points):
            if self.seen.containsKey((attempt,)):
                replays += 1
                continue
            self.seen.updateValue((attempt,), (at,))
            days.add(at // DAY_MS)
            total[1:] = [x + y for x, y in zip(total[1:], (1, *own))]
        for day in days:
            self.handle.registerTimer((day + 1) * DAY_MS + self.keep_ms)
        total[0] += 1
        self.total.update(tuple(total))
        yield pd.DataFrame([(*key, *total, replays)], columns=[*self.keys, "version", "attempts", *self.sums, "replays"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        gone = expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms
        for attempt in [a for a, (at,) in self.seen.iterator() if at < gone]:
            self.seen.removeKey(attempt)
        yield from ()


def attempt_totals(submissions: DataFrame, keys: list[str], sums: list[str], keep_days: float = 90, late: str = "2 days") -> DataFrame:
    """Totals of ``sums`` for each value of ``keys``, of which every attempt counts once, however often and in whatever batch it comes.

    ``submissions``: keys, attempt_id, created_at, sums (whole numbers), one row for each attempt and key. Each batch gives the new totals of its own
    keys, with a ``version`` that rises by one, so a sink may write a batch again. Attempts are remembered for ``keep_days`` after the day
    they were made, by event time; rows later than ``late`` are dropped, so with ``keep_days`` beyond that none counts twice. The totals stay.
    """
    rows = submissions.select(*keys, F.col("attempt_id").cast("long").alias("attempt_id"), "created_at", *[F.col(c).cast("long").alias(c) for c in sums]).withWatermark("created_at", late)
    fields = [T.StructField(c, rows.schema[c].dataType) for c in keys] + [T.StructField(c, T.LongType()) for c in ("version", "attempts", *sums, "replays")]
    return rows.groupBy(*keys).transformWithStateInPandas(_Totals(keys, sums, int(keep_days * DAY_MS)), T.StructType(fields), "update", "eventTime")


def totals_sink(path: str):
    """A ``foreachBatch`` sink of versioned totals: a batch writes its own folder only, again when it is retried, so its cost is the batch's."""

    def sink(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def written_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest totals of each key that a ``totals_sink`` wrote, whatever was written twice."""
    return latest_by(spark.read.parquet(path).drop("batch", "replays"), keys, ["version"])


def stored_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The totals as the query's state has them, from its checkpoint: whole even where folders of the sink were lost."""
    state = spark.read.format("statestore").option("stateVarName", "total").load(checkpoint)
    return state.select("key.*", "value.*")
