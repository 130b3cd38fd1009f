"""Spaced-repetition analytics over whole review logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.expressions import next_interval, retrievability
from gradeloom.functions.folds import folded
from gradeloom.functions.relational import asof_forward, half_up, islands

#: The 21 default weights of the published FSRS-6 model, the retention asked for, and the (re)learning steps in minutes.
FSRS_WEIGHTS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
RETENTION, MOST_DAYS = 0.95, 36_500
LEARNING_STEPS, RELEARNING_STEPS = (1, 10), (10,)


def daily_activity(reviews: DataFrame, since: Column | None = None) -> DataFrame:
    """Reviews and correct ones (rating 3 or 4) of a student and day."""
    rows = reviews.filter(F.col("reviewed_on") >= since) if since is not None else reviews
    return rows.groupBy("student_id", "reviewed_on").agg(F.count("*").alias("reviews"), F.count_if(F.col("rating") >= 3).alias("correct"))


def streaks(days: DataFrame, today: Column) -> DataFrame:
    """The run of consecutive days that ends today or yesterday, and the best one, from distinct (student_id, day)."""
    numbered = days.select("student_id", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d")).distinct()
    runs = islands(numbered, ["student_id"], "d").groupBy("student_id", "island").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    now = F.datediff(today, F.lit("1970-01-01").cast("date"))
    return runs.groupBy("student_id").agg(F.max(F.when(F.col("last").between(now - 1, now), F.col("n")).otherwise(0)).alias("current_streak"), F.max("n").alias("best_streak"))


def sm2_fold(reviews: DataFrame) -> DataFrame:
    """The SM-2-style schedule of every student and card: a fold over its study reviews in order of time, then id.

    A rating of 1 resets the repetitions, counts a lapse and takes 0.20 from the ease; 2 takes 0.15 and grows the interval by 1.2; 3 keeps the
    ease; 4 adds 0.15 and grows by a further 1.3. Ease stays at 1.30 or more; four lapses make a leech. Intervals are whole days.
    """
    log = F.array_sort(F.collect_list(F.struct("created_at", "review_id", "rating")))  # one card's history
    start = F.struct(F.lit(250).alias("ease"), F.lit(0).alias("days"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"))

    def step(s: Column, r: Column) -> Column:
        rating = r["rating"]
        ease = F.greatest(s["ease"] + F.when(rating == 1, -20).when(rating == 2, -15).when(rating == 4, 15).otherwise(0), F.lit(130))
        reps = F.when(rating == 1, F.lit(0)).otherwise(s["reps"] + 1)
        grown = F.when(rating == 2, F.floor((s["days"] * 12 + 5) / 10)).when(rating == 4, F.floor((s["days"] * ease * 13 + 500) / 1000)).otherwise(F.floor((s["days"] * ease + 50) / 100)).cast("int")
        days = F.when(rating == 1, F.lit(0)).when(reps == 1, F.when(rating == 4, F.lit(4)).otherwise(F.lit(1))).when(reps == 2, F.when(rating == 4, F.lit(8)).otherwise(F.lit(6))).otherwise(F.greatest(grown, s["days"] + 1))
        return F.struct(ease.alias("ease"), F.least(days, F.lit(MOST_DAYS)).cast("int").alias("days"), reps.cast("int").alias("reps"), (s["lapses"] + (rating == 1).cast("int")).alias("lapses"))

    out = reviews.filter("mode = 'study'").groupBy("student_id", "card_id").agg(log.alias("log"))
    out = out.withColumn("s", F.aggregate("log", start, step)).withColumn("last", F.element_at("log", -1))
    due = F.date_add(F.to_date("last.created_at"), F.col("s.days"))
    status = F.when(F.col("s.lapses") >= 4, "leech").when(F.col("s.reps") == 0, "relearning").when(F.col("s.days") < 21, "young").otherwise("mature")
    return out.select("student_id", "card_id", F.size("log").alias("reviews"), F.col("s.ease").alias("ease"), F.col("s.days").alias("interval_days"), F.col("s.reps").alias("reps"), F.col("s.lapses").alias("lapses"), due.alias("due_on"), status.alias("status"))


def _interval(stability: float) -> int:
    factor = 0.9 ** (-1 / FSRS_WEIGHTS[20]) - 1
    return int(min(max(np.floor(stability / factor * (RETENTION ** (-1 / FSRS_WEIGHTS[20]) - 1) + 0.5), 1), MOST_DAYS))


def _next_stability(s: float, d: float, rating: int, days: int) -> float:
    """Stability after a review, ``days`` whole days after the last one."""
    w = FSRS_WEIGHTS
    r = (1 + (0.9 ** (-1 / w[20]) - 1) * days / s) ** -w[20]
    if days == 0:
        grow = np.exp(w[17] * (rating - 3 + w[18])) * s ** -w[19]
        new = s * (max(grow, 1.0) if rating >= 3 else grow)
    elif rating == 1:
        new = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * np.exp(w[14] * (1 - r)), s / np.exp(w[17] * w[18]))
    else:
        new = s * (1 + np.exp(w[8]) * (11 - d) * s ** -w[9] * (np.exp(w[10] * (1 - r)) - 1) * (w[15] if rating == 2 else 1) * (w[16] if rating == 4 else 1))
    return float(min(max(new, 0.001), MOST_DAYS))


def _step_minutes(kind: int, step: int, rating: int) -> tuple[int, int]:
    """Minutes to the next showing inside (re)learning and the step that it is; no minutes: the card leaves for review."""
    steps = LEARNING_STEPS if kind == 1 else RELEARNING_STEPS
    if rating == 1:
        return steps[0], 0
    if rating == 2:
        return (steps[0] + steps[1] + 1) // 2 if len(steps) > 1 else (steps[0] * 3 + 1) // 2, step
    return (steps[step + 1], step + 1) if rating == 3 and step + 1 < len(steps) else (0, 0)


def _fsrs_step(state: tuple[float, float, int, int, int, int, int] | None, rating: int, days: int) -> tuple[float, float, int, int, int, int, int]:
    """One FSRS-6 review: stability, difficulty, state (1 learning, 2 review, 3 relearning), repetitions, lapses, step, minutes until it is due.

    ``days`` are whole days of the calendar in UTC since the last review. A new card enters the learning steps of 1 and 10 minutes, a forgotten
    one the relearning step of 10; the intervals of one review keep Hard <= Good < Easy.
    """
    w = FSRS_WEIGHTS
    start = lambda g: w[4] - np.exp(w[5] * (g - 1)) + 1
    if state is None:
        s, d, kind, reps, lapses, step = w[rating - 1], float(min(max(start(rating), 1), 10)), 1, 0, 0, 0
        options = {}
    else:
        before, hard_was, kind, reps, lapses, step, _ = state
        asked = {rating, 2, 3, 4} if kind == 2 and rating > 1 else {rating}
        options = {g: _next_stability(before, hard_was, g, days) for g in asked}
        s, moved = options[rating], hard_was - w[6] * (rating - 3) * (10 - hard_was) / 9
        d = float(min(max(w[7] * start(4) + (1 - w[7]) * moved, 1), 10))
    if kind == 2 and rating > 1:
        good = _interval(options[3])
        hard = min(_interval(options[2]), good)
        good = max(good, hard + 1)
        return s, d, 2, reps + 1, lapses, 0, 1_440 * {2: hard, 3: good, 4: max(_interval(options[4]), good + 1)}[rating]
    if kind == 2:
        return s, d, 3, reps + 1, lapses + 1, 0, RELEARNING_STEPS[0]
    minutes, step = _step_minutes(kind, step, rating)
    return (s, d, kind, reps + 1, lapses, step, minutes) if minutes else (s, d, 2, reps + 1, lapses, 0, 1_440 * _interval(s))


FSRS_STATE = "stability double, difficulty double, state int, reps int, lapses int, step int, minutes long, last_at long"


def fsrs_replay(reviews: DataFrame) -> DataFrame:
    """The FSRS-6 schedule of every student and card, by replay of its study reviews in order of time, then id.

    Cards are walked along sorted partitions (``folded``). Input order doesn't matter.
    """

    def step(state: tuple | None, rating: int, at: int) -> tuple:
        last = None if state is None else state[1]
        return _fsrs_step(state and state[0], int(rating), 0 if last is None else max(0, at // 86_400 - last // 86_400)), at

    study = reviews.filter("mode = 'study'").select(F.col("student_id").cast("long").alias("student_id"), F.col("card_id").cast("long").alias("card_id"), "review_id", "rating", F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("at"))
    finish = lambda state: (*[float(x) for x in state[0][:2]], *state[0][2:], state[1])
    out = folded(study, ["student_id", "card_id"], [F.col("at"), F.col("review_id"), F.col("rating")], ["rating", "at"], step, finish, f"student_id long, card_id long, {FSRS_STATE}")
    return out.withColumn("due_at", F.timestamp_seconds(F.col("last_at") + F.col("minutes") * 60))


def rating_previews(schedule: DataFrame, now: Column) -> DataFrame:
    """Recall at ``now`` and what each rating would give every card that is due: its next state, minutes until due and whole days.

    Cards in (re)learning follow their steps, cards in review the order Hard <= Good < Easy, as a review itself does.
    """
    w, s, d = FSRS_WEIGHTS, F.col("stability"), F.col("difficulty")
    days = F.greatest(F.floor(F.unix_timestamp(now) / 86_400) - F.floor(F.col("last_at") / 86_400), F.lit(0))
    recall = retrievability(F.col("days"), s, w[20])
    due = schedule.filter(F.col("due_at") <= now).withColumn("days", days).withColumn("recall", recall)
    left = F.exp(w[10] * (1 - F.col("recall"))) - 1
    forget = F.least(w[11] * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp(w[14] * (1 - F.col("recall"))), s / F.exp(F.lit(w[17] * w[18])))

    def after(rating: int) -> Column:
        short = F.exp(F.lit(w[17] * (rating - 3 + w[18]))) * F.pow(s, F.lit(-w[19]))
        grown = 1 + F.exp(F.lit(w[8])) * (11 - d) * F.pow(s, F.lit(-w[9])) * left * (w[15] if rating == 2 else w[16] if rating == 4 else 1.0)
        new = F.when(F.col("days") == 0, s * (F.greatest(short, F.lit(1.0)) if rating >= 3 else short)).otherwise(forget if rating == 1 else s * grown)
        return next_interval(F.least(F.greatest(new, F.lit(0.001)), F.lit(float(MOST_DAYS))), RETENTION)

    due = due.select("student_id", "card_id", "recall", "state", "step", *[after(g).alias(f"i{g}") for g in (1, 2, 3, 4)])
    hard = F.least("i2", "i3")
    good = F.greatest(F.col("i3"), hard + 1)
    ordered = {1: F.lit(None).cast("long"), 2: hard, 3: good, 4: F.greatest(F.col("i4"), good + 1)}

    def option(rating: int) -> Column:
        kept, steps = F.lit(0), {1: len(LEARNING_STEPS), 3: len(RELEARNING_STEPS)}
        for kind, n in steps.items():
            for step in range(n):
                kept = F.when((F.col("state") == kind) & (F.col("step") == step), F.lit(_step_minutes(kind, step, rating)[0])).otherwise(kept)
        review = F.col("state") == 2
        minutes = F.when(review & F.lit(rating == 1), F.lit(RELEARNING_STEPS[0])).otherwise(kept)
        whole = F.when(minutes > 0, F.lit(0)).when(review, ordered[rating]).otherwise(F.col(f"i{rating}")).cast("long")
        kind = F.when(minutes == 0, F.lit(2)).when(review, F.lit(3)).otherwise(F.col("state"))
        return F.struct(F.lit(rating).alias("rating"), kind.alias("next_state"), F.when(minutes > 0, minutes).otherwise(whole * 1_440).cast("long").alias("minutes"), whole.alias("days"))

    return due.select("student_id", "card_id", "recall", F.inline(F.array(*[option(g) for g in (1, 2, 3, 4)])))


#: The scheduler that schedules are moved to, and the status that each of its states has.
SCHEDULER = "fsrs-6"
STATUS_OF = {0: "new", 1: "learning", 2: "review", 3: "learning"}
_CARD, _FSRS = ["student_id", "card_id"], ["stability", "difficulty", "state", "reps", "lapses", "step", "minutes", "last_at"]
#: What a migration changes of a schedule.
SCHEDULE = ["scheduler_version", "state_version", "status", "legacy_lapses", *_FSRS]
_SCHEDULE_TYPE = f"scheduler_version string, state_version long, status string, legacy_lapses int, {FSRS_STATE}"


def _to_migrate(states: DataFrame, reviews: DataFrame, version: str) -> DataFrame:
    history = reviews.filter("mode = 'study'").groupBy(*_CARD).agg(F.count("*").alias("n"))
    both = states.select(*_CARD, F.lit(True).alias("has"), "scheduler_version").join(history, _CARD, "full")
    return both.withColumn("pending", ~F.col("scheduler_version").eqNullSafe(version))


def schedule_migration(states: DataFrame, reviews: DataFrame, version: str = SCHEDULER) -> DataFrame:
    """A dry run's counts: states, study reviews, schedules (keys of either), those that have the version already, and of the pending ones all and those without history."""
    pending = F.col("pending")
    return _to_migrate(states, reviews, version).agg(
        F.count("has").alias("states"), F.coalesce(F.sum("n"), F.lit(0)).alias("reviews"), F.count("*").alias("schedules"), F.count_if(~pending).alias("already"), F.count_if(pending).alias("pending"), F.count_if(pending & F.col("n").isNull()).alias("without_history"),
    )


def migration_diff(states: DataFrame, reviews: DataFrame, version: str = SCHEDULER) -> DataFrame:
    """What a migration changes: each pending schedule as it is (``before``, null if there is none) and as a replay of its study reviews makes it (``after``).

    ``states``: student_id, card_id and the columns of ``SCHEDULE``; its lapses before are its legacy ones, four of which make it a leech. A schedule without
    history starts anew. The version of a state rises by one. ``before`` is the image from which ``rolled_back`` restores.
    """
    pending = _to_migrate(states, reviews, version).filter("pending").select(*_CARD)
    kinds = dict(f.split(" ") for f in _SCHEDULE_TYPE.split(", "))
    typed = lambda f, c: c.cast(kinds[f]).alias(f)
    old = states.select(*_CARD, F.struct(*[typed(f, F.col(f)) for f in SCHEDULE]).alias("before"))
    new = fsrs_replay(reviews).drop("due_at")
    rows = pending.join(old, _CARD, "left").join(new, _CARD, "left")
    legacy = F.coalesce(F.coalesce("before.legacy_lapses", "before.lapses"), F.lit(0))
    fresh = {f: F.coalesce(F.col(f), F.lit(None if f == "last_at" else 0)) for f in _FSRS}
    status = F.when(legacy >= 4, "leech")
    for kind, name in STATUS_OF.items():
        status = status.when(fresh["state"] == kind, name)
    values = {"scheduler_version": F.lit(version), "state_version": F.coalesce("before.state_version", F.lit(0)) + 1, "status": status, "legacy_lapses": legacy, **fresh}
    return rows.select(*_CARD, "before", F.struct(*[typed(f, c) for f, c in values.items()]).alias("after"))


def _replaced(states: DataFrame, diff: DataFrame, old: str, new: str) -> DataFrame:
    """States with ``new`` for ``old`` where the state still has ``old``'s version; a null ``new`` goes, a null ``old`` comes."""
    rows = states.join(diff.select(*_CARD, F.col(old).alias("o"), F.col(new).alias("n"), F.lit(True).alias("listed")), _CARD, "full")
    here = F.col("scheduler_version").isNotNull() | F.col("state_version").isNotNull() | F.col("status").isNotNull()
    fits = F.col("listed").isNotNull() & F.when(F.col("o").isNull(), ~here).otherwise(here & F.col("state_version").eqNullSafe(F.col("o.state_version")))
    kept = rows.withColumn("fits", fits).filter((F.col("fits") & F.col("n").isNotNull()) | (~F.col("fits") & here))
    return kept.select(*_CARD, *[F.when(F.col("fits"), F.col(f"n.{f}")).otherwise(F.col(f)).cast(states.schema[f].dataType).alias(f) for f in SCHEDULE])


def migrated(states: DataFrame, diff: DataFrame) -> DataFrame:
    """States after a migration. One that changed since the diff was made, by its version, stays as it is."""
    return _replaced(states, diff, "before", "after")


def rolled_back(states: DataFrame, diff: DataFrame) -> DataFrame:
    """States before a migration, from its images. One that was reviewed since, by its version, stays as it is."""
    return _replaced(states, diff, "after", "before")


def deck_dashboard(cards: DataFrame, schedule: DataFrame, today: Column) -> DataFrame:
    """Cards, due and new cards of each student's decks. ``cards``: student_id, deck_id, card_id."""
    rows = cards.join(schedule.select("student_id", "card_id", "due_on"), ["student_id", "card_id"], "left")
    return rows.groupBy("student_id", "deck_id").agg(F.count("*").alias("card_count"), F.count_if(F.col("due_on") <= today).alias("due_count"), F.count_if(F.col("due_on").isNull()).alias("new_count"))


def deck_progress(cards: DataFrame, schedule: DataFrame, reviews: DataFrame, today: Column) -> DataFrame:
    """Work left and done today on each assigned deck; sprint reviews don't count, and no timed review gives a null time."""
    rows = cards.join(schedule.select("student_id", "card_id", "due_on"), ["student_id", "card_id"], "left")
    left = rows.groupBy("student_id", "deck_id").agg(F.count_if(F.col("due_on") <= today).alias("due_remaining"), F.count_if(F.col("due_on").isNull()).alias("new_remaining"), F.count("*").alias("card_count"))
    done = reviews.filter("mode = 'study'").filter(F.col("reviewed_on") == today).groupBy("student_id", "deck_id").agg(F.count("*").alias("reviews_today"), F.countDistinct("card_id").alias("cards_today"), F.sum("response_ms").alias("tracked_ms"), F.count("response_ms").alias("tracked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = left.join(done, ["student_id", "deck_id"], "left").select("student_id", "deck_id", "due_remaining", "new_remaining", zero("reviews_today"), zero("cards_today"), "tracked_ms", zero("tracked"))
    return out.withColumn("status", F.when(F.col("due_remaining") > 0, "due_remaining").when(F.col("reviews_today") > 0, "done_today").otherwise("no_cards_due"))


def study_history(cards: DataFrame, reviews: DataFrame, schedule: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """The due cards of each of the last days, rebuilt: a card's due date at the end of a day is the one its first later review saw, else today's.

    ``reviews`` has ``due_before``, what the schedule said just before; where the first later review doesn't have it, the day's total is unknown (null).
    """
    spine = cards.select("student_id", "deck_id", "card_id").distinct().withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("day", F.date_sub(today, F.col("back"))).withColumn("cutoff", F.date_add("day", 1))
    window = reviews.filter("mode = 'study'").filter(F.col("reviewed_on") > F.date_sub(today, days))
    later = window.select("student_id", "card_id", "reviewed_on", "created_at", "review_id", "due_before")
    order = F.struct(F.col("created_at").cast("timestamp"), F.col("review_id"))
    keyed = later.select("student_id", "card_id", "reviewed_on", F.struct(F.lit(1).alias("seen"), F.col("due_before")).alias("take"), F.struct(F.col("reviewed_on"), order.alias("o")).alias("at"))
    hits = asof_forward(spine.withColumn("cut", F.struct(F.col("cutoff").alias("reviewed_on"), F.struct(F.lit("0001-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit(0).cast("long").alias("review_id")).alias("o"))), keyed.withColumnRenamed("take", "t"), ["student_id", "card_id"], "cut", "at", F.col("t"), "first_later")
    now = hits.join(schedule.select("student_id", "card_id", "due_on"), ["student_id", "card_id"], "left")
    due = F.when(F.col("first_later").isNotNull(), F.col("first_later.due_before")).otherwise(F.col("due_on"))
    unknown = F.col("first_later").isNotNull() & F.col("first_later.due_before").isNull()
    total = now.groupBy("student_id", "deck_id", "day").agg(F.count_if(due <= F.col("day")).alias("due_total"), F.count_if(unknown).alias("unknown"))
    done = window.groupBy("student_id", "deck_id", F.col("reviewed_on").alias("day")).agg(F.countDistinct("card_id").alias("studied"), F.count("*").alias("reviews"), F.sum("response_ms").alias("tracked_ms"))
    out = total.join(done, ["student_id", "deck_id", "day"], "left")
    return out.select("student_id", "deck_id", "day", F.when(F.col("unknown") == 0, F.col("due_total")).alias("total_due"), "unknown", F.coalesce("studied", F.lit(0)).alias("studied"), F.coalesce("reviews", F.lit(0)).alias("reviews"), "tracked_ms")


def deck_report(progress: DataFrame) -> DataFrame:
    """Decks over all students: the mean time a timed review takes is weighted by how many are timed."""
    out = progress.groupBy("deck_id").agg(F.count("*").alias("students"), F.sum("due_remaining").alias("due_remaining"), F.sum("new_remaining").alias("new_remaining"), F.sum("reviews_today").alias("reviews_today"), F.sum("tracked_ms").alias("tracked_ms"), F.sum("tracked").alias("tracked"), F.count_if(F.col("status") == "done_today").alias("done"))
    return out.withColumn("mean_ms", half_up(F.try_divide(F.col("tracked_ms").cast("double"), F.col("tracked").cast("double")))).withColumn("status", F.when(F.col("done") == F.col("students"), "all_done").when(F.col("reviews_today") > 0, "started").otherwise("not_started"))


def study_queue(cards: DataFrame, schedule: DataFrame, today: Column, most: int = 20) -> DataFrame:
    """A student's next cards: new ones first, then the earliest due."""
    rows = cards.join(schedule.select("student_id", "card_id", "due_on"), ["student_id", "card_id"], "left").filter(F.col("due_on").isNull() | (F.col("due_on") <= today))
    return rows.select("student_id", "card_id", "due_on", F.row_number().over(Window.partitionBy("student_id").orderBy(F.col("due_on").asc_nulls_first(), "card_id")).alias("n")).filter(F.col("n") <= most)


def sprint_sample(cards: DataFrame, seed: int, most: int = 250) -> DataFrame:
    """At most ``most`` cards of a student, in an order that the seed gives."""
    order = F.md5(F.concat_ws(":", "student_id", "card_id", F.lit(seed)).cast("binary"))
    return cards.withColumn("n", F.row_number().over(Window.partitionBy("student_id").orderBy(order, "card_id"))).filter(F.col("n") <= most)


def card_merge(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming words that their deck doesn't have, whatever their case, the first of each; ``place`` is their order."""
    first = incoming.withColumn("w", F.lower(F.trim("word"))).groupBy("deck_id", "w").agg(F.min_by("word", "place").alias("word"), F.min("place").alias("place"), F.count("*").alias("times"))
    return first.join(known.select("deck_id", F.lower(F.trim("word")).alias("w")).distinct(), ["deck_id", "w"], "left_anti").select("deck_id", "word", "place", (F.col("times") - 1).alias("skipped"))


def consistency(reviews: DataFrame, activity: DataFrame) -> DataFrame:
    """Days on which the review log and the daily totals differ."""
    log = daily_activity(reviews).select("student_id", "reviewed_on", F.col("reviews").alias("logged"))
    return log.join(activity.select("student_id", "reviewed_on", "reviews"), ["student_id", "reviewed_on"], "full").filter(~F.col("logged").eqNullSafe(F.col("reviews")))


def deck_listing(decks: DataFrame, assigned: DataFrame, text: str = "") -> DataFrame:
    """Shared decks with a text in their name, and the students they are assigned to; newest first by ``n``."""
    counts = assigned.groupBy("deck_id").agg(F.countDistinct("student_id").alias("students"))
    rows = decks.filter(F.contains(F.lower("name"), F.lit(text.lower()))).join(counts, "deck_id", "left")
    return rows.select("deck_id", "name", F.coalesce("students", F.lit(0)).alias("students"))


def due_before(reviews: DataFrame, lead_days: int = 3) -> DataFrame:
    """Study reviews with the due date that the schedule had before them: a fixed step after the review before; null for the first."""
    along = Window.partitionBy("student_id", "card_id").orderBy("created_at", "review_id")
    return reviews.filter("mode = 'study'").withColumn("due_before", F.date_add(F.lag("reviewed_on").over(along), lead_days))


