"""Assignment, class and student progress over whole attempt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.expressions import difficulty_label, local_date, profile_complete, progress_status, remaining_seconds
from gradeloom.functions.relational import half_up, pct


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The newest attempt of each assignment, ties by the larger id."""
    newest = attempts.groupBy("assignment_id").agg(F.max_by(F.struct("attempt_id", "status"), F.struct("started_at", "attempt_id")).alias("a"))
    return newest.select("assignment_id", F.col("a.attempt_id").alias("attempt_id"), F.col("a.status").alias("attempt_status"))


def assignment_progress(assignments: DataFrame, attempts: DataFrame, scores: DataFrame, module_times: DataFrame, now: Column) -> DataFrame:
    """Status, score, accuracy and time of every assignment, from its newest attempt. No timed module gives a null time."""
    base = assignments.join(latest_attempts(attempts), "assignment_id", "left").join(scores.select("attempt_id", "raw", "total"), "attempt_id", "left")
    times = module_times.groupBy("attempt_id").agg(F.sum("seconds").alias("seconds"))
    done = base.join(times, "attempt_id", "left")
    status = progress_status(F.col("status"), F.col("due_at").cast("timestamp"), F.col("attempt_status"), now)
    return done.select("assignment_id", "student_id", "batch_id", "test_id", "attempt_id", status.alias("progress"), "raw", "total", pct(F.col("raw"), F.col("total")).alias("accuracy"), "seconds")


def assignment_rows(assignments: DataFrame, attempts: DataFrame, scores: DataFrame, module_times: DataFrame, tests: DataFrame, practice: DataFrame, full: DataFrame, now: Column) -> DataFrame:
    """Every assignment with its test's kind, the batch it belongs to, and the status, score, accuracy and time of its newest attempt.

    The batch of a practice test is the one whose snapshot it is, the largest id if there are several; any other test's batch is the assignment's own. The
    title is the batch's, else the test's, else a plain one. ``assignments``: assignment_id, student_id, test_id, full_batch_id, assigned_at, due_at,
    status; ``attempts`` also submitted_at; ``tests``: test_id, title, kind; ``practice``: batch_id, snapshot_test_id, title, timer_minutes,
    class_id, class_name; ``full``: batch_id, title, class_id, class_name.
    """
    seen = F.struct("attempt_id", "status", "started_at", "submitted_at")
    newest = attempts.filter("assignment_id is not null").groupBy("assignment_id").agg(F.max_by(seen, F.struct("started_at", "attempt_id")).alias("a"))
    # an attempt's score and its times come in one row
    points = scores.select("attempt_id", "raw", "total", F.lit(None).cast("long").alias("seconds")).unionAll(module_times.select("attempt_id", F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("seconds").cast("long")))
    sums = points.groupBy("attempt_id").agg(F.max("raw").alias("raw"), F.max("total").alias("total"), F.sum("seconds").alias("seconds"))
    snap = practice.groupBy(F.col("snapshot_test_id").alias("test_id")).agg(F.max_by(F.struct("batch_id", "title", "timer_minutes", "class_id", "class_name"), "batch_id").alias("p"))
    own = full.select(F.col("batch_id").alias("full_batch_id"), F.struct("batch_id", "title", F.lit(None).cast("int").alias("timer_minutes"), "class_id", "class_name").alias("f"))
    rows = assignments.join(tests.select("test_id", F.col("title").alias("test_title"), "kind"), "test_id", "left").join(snap, "test_id", "left").join(own, "full_batch_id", "left").join(newest, "assignment_id", "left")
    rows = rows.withColumn("b", F.when(F.col("kind") == "practice", F.col("p")).otherwise(F.col("f"))).join(sums.withColumnRenamed("attempt_id", "scored_id"), F.col("a.attempt_id") == F.col("scored_id"), "left")
    status = progress_status(F.col("status"), F.col("due_at").cast("timestamp"), F.col("a.status"), now)
    title = F.coalesce("b.title", "test_title", F.lit("Assigned test"))
    return rows.select(
        "assignment_id", "student_id", "test_id", F.coalesce("kind", F.lit("full")).alias("kind"), F.col("b.batch_id").alias("batch_id"), title.alias("title"), F.col("b.class_id").alias("class_id"), F.col("b.class_name").alias("class_name"), F.col("b.timer_minutes").alias("timer_minutes"), status.alias("progress"),
        F.col("a.attempt_id").alias("attempt_id"), F.col("a.status").alias("attempt_status"), F.col("a.submitted_at").isNotNull().alias("submitted"), "raw", "total", pct(F.col("raw"), F.col("total")).alias("accuracy"), F.when(F.col("a.attempt_id").isNotNull(), F.col("seconds")).alias("seconds"),
    )


def dashboard_items(assignments: DataFrame, attempts: DataFrame, tests: DataFrame, now: Column) -> DataFrame:
    """A student's assignments with their state and where they lead: to a session in progress, a score, a list of tests, or a start.

    An assignment is ``complete`` if it says so or its newest attempt was submitted, ``overdue`` once it is past due, else ``assigned``. Without its
    test it leads to the list.
    """
    newest = attempts.filter("assignment_id is not null").groupBy("assignment_id").agg(F.max_by(F.struct("attempt_id", "status"), F.struct("started_at", "attempt_id")).alias("a"))
    rows = assignments.join(newest, "assignment_id", "left").join(tests.select("test_id", "title", F.col("kind").alias("test_kind")), "test_id", "left")
    done = F.coalesce(F.col("a.status").isin("submitted", "graded"), F.lit(False))
    state = F.when((F.col("status") == "completed") | done, "complete").when(F.col("due_at").cast("timestamp") < now, "overdue").otherwise("assigned")
    goes = F.when(F.col("a.status") == "in_progress", "session").when(done, "score").when((state == "complete") | F.col("title").isNull(), "list").otherwise("start")
    target = F.when(goes.isin("session", "score"), F.col("a.attempt_id")).when(goes == "start", F.col("test_id"))
    kind = F.when(F.col("test_kind") == "practice", "practice").otherwise("test")
    return rows.select("student_id", "assignment_id", F.coalesce("title", F.lit("Unavailable assignment")).alias("title"), kind.alias("kind"), state.alias("state"), goes.alias("leads_to"), target.alias("target_id"))


def batch_rollup(progress: DataFrame, key: str = "batch_id") -> DataFrame:
    """Students, completed assignments and the mean of the accuracies that are not null."""
    tenths = F.sum(F.floor(F.col("accuracy") * 10 + 0.5))
    return progress.groupBy(key).agg(F.countDistinct("student_id").alias("student_count"), F.count("*").alias("assigned"), F.count_if(F.col("progress") == "completed").alias("completed_count"), half_up(F.try_divide(tenths.cast("double"), F.count("accuracy").cast("double")) / 10).alias("avg_accuracy"))


def batch_students(assignments: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each student of a batch with the newest and the newest graded attempt."""
    order = F.struct("started_at", "attempt_id")
    newest = attempts.groupBy("assignment_id").agg(F.max_by("attempt_id", order).alias("latest_attempt_id"), F.max_by("attempt_id", F.when(F.col("status") == "graded", order)).alias("latest_graded_id"), F.count_if(F.col("status") == "graded").alias("graded"))
    return assignments.join(newest, "assignment_id", "left").select("batch_id", "student_id", "assignment_id", "latest_attempt_id", F.when(F.col("graded") > 0, F.col("latest_graded_id")).alias("latest_graded_id"))


def class_roster(classes: DataFrame, students: DataFrame) -> DataFrame:
    """Members of every class, empty classes included, and a digest of their ordered ids."""
    members = students.groupBy("class_id").agg(F.count("*").alias("members"), F.min("student_id").alias("first_id"), F.max("student_id").alias("last_id"))
    return classes.join(members, "class_id", "left").select("class_id", "class_name", F.coalesce("members", F.lit(0)).alias("members"), "first_id", "last_id")


def class_assignments(students: DataFrame, progress: DataFrame) -> DataFrame:
    """Counts of each class and test kind: tests of id 0 are practice sets, the others full tests."""
    kind = F.when(F.col("test_id") == 0, "practice").otherwise("full_test")
    rows = progress.join(students.select("student_id", "class_id"), "student_id").withColumn("kind", kind)
    return rows.groupBy("class_id", "kind").agg(F.countDistinct("student_id").alias("student_count"), F.count("*").alias("assigned"), F.count_if(F.col("progress") == "completed").alias("completed_count"))


def student_roster(students: DataFrame, attempts: DataFrame, topics: DataFrame) -> DataFrame:
    """Attempts and totals of every student; both sides are aggregated before the join, so neither multiplies the other."""
    tries = attempts.groupBy("student_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "graded").alias("graded"))
    total = topics.groupBy("student_id").agg(F.sum("attempted").alias("attempted"), F.sum("correct").alias("correct"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = students.join(tries, "student_id", "left").join(total, "student_id", "left").select("student_id", zero("attempts"), zero("graded"), zero("attempted"), zero("correct"), profile_complete(F.col("name"), F.col("profile")).alias("profile_complete"))
    return out.withColumn("accuracy", pct(F.col("correct"), F.col("attempted")))


def test_listing(attempts: DataFrame, roster: DataFrame, scope: Column) -> DataFrame:
    """Each student's tests with the modules and questions in scope and the attempt to go on with: an active one, else the newest."""
    active = (F.col("status") == "in_progress").cast("int")
    best = attempts.groupBy("student_id", "test_id").agg(F.max_by(F.struct("attempt_id", "status"), F.struct(active, "started_at", "attempt_id")).alias("b"), F.count("*").alias("attempts"))
    size = roster.filter(scope).groupBy("test_id").agg(F.countDistinct("module_id").alias("modules"), F.countDistinct("question_id").alias("questions"))
    return best.join(size, "test_id", "left").select("student_id", "test_id", "attempts", F.col("b.attempt_id").alias("attempt_id"), F.col("b.status").alias("attempt_status"), "modules", "questions")


def module_timing(events: DataFrame, limit_minutes: int, now: Column) -> DataFrame:
    """Active seconds between start, resume and advance events and the next event of a module, and what is left of its limit.

    ``events`` has ``module_key``, ``event_id``, ``at`` (seconds) and ``kind``; the time after a pause doesn't count, and the last event runs to ``now``.
    """
    along = Window.partitionBy("module_key").orderBy("at", "event_id")
    spans = events.withColumn("until", F.coalesce(F.lead("at").over(along), now)).withColumn("active", F.col("kind") != "pause")
    out = spans.groupBy("module_key").agg(F.sum(F.when(F.col("active"), F.greatest(F.col("until") - F.col("at"), F.lit(0))).otherwise(0)).alias("active_seconds"), F.count("*").alias("events"))
    return out.withColumn("remaining", remaining_seconds(F.lit(None).cast("double"), F.lit(limit_minutes), F.col("active_seconds").cast("double")))


def dashboard_summary(progress: DataFrame, assignments: DataFrame, now: Column, offset_hours: int = 7) -> DataFrame:
    """Exclusive states of a student's assignments, and how many are due on the local day of ``now``."""
    rows = progress.join(assignments.select("assignment_id", "due_at"), "assignment_id")
    today = local_date(rows["due_at"].cast("timestamp"), offset_hours) == local_date(now, offset_hours)
    states = [F.count_if(F.col("progress") == s).alias(s) for s in ("completed", "in_progress", "overdue", "assigned", "expired")]
    return rows.groupBy("student_id").agg(*states, F.count_if(today & (F.col("progress") != "completed")).alias("due_today"), F.min(F.datediff(F.to_date("due_at"), F.to_date(now))).alias("days_to_first_due"))


def practice_sets(tests: DataFrame, snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """Practice tests that are no batch's snapshot, with their questions and a minute and a half for each."""
    open_ = tests.join(snapshots.select("test_id").distinct(), "test_id", "left_anti")
    size = links.groupBy("test_id").agg(F.countDistinct("question_id").alias("questions"))
    return open_.join(size, "test_id").select("test_id", "questions", F.ceil(F.col("questions") * 1.5).alias("minutes"))


def ineligible_questions(questions: DataFrame) -> DataFrame:
    """Questions that a practice set can't take, with the first reason: inactive, unrated, or without a usable key."""
    reason = F.when(F.col("status") != "active", "inactive").when(F.col("difficulty").isNull(), "unrated").when((F.col("question_type") == "typed") & (F.trim(F.coalesce("key_text", F.lit(""))) == ""), "no_answer").when((F.col("question_type") == "choice") & F.col("key_no").isNull(), "no_correct_choice").when(F.col("skill").isNull(), "no_skill")
    return questions.select("question_id", reason.alias("reason")).filter("reason is not null")


def question_usage(links: DataFrame) -> DataFrame:
    """How many modules use a question; used by several it is copied on write. The next free position of each is beside it."""
    return links.groupBy("question_id").agg(F.countDistinct("module_id").alias("uses"), (F.max("position") + 1).alias("next_position")).withColumn("shared", F.col("uses") > 1)


def deletable_batches(batches: DataFrame) -> DataFrame:
    """Batches whose snapshot no other batch has and that no batch was made from. ``batches``: batch_id, snapshot_id, source_id."""
    shared = batches.groupBy("snapshot_id").agg(F.countDistinct("batch_id").alias("n")).filter("n > 1").select("snapshot_id")
    sources = batches.select(F.col("source_id").alias("snapshot_id")).filter("snapshot_id is not null").distinct()
    return batches.select("batch_id", "snapshot_id").distinct().join(shared, "snapshot_id", "left_anti").join(sources, "snapshot_id", "left_anti")


def bank_search(questions: DataFrame, section: str | None = None, difficulty: int | None = None, contains: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the rated questions that fit, newest first, with the number of all that fit and whether more follow."""
    rows = questions.filter("difficulty is not null")
    for name, value in (("section", section), ("difficulty", difficulty)):
        rows = rows.filter(F.col(name) == value) if value is not None else rows
    rows = rows.filter(F.contains(F.lower("prompt"), F.lit(contains.lower()))) if contains else rows
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.select("question_id", "section", "domain", "difficulty", difficulty_label(F.col("difficulty")).alias("label")).orderBy(F.desc("question_id")).offset((page - 1) * size).limit(size)
    return shown.withColumn("total", total.scalar()).withColumn("has_more", F.col("total") > page * size)


def tag_search(cards: DataFrame, tag: str, text: str) -> DataFrame:
    """Cards that have a tag and a text in any of their fields."""
    return cards.filter(F.array_contains("tags", tag) & F.contains(F.lower(F.concat_ws(" ", "front", "back", F.array_join("tags", " "))), F.lit(text.lower())))


def visible_decks(owned: DataFrame, assigned: DataFrame, active: DataFrame) -> DataFrame:
    """Decks that a student owns or was assigned, if they are active."""
    return owned.select("student_id", "deck_id").unionByName(assigned.select("student_id", "deck_id")).distinct().join(active.select("deck_id").distinct(), "deck_id", "left_semi").select("student_id", "deck_id")


def scoped_modules(assignments: DataFrame, modules: DataFrame) -> DataFrame:
    """The modules of an assignment: all of its test, those of one section, or those listed that exist. Empty results have no row."""
    inner = assignments.join(modules, "test_id")
    allowed = F.when(F.col("scope") == "full_test", F.lit(True)).when(F.col("scope") == "custom_modules", F.array_contains("module_ids", F.col("module_id"))).otherwise(F.col("scope") == F.col("section"))
    return inner.filter(allowed).select("assignment_id", "module_id", "section")
