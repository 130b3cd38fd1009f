"""Grading and score analytics over whole response tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.expressions import answers_match, explanations_open
from gradeloom.functions.relational import latest_by, pct, spread


def grade_responses(roster: DataFrame, attempts: DataFrame, responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Grade every question of every attempt's roster: a choice against the key's choice, a typed answer against the key's alternatives.

    A question without a response is wrong and unanswered; a response to what is not on the roster counts nothing. ``roster``: attempt_id, question_id,
    module_id and points, null for 1. Adds ``is_correct``, ``is_answered`` and ``points``.
    """
    own = roster.select("attempt_id", "question_id", "module_id", F.coalesce("points", F.lit(1)).alias("points"))
    given = responses.select("attempt_id", "question_id", "choice_no", "typed_text", "seconds")
    joined = own.join(given, ["attempt_id", "question_id"], "left").join(questions.drop("prompt", "status"), "question_id")
    typed = F.col("question_type") == "typed"
    right = F.when(typed, answers_match(F.col("typed_text"), F.col("key_text"))).otherwise(F.coalesce(F.col("choice_no") == F.col("key_no"), F.lit(False)))
    answered = F.when(typed, F.trim(F.coalesce("typed_text", F.lit(""))) != "").otherwise(F.col("choice_no").isNotNull())
    marked = joined.select("attempt_id", "question_id", "module_id", "section", "domain", "skill", "difficulty", "question_type", "choice_no", "key_no", "typed_text", "key_text", "seconds", right.alias("is_correct"), answered.alias("is_answered"), "points")
    rows = spread(marked, "attempt_id").join(attempts.select("attempt_id", "student_id", "assignment_id", "test_id", "status", "started_at"), "attempt_id")  # last, so that what is summed up by attempt needs no further shuffle
    return rows.select("attempt_id", "student_id", "assignment_id", "test_id", F.col("status").alias("attempt_status"), "started_at", *marked.columns[1:])


def score_rollup(graded: DataFrame) -> DataFrame:
    """Raw points, questions and accuracy for attempts, sections and modules, by grouping sets over the sums of modules; ``level`` tells them apart."""
    right = F.sum(F.col("is_correct").cast("int") * F.col("points"))
    modules = graded.groupBy("attempt_id", "section", "module_id").agg(right.alias("r"), F.count("*").alias("q"), F.sum("points").alias("p"))  # sums add up, so only modules are expanded into levels
    out = modules.groupingSets([["attempt_id"], ["attempt_id", "section"], ["attempt_id", "section", "module_id"]], "attempt_id", "section", "module_id").agg(F.sum("r").alias("raw"), F.sum("q").alias("total_questions"), F.sum("p").alias("total_points"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "attempt").when(F.col("g") == 1, "section").otherwise("module")
    return out.select("attempt_id", level.alias("level"), "section", "module_id", "raw", "total_questions", "total_points", pct(F.col("raw"), F.col("total_points")).alias("accuracy_points"), pct(F.col("raw"), F.col("total_questions")).alias("accuracy_questions"))


def topic_totals(graded: DataFrame) -> DataFrame:
    """Questions attempted and correct by student, domain and skill; questions without a domain are left out."""
    rows = spread(graded.filter("domain is not null"), "student_id")
    return rows.groupBy("student_id", "domain", F.coalesce("skill", F.lit("")).alias("skill")).agg(F.count("*").alias("attempted"), F.sum(F.col("is_correct").cast("int")).alias("correct"))


def _question_number() -> Column:
    return F.row_number().over(Window.partitionBy("attempt_id").orderBy(F.desc("section"), "module_id", "question_id"))


def attempt_review(graded: DataFrame, submissions: DataFrame, now: Column) -> DataFrame:
    """Every question of every graded attempt with its number in section, module and question order; keys are shown once explanations are open.

    They open when they are ``released`` by hand, or seven days after submission; never for an attempt that wasn't submitted. ``submissions``:
    attempt_id, submitted_at, released.
    """
    rows = graded.filter("attempt_status = 'graded'").withColumn("question_number", _question_number()).join(submissions.select("attempt_id", "submitted_at", "released"), "attempt_id", "left")
    shown = explanations_open(F.col("released"), F.col("submitted_at").cast("timestamp"), now)
    return rows.select("attempt_id", "question_number", "question_id", "section", "module_id", "choice_no", "is_correct", "is_answered", shown.alias("explained"), F.when(shown, F.col("key_no")).alias("shown_key"))


def error_log(graded: DataFrame, submissions: DataFrame, notes: DataFrame, page: int = 1, size: int = 10, domain: str | None = None, skill: str | None = None) -> DataFrame:
    """A page of each student's wrong or unanswered questions of graded attempts, of one ``domain`` and ``skill`` if they are given and not blank.

    The latest submission comes first, unsubmitted ones last, then by attempt, section, module and question. ``total`` counts the filtered
    questions over all pages, ``needs_review`` all of the student's errors without a ``reviewed_at``, whatever the filters. A page has ten questions at
    most. ``submissions``: attempt_id, submitted_at; ``notes``: attempt_id, question_id, note_text, reviewed_at.
    """
    page, size = max(page, 1), min(max(size, 1), 10)
    blank = lambda x: not (x or "").strip()
    numbered = graded.filter("attempt_status = 'graded'").withColumn("question_number", _question_number())
    wrong = numbered.filter(~F.col("is_answered") | ~F.col("is_correct").eqNullSafe(True))
    rows = wrong.join(submissions.select("attempt_id", "submitted_at"), "attempt_id", "left").join(notes.select("attempt_id", "question_id", "note_text", "reviewed_at"), ["attempt_id", "question_id"], "left")
    asked = F.lit(True)
    for c, value in (("domain", domain), ("skill", skill)):
        if not blank(value):
            asked = asked & F.col(c).eqNullSafe(value.strip())
    order = Window.partitionBy("student_id").orderBy(F.col("submitted_at").desc_nulls_last(), F.desc("attempt_id"), F.desc("section"), "module_id", "question_id")
    every = Window.partitionBy("student_id")
    rows = rows.withColumn("asked", asked).withColumns({"n": F.count_if("asked").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.count_if("asked").over(every), "needs_review": F.count_if(F.col("reviewed_at").isNull()).over(every)})
    given = F.coalesce(F.concat(F.lit("choice "), F.col("choice_no").cast("string")), F.nullif(F.trim("typed_text"), F.lit("")))
    shown = rows.filter(F.col("asked") & F.col("n").between((page - 1) * size + 1, page * size))
    return shown.select("student_id", "attempt_id", "question_id", "question_number", "domain", "skill", given.alias("your_answer"), (~F.col("is_answered")).alias("unanswered"), F.coalesce("note_text", F.lit("")).alias("note_text"), F.col("reviewed_at").isNotNull().alias("reviewed"), "n", "total", "needs_review")


def error_facets(graded: DataFrame) -> DataFrame:
    """The domains and skills among a student's errors, in order, to filter by."""
    wrong = graded.filter("attempt_status = 'graded'").filter(~F.col("is_answered") | ~F.col("is_correct").eqNullSafe(True))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    return wrong.groupBy("student_id").agg(listed("domain"), listed("skill"))


def score_history(graded: DataFrame) -> DataFrame:
    """A student's graded attempts, newest first, with the running number and the change from the one before."""
    one = graded.filter("attempt_status = 'graded'").groupBy("student_id", "attempt_id", "started_at").agg(F.sum(F.col("is_correct").cast("int")).alias("raw"), F.count("*").alias("total"))
    one = one.withColumn("accuracy", pct(F.col("raw"), F.col("total")))
    back = Window.partitionBy("student_id").orderBy(F.desc("started_at"), F.desc("attempt_id"))
    return one.select("student_id", "attempt_id", F.row_number().over(back).alias("n"), "raw", "total", "accuracy", (F.col("raw") - F.lead("raw").over(back)).alias("raw_change"))


def results_summary(graded: DataFrame) -> DataFrame:
    """Attempts, answered and correct questions, and the mean accuracy of a student."""
    one = graded.filter("attempt_status = 'graded'").groupBy("student_id", "attempt_id").agg(F.sum(F.col("is_correct").cast("int")).alias("raw"), F.count("*").alias("total"), F.sum(F.col("is_answered").cast("int")).alias("answered"))
    mean = F.try_divide(F.sum(F.floor(F.col("raw") * 10000 / F.col("total"))), F.count("*"))
    return one.groupBy("student_id").agg(F.count("*").alias("attempts"), F.sum("raw").alias("correct"), F.sum("answered").alias("answered"), (F.floor(mean / 10 + 0.5) / 10).alias("avg_accuracy"))


def score_report(graded: DataFrame) -> DataFrame:
    """Correct, wrong and unanswered questions of an attempt by section and domain."""
    right, answered = F.col("is_correct"), F.col("is_answered")
    return graded.groupBy("attempt_id", "section", "domain").agg(F.count_if(right).alias("correct"), F.count_if(~right & answered).alias("wrong"), F.count_if(~answered & ~right).alias("unanswered"), F.countDistinct("skill").alias("skills"))


def latest_graded(graded: DataFrame, attempts: DataFrame) -> DataFrame:
    """The rows of each assignment's newest graded attempt; if that one has no rows, there are none."""
    ids = attempts.filter("status = 'graded'").groupBy("assignment_id").agg(F.max_by("attempt_id", F.struct("started_at", "attempt_id")).alias("attempt_id"))
    return graded.join(ids.select("attempt_id"), "attempt_id", "left_semi")


def item_analysis(graded: DataFrame, attempts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Correct, wrong and unanswered of each question of a batch among newest graded attempts, and how often each choice was taken, zeros included."""
    rows = latest_graded(graded, attempts).join(assignments.select("assignment_id", "batch_id"), "assignment_id")
    right, answered = F.col("is_correct"), F.col("is_answered")
    picks = [F.count_if(F.col("choice_no") == c).alias(f"choice_{'abcd'[c]}") for c in range(4)]
    out = rows.groupBy("batch_id", "question_id").agg(F.count_if(right).alias("correct"), F.count_if(~right & answered).alias("incorrect"), F.count_if(~right & ~answered).alias("unanswered"), F.count("*").alias("seen"), *picks)
    return out.withColumn("accuracy", pct(F.col("correct"), F.col("seen")))


def typed_answers(graded: DataFrame, attempts: DataFrame, assignments: DataFrame) -> DataFrame:
    """The typed answers of a batch's question by frequency, then text."""
    rows = latest_graded(graded, attempts).filter("question_type = 'typed' and typed_text is not null").join(assignments.select("assignment_id", "batch_id"), "assignment_id")
    counts = rows.groupBy("batch_id", "question_id", "typed_text").agg(F.count("*").alias("times"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("batch_id", "question_id").orderBy(F.desc("times"), "typed_text")))


def submission_audit(topics: DataFrame, corrections: DataFrame) -> DataFrame:
    """What makes a submission bad: repeated corrections or topics, more correct than attempted, blank domains."""
    twice = corrections.groupBy("attempt_id", "question_id").count().filter("count > 1").groupBy("attempt_id").agg(F.count("*").alias("n")).select("attempt_id", F.lit("duplicate_correction").alias("rule"), "n")
    topic = topics.groupBy("attempt_id", "domain", "skill").agg(F.count("*").alias("times"), F.count_if(F.col("correct") > F.col("attempted")).alias("more"))
    blank = F.when(F.trim(F.coalesce("domain", F.lit(""))) == "", F.col("times")).otherwise(0)
    one = topic.groupBy("attempt_id").agg(F.sum("more").alias("correct_exceeds_total"), F.sum(blank).alias("blank_domain"), F.count_if(F.col("times") > 1).alias("duplicate_topic"))
    rules = F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in one.columns[1:]]))
    return twice.unionByName(one.select("attempt_id", rules).filter("n > 0"))


def finalize_once(events: DataFrame) -> DataFrame:
    """One score for each attempt under retries: the first by time, then event."""
    return events.groupBy("attempt_id").agg(F.min_by(F.struct("event_id", "score"), F.struct("at", "event_id")).alias("first"), F.count("*").alias("tries")).select("attempt_id", "first.event_id", "first.score", "tries")


def adaptive_route(graded: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The second module's difficulty by the share correct of the first module's answered questions."""
    first = graded.groupBy("attempt_id", "section").agg(F.min("module_id").alias("module_id"))
    rows = graded.join(first, ["attempt_id", "section", "module_id"])
    out = rows.groupBy("attempt_id", "section").agg(F.count_if("is_correct").alias("correct"), F.count_if("is_answered").alias("answered"))
    return out.withColumn("route", F.when(F.try_divide(F.col("correct"), F.col("answered")) >= threshold, "harder").otherwise("easier"))


def constraint_audit(attempts: DataFrame, responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Broken uniqueness, enumeration and range rules, a count for each."""
    active = attempts.filter("status = 'in_progress'").groupBy("student_id", "test_id").count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("one_active_attempt").alias("rule"), "violations")
    twice = responses.groupBy("attempt_id", "question_id").count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("response_key").alias("rule"), "violations")
    enum = attempts.agg(F.count_if(~F.col("status").isin("graded", "submitted", "in_progress")).alias("violations")).select(F.lit("attempt_status").alias("rule"), "violations")
    span = questions.agg(F.count_if(~F.col("difficulty").between(1, 5)).alias("violations")).select(F.lit("difficulty_range").alias("rule"), "violations")
    name = questions.groupBy("domain", F.lower(F.trim("prompt")).alias("p")).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("prompt_case_insensitive").alias("rule"), "violations")
    return active.unionByName(twice).unionByName(enum).unionByName(span).unionByName(name)


def newest_attempts(attempts: DataFrame) -> DataFrame:
    return latest_by(attempts, ["assignment_id"], ["started_at", "attempt_id"])
