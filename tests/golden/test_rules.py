"""Golden cases of the domain rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import expressions as E
from gradeloom.functions import relational as R
from gradeloom.operators import audits, evaluation, grading, ingestion, progress, reviews
from gradeloom.plans.adapters import Views

NOW = dt.datetime(2026, 9, 25, 12)


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("submitted", "key", "right"), [("3/4", "0.75", True), ("4", "4.0", True), ("2.5", "5/2", True), ("A", "B", False), (None, "5", False), ("x", None, False), ("0", "0 | 3", True), ("2", "0 | 3", False), ("44/3", "14.66 | 14.67 | 44/3", True), ("-30", "30 | -30", True), ("0 | 3", "0 | 3", False), ("1/0", "1/0 | 3", False), ("12abc", "12", True)])
def test_typed_answers(spark, submitted, key, right):
    df = spark.createDataFrame([(submitted, key)], "s string, k string")
    assert df.select(E.answers_match(F.col("s"), F.col("k")).alias("x")).first()["x"] is right


@pytest.mark.parametrize(("text", "value"), [("1,250", 1250.0), ("-1/2", -0.5), ("1/0", None), ("0.3333333333", 0.333333), (" ", None)])
def test_math_value(spark, text, value):
    assert one(spark, E.math_value(F.col("s")), s=text) == value


def test_latest_attempt_takes_the_larger_id_on_ties(spark):
    rows = spark.createDataFrame([("a", "old", dt.datetime(2026, 9, 23, 10), "graded"), ("a", "newer", dt.datetime(2026, 9, 24, 10), "in_progress"), ("a", "tie-z", dt.datetime(2026, 9, 24, 10), "submitted")], "assignment_id string, attempt_id string, started_at timestamp, status string")
    assert progress.latest_attempts(rows).first()["attempt_id"] == "tie-z"
    assert R.latest_by(rows, ["assignment_id"], ["started_at", "attempt_id"]).first()["attempt_id"] == "tie-z"


@pytest.mark.parametrize(("assigned", "due", "attempt", "status"), [("assigned", -1, "graded", "completed"), ("assigned", -1, "in_progress", "in_progress"), ("assigned", -1, None, "overdue"), ("assigned", 1, None, "assigned"), ("expired", None, None, "expired")])
def test_statuses(spark, assigned, due, attempt, status):
    df = spark.createDataFrame([(assigned, NOW + dt.timedelta(days=due) if due else None, attempt)], "a string, d timestamp, s string")
    assert df.select(E.progress_status(F.col("a"), F.col("d"), F.col("s"), F.lit(NOW)).alias("x")).first()["x"] == status


def test_explanations_open_after_exactly_seven_days(spark):
    for days, opened in ((7, True), (6.99, False), (-1, False)):
        assert one(spark, E.explanations_open(F.lit(False), F.col("t"), F.lit(NOW)), t=NOW - dt.timedelta(days=days)) is opened
    assert one(spark, E.explanations_open(F.lit(True), F.lit(None).cast("timestamp"), F.lit(NOW)), t=NOW) is True


@pytest.mark.parametrize(("days", "current", "best"), [((18, 19, 21, 22, 23, 25), 1, 3), ((23, 24), 2, 2), ((1, 2), 0, 2)])
def test_streaks(spark, days, current, best):
    rows = spark.createDataFrame([(1, dt.date(2026, 9, d)) for d in days], "student_id long, day date")
    out = reviews.streaks(rows, F.lit("2026-09-25").cast("date")).first()
    assert (out["current_streak"], out["best_streak"]) == (current, best)


def test_progress_keeps_null_times(spark):
    a = spark.createDataFrame([(1, 1, 1, 1, "assigned", None), (2, 1, 1, 1, "assigned", None)], "assignment_id long, student_id long, batch_id long, test_id long, status string, due_at timestamp")
    t = spark.createDataFrame([(10, 1, NOW, "graded"), (20, 2, NOW, "graded")], "attempt_id long, assignment_id long, started_at timestamp, status string")
    s = spark.createDataFrame([(10, 3, 4)], "attempt_id long, raw long, total long")
    m = spark.createDataFrame([(10, 30), (10, 45), (10, None)], "attempt_id long, seconds long")
    got = {r["assignment_id"]: (r["seconds"], r["accuracy"]) for r in progress.assignment_progress(a, t, s, m, F.lit(NOW)).collect()}
    assert got == {1: (75, 75.0), 2: (None, None)}


def test_fsrs_replay_ignores_input_order_and_keeps_its_bounds(spark):
    log = [(1, 1, k, "study", r, dt.datetime(2026, 1, 1) + dt.timedelta(days=d)) for k, (r, d) in enumerate([(3, 0), (3, 1), (4, 5), (1, 30), (3, 31)])]
    schema = "student_id long, card_id long, review_id long, mode string, rating int, created_at timestamp"
    a, b = (reviews.fsrs_replay(spark.createDataFrame(x, schema)).first() for x in (log, log[::-1]))
    assert a == b and a["stability"] > 0 and 1 <= a["difficulty"] <= 10 and a["reps"] == 5 and a["lapses"] == 1
    again = reviews.fsrs_replay(spark.createDataFrame(log[:4], schema)).first()
    assert again["state"] == 3 and (again["due_at"] - log[3][5]).total_seconds() <= 600


@pytest.mark.parametrize(("ratings", "state", "step", "minutes"), [((1,), 1, 0, 1), ((2,), 1, 0, 6), ((3,), 1, 1, 10), ((1, 3), 1, 1, 10), ((3, 1), 1, 0, 1), ((3, 2), 1, 1, 6), ((3, 3), 2, 0, None), ((4,), 2, 0, None), ((3, 3, 1), 3, 0, 10), ((3, 3, 1, 2), 3, 0, 15), ((3, 3, 1, 3), 2, 0, None)])
def test_learning_steps(spark, ratings, state, step, minutes):
    log = [(1, 1, k, "study", r, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=10 * k)) for k, r in enumerate(ratings)]
    out = reviews.fsrs_replay(spark.createDataFrame(log, "student_id long, card_id long, review_id long, mode string, rating int, created_at timestamp")).first()
    assert (out["state"], out["step"]) == (state, step)
    assert out["minutes"] == minutes if minutes else out["minutes"] >= 1_440 and out["minutes"] % 1_440 == 0


def test_previews_are_what_a_review_gives_and_keep_their_order(spark):
    states = [(s, d, kind, 5, 1, step, 1_440) for s in (0.01, 0.8, 3.0, 40.0, 36_000.0) for d in (1.0, 5.5, 10.0) for kind, step in ((1, 0), (1, 1), (2, 0), (3, 0))]
    for days in (0, 1, 40):
        rows = [(k, 0, *x, 1_767_225_600 - 86_400 * days, NOW - dt.timedelta(days=999)) for k, x in enumerate(states)]
        df = spark.createDataFrame(rows, f"student_id long, card_id long, {reviews.FSRS_STATE}, due_at timestamp")
        got = {(r["student_id"], r["rating"]): (r["next_state"], r["minutes"]) for r in reviews.rating_previews(df, F.timestamp_seconds(F.lit(1_767_225_600))).collect()}
        assert got == {(k, g): (lambda y: (y[2], y[6]))(reviews._fsrs_step(x, g, days)) for k, x in enumerate(states) for g in (1, 2, 3, 4)}
        for k, x in enumerate(states):
            if x[2] == 2:
                assert got[k, 2][1] <= got[k, 3][1] < got[k, 4][1]


def test_history_is_unknown_without_a_snapshot(spark):
    cards = spark.createDataFrame([(1, 1, 1)], "student_id long, deck_id long, card_id long")
    day = lambda d: dt.date(2026, 10, d)
    rev = spark.createDataFrame([(1, 1, 1, 5, "study", day(10), dt.datetime(2026, 10, 10, 9), 6000, None)], "student_id long, deck_id long, card_id long, review_id long, mode string, reviewed_on date, created_at timestamp, response_ms int, due_before date")
    sched = spark.createDataFrame([(1, 1, day(12))], "student_id long, card_id long, due_on date")
    got = {r["day"].day: r["total_due"] for r in reviews.study_history(cards, rev, sched, F.lit("2026-10-10").cast("date")).collect()}
    assert got[9] is None and got[10] == 0


DRAFT = "import_id string, id long, page_number int, number int, section string, module int, answer string, keys long, conflict boolean"
IMPORT = "import_id string, status string, raw_keys long"


def _ready(spark, rows, imports=(("x", "completed", None),)):
    """Rows: page, number, section, module, answer, keys, conflict; shorter ones are filled up."""
    full = [("x", i, *(r + (1, None, None, None, "A", 0, False)[len(r) :])) for i, r in enumerate(rows)]
    return audits.import_readiness(spark.createDataFrame(full, DRAFT), spark.createDataFrame(list(imports), IMPORT)).collect()[0]


def _places(r):
    return [r[f"m{i}"] for i in range(4)], r["question_status"], r["key_status"]


def test_readiness_of_98_without_headings_is_inferred(spark):
    rows = [(i,) for i in range(1, 99)]
    r = _ready(spark, rows)
    assert _places(r) == ([27, 27, 22, 22], "complete", "complete") and r["inferred"] == 98 and not r["ambiguous"]
    assert _places(_ready(spark, rows, [("x", "running", None)]))[1:] == ("processing", "processing")
    assert _places(_ready(spark, rows, [("x", "cancelled", 98)]))[1:] == ("failed", "failed")
    assert _places(_ready(spark, rows, [("x", "completed", 99)]))[1:] == ("complete", "partial")  # a key without a question


def test_readiness_sees_conflicts_with_the_sequence(spark):
    rows = [(i, None, None, 0 if i <= 26 else None) for i in range(1, 99)]
    assert _ready(spark, rows)["conflicts"] == 0
    rows[40] = (41, None, None, 3)
    r = _ready(spark, rows)
    assert r["conflicts"] == 1 and _places(r) == ([27, 27, 22, 22], "partial", "partial")
    declared = [(i, None, None, 0 if i <= 27 else 1 if i <= 54 else 2 if i <= 76 else 3) for i in range(1, 99)]
    declared[0], declared[97] = (1, None, None, 3), (98, None, None, 0)
    r = _ready(spark, declared)  # all declared: their word counts, whatever their order
    assert r["conflicts"] == 0 and r["inferred"] == 0 and _places(r)[1] == "complete"


def test_readiness_sees_an_ambiguous_order(spark):
    for change in ((1, 5), (None, 5), (1, None)):
        rows = [(i, i) for i in range(1, 97)] + [(1, 5), change if change[0] else (None, 5)]
        rows = [(1, 5 if change[1] else None), *rows[1:96], change, (98, 98)]
        r = _ready(spark, rows)
        assert r["questions"] == 98 and r["ambiguous"] and r["question_status"] == "partial"
    declared = [(1, None, None, 0)] * 2
    assert not _ready(spark, declared)["ambiguous"]  # nothing was inferred


def test_readiness_of_a_part_divides_sections(spark):
    rows = [(i, i, "Reading & Writing") for i in range(1, 31)] + [(50 + i, i, "math") for i in range(1, 46)] + [(200, 1, None), (201, 1, "history")]
    r = _ready(spark, rows)
    assert [r[f"m{i}"] for i in range(4)] == [27, 3, 22, 22] and (r["overflow_math"], r["overflow_rw"], r["unclassified"]) == (1, 0, 2)
    rows = [(1, 1, "math", 3), *[(2 + i, i, "math") for i in range(22)]]
    r = _ready(spark, rows)  # one that declares its module takes no place of the others
    assert [r[f"m{i}"] for i in range(4)] == [0, 0, 22, 1] and r["inferred"] == 22
    assert [_ready(spark, [(1, 1, s)])["m0"] for s in ("rw", "Reading_Writing", "WRITING", "preread")] == [1, 1, 1, 0]


def test_readiness_counts_keys_and_duplicates(spark):
    rows = [(i,) for i in range(1, 97)] + [(97, None, None, None, None), (98, None, None, None, "B", 2)]
    r = _ready(spark, rows)
    assert (r["mapped"], r["matched"], r["duplicate_keys"], r["k3"], r["key_status"]) == (98, 97, 1, 22, "partial")
    assert _ready(spark, [(1, 3, None, 0), (2, 3, None, 0), (3, 4, None, 0)])["duplicates"] == 1
    assert _ready(spark, [(1, 3, None, 0), (2, 0, None, 1), (3, 0, None, 1)])["duplicates"] == 0
    assert _ready(spark, [(1, 3, None, 0, "A", 0, True)])["duplicates"] == 1
    assert _ready(spark, [(1, 1, None, 0, " ")])["key_status"] == "failed"
    none = audits.import_readiness(spark.createDataFrame([], DRAFT), spark.createDataFrame([("x", "completed", 5)], IMPORT)).first()
    assert (none["questions"], none["question_status"], none["key_status"]) == (0, "failed", "partial")


def _readings(spark, *rows):
    names = ["questions", "mapped", "matched", *[f"{x}{m}" for x in "mk" for m in range(4)], "unclassified", "overflow_rw", "overflow_math", "k_unclassified", "k_overflow_rw", "k_overflow_math"]
    base = dict.fromkeys(names, 0) | {"questions": 90, "mapped": 80, "matched": 80, "m0": 27, "m1": 27, "m2": 22, "m3": 14, "k0": 27, "k1": 27, "k2": 22, "k3": 4, "question_status": "partial", "key_status": "partial"}
    full = [base | {"import_id": i} | r for i, r in rows]
    schema = "import_id string, " + ", ".join(f"{n} long" for n in names) + ", question_status string, key_status string"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in full], schema)


@pytest.mark.parametrize(
    ("old", "new", "removed", "reason"),
    [
        ({}, {}, 0, "unchanged"),
        ({}, {"questions": 91, "m3": 15}, 0, "improved"),
        ({}, {"question_status": "complete"}, 0, "improved"),
        ({"question_status": "failed"}, {"question_status": "processing"}, 0, "questions_status_fell"),
        ({}, {"questions": 89, "m3": 13}, 5, "questions_count_fell"),
        ({"questions": 99, "m0": 28, "m3": 22}, {"questions": 98, "m3": 22, "question_status": "complete"}, 0, "questions_count_fell"),
        ({"questions": 99, "m0": 28, "m3": 22}, {"questions": 98, "m3": 22, "question_status": "complete"}, 1, "improved"),
        ({"questions": 99, "m0": 28, "m3": 22}, {"questions": 98, "m0": 26, "m1": 28, "m3": 22, "question_status": "complete"}, 2, "questions_m0_fell"),
        ({}, {"m0": 26, "m3": 15}, 0, "questions_m0_fell"),
        ({"overflow_math": 3}, {"questions": 93}, 0, "improved"),
        ({"overflow_math": 3}, {"questions": 93, "unclassified": 1}, 0, "questions_overflow_math_disappeared"),
        ({"unclassified": 2}, {"questions": 93}, 0, "questions_unclassified_disappeared"),
        ({"unclassified": 2}, {"questions": 93, "unclassified": 1}, 0, "questions_unclassified_fell"),
        ({}, {"questions": 95, "mapped": 79}, 9, "keys_count_fell"),
        ({}, {"questions": 95, "matched": 79}, 0, "keys_matched_fell"),
        ({}, {"k3": 5, "mapped": 81}, 0, "improved"),
    ],
)
def test_promotion_never_lets_a_count_fall(spark, old, new, removed, reason):
    gone = spark.createDataFrame([("a", removed)], "import_id string, removed long")
    r = audits.promotion_decision(_readings(spark, ("a", old)), _readings(spark, ("a", new)), gone).first()
    assert (r["reason"], r["promote"]) == (reason, reason == "improved")


def test_promotion_of_new_and_lost_imports(spark):
    got = audits.promotion_decision(_readings(spark, ("a", {}), ("b", {})), _readings(spark, ("b", {}), ("c", {}))).collect()
    assert {r["import_id"]: (r["reason"], r["promote"]) for r in got} == {"a": ("lost", False), "b": ("unchanged", False), "c": ("added", True)}


RISK = "import_id string, id long, page_number int, prompt string, question_type string, answer string, flags array<string>, choices array<string>, number_origin string, key_confidence string, key_method string, has_visual boolean, visual_code string, image string, crop string"


@pytest.mark.parametrize(
    ("change", "codes", "state"),
    [
        ({}, "", "complete"),
        ({"page_number": 0}, "source_evidence_missing", "major"),
        ({"prompt": " 1234567 "}, "prompt_suspect", "minor"),
        ({"prompt": "12345678"}, "", "complete"),
        ({"answer": " "}, "required_answer_missing", "major"),
        ({"choices": ["a", "b", "c"]}, "choice_structure", "minor"),
        ({"choices": ["a", "b", " ", "d"]}, "choice_structure", "minor"),
        ({"choices": None, "question_type": "typed"}, "", "complete"),
        ({"flags": ["legacy_parser_unverified", "legacy_parser_unverified"]}, "parser:legacy_parser_unverified", "minor"),
        ({"flags": ["number_inference_after_duplicate"]}, "parser:number_inference_after_duplicate", "major"),
        ({"flags": ["what is this"], "number_origin": "inferred"}, "parser:what is this,question_number_inferred", "major"),
        ({"key_confidence": "low", "key_method": "module_position"}, "answer_alignment_low_confidence", "minor"),
        ({"key_method": "recovered_question_id"}, "answer_alignment_low_confidence", "minor"),
        ({"has_visual": True}, "visual_source_missing", "major"),
        ({"has_visual": True, "image": "x"}, "crop_unconfirmed", "minor"),
        ({"has_visual": True, "image": "x", "crop": "confirmed"}, "", "complete"),
        ({"has_visual": True, "visual_code": "plot"}, "", "complete"),
    ],
)
def test_draft_risks(spark, change, codes, state):
    names = [c.split()[0] for c in RISK.split(", ")]
    row = dict.fromkeys(names) | {"import_id": "x", "id": 1, "page_number": 1, "prompt": "A long enough prompt", "question_type": "multiple_choice", "answer": "A", "choices": ["a", "b", "c", "d"], "has_visual": False} | change
    r = audits.draft_risks(spark.createDataFrame([tuple(row[n] for n in names)], RISK)).first()
    assert (r["codes"], r["state"]) == (codes, state)


def test_import_risks(spark):
    schema = "import_id string, status string, family string, pages_failed long, retries_failed long, inferred_numbers long, key_status string, key_source string, fallback_matches long, key_diagnostics long, parser_warnings long"
    imports = [("whole", "completed", "full_test", 0, 0, 0, "complete", "parsed", 0, 0, 0), ("none", "failed", "full_test", 1, None, 2, None, "model", 1, 1, 1), ("bank", "completed", "bank", 0, 0, 0, "complete", None, 0, 0, 0), ("bad", "completed", "full_test", 0, 0, 0, "complete", None, 0, 0, 0)]
    whole = [("whole", m, None, None, i + 1) for m, n in ((0, 27), (1, 27), (2, 22), (3, 22)) for i in range(n)]
    drafts = [*whole, ("bank", None, None, None, 1), ("bad", 0, 2, "reading_writing", 1), ("bad", 0, 1, "math", 1), ("bad", None, None, None, 0)]
    out = audits.import_risks(spark.createDataFrame(drafts, "import_id string, module int, position int, section string, number int"), spark.createDataFrame(imports, schema))
    got = {r["import_id"]: (r["questions"], r["major"], r["warnings"]) for r in out.collect()}
    assert got["whole"] == (98, "", "") and got["bank"] == (1, "", "")
    assert got["none"] == (0, "import_processing_failed,no_readable_questions", "ocr_page_failure,inferred_question_numbers,answer_key_warning,answer_key_source,positional_key_matches,answer_key_diagnostics,parser_warnings")
    assert got["bad"] == (3, "full_test_question_count,explicit_module_order_conflict,module_distribution,module_assignment,duplicate_question_identity", "")


def test_section_transition_needs_whole_windows_after_the_first_twenty(spark):
    texts = ["prose about a percentage"] * 24 + ["the slope is", "$x = 2$", "more prose", "a triangle", "prose", "end"]
    df = lambda t: spark.createDataFrame([("x", i, v) for i, v in enumerate(t)], "import_id string, seq int, text string")
    at = lambda t: ingestion.section_transition(df(t), "text").first()["transition"]
    assert at(texts) == 23
    assert at(["an equation"] * 30) == 20 and at(["an equation"] * 24) is None and at(["an equation"] * 25) == 20
    assert at(["$a \\frac b$"] * 30) == 20 and at(["cost $5 and $6"] * 30) is None and at(["subequations"] * 30) is None


def test_verified_removals(spark):
    before = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")], "import_id string, fp string")
    after = spark.createDataFrame([("a", "x"), ("b", "z"), ("b", "z")], "import_id string, fp string")
    assert {r["import_id"]: r["removed"] for r in audits.verified_removals(before, after).collect()} == {"a": 2, "b": 0}


def test_answers_match_by_position_only_when_counts_agree(spark):
    q = spark.createDataFrame([("a", 1, 0, 1), ("a", 2, 0, None), ("b", 1, 0, 1), ("b", 2, 0, None), ("b", 3, 0, None)], "import_id string, seq int, module int, number int")
    k = spark.createDataFrame([("a", 1, 0, 1, "A"), ("a", 2, 0, 2, "B"), ("b", 1, 0, 1, "A"), ("b", 2, 0, 2, "B")], "import_id string, entry int, module int, number int, answer string")
    got = {(r["import_id"], r["seq"]): r["method"] for r in ingestion.match_answers(q, k).collect()}
    assert got == {("a", 1): "question_id", ("a", 2): "module_position", ("b", 1): "question_id", ("b", 2): "unmatched", ("b", 3): "unmatched"}


def test_answers_are_refused_where_the_order_or_the_count_differs(spark):
    q = spark.createDataFrame([("a", 1, 0, 2), ("a", 2, 0, None), ("b", 1, 0, 1), ("b", 2, 1, 1), ("c", 1, 0, 1), ("c", 2, 0, 2), ("d", 1, 0, 1)], "import_id string, seq int, module int, number int")
    k = spark.createDataFrame([("a", 1, 0, 1, "A"), ("a", 2, 0, 2, "B"), ("b", 1, None, 1, "C"), ("b", 2, None, 2, "D"), ("c", 1, None, 1, "A"), ("d", 1, 3, 1, "B")], "import_id string, entry int, module int, number int, answer string")
    out = ingestion.match_answers(q, k)
    assert {(r["import_id"], r["seq"]): (r["method"], r["answer"]) for r in out.collect()} == {("a", 1): ("question_id", "B"), ("a", 2): ("unmatched", None), ("b", 1): ("document_position", "C"), ("b", 2): ("document_position", "D"), ("c", 1): ("unmatched", None), ("c", 2): ("unmatched", None), ("d", 1): ("unmatched", None)}
    assert {(r["import_id"], r["entry"]): r["reason"] for r in ingestion.unmatched_keys(q, k, out).collect()} == {("a", 1): "no_matching_question", ("c", 1): "question_key_count_mismatch", ("d", 1): "no_matching_question"}
    only = spark.createDataFrame([("x",)], "import_id string")
    assert ingestion.match_answers(q, k, only).filter("method = 'document_position'").count() == 0


def test_labels(spark):
    labels = spark.createDataFrame([(1, "March 2024 US Form A"), (2, "mar 2024 int"), (3, "June 2024 US"), (4, "March 2024")], "id long, label string")
    sources = spark.createDataFrame([(9, "March 2024 US Form A")], "id long, label string")
    assert {r["id"]: r["verdict"] for r in ingestion.find_existing(labels, sources).collect()} == {1: "duplicate", 2: "new", 3: "new", 4: "review"}


def test_wilson_and_empty_wholes(spark):
    counts = spark.createDataFrame([("a", 0, 0), ("b", 5, 10)], "metric string, part long, whole long")
    got = {r["metric"]: r for r in evaluation.rates(counts, []).collect()}
    assert got["a"]["value"] is None and got["a"]["low"] is None
    assert got["b"]["low"] < 0.5 < got["b"]["high"]


def test_finalize_once_keeps_the_first(spark):
    e = spark.createDataFrame([(1, "b", 2.0, 5), (1, "a", 1.0, 5), (1, "c", 3.0, 9)], "attempt_id long, event_id string, score double, at long")
    r = grading.finalize_once(e).first()
    assert (r["event_id"], r["score"], r["tries"]) == ("a", 1.0, 3)


def test_submission_audit_rules(spark):
    t = spark.createDataFrame([(1, "d", "s", 1, 2), (1, "d", "s", 1, 1), (2, " ", "s", 1, 1)], "attempt_id long, domain string, skill string, attempted long, correct long")
    c = spark.createDataFrame([(1, 7), (1, 7), (2, 7)], "attempt_id long, question_id long")
    got = {(r["attempt_id"], r["rule"]) for r in grading.submission_audit(t, c).collect()}
    assert got == {(1, "correct_exceeds_total"), (1, "duplicate_correction"), (1, "duplicate_topic"), (2, "blank_domain")}


def test_repeats_of_a_question(spark):
    long = "alpha beta gamma delta epsilon " * 20_000
    rows = [
        ("i", 0, 1, 1, 3, "alpha beta gamma delta epsilon", ["Yes"], ["a"]),
        ("i", 0, 1, 2, 6, "Alpha beta gamma delta epsilon zeta", ["yes "], ["b", "a"]),
        ("i", 0, 1, 3, 7, "alpha beta gamma delta epsilon", [], []),
        ("i", 0, 1, 4, 4, "alpha beta gamma delta epsilon", ["No"], []),
        ("i", 0, 2, 5, 3, long, [], []),
        ("i", 0, 2, 6, 3, long, [], []),
        ("i", 0, 2, 7, 3, None, [], []),
        ("i", 0, 2, 8, 3, "", [], []),
    ]
    drafts = spark.createDataFrame(rows, "import_id string, module int, number int, id long, page_number int, prompt string, choices array<string>, flags array<string>")
    got = {(r["kept"], r["dropped"]): (r["page_number"], r["overlap_permille"], r["flags"]) for r in ingestion.coalesce_repeats(drafts).collect()}
    flag = ingestion.REPEATED
    assert got == {(2, 1): (3, 1000, f"a,b,{flag}"), (2, 3): (6, 1000, f"a,b,{flag}"), (4, 3): (4, 1000, flag), (5, 6): (3, 1000, flag)}
    assert ingestion.coalesce_repeats(drafts.limit(0)).count() == 0


def test_all_pages_of_a_dump(spark):
    from gradeloom.sources import tables

    dump = "front matter\n" + "\n".join(f"===== PAGE {i} =====\nline {i}\n" for i in range(1, 301))
    pages = tables.split_pages(spark.createDataFrame([(1, dump), (2, "no page"), (3, None), (4, "")], "id long, dump string"), "id", "dump")
    assert [(r["id"], r["page_number"]) for r in pages.orderBy("page_number").collect()] == [(1, i) for i in range(1, 301)]


def test_evaluation_counts_by_id_and_compares_in_one_spelling(spark):
    gold = [("a", "x", "It’s  “one”", "P", ["A", "B"], "1/2", True), ("b", "x", "two", None, [], None, False), ("c", "x", "three", "Q", ["A"], "3", True), ("d", "y", "four", None, ["ﬁ"], "4", False)]
    predicted = [("a", 1, "wrong", None, None, None, None, "failed"), ("a", 2, "It's \"one\"", "p", ["A ", " B"], "１/2", True, "complete"), ("b", 1, "two", "new", ["Z"], "9", True, "review"), ("d", 1, "four!", None, ["fi"], "5", None, None), ("z", 1, "?", None, None, None, None, "complete")]
    out = evaluation.evaluate_extraction(spark.createDataFrame(gold, "id string, section string, prompt string, passage string, choices array<string>, answer string, visual boolean"), spark.createDataFrame(predicted, "id string, seq int, prompt string, passage string, choices array<string>, answer string, visual_correct boolean, review_state string"), ["section"])
    rows = [tuple(r) for r in out.collect()]
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    assert {m: got["x", m] for m in ("question_precision", "question_recall", "prompt_exact", "passage_exact", "choice_exact", "key_coverage", "key_accuracy", "visual_association", "complete_coverage", "human_review_rate", "failed_rate")} == {
        "question_precision": (3, 3), "question_recall": (2, 3), "prompt_exact": (2, 2), "passage_exact": (0, 1), "choice_exact": (1, 1), "key_coverage": (2, 2), "key_accuracy": (1, 2), "visual_association": (1, 1), "complete_coverage": (1, 2), "human_review_rate": (1, 2), "failed_rate": (0, 2)}
    assert got["y", "choice_exact"] == (1, 1) and got["y", "prompt_exact"] == (0, 1) and got[None, "question_precision"] == (0, 1)


def test_findings_match_once_for_each_key(spark):
    q = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    gold = spark.createDataFrame([("a", "t", "f", 1, "major"), ("a", "t", "f", 1, "major"), ("b", "t", None, 2, "minor"), ("c", "t", "f", 3, "major")], "id string, issue_type string, field string, page int, severity string")
    found = spark.createDataFrame([("a", "t", "f", 1), ("a", "t", "f", 1), ("a", "t", "f", 1), ("b", "t", None, 2), ("c", "t", "g", 3), ("e", "t", "f", 1)], "id string, issue_type string, field string, page int")
    states = spark.createDataFrame([("a", "complete"), ("b", "complete"), ("c", "review"), ("d", "complete"), ("z", "complete")], "id string, review_state string")
    got = {r[0]: (r[1], r[2]) for r in (tuple(x) for x in evaluation.finding_match(q("a", "b", "c", "d", "e"), gold, states, found).collect())}
    assert got == {"precision": (2, 6), "recall": (2, 4), "serious_recall": (2, 3), "clean_specificity": (1, 2), "serious_defect_complete": (1, 3)}


def test_evidence_in_nfkc(spark):
    df = spark.createDataFrame([("ﬁve ＡＢＣ ①", "five abc 1"), ("Été", "Été"), (None, None)], "x string, y string")
    assert [r["same"] for r in df.select(E.evidence(F.col("x")).eqNullSafe(E.evidence(F.col("y"))).alias("same")).collect()] == [True] * 3


def test_asof_takes_the_first_right_row_from_the_cutoff_on(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (1, 20), (2, 1), (None, 5)], "k int, cut int")
    right = spark.createDataFrame([(1, 5, "at"), (1, 7, None), (1, 9, "nine"), (1, None, "never"), (3, 1, "other")], "k int, at int, v string")
    got = sorted((r["k"] or 0, r["cut"], r["hit"]) for r in R.asof_forward(left, right, ["k"], "cut", "at", F.struct("v", "at"), "hit").collect())
    assert [(k, c, h and (h["v"], h["at"])) for k, c, h in got] == [(0, 5, None), (1, 5, ("at", 5)), (1, 9, ("nine", 9)), (1, 20, None), (2, 1, None)]
    assert R.asof_forward(left.filter("cut = 5 and k = 1"), right.filter("at = 7"), ["k"], "cut", "at", F.col("v"), "hit").first()["hit"] is None


def test_migration_and_its_inverse_give_back_the_snapshot(spark):
    old = f"student_id long, card_id long, scheduler_version string, state_version long, status string, legacy_lapses int, {reviews.FSRS_STATE}"
    none = (None,) * 8
    states = spark.createDataFrame([(1, 1, "sm-2", 4, "mature", 1, *none), (1, 2, "fsrs-6", 2, "review", 0, 5.0, 6.0, 2, 3, 0, 0, 1440, 9), (1, 3, "sm-2", 1, "young", 5, *none), (1, 4, None, 7, "young", None, *none)], old)
    log = spark.createDataFrame([(1, 1, 1, 3, "study", "2026-01-01 00:00:00"), (1, 1, 2, 3, "study", "2026-01-02 00:00:00"), (2, 9, 3, 3, "study", "2026-01-02 00:00:00"), (1, 3, 4, 3, "sprint", "2026-01-02 00:00:00")], "student_id long, card_id long, review_id long, rating int, mode string, created_at string")
    counts = reviews.schedule_migration(states, log).first().asDict()
    assert counts == {"states": 4, "reviews": 3, "schedules": 5, "already": 1, "pending": 4, "without_history": 2}
    diff = reviews.migration_diff(states, log).cache()
    got = {(r["student_id"], r["card_id"]): (r["before"] and r["before"]["state_version"], r["after"]["state_version"], r["after"]["status"], r["after"]["reps"]) for r in diff.collect()}
    assert got == {(1, 1): (4, 5, "review", 2), (1, 3): (1, 2, "leech", 0), (1, 4): (7, 8, "new", 0), (2, 9): (None, 1, "learning", 1)}
    new = reviews.migrated(states, diff).cache()
    assert new.count() == 5 and new.filter("scheduler_version = 'fsrs-6'").count() == 5
    rows = lambda df: sorted(map(str, df.select(states.columns).collect()))
    assert rows(reviews.rolled_back(new, diff)) == rows(states)
    # a card that was reviewed in between keeps its newer state, both ways
    later = states.withColumn("state_version", F.col("state_version") + F.when(F.col("card_id") == 1, 1).otherwise(0))
    assert {r["card_id"]: r["scheduler_version"] for r in reviews.migrated(later, diff).collect()}[1] == "sm-2"
    moved = new.withColumn("state_version", F.col("state_version") + F.when(F.col("card_id") == 9, 1).otherwise(0))
    assert {r["card_id"] for r in reviews.rolled_back(moved, diff).collect()} == {1, 2, 3, 4, 9}


def test_fingerprints_take_section_type_choices_and_key(spark):
    schema = "id long, section string, kind string, passage string, prompt string, choices array<struct<label:string,text:string>>, answer string, file string, number int"
    base = ("math", "multiple_choice", None, "What  is “x”?", [("a", "One"), ("b", "two..")], "A")
    def of(**change):  # noqa: E306
        return tuple((dict(zip(("section", "kind", "passage", "prompt", "choices", "answer"), base)) | change).values())
    rows = [(1, *base, "b", 1), (2, *of(prompt='what is "X"?', choices=[("A", "one "), ("B", "TWO")], answer="a"), "a", 9), (3, *base, "a", 2), (4, *of(answer=None), "a", 1), (5, *of(section="rw"), "a", 1), (6, *of(kind="typed"), "a", 1), (7, *of(choices=[("b", "One"), ("a", "two..")]), "a", 1), (8, *of(answer=""), "c", 1), (9, *of(prompt=" ", choices=None), "c", 1), (10, *of(prompt=" ", choices=None), "c", 1)]
    got = {r["id"]: (r["size"], r["canonical"], r["is_copy"]) for r in ingestion.exact_duplicates(spark.createDataFrame(rows, schema), "id", ["file", "number"]).collect()}
    assert got == {1: (3, 3, True), 2: (3, 3, True), 3: (3, 3, False), 4: (2, 4, False), 8: (2, 4, True)}


def _keys(spark, text):
    rows = [("x", 1, i, t) for i, t in enumerate(text.strip().splitlines())]
    out = ingestion.scoped_keys(spark.createDataFrame(rows, "import_id string, page_number int, line_no int, line string"))
    return out, sorted((r["module"], r["place"], r["number"], r["answer"], r["heading"]) for r in out.collect())


def test_keys_after_an_early_heading_go_back_to_the_module_before(spark):
    rw1 = "\n".join(["# Reading and Writing Module 1 Answers", *[f"{i}. A" for i in range(1, 28)]])
    rw2 = "\n".join(["Reading and Writing Module 2 Answer", *[f"**{i})** B **" for i in range(1, 26)]])
    tail = "\n".join(["Math Module 1 Answers", "26. C", "27. D", "no entry", *[f"{i}. {i}/4" for i in range(1, 23)]])
    rest = "\n".join(["math module 2 answers", *[f"{i}. x = {i}" for i in range(1, 23)]])
    out, got = _keys(spark, "\n".join(["9. lost", rw1, rw2, tail, rest]))
    assert [(m, p, n, a, h) for m, p, n, a, h in got if m == 1][-2:] == [(1, 26, 26, "C", 2), (1, 27, 27, "D", 2)]
    assert [g[3] for g in got if g[0] == 2][:2] == ["1/4", "2/4"] and got[-1] == (3, 22, 22, "x = 22", 3)
    r = ingestion.scoped_exactness(out).first()
    assert ([r[f"c{i}"] for i in range(4)], r["astray"], r["exact"]) == ([27, 27, 22, 22], 0, True)
    # a number that isn't the next one of the module before, or fits its own module, stays
    out, got = _keys(spark, "Reading and Writing Module 2 Answers\n1. A\nMath Module 1 Answers\n27. B\n2. C\n23. D")
    assert [(m, n) for m, _, n, _, _ in got] == [(1, 1), (2, 27), (2, 2), (2, 23)] and not ingestion.scoped_exactness(out).first()["exact"]


@pytest.mark.parametrize(("before", "after", "goes_on"), [([1, 10], [2, 11], True), ([1, 10], [2, 12], False), ([1, 2, 3], [4, 5, 6], True), ([1, 2], [3, 5], True), ([1, 2, 3], [4, 5], False), ([5, 9, 13], [6, 10], True), ([], [1], False), ([3], [3], False)])
def test_rows_of_key_tables_go_on(spark, before, after, goes_on):
    df = spark.createDataFrame([(before, after)], "b array<int>, a array<int>")
    assert df.select(ingestion.rows_continue(F.col("b"), F.col("a")).alias("x")).first()["x"] is goes_on


def test_error_log_filters_a_page_but_counts_what_needs_review_over_all(spark):
    schema = "student_id long, attempt_id long, question_id long, section string, module_id int, domain string, skill string, choice_no int, typed_text string, key_no int, is_correct boolean, is_answered boolean, attempt_status string"
    row = lambda a, q, right, answered, domain="D", skill="S", status="graded": (1, a, q, "math", 0, domain, skill, 2 if answered else None, None, 3, right, answered, status)
    rows = [row(1, q, q % 2 == 0, True) for q in range(1, 30)] + [row(2, 1, False, False, "E"), row(2, 2, None, True, "E", None), row(3, 1, False, True, status="submitted"), row(4, 1, True, False)]
    df = spark.createDataFrame(rows, schema)
    sub = spark.createDataFrame([(1, "2026-01-01", False), (2, "2026-02-01", False), (4, None, True)], "attempt_id long, submitted_at string, released boolean").withColumn("submitted_at", F.to_timestamp("submitted_at"))
    notes = spark.createDataFrame([(1, 1, "mine", "2026-01-02"), (1, 3, "later", None), (1, 2, "right anyway", "2026-01-02")], "attempt_id long, question_id long, note_text string, reviewed_at string")
    log = lambda *a, **k: sorted(((r["n"], r["attempt_id"], r["question_id"], r["total"], r["needs_review"], r["note_text"], r["reviewed"]) for r in grading.error_log(df, sub, notes, *a, **k).collect()))
    first = log(1, 50)
    assert [x[:3] for x in first] == [(1, 2, 1), (2, 2, 2), (3, 1, 1), (4, 1, 3), (5, 1, 5), (6, 1, 7), (7, 1, 9), (8, 1, 11), (9, 1, 13), (10, 1, 15)] and {x[3:5] for x in first} == {(18, 17)}
    assert first[2][5:] == ("mine", True) and first[3][5:] == ("later", False)
    assert [x[:3] for x in log(2, 10)][-1] == (18, 4, 1)  # right but unanswered, and not submitted
    assert [x[:5] for x in log(0, 0, domain=" E ")] == [(1, 2, 1, 2, 17)] and log(1, 10, domain="E", skill="S")[0][3] == 1 and log(1, 10, domain=" ", skill="")[0][3] == 18
    numbers = {(r["attempt_id"], r["question_id"]): r["question_number"] for r in grading.error_log(df, sub, notes).collect()}
    assert numbers[1, 15] == 15 and numbers[2, 2] == 2
    assert {(r["attempt_id"], r["explained"]) for r in grading.attempt_review(df, sub, F.lit("2026-02-01").cast("timestamp")).collect()} == {(1, True), (2, False), (4, True)}
    facets = grading.error_facets(df).first()
    assert (facets["domains"], facets["skills"]) == ("D,E", "S")


def test_assignments_find_their_batch_title_and_newest_attempt(spark):
    given = spark.createDataFrame([(1, 9, 1, None, "2026-01-01", "2026-01-05", "assigned"), (2, 9, 2, 50, "2026-01-01", None, "assigned"), (3, 9, 3, 99, "2026-01-01", "2026-12-01", "expired"), (4, 9, 2, None, "2026-01-01", "2026-12-01", "completed")], "assignment_id long, student_id long, test_id long, full_batch_id long, assigned_at string, due_at string, status string")
    tried = spark.createDataFrame([(10, 2, "2026-01-02", None, "in_progress"), (11, 2, "2026-01-02", "2026-01-03", "graded"), (12, None, "2026-02-02", None, "graded")], "attempt_id long, assignment_id long, started_at string, submitted_at string, status string")
    tests = spark.createDataFrame([(1, "One", "practice"), (2, "Two", "full")], "test_id long, title string, kind string")
    practice = spark.createDataFrame([(5, 1, "Old", 10, 1, "A"), (6, 1, None, 20, 2, "B"), (7, 2, "Not me", 5, 1, "A")], "batch_id long, snapshot_test_id long, title string, timer_minutes int, class_id long, class_name string")
    full = spark.createDataFrame([(50, "Fifty", 3, "C")], "batch_id long, title string, class_id long, class_name string")
    scores = spark.createDataFrame([(11, 40, 98), (10, 1, 98)], "attempt_id long, raw long, total long")
    times = spark.createDataFrame([(11, 30), (11, None), (10, 5)], "attempt_id long, seconds int")
    now = F.lit("2026-06-01").cast("timestamp")
    got = {r["assignment_id"]: r for r in progress.assignment_rows(given, tried, scores, times, tests, practice, full, now).collect()}
    assert [got[1][c] for c in ("kind", "batch_id", "title", "class_name", "timer_minutes", "progress", "seconds")] == ["practice", 6, "One", "B", 20, "overdue", None]
    assert [got[2][c] for c in ("kind", "batch_id", "title", "timer_minutes", "progress", "attempt_id", "raw", "accuracy", "seconds")] == ["full", 50, "Fifty", None, "completed", 11, 40, 40.8, 30]
    assert [got[3][c] for c in ("kind", "batch_id", "title", "progress")] == ["full", None, "Assigned test", "expired"]
    items = {r["assignment_id"]: (r["title"], r["kind"], r["state"], r["leads_to"], r["target_id"]) for r in progress.dashboard_items(given, tried, tests, now).collect()}
    assert items == {1: ("One", "practice", "overdue", "start", 1), 2: ("Two", "test", "complete", "score", 11), 3: ("Unavailable assignment", "test", "assigned", "list", None), 4: ("Two", "test", "complete", "list", None)}


def test_submission_audit_goes_over_topics_once(spark):
    rows = [(1, "A", "x", 3, 3), (1, "A", "x", 1, 2), (1, None, "x", 1, 0), (1, " ", "x", 1, 0), (1, " ", "x", 1, 0), (2, "A", None, 1, 2), (2, "A", None, None, 2), (None, "", "x", 1, 2), (3, "B", "x", 5, 1)]
    names = ("attempt_id", "domain", "skill", "attempted", "correct")
    topics = spark.range(len(rows)).select(*[F.element_at(F.array(*[F.lit(r[i]).cast(kind) for r in rows]), F.col("id").cast("int") + 1).alias(c) for i, (c, kind) in enumerate(zip(names, ("long", "string", "string", "int", "int")))])
    out = grading.submission_audit(topics, spark.createDataFrame([(3, 7), (3, 7)], "attempt_id long, question_id long"))
    assert {tuple(r) for r in out.select("attempt_id", "rule", "n").collect()} == {(1, "correct_exceeds_total", 1), (1, "blank_domain", 3), (1, "duplicate_topic", 2), (2, "correct_exceeds_total", 1), (2, "duplicate_topic", 1), (None, "correct_exceeds_total", 1), (None, "blank_domain", 1), (3, "duplicate_correction", 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def _graded(spark, n=50):
    roster = spark.range(n).select((F.col("id") % 20).alias("attempt_id"), F.col("id").alias("question_id"), F.lit(0).alias("module_id"), F.lit(1).alias("points"))
    attempts = spark.range(20).select(F.col("id").alias("attempt_id"), (F.col("id") % 7).alias("student_id"), F.lit(1).alias("assignment_id"), F.lit(1).alias("test_id"), F.lit("2026-01-01").alias("started_at"), F.lit("graded").alias("status"))
    responses = roster.select("attempt_id", "question_id", F.lit(0).alias("choice_no"), F.lit(None).cast("string").alias("typed_text"), F.lit(5).alias("seconds"))
    questions = spark.range(n).select(F.col("id").alias("question_id"), F.lit("math").alias("section"), (F.col("id") % 3).cast("string").alias("domain"), F.lit("x").alias("skill"), F.lit(1).alias("difficulty"), F.lit("choice").alias("question_type"), (F.col("id") % 2).cast("int").alias("key_no"), F.lit("1").alias("key_text"), F.lit("?").alias("prompt"), F.lit("active").alias("status"))
    return grading.grade_responses(roster, attempts, responses, questions)


def test_graded_rows_stay_in_all_partitions(spark):
    graded = _graded(spark)
    assert graded.filter("is_correct").count() == 25
    assert graded.groupBy("attempt_id").count().rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_totals_are_added_in_all_partitions_of_students(spark):
    graded = _graded(spark)
    totals = [grading.topic_totals(graded.filter(F.col("attempt_id") % 2 == k)) for k in (0, 1)]
    out = R.upsert_sum(*totals, ["student_id", "domain", "skill"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert totals[0].rdd.getNumPartitions() == out.rdd.getNumPartitions() == n
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in grading.topic_totals(graded).collect()} and out.agg(F.sum("attempted"), F.sum("correct")).first() == (50, 25)


def test_score_rollup_sums_modules_in_all_partitions(spark):
    out = grading.score_rollup(_graded(spark))
    rows = {r["attempt_id"]: (r["raw"], r["total_questions"]) for r in out.filter("level = 'attempt'").collect()}
    assert len(rows) == 20 and rows[0] == (3, 3) and rows[1] == (0, 3) and rows[19] == (0, 2) and out.count() == 60
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_roster_and_responses_meet_in_all_partitions(spark, sf):
    views = Views(spark, sf)
    both = views.roster.join(views.responses.hint("merge"), ["attempt_id", "question_id"], "left")
    assert both.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
