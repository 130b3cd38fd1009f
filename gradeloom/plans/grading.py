"""Queries of the grading family and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import expressions as E
from gradeloom.operators import grading as G
from gradeloom.plans.adapters import NOW, Views, sql

GRADED = """graded as (select k.attempt_id, a.student_id, a.assignment_id, a.test_id, a.status as attempt_status, a.started_at, k.question_id, k.module_id, q.section, q.domain, q.skill, q.difficulty, q.question_type, r.choice_no, q.key_no, r.typed_text, r.seconds,
  case when q.question_type = 'typed' then coalesce(cast(split_part(r.typed_text, '/', 1) as double) / cast(split_part(r.typed_text, '/', 2) as double) = cast(split_part(q.key_text, '/', 1) as double) / 4, false) else coalesce(r.choice_no = q.key_no, false) end as is_correct,
  case when q.question_type = 'typed' then r.typed_text is not null else r.choice_no is not null end as is_answered
  from roster k join attempts a on k.attempt_id = a.attempt_id join questions q on k.question_id = q.question_id left join responses r on r.attempt_id = k.attempt_id and r.question_id = k.question_id)"""


def graded(v: Views):
    return G.grade_responses(v.roster, v.attempts, v.responses, v.questions)


def g(query: str) -> str:
    return sql(f"with {GRADED}{' ' if query.lower().startswith('select') else ', '}{query}")


PCT = "floor(({a})::double / nullif({b}, 0)::double * 1000 + 0.5) / 10"


def pct(a: str, b: str) -> str:
    return PCT.format(a=a, b=b)


def _topics(v: Views):
    rows = graded(v)
    return rows.groupBy("attempt_id", F.when(F.col("question_id") % 97 != 0, F.col("domain")).alias("domain"), F.coalesce("skill", F.lit("")).alias("skill")).agg(F.count("*").alias("attempted"), F.sum(F.col("is_correct").cast("int")).alias("correct"))


#: Submissions and students' notes on their errors, in the SQL that both engines share.
_SUBMITTED = "select o_orderkey as attempt_id, case when o_orderkey % 13 > 0 then o_orderdate + interval '5' day end as submitted_at, o_orderkey % 17 = 0 as released from {orders}"
_NOTES = "select l_orderkey as attempt_id, l_partkey as question_id, concat('note ', count(*)) as note_text, case when (l_orderkey + l_partkey) % 3 = 0 then max(l_shipdate) end as reviewed_at from {lineitem} where (l_orderkey + l_partkey) % 4 <> 1 group by l_orderkey, l_partkey"


def _submitted(v: Views):
    return v.spark.sql(_SUBMITTED, orders=v.orders)


def _errors(v: Views, *page, **only):
    return G.error_log(graded(v), _submitted(v), v.spark.sql(_NOTES, lineitem=v.lineitem), *page, **only)


def _error_sql(page: int, size: int, asked: str) -> str:
    return g(f"""sb as ({_SUBMITTED.format(orders="orders")}), nt as ({_NOTES.format(lineitem="lineitem")}), al as (select *, row_number() over (partition by attempt_id order by section desc, module_id, question_id) as question_number from graded where attempt_status = 'graded'),
      er as (select al.*, submitted_at, note_text, reviewed_at, {asked} as asked from al left join sb using (attempt_id) left join nt using (attempt_id, question_id) where not is_answered or is_correct is distinct from true)
      select student_id, attempt_id, question_id, question_number, domain, skill, coalesce('choice ' || choice_no, nullif(trim(typed_text), '')) as your_answer, not is_answered as unanswered, coalesce(note_text, '') as note_text, reviewed_at is not null as reviewed, n, total, needs_review
      from (select *, count(*) filter (asked) over (partition by student_id order by submitted_at desc nulls last, attempt_id desc, section desc, module_id, question_id rows unbounded preceding) as n, count(*) filter (asked) over (partition by student_id) as total, count(*) filter (reviewed_at is null) over (partition by student_id) as needs_review from er)
      where asked and n between {(page - 1) * size + 1} and {page * size}""")


LATEST_GRADED = "lg as (select arg_max(attempt_id, (started_at, attempt_id)) as attempt_id from attempts where status = 'graded' group by assignment_id)"

QUERIES = {
    "g1_grade_responses": lambda v: graded(v).select("attempt_id", "question_id", "is_correct", "is_answered", "points"),
    "g2_score_rollup": lambda v: G.score_rollup(graded(v)),
    "g3_topic_totals": lambda v: G.topic_totals(graded(v)),
    "g4_attempt_review": lambda v: G.attempt_review(graded(v), _submitted(v), F.lit("1995-06-01 00:00:00").cast("timestamp")),
    "g5_error_log": lambda v: _errors(v),
    "g5_error_log_filtered": lambda v: _errors(v, 2, 3, domain=" Brand#23 "),
    "g5_error_facets": lambda v: G.error_facets(graded(v)),
    "g6_score_history": lambda v: G.score_history(graded(v)),
    "g6_results_summary": lambda v: G.results_summary(graded(v)),
    "g7_score_report": lambda v: G.score_report(graded(v)),
    "g8_item_analysis": lambda v: G.item_analysis(graded(v), v.attempts, v.assignments),
    "g8_typed_answers": lambda v: G.typed_answers(graded(v), v.attempts, v.assignments),
    "g9_submission_audit": lambda v: G.submission_audit(_topics(v), v.lineitem.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("question_id"))),
    "g10_finalize_once": lambda v: G.finalize_once(v.lineitem.select(F.col("l_orderkey").alias("attempt_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").cast("string").alias("event_id"), F.col("l_quantity").alias("score"), F.col("l_shipdate").alias("at"))).select("attempt_id", "event_id", "score", "tries"),
    "g11_adaptive_route": lambda v: G.adaptive_route(graded(v)),
    "g12_constraint_audit": lambda v: G.constraint_audit(v.attempts, v.lineitem.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("question_id")), v.questions),
    "e1_answers_match": lambda v: v.questions.select("question_id", E.math_value(F.col("key_text")).alias("value"), E.answers_match(F.concat((F.col("question_id") % 51).cast("string"), F.lit("/4")), F.concat_ws(" | ", "key_text", F.lit("7/4"))).alias("matches")),
    "e14_difficulty_label": lambda v: v.questions.groupBy(E.difficulty_label(F.col("difficulty")).alias("label")).agg(F.count("*").alias("n")),
    "e12_explanations_open": lambda v: v.attempts.groupBy(E.explanations_open(F.col("test_id") == 3, F.col("started_at").cast("timestamp"), F.lit("1995-06-01 00:00:00").cast("timestamp")).alias("open"), "test_id").agg(F.count("*").alias("n")),
}

SQL = {
    "g1_grade_responses": g("select attempt_id, question_id, is_correct, is_answered, 1 as points from graded"),
    "g2_score_rollup": g(f"select attempt_id, case when grouping(section) = 1 then 'attempt' when grouping(module_id) = 1 then 'section' else 'module' end as level, section, module_id, sum(is_correct::int)::bigint as raw, count(*) as total_questions, count(*) as total_points, {pct('sum(is_correct::int)', 'count(*)')} as accuracy_points, {pct('sum(is_correct::int)', 'count(*)')} as accuracy_questions from graded group by grouping sets ((attempt_id), (attempt_id, section), (attempt_id, section, module_id))"),
    "g3_topic_totals": g("select student_id, domain, coalesce(skill, '') as skill, count(*) as attempted, sum(is_correct::int)::bigint as correct from graded where domain is not null group by 1, 2, 3"),
    "g4_attempt_review": g(f"sb as ({_SUBMITTED.format(orders='orders')}) select attempt_id, question_number, question_id, section, module_id, choice_no, is_correct, is_answered, explained, case when explained then key_no end as shown_key from (select gr.*, row_number() over (partition by attempt_id order by section desc, module_id, question_id) as question_number, released or coalesce(submitted_at + interval 7 days <= timestamp '1995-06-01', false) as explained from graded gr left join sb using (attempt_id) where attempt_status = 'graded')"),
    "g5_error_log": _error_sql(1, 10, "true"),
    "g5_error_log_filtered": _error_sql(2, 3, "coalesce(domain = 'Brand#23', false)"),
    "g5_error_facets": g("select student_id, string_agg(distinct domain, ',' order by domain) as domains, coalesce(string_agg(distinct skill, ',' order by skill), '') as skills from graded where attempt_status = 'graded' and (not is_answered or not is_correct) group by 1"),
    "g6_score_history": g(f"select student_id, attempt_id, row_number() over w as n, raw, total, {pct('raw', 'total')} as accuracy, raw - lead(raw) over w as raw_change from (select student_id, attempt_id, started_at, sum(is_correct::int)::bigint as raw, count(*) as total from graded where attempt_status = 'graded' group by 1, 2, 3) window w as (partition by student_id order by started_at desc, attempt_id desc)"),
    "g6_results_summary": g("select student_id, count(*) as attempts, sum(raw)::bigint as correct, sum(answered)::bigint as answered, floor(sum(floor(raw * 10000 / total))::double / count(*) / 10 + 0.5) / 10 as avg_accuracy from (select student_id, attempt_id, sum(is_correct::int) as raw, count(*) as total, sum(is_answered::int) as answered from graded where attempt_status = 'graded' group by 1, 2) group by 1"),
    "g7_score_report": g("select attempt_id, section, domain, count_if(is_correct) as correct, count_if(not is_correct and is_answered) as wrong, count_if(not is_correct and not is_answered) as unanswered, count(distinct skill) as skills from graded group by 1, 2, 3"),
    "g8_item_analysis": g(f"select b.batch_id, question_id, count_if(is_correct) as correct, count_if(not is_correct and is_answered) as incorrect, count_if(not is_correct and not is_answered) as unanswered, count(*) as seen, count_if(choice_no = 0) as choice_a, count_if(choice_no = 1) as choice_b, count_if(choice_no = 2) as choice_c, count_if(choice_no = 3) as choice_d, {pct('count_if(is_correct)', 'count(*)')} as accuracy from graded join (select arg_max(attempt_id, (started_at, attempt_id)) as attempt_id from attempts where status = 'graded' group by assignment_id) lg using (attempt_id) join assignments b using (assignment_id) group by 1, 2"),
    "g8_typed_answers": g("select *, row_number() over (partition by batch_id, question_id order by times desc, typed_text) as rank from (select b.batch_id, question_id, typed_text, count(*) as times from graded join (select arg_max(attempt_id, (started_at, attempt_id)) as attempt_id from attempts where status = 'graded' group by assignment_id) lg using (attempt_id) join assignments b using (assignment_id) where question_type = 'typed' and typed_text is not null group by 1, 2, 3)"),
    "g9_submission_audit": g("""select attempt_id, rule, n from (
        select attempt_id, 'duplicate_correction' as rule, count(*) as n from (select l_orderkey as attempt_id, l_partkey from lineitem group by 1, 2 having count(*) > 1) group by 1
        union all select attempt_id, 'blank_domain', count(distinct coalesce(skill, '')) from graded where question_id % 97 = 0 group by 1)"""),
    "g10_finalize_once": "select attempt_id, '{' || l_linenumber || ', ' || l_partkey || ', ' || l_suppkey || '}' as event_id, l_quantity as score, tries from (select l_orderkey as attempt_id, *, row_number() over (partition by l_orderkey order by l_shipdate, '{' || l_linenumber || ', ' || l_partkey || ', ' || l_suppkey || '}') as r, count(*) over (partition by l_orderkey) as tries from lineitem) where r = 1",
    "g11_adaptive_route": g("select attempt_id, section, count_if(is_correct) as correct, count_if(is_answered) as answered, case when count_if(is_correct)::double / nullif(count_if(is_answered), 0) >= 0.6 then 'harder' else 'easier' end as route from (select *, min(module_id) over (partition by attempt_id, section) as m from graded) where module_id = m group by 1, 2"),
    "g12_constraint_audit": sql("""select 'one_active_attempt' as rule, count(*) as violations from (select student_id, test_id from attempts where status = 'in_progress' group by 1, 2 having count(*) > 1)
        union all select 'response_key', count(*) from (select l_orderkey, l_partkey from lineitem group by 1, 2 having count(*) > 1)
        union all select 'attempt_status', count(*) from attempts where status not in ('graded', 'submitted', 'in_progress')
        union all select 'difficulty_range', count(*) from questions where difficulty not between 1 and 5
        union all select 'prompt_case_insensitive', count(*) from (select domain, lower(trim(prompt)) from questions group by 1, 2 having count(*) > 1)"""),
    "e1_answers_match": sql("select question_id, floor(cast(split_part(key_text, '/', 1) as double) / 4 * 1000000 + 0.5) / 1000000 as value, question_id % 51 = cast(split_part(key_text, '/', 1) as int) or question_id % 51 = 7 as matches from questions"),
    "e14_difficulty_label": sql("select case when difficulty <= 2 then 'easy' when difficulty >= 4 then 'hard' else 'medium' end as label, count(*) as n from questions group by 1"),
    "e12_explanations_open": sql("select test_id = 3 or started_at + interval 7 days <= timestamp '1995-06-01' as open, test_id, count(*) as n from attempts group by 1, 2"),
}
