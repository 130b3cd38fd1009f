"""Queries of the progress family, of scans, filters and joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.relational import replace_latest, upsert_sum
from gradeloom.operators import grading as G
from gradeloom.operators import progress as P
from gradeloom.plans.adapters import NOW, Views, sql
from gradeloom.plans.grading import g, graded, pct
from gradeloom.sources import tables as S


def _now():
    return F.lit("1995-06-15 00:00:00").cast("timestamp")


def _scores(v: Views):
    return graded(v).filter("attempt_status = 'graded'").groupBy("attempt_id").agg(F.sum(F.col("is_correct").cast("int")).alias("raw"), F.count("*").alias("total"))


def progress(v: Views):
    return P.assignment_progress(v.assignments, v.attempts, _scores(v), v.responses.select("attempt_id", "seconds"), _now())


_LATEST = "select assignment_id, arg_max(attempt_id, (started_at, attempt_id)) as attempt_id, arg_max(status, (started_at, attempt_id)) as attempt_status from attempts group by 1"
_PROGRESS = f"""(select b.assignment_id, b.student_id, b.batch_id, b.test_id, b.due_at, l.attempt_id, case when attempt_status = 'graded' then 'completed' when attempt_status is not null then 'in_progress' when b.status <> 'assigned' then b.status when due_at < timestamp '1995-06-15' then 'overdue' else 'assigned' end as progress, s.raw, s.total, {pct('raw', 'total')} as accuracy, t.seconds
  from assignments b left join ({_LATEST}) l using (assignment_id) left join (select attempt_id, sum(is_correct::int)::bigint as raw, count(*) as total from graded where attempt_status = 'graded' group by 1) s using (attempt_id) left join (select attempt_id, sum(seconds)::bigint as seconds from responses group by 1) t using (attempt_id)) p"""


#: Tests, batches, assignments and attempts with what the listings need, in the SQL that both engines share.
_LISTED = {
    "listed_tests": "select cast(t as bigint) as test_id, concat('Test ', t) as title, case when t < 2 then 'practice' when t = 2 then 'full' end as kind from (select distinct n_nationkey % 4 as t from {nation}) x",
    "practice_batches": "select cast(n_nationkey as bigint) as batch_id, cast(n_nationkey % 3 as bigint) as snapshot_test_id, case when n_nationkey % 5 > 0 then n_name end as title, cast(n_nationkey * 5 as int) as timer_minutes, cast(n_regionkey as bigint) as class_id, concat('Class ', n_regionkey) as class_name from {nation} where n_nationkey % 3 <> 1",
    "full_batches": "select cast(n_nationkey * 2 as bigint) as batch_id, concat('Batch of ', n_name) as title, cast(n_regionkey as bigint) as class_id, concat('Class ', n_regionkey) as class_name from {nation}",
    "tried": "select o_orderkey as attempt_id, case when o_orderkey % 23 > 0 then o_custkey * 10 + o_orderkey % 5 end as assignment_id, o_orderdate as started_at, case when o_orderstatus <> 'O' then o_orderdate end as submitted_at, case o_orderstatus when 'F' then 'graded' when 'P' then 'submitted' else 'in_progress' end as status from {orders}",
    "given": "select assignment_id, student_id, test_id, case when assignment_id % 6 > 0 then batch_id end as full_batch_id, assigned_at, due_at, case when assignment_id % 19 = 0 then 'completed' else status end as status from {assignments}",
}


def _listed(v: Views, name: str):
    return v.spark.sql(_LISTED[name], nation=v.nation, orders=v.orders, assignments=v.assignments)


def _assignment_rows(v: Views):
    return P.assignment_rows(_listed(v, "given"), _listed(v, "tried"), _scores(v), v.responses.select("attempt_id", "seconds"), _listed(v, "listed_tests"), _listed(v, "practice_batches"), _listed(v, "full_batches"), _now())


def _events(v: Views):
    return v.events.select((F.col("user_id") * 10 + F.col("event_id") % 4).alias("module_key"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") == "view", "pause").otherwise("start").alias("kind"))


def _links(v: Views):
    return v.lineitem.select((F.col("l_suppkey") % 40).alias("test_id"), (F.col("l_suppkey") % 97).alias("module_id"), F.col("l_partkey").alias("question_id"), F.col("l_linenumber").alias("position"))


def _batches(v: Views):
    return v.orders.select((F.col("o_custkey") % 300).alias("batch_id"), (F.col("o_custkey") % 300 + F.when(F.col("o_custkey") % 300 % 7 == 0, F.lit(1)).otherwise(0)).alias("snapshot_id"), F.when(F.col("o_custkey") % 300 % 5 == 0, F.col("o_custkey") % 300 + 2).alias("source_id"))


def _cards(v: Views):
    return v.part.select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("front"), F.col("p_type").alias("back"), F.split("p_name", " ").alias("tags"))


def _scoped(v: Views):
    modules = v.nation.select((F.col("n_nationkey") % 5).alias("test_id"), F.col("n_nationkey").alias("module_id"), F.when(F.col("n_nationkey") % 2 == 0, "math").otherwise("reading_writing").alias("section"))
    scope = F.when(F.col("assignment_id") % 3 == 0, "full_test").when(F.col("assignment_id") % 3 == 1, "math").otherwise("custom_modules")
    return P.scoped_modules(v.assignments.select("assignment_id", "test_id", scope.alias("scope"), F.array(F.lit(1), F.lit(7), F.lit(12), F.lit(99)).alias("module_ids")), modules)


def _deltas(v: Views):
    t = lambda cond: G.topic_totals(graded(v).filter(cond))
    return upsert_sum(t("attempt_id % 2 = 0"), t("attempt_id % 2 = 1"), ["student_id", "domain", "skill"])


QUERIES = {
    "s1_typed_scan": lambda v: S.scan(v.spark, v.dir, "part", ["p_partkey", "p_brand", "p_size"]).filter("p_size > 40"),
    "s2_semi_scan": lambda v: S.semi_scan(v.orders.select("o_orderkey", "o_custkey"), v.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"),
    "s8_upsert_sum": _deltas,
    "s9_replace_latest": lambda v: replace_latest(v.attempts.filter("attempt_id % 2 = 0"), v.attempts.filter("attempt_id % 2 = 1"), ["student_id", "test_id"], ["started_at", "attempt_id"]).select("student_id", "test_id", "attempt_id", "status"),
    "f1_bank_search": lambda v: P.bank_search(v.questions, section="math", contains="a", page=2, size=25),
    "f2_tag_search": lambda v: P.tag_search(_cards(v), "small", "bolt").select("card_id"),
    "f3_not_correct": lambda v: graded(v).filter(~F.when(F.col("is_answered"), F.col("is_correct")).eqNullSafe(True)).groupBy("domain").agg(F.count("*").alias("n")),
    "f4_visible_decks": lambda v: P.visible_decks(v.orders.select(F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % 7).alias("deck_id")), v.customer.select(F.col("c_custkey").alias("student_id"), (F.col("c_nationkey") % 9).alias("deck_id")), v.nation.filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("deck_id"))),
    "f5_scoped_modules": _scoped,
    "p1_assignment_progress": progress,
    "p1_assignment_rows": _assignment_rows,
    "p8_dashboard_items": lambda v: P.dashboard_items(_listed(v, "given"), _listed(v, "tried"), _listed(v, "listed_tests"), _now()),
    "p2_batch_rollup": lambda v: P.batch_rollup(progress(v)),
    "p3_batch_students": lambda v: P.batch_students(v.assignments, v.attempts),
    "p4_class_roster": lambda v: P.class_roster(v.classes, v.students),
    "p4_class_assignments": lambda v: P.class_assignments(v.students, progress(v)),
    "p5_student_roster": lambda v: P.student_roster(v.students, v.attempts, G.topic_totals(graded(v))),
    "p6_test_listing": lambda v: P.test_listing(v.attempts, graded(v).select("test_id", "module_id", "question_id", "section"), F.col("section") == "math"),
    "p7_module_timing": lambda v: P.module_timing(_events(v), 600, F.unix_timestamp(F.lit(NOW).cast("timestamp"))),
    "p8_dashboard_summary": lambda v: P.dashboard_summary(progress(v), v.assignments, _now()),
    "p9_practice_sets": lambda v: P.practice_sets(v.supplier.select((F.col("s_suppkey") % 40).alias("test_id")).distinct(), v.nation.select((F.col("n_nationkey") * 3).alias("test_id")), _links(v)),
    "p10_ineligible_questions": lambda v: P.ineligible_questions(v.questions),
    "p11_question_usage": lambda v: P.question_usage(_links(v)),
    "p12_deletable_batches": lambda v: P.deletable_batches(_batches(v)),
    "j1_roster_chain": lambda v: v.attempts.join(v.responses, "attempt_id").join(v.questions, "question_id").join(v.students, "student_id").join(v.classes, "class_id").groupBy("class_name", "section").agg(F.count("*").alias("n")),
    "j2_outer_responses": lambda v: v.attempts.join(v.responses.groupBy("attempt_id").agg(F.count("*").alias("n")), "attempt_id", "left").groupBy("status").agg(F.count_if(F.col("n").isNull()).alias("without"), F.count("n").alias("with")),
    "j3_choices_of_question": lambda v: v.questions.select("question_id").join(v.responses.filter("choice_no is not null").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("choice_no")), ",").alias("choices")), "question_id", "left"),
    "j5_unanswered_questions": lambda v: v.questions.join(v.responses.filter("choice_no = 3"), "question_id", "left_anti").select("question_id"),
}

_LISTING = ", ".join(f"{n} as ({q.format(nation='nation', orders='orders', assignments='(select * from assignments)')})" for n, q in _LISTED.items())
_TRIED = "select assignment_id, arg_max({{'attempt_id': attempt_id, 'status': status, 'submitted_at': submitted_at}}, (started_at, attempt_id)) as a from tried where assignment_id is not null group by 1".replace("{{", "{").replace("}}", "}")

SQL = {
    "p1_assignment_rows": g(f"""{_LISTING}, pb as (select * from practice_batches qualify row_number() over (partition by snapshot_test_id order by batch_id desc) = 1), sc as (select attempt_id, sum(is_correct::int)::bigint as raw, count(*) as total from graded where attempt_status = 'graded' group by 1), ti as (select attempt_id, sum(seconds)::bigint as seconds from responses group by 1)
      select b.assignment_id, b.student_id, b.test_id, coalesce(t.kind, 'full') as kind, case when t.kind = 'practice' then p.batch_id else f.batch_id end as batch_id, coalesce(case when t.kind = 'practice' then p.title else f.title end, t.title, 'Assigned test') as title, case when t.kind = 'practice' then p.class_id else f.class_id end as class_id,
        case when t.kind = 'practice' then p.class_name else f.class_name end as class_name, case when t.kind = 'practice' then p.timer_minutes end as timer_minutes, case when l.a.status = 'graded' then 'completed' when l.a.status is not null then 'in_progress' when b.status <> 'assigned' then b.status when b.due_at < timestamp '1995-06-15' then 'overdue' else 'assigned' end as progress,
        l.a.attempt_id as attempt_id, l.a.status as attempt_status, l.a.submitted_at is not null as submitted, sc.raw, sc.total, {pct('sc.raw', 'sc.total')} as accuracy, ti.seconds
      from given b left join listed_tests t on t.test_id = b.test_id left join pb p on p.snapshot_test_id = b.test_id left join full_batches f on f.batch_id = b.full_batch_id left join ({_TRIED}) l on l.assignment_id = b.assignment_id left join sc on sc.attempt_id = l.a.attempt_id left join ti on ti.attempt_id = l.a.attempt_id"""),
    "p8_dashboard_items": sql(f"""with {_LISTING}, r as (select b.*, l.a.attempt_id as aid, l.a.status as st, t.title, t.kind, case when b.status = 'completed' or l.a.status in ('submitted', 'graded') then 'complete' when b.due_at < timestamp '1995-06-15' then 'overdue' else 'assigned' end as state
        from given b left join ({_TRIED}) l on l.assignment_id = b.assignment_id left join listed_tests t on t.test_id = b.test_id),
      q as (select *, case when st = 'in_progress' then 'session' when st in ('submitted', 'graded') then 'score' when state = 'complete' or title is null then 'list' else 'start' end as leads_to from r)
      select student_id, assignment_id, coalesce(title, 'Unavailable assignment') as title, case when kind = 'practice' then 'practice' else 'test' end as kind, state, leads_to, case when leads_to in ('session', 'score') then aid when leads_to = 'start' then test_id end as target_id from q"""),
    "s1_typed_scan": "select p_partkey, p_brand, p_size from part where p_size > 40",
    "s2_semi_scan": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    "s8_upsert_sum": g("select student_id, domain, coalesce(skill, '') as skill, count(*) as attempted, sum(is_correct::int)::bigint as correct from graded where domain is not null group by 1, 2, 3"),
    "s9_replace_latest": sql("select student_id, test_id, arg_max(attempt_id, (started_at, attempt_id)) as attempt_id, arg_max(status, (started_at, attempt_id)) as status from attempts group by 1, 2"),
    "f1_bank_search": sql("select * from (select question_id, section, domain, difficulty, case when difficulty <= 2 then 'easy' when difficulty >= 4 then 'hard' else 'medium' end as label, count(*) over () as total, count(*) over () > 50 as has_more from questions where difficulty is not null and section = 'math' and lower(prompt) like '%a%') order by question_id desc limit 25 offset 25"),
    "f2_tag_search": "select p_partkey as card_id from part where list_contains(string_split(p_name, ' '), 'small') and lower(concat_ws(' ', p_name, p_type, p_name)) like '%bolt%'",
    "f3_not_correct": g("select domain, count(*) as n from graded where (case when is_answered then is_correct end) is distinct from true group by 1"),
    "f4_visible_decks": "select student_id, deck_id from (select o_custkey as student_id, o_orderkey % 7 as deck_id from orders union select c_custkey, c_nationkey % 9 from customer) where deck_id in (select n_nationkey from nation where n_nationkey % 4 <> 0)",
    "f5_scoped_modules": sql("select assignment_id, module_id, section from (select assignment_id, test_id, case assignment_id % 3 when 0 then 'full_test' when 1 then 'math' else 'custom_modules' end as scope from assignments) join (select n_nationkey % 5 as test_id, n_nationkey as module_id, case when n_nationkey % 2 = 0 then 'math' else 'reading_writing' end as section from nation) using (test_id) where scope = 'full_test' or scope = section or (scope = 'custom_modules' and module_id in (1, 7, 12, 99))"),
    "p1_assignment_progress": g(f"select * exclude (due_at) from {_PROGRESS}"),
    "p2_batch_rollup": g(f"select batch_id, count(distinct student_id) as student_count, count(*) as assigned, count_if(progress = 'completed') as completed_count, floor(sum(floor(accuracy * 10 + 0.5))::double / nullif(count(accuracy), 0)::double / 10 * 10.0 + 0.5) / 10.0 as avg_accuracy from {_PROGRESS} group by 1"),
    "p3_batch_students": sql("select batch_id, b.student_id, assignment_id, latest_attempt_id, latest_graded_id from assignments b left join (select assignment_id, arg_max(attempt_id, (started_at, attempt_id)) as latest_attempt_id from attempts group by 1) using (assignment_id) left join (select assignment_id, arg_max(attempt_id, (started_at, attempt_id)) as latest_graded_id from attempts where status = 'graded' group by 1) using (assignment_id)"),
    "p4_class_roster": sql("select class_id, class_name, coalesce(members, 0) as members, first_id, last_id from classes left join (select class_id, count(*) as members, min(student_id) as first_id, max(student_id) as last_id from students group by 1) using (class_id)"),
    "p4_class_assignments": g(f"select class_id, case when test_id = 0 then 'practice' else 'full_test' end as kind, count(distinct student_id) as student_count, count(*) as assigned, count_if(progress = 'completed') as completed_count from {_PROGRESS} join students using (student_id) group by 1, 2"),
    "p5_student_roster": g(f"select student_id, coalesce(attempts, 0) as attempts, coalesce(n_graded, 0) as graded, coalesce(attempted, 0) as attempted, coalesce(correct, 0) as correct, coalesce(trim(name), '') <> '' and coalesce(trim(profile), '') <> '' as profile_complete, {pct('coalesce(correct, 0)', 'coalesce(attempted, 0)')} as accuracy from students left join (select student_id, count(*) as attempts, count_if(status = 'graded') as n_graded from attempts group by 1) using (student_id) left join (select student_id, count(*) as attempted, sum(is_correct::int)::bigint as correct from graded where domain is not null group by 1) using (student_id)"),
    "p6_test_listing": g("select student_id, test_id, attempts, attempt_id, attempt_status, modules, questions from (select student_id, test_id, count(*) as attempts, arg_max(attempt_id, ((status = 'in_progress')::int, started_at, attempt_id)) as attempt_id, arg_max(status, ((status = 'in_progress')::int, started_at, attempt_id)) as attempt_status from attempts group by 1, 2) left join (select test_id, count(distinct module_id) as modules, count(distinct question_id) as questions from graded where section = 'math' group by 1) using (test_id)"),
    "p7_module_timing": f"select module_key, sum(case when event_type = 'view' then 0 else greatest(u - t0, 0) end)::bigint as active_seconds, count(*) as events, greatest(0, 36000 - sum(case when event_type = 'view' then 0 else greatest(u - t0, 0) end))::bigint as remaining from (select *, coalesce(lead(t0) over (partition by module_key order by t0, event_id), epoch(timestamp '{NOW}')::bigint) as u from (select user_id * 10 + event_id % 4 as module_key, event_id, event_type, floor(epoch(ts))::bigint as t0 from events)) group by 1",
    "p8_dashboard_summary": g(f"select student_id, count_if(progress = 'completed') as completed, count_if(progress = 'in_progress') as in_progress, count_if(progress = 'overdue') as overdue, count_if(progress = 'assigned') as assigned, count_if(progress = 'expired') as expired, count_if(cast(due_at + interval 7 hours as date) = date '1995-06-15' and progress <> 'completed') as due_today, min(date_diff('day', date '1995-06-15', cast(due_at as date)))::int as days_to_first_due from {_PROGRESS} group by 1"),
    "p9_practice_sets": "select test_id, count(distinct question_id) as questions, ceil(count(distinct question_id) * 1.5)::bigint as minutes from (select l_suppkey % 40 as test_id, l_partkey as question_id from lineitem) where test_id in (select s_suppkey % 40 from supplier) and test_id not in (select n_nationkey * 3 from nation) group by 1",
    "p10_ineligible_questions": sql("select question_id, case when status <> 'active' then 'inactive' else 'no_skill' end as reason from questions where status <> 'active' or skill is null"),
    "p11_question_usage": "select l_partkey as question_id, count(distinct l_suppkey % 97) as uses, max(l_linenumber) + 1 as next_position, count(distinct l_suppkey % 97) > 1 as shared from lineitem group by 1",
    "p12_deletable_batches": "with b as (select distinct o_custkey % 300 as batch_id, o_custkey % 300 + case when o_custkey % 300 % 7 = 0 then 1 else 0 end as snapshot_id, case when o_custkey % 300 % 5 = 0 then o_custkey % 300 + 2 end as source_id from orders) select distinct batch_id, snapshot_id from b where snapshot_id not in (select snapshot_id from b group by 1 having count(distinct batch_id) > 1) and snapshot_id not in (select source_id from b where source_id is not null)",
    "j1_roster_chain": sql("select class_name, section, count(*) as n from attempts join responses using (attempt_id) join questions using (question_id) join students using (student_id) join classes using (class_id) group by 1, 2"),
    "j2_outer_responses": sql('select status, count_if(n is null) as without, count(n) as "with" from attempts left join (select attempt_id, count(*) as n from responses group by 1) using (attempt_id) group by 1'),
    "j3_choices_of_question": sql("select question_id, choices from (select question_id from questions) left join (select question_id, string_agg(distinct choice_no::varchar, ',' order by choice_no::varchar) as choices from responses where choice_no is not null group by 1) using (question_id)"),
    "j5_unanswered_questions": sql("select question_id from questions where question_id not in (select question_id from responses where choice_no = 3)"),
}
