"""Queries of the review family and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import reviews as R
from gradeloom.plans.adapters import NOW, Views, dated, sql

_D = "date '2024-01-31'"


def _today():
    return F.lit("2024-01-31").cast("date")


def _cards(v: Views):
    return v.reviews.select("student_id").distinct().select("student_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("card_id")).select("student_id", (F.col("card_id") % 3).alias("deck_id"), "card_id")


def _schedule(v: Views):
    return R.sm2_fold(v.reviews)


#: The same fold as a recursive walk along each card's numbered reviews.
_FOLD = f"""with recursive o as (select *, row_number() over (partition by student_id, card_id order by created_at, review_id) as k from reviews where mode = 'study'),
 f as (select student_id, card_id, 0::bigint as k, 250 as ease, 0 as days, 0 as reps, 0 as lapses, null::date as day from (select distinct student_id, card_id from o)
  union all
  select student_id, card_id, k, ease, least(case when rating = 1 then 0 when reps = 1 then case when rating = 4 then 4 else 1 end when reps = 2 then case when rating = 4 then 8 else 6 end else greatest(case when rating = 2 then floor((d0 * 12 + 5) / 10) when rating = 4 then floor((d0 * ease * 13 + 500) / 1000) else floor((d0 * ease + 50) / 100) end::int, d0 + 1) end, 36500)::int, reps, lapses, day
  from (select o.student_id, o.card_id, o.k, o.rating, o.reviewed_on as day, f.days as d0, greatest(f.ease + case o.rating when 1 then -20 when 2 then -15 when 4 then 15 else 0 end, 130) as ease, case when o.rating = 1 then 0 else f.reps + 1 end as reps, f.lapses + (o.rating = 1)::int as lapses from f join o on o.student_id = f.student_id and o.card_id = f.card_id and o.k = f.k + 1)),
 s as (select student_id, card_id, k::int as reviews, ease, days as interval_days, reps, lapses, day + days as due_on, case when lapses >= 4 then 'leech' when reps = 0 then 'relearning' when days < 21 then 'young' else 'mature' end as status from (select *, max(k) over (partition by student_id, card_id) as last from f) where k = last),
 cards as (select student_id, u % 3 as deck_id, u as card_id from (select distinct student_id from reviews), (select unnest(range(0, 12))::int as u)),
 done as (select student_id, deck_id, count(*) as reviews_today, count(distinct card_id) as cards_today, sum(response_ms)::bigint as tracked_ms, count(response_ms) as tracked from reviews where mode = 'study' and reviewed_on = {_D} group by 1, 2),
 work as (select student_id, deck_id, due_remaining, new_remaining, coalesce(reviews_today, 0) as reviews_today, coalesce(cards_today, 0) as cards_today, tracked_ms, coalesce(tracked, 0) as tracked, case when due_remaining > 0 then 'due_remaining' when reviews_today > 0 then 'done_today' else 'no_cards_due' end as status
  from (select student_id, deck_id, count_if(due_on <= {_D}) as due_remaining, count_if(due_on is null) as new_remaining from cards left join s using (student_id, card_id) group by 1, 2) left join done using (student_id, deck_id))"""


#: FSRS-6 as a recursive walk along each card's numbered reviews; kind 0 is a new card. Stability after a rating is ``s1`` to ``s4``, its interval ``i1`` to ``i4``.
_START = "6.4133 - exp(0.8334 * ({g} - 1)) + 1"
_RECALL = "pow(1 + (pow(0.9, -1 / 0.1542) - 1) * days / s, -0.1542)"
_GROWN = "least(greatest(case when days = 0 then s * {short} else s * (1 + exp(1.8722) * (11 - d) * pow(s, -0.1666) * (exp(0.796 * (1 - r)) - 1) * {bonus}) end, 0.001), 36500)"
_SHORT = "exp(0.5425 * ({g} - 3 + 0.0912)) * pow(s, -0.0658)"
_AFTER = ", ".join([
    f"least(greatest(case when days = 0 then s * {_SHORT.format(g=1)} else least(1.4835 * pow(d, -0.0614) * (pow(s + 1, 0.2629) - 1) * exp(1.6483 * (1 - r)), s / exp(0.5425 * 0.0912)) end, 0.001), 36500) as s1",
    _GROWN.format(short=_SHORT.format(g=2), bonus="0.6014") + " as s2",
    _GROWN.format(short=f"greatest({_SHORT.format(g=3)}, 1)", bonus="1") + " as s3",
    _GROWN.format(short=f"greatest({_SHORT.format(g=4)}, 1)", bonus="1.8729") + " as s4",
])
_DAYS = "least(greatest(floor({s} / (pow(0.9, -1 / 0.1542) - 1) * (pow(0.95, -1 / 0.1542) - 1) + 0.5), 1), 36500)::bigint"
_INTERVALS = ", ".join(f"{_DAYS.format(s=f's{g}')} as i{g}" for g in (1, 2, 3, 4))
_MINUTES = """case when kind = 2 and rating = 1 then 10 when kind = 2 then 1440 * case rating when 2 then least(i2, i3) when 3 then greatest(i3, least(i2, i3) + 1) else greatest(i4, greatest(i3, least(i2, i3) + 1) + 1) end
 when kind = 3 and rating < 3 then case rating when 1 then 10 else 15 end when kind < 2 and rating < 3 then case rating when 1 then 1 else 6 end when kind < 2 and rating = 3 and step = 0 then 10
 else 1440 * case rating when 1 then i1 when 2 then i2 when 3 then i3 else i4 end end"""
_KIND = "case when kind = 2 then case when rating = 1 then 3 else 2 end when rating < 3 or (rating = 3 and kind < 2 and step = 0) then greatest(kind, 1) else 2 end"
_REPLAY = f"""with recursive o as (select *, floor(epoch(created_at))::bigint as sec, row_number() over (partition by student_id, card_id order by created_at, review_id) as k from reviews where mode = 'study'),
 f as (select student_id, card_id, 0::bigint as k, 0::double as s, 0::double as d, 0 as kind, 0 as reps, 0 as lapses, 0 as step, 0::bigint as minutes, 0::bigint as sec from (select distinct student_id, card_id from o)
  union all
  select student_id, card_id, k, case when kind = 0 then first_s else case rating when 1 then s1 when 2 then s2 when 3 then s3 else s4 end end,
   case when kind = 0 then least(greatest({_START.format(g="rating")}, 1), 10) else least(greatest(0.001 * ({_START.format(g=4)}) + 0.999 * (d - 3.0194 * (rating - 3) * (10 - d) / 9), 1), 10) end,
   {_KIND}, reps + 1, lapses + (kind = 2 and rating = 1)::int, case when kind < 2 and rating = 3 and step = 0 then 1 when kind in (0, 1) and rating = 2 then step else 0 end, ({_MINUTES})::bigint, sec
  from (select *, {_INTERVALS} from (select * replace (case when kind = 0 then first_s else s1 end as s1, case when kind = 0 then first_s else s2 end as s2, case when kind = 0 then first_s else s3 end as s3, case when kind = 0 then first_s else s4 end as s4)
   from (select *, {_AFTER} from (select *, {_RECALL} as r from (
    select o.student_id, o.card_id, o.k, o.rating, o.sec, case when f.kind = 0 then 1 else f.s end as s, case when f.kind = 0 then 5 else f.d end as d, f.kind, f.reps, f.lapses, f.step, greatest(o.sec // 86400 - f.sec // 86400, 0) as days, case o.rating when 1 then 0.212 when 2 then 1.2931 when 3 then 2.3065 else 8.2956 end::double as first_s
    from f join o on o.student_id = f.student_id and o.card_id = f.card_id and o.k = f.k + 1)))))),
 s as (select student_id, card_id, s, d, kind, reps, lapses, step, minutes, sec from f qualify k = max(k) over (partition by student_id, card_id))"""


def replayed(query: str) -> str:
    return sql(f"{_REPLAY} {query}")


def f(query: str) -> str:
    return sql(f"{_FOLD} {query}")


#: Schedules of another scheduler, some of them moved already, in the SQL that both engines share.
_STATES = "select student_id, card_id, case when card_id % 4 = 0 then 'fsrs-6' else 'sm-2' end as scheduler_version, cast(card_id + 1 as bigint) as state_version, 'review' as status, cast((student_id + card_id) % 6 as int) as legacy_lapses from {cards} where card_id % 3 < 2"


def _states(v: Views):
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split(" ") for f in R.FSRS_STATE.split(", "))]
    return v.spark.sql(_STATES, cards=_cards(v)).select("*", *empty)


def _migration(v: Views):
    rows = R.migration_diff(_states(v), v.reviews)
    new = [F.col(f"after.{c}").alias(c) for c in ("state_version", "status", "legacy_lapses", "state", "reps", "lapses", "step", "minutes")]
    return rows.select("student_id", "card_id", F.col("before.state_version").alias("old_version"), F.col("before.status").alias("old_status"), *new, F.round("after.stability", 5).alias("stability"), F.round("after.difficulty", 5).alias("difficulty"))


def _progress(v: Views):
    return R.deck_progress(_cards(v), _schedule(v), v.reviews, _today())


def _activity(v: Views):
    return R.daily_activity(v.reviews).filter("reviews > 1").withColumn("reviews", F.when(F.col("student_id") % 9 == 0, F.col("reviews") + 1).otherwise(F.col("reviews")))


QUERIES = {
    "r1_daily_activity": lambda v: R.daily_activity(v.reviews),
    "r2_streaks": lambda v: R.streaks(v.reviews.select("student_id", F.col("reviewed_on").alias("day")), _today()),
    "r3_fsrs_replay": lambda v: R.fsrs_replay(v.reviews).withColumn("stability", F.round("stability", 5)).withColumn("difficulty", F.round("difficulty", 5)).withColumn("due_on", F.to_date("due_at")).drop("due_at", "last_at"),
    "r4_rating_previews": lambda v: R.rating_previews(R.fsrs_replay(v.reviews), F.lit(NOW).cast("timestamp")).withColumn("recall", F.round("recall", 6)),
    "r5_sm2_fold": _schedule,
    "r6_schedule_migration": lambda v: R.schedule_migration(_states(v), v.reviews),
    "r6_migration_diff": _migration,
    "r7_deck_dashboard": lambda v: R.deck_dashboard(_cards(v), _schedule(v), _today()),
    "r8_deck_progress": _progress,
    "r9_study_history": lambda v: R.study_history(_cards(v), R.due_before(v.reviews), _schedule(v), _today()),
    "r10_deck_report": lambda v: R.deck_report(_progress(v)),
    "r11_study_queue": lambda v: R.study_queue(_cards(v), _schedule(v), _today(), 5),
    "r12_sprint_sample": lambda v: R.sprint_sample(_cards(v), 7, 6),
    "r13_card_merge": lambda v: R.card_merge(v.part.filter("p_size <= 25").select((F.col("p_partkey") % 5).alias("deck_id"), F.col("p_name").alias("word")), v.part.select((F.col("p_size") % 5).cast("long").alias("deck_id"), F.upper("p_name").alias("word"), F.col("p_partkey").alias("place"))),
    "r14_consistency": lambda v: R.consistency(v.reviews, _activity(v)),
    "r15_deck_listing": lambda v: R.deck_listing(v.nation.select(F.col("n_nationkey").cast("long").alias("deck_id"), F.col("n_name").alias("name")), v.orders.select((F.col("o_custkey") % 20).alias("deck_id"), F.col("o_custkey").alias("student_id")), "i"),
}

SQL = {
    "r1_daily_activity": sql("select student_id, reviewed_on, count(*) as reviews, count_if(rating >= 3) as correct from reviews group by 1, 2"),
    "r2_streaks": sql(f"select student_id, max(case when last >= {_D} - 1 then n else 0 end)::bigint as current_streak, max(n)::bigint as best_streak from (select student_id, i, count(*) as n, max(d) as last from (select student_id, d, d - row_number() over (partition by student_id order by d)::int as i from (select distinct student_id, reviewed_on as d from reviews)) group by 1, 2) group by 1"),
    "r3_fsrs_replay": replayed("select student_id, card_id, round(s, 5) as stability, round(d, 5) as difficulty, kind as state, reps, lapses, step, minutes, (to_timestamp(sec + minutes * 60) at time zone 'UTC')::date as due_on from s"),
    "r4_rating_previews": replayed(f"select student_id, card_id, round(r, 6) as recall, rating, {_KIND} as next_state, ({_MINUTES})::bigint as minutes, ({_MINUTES})::bigint // 1440 as days from (select *, {_INTERVALS} from (select *, {_AFTER} from (select *, {_RECALL} as r from (select *, greatest(epoch(timestamp '{NOW}')::bigint // 86400 - sec // 86400, 0) as days from s where sec + minutes * 60 <= epoch(timestamp '{NOW}'))))), (select unnest([1, 2, 3, 4]) as rating)"),
    "r5_sm2_fold": f("select * from s"),
    "r6_schedule_migration": f(f"select count(c.card_id) as states, coalesce(sum(n), 0)::bigint as reviews, count(*) as schedules, count_if(coalesce(c.scheduler_version, '') = 'fsrs-6') as already, count_if(coalesce(c.scheduler_version, '') <> 'fsrs-6') as pending, count_if(coalesce(c.scheduler_version, '') <> 'fsrs-6' and n is null) as without_history from ({_STATES.format(cards='cards')}) c full join (select student_id, card_id, count(*) as n from o group by 1, 2) h on c.student_id = h.student_id and c.card_id = h.card_id"),
    "r6_migration_diff": replayed(f"select coalesce(c.student_id, s.student_id) as student_id, coalesce(c.card_id, s.card_id) as card_id, c.state_version as old_version, c.status as old_status, coalesce(c.state_version, 0) + 1 as state_version, case when coalesce(c.legacy_lapses, 0) >= 4 then 'leech' else case coalesce(s.kind, 0) when 0 then 'new' when 2 then 'review' else 'learning' end end as status, coalesce(c.legacy_lapses, 0) as legacy_lapses, coalesce(s.kind, 0) as state, coalesce(s.reps, 0) as reps, coalesce(s.lapses, 0) as lapses, coalesce(s.step, 0) as step, coalesce(s.minutes, 0) as minutes, coalesce(round(s.s, 5), 0) as stability, coalesce(round(s.d, 5), 0) as difficulty from ({_STATES.format(cards='(select student_id, u as card_id from (select distinct student_id from reviews), (select unnest(range(0, 12))::int as u))')}) c full join s on c.student_id = s.student_id and c.card_id = s.card_id where coalesce(c.scheduler_version, '') <> 'fsrs-6'"),
    "r7_deck_dashboard": f(f"select student_id, deck_id, count(*) as card_count, count_if(due_on <= {_D}) as due_count, count_if(due_on is null) as new_count from cards left join s using (student_id, card_id) group by 1, 2"),
    "r8_deck_progress": f("select * from work"),
    "r9_study_history": f(f"""select student_id, deck_id, day, case when unknown = 0 then due end as total_due, unknown, coalesce(studied, 0) as studied, coalesce(n, 0) as reviews, tracked_ms from (
        select student_id, deck_id, day, count_if(case when seen then due_before else due_on end <= day) as due, count_if(seen and due_before is null) as unknown from (
          select c.student_id, c.deck_id, c.card_id, x.day, s.due_on, (select count(*) > 0 from w where w.student_id = c.student_id and w.card_id = c.card_id and w.reviewed_on > x.day) as seen, (select arg_min((1, w.due_before), (w.created_at, w.review_id)) from w where w.student_id = c.student_id and w.card_id = c.card_id and w.reviewed_on > x.day)[2] as due_before
          from cards c cross join x left join s on s.student_id = c.student_id and s.card_id = c.card_id) group by 1, 2, 3)
        left join (select student_id, deck_id, reviewed_on as day, count(distinct card_id) as studied, count(*) as n, sum(response_ms)::bigint as tracked_ms from w group by 1, 2, 3) using (student_id, deck_id, day)""").replace(" cards as (", f" x as (select ({_D} - u::int) as day from (select unnest(range(0, 7)) as u)), w as (select *, lag(reviewed_on) over (partition by student_id, card_id order by created_at, review_id) + 3 as due_before from reviews where mode = 'study' qualify reviewed_on > {_D} - 7), cards as ("),
    "r10_deck_report": f("select deck_id, count(*) as students, sum(due_remaining)::bigint as due_remaining, sum(new_remaining)::bigint as new_remaining, sum(reviews_today)::bigint as reviews_today, sum(tracked_ms)::bigint as tracked_ms, sum(tracked)::bigint as tracked, count_if(status = 'done_today') as done, floor(sum(tracked_ms)::double / nullif(sum(tracked), 0)::double * 10.0 + 0.5) / 10.0 as mean_ms, case when count_if(status = 'done_today') = count(*) then 'all_done' when sum(reviews_today) > 0 then 'started' else 'not_started' end as status from work group by 1"),
    "r11_study_queue": f(f"select * from (select student_id, card_id, due_on, row_number() over (partition by student_id order by due_on nulls first, card_id) as n from cards left join s using (student_id, card_id) where due_on is null or due_on <= {_D}) where n <= 5"),
    "r12_sprint_sample": f("select * from (select student_id, deck_id, card_id, row_number() over (partition by student_id order by md5(student_id || ':' || card_id || ':7'), card_id) as n from cards) where n <= 6"),
    "r13_card_merge": "select deck_id, arg_min(word, place) as word, min(place) as place, count(*) - 1 as skipped from (select (p_size % 5)::bigint as deck_id, upper(p_name) as word, p_partkey as place from part) i where not exists (select 1 from part k where k.p_size <= 25 and k.p_partkey % 5 = i.deck_id and lower(trim(k.p_name)) = lower(trim(i.word))) group by deck_id, lower(trim(word))",
    "r14_consistency": sql("select * from (select student_id, reviewed_on, l.logged, a.reviews from (select student_id, reviewed_on, count(*) as logged from reviews group by 1, 2) l full join (select student_id, reviewed_on, count(*) + case when student_id % 9 = 0 then 1 else 0 end as reviews from reviews group by 1, 2 having count(*) > 1) a using (student_id, reviewed_on)) where logged is distinct from reviews"),
    "r15_deck_listing": "select n_nationkey::bigint as deck_id, n_name as name, coalesce(students, 0) as students from nation left join (select o_custkey % 20 as deck_id, count(distinct o_custkey) as students from orders group by 1) d on d.deck_id = n_nationkey where lower(n_name) like '%i%'",
}

for _name, _column in (("r1_daily_activity", "reviewed_on"), ("r3_fsrs_replay", "due_on"), ("r5_sm2_fold", "due_on"), ("r9_study_history", "day"), ("r11_study_queue", "due_on"), ("r14_consistency", "reviewed_on")):
    SQL[_name] = dated(SQL[_name], _column)
