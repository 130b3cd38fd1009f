"""Queries of evaluation, statistics, models and the batch twins of streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.lineage import cut, forget
from gradeloom.operators import evaluation as V
from gradeloom.operators import skills as K
from gradeloom.operators import vectors as X
from gradeloom.plans.adapters import NOW, Views, sql
from gradeloom.plans.grading import graded
from gradeloom.streaming import logs as L


#: Gold and predicted questions and findings, in the SQL that both engines share.
_INPUTS = {
    "gold_questions": "select d.doc_id as id, d.lang, d.text as prompt, case when d.n_chars % 4 <> 0 then concat(d.lang, '  ', d.source) end as passage, case when d.n_chars % 5 <> 0 then split(concat(d.lang, ' ', d.source, ' ', d.n_chars), ' ') end as choices, case when d.n_chars % 9 <> 0 then cast(l.quality as string) end as answer, d.n_chars % 3 = 0 as visual from {documents} d join {labels} l on d.doc_id = l.doc_id",
    "predicted_questions": "select doc_id as id, seq, case when n_chars % 7 = 0 then concat(text, ' end') when n_chars % 7 = 1 then concat('  ', text) else text end as prompt, case when n_chars % 8 > 0 then concat(lang, ' ', source) end as passage, split(concat(lang, ' ', source, ' ', n_chars + case when n_chars % 6 = 0 then 1 else 0 end), ' ') as choices, case when n_chars % 11 <> 0 then case when n_chars > 600 then '1' else '0' end end as answer, n_chars % 2 = 0 as visual_correct, case (n_chars + seq) % 4 when 0 then 'complete' when 1 then 'review' when 2 then 'failed' end as review_state from (select *, 1 as seq from {documents} where source <> 'src0' union all select *, 2 as seq from {documents} where n_chars % 10 = 0 and source <> 'src0') x",
    "gold_findings": "select doc_id as id, 'layout' as issue_type, case when doc_id % 2 = 0 then 'prompt' end as field, doc_id % 3 as page, case when toxic = 1 then 'major' else 'minor' end as severity from {labels} where quality = 0 or toxic = 1 union all select doc_id, 'layout', case when doc_id % 2 = 0 then 'prompt' end, doc_id % 3, 'major' from {labels} where quality = 0 and toxic = 1",
    "predicted_findings": "select doc_id as id, 'layout' as issue_type, case when doc_id % 2 = 0 then 'prompt' end as field, doc_id % 3 as page from {documents} where lang <> 'en' union all select doc_id, 'layout', case when doc_id % 2 = 0 then 'prompt' end, doc_id % 3 from {documents} where n_chars % 5 = 0",
}
_INPUTS["last_predicted"] = "select id, max_by(review_state, seq) as review_state from ({predicted_questions}) q group by id"
_INPUTS = {n: q.replace("{predicted_questions}", _INPUTS["predicted_questions"]) for n, q in _INPUTS.items()}


def _input(v: Views, name: str):
    return v.spark.sql(_INPUTS[name], documents=v.documents, labels=v.labels)


def _stats(v: Views):
    phase = F.when(F.col("event_id") % 2 == 0, "before").otherwise("after")
    return V.nearest_rank(v.events.withColumn("phase", phase), ["event_type", "phase"], "value", F.col("event_id") % 20 == 0)


def _jobs(v: Views):
    return v.events.select((F.col("user_id") % 60).alias("import_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("version"), F.floor("value").alias("tokens"), (F.col("event_id") % 5 != 0).alias("ok"))


def _answers(v: Views):
    return graded(v).select("student_id", "skill", F.col("question_id").alias("id"), F.col("started_at").alias("at"), "is_correct", "difficulty")


def _candidates(v: Views):
    rows = cut(graded(v).select("student_id", "skill", "question_id", F.col("started_at").alias("at"), "is_correct", "difficulty"))
    mastery = cut(V.mastery(rows.withColumnRenamed("question_id", "id")))
    given = K.assign_candidates(K.candidate_scores(mastery.withColumn("last_on", F.to_date(F.timestamp_seconds("last_at"))), v.questions, rows, F.lit(NOW).cast("date")))
    forget(rows, mastery)
    return given


def _difficulties(v: Views):
    answers = graded(v).select("student_id", "skill", "question_id", F.col("is_correct").cast("int").alias("right"))
    return K.item_ratings(answers)[1].select("question_id", "answers", F.round("difficulty", 2).alias("difficulty"))


def _stream_events(v: Views):
    return v.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _classified(v: Views):
    rows = v.documents.join(v.labels, "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return V.macro_f1(V.text_classifier(rows.filter(~held), "text", "label").transform(rows.filter(held)), "label", "prediction")


QUERIES = {
    "v1_evaluate_extraction": lambda v: V.evaluate_extraction(_input(v, "gold_questions"), _input(v, "predicted_questions"), ["lang"]),
    "v2_finding_match": lambda v: V.finding_match(_input(v, "gold_questions"), _input(v, "gold_findings"), _input(v, "last_predicted"), _input(v, "predicted_findings")),
    "v3_slices": lambda v: V.slices(v.documents, F.concat(F.lit("lang:"), "lang"), F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("source") == "src0", "hot_source")).groupBy("slice").agg(F.count("*").alias("n")),
    "v4_nearest_rank": lambda v: V.nearest_rank(v.events, ["event_type"], "value", F.col("event_id") % 20 == 0),
    "v5_before_after": lambda v: V.before_after(_stats(v), "event_type", "phase", "p95", 140.0),
    "v6_ops_ratios": lambda v: V.ops_ratios(v.events, ["user_id"], error_rate=(F.col("event_type") == "error", F.lit(True)), buy_per_click=(F.col("event_type") == "purchase", F.col("event_type") == "click")),
    "v7_flag_counters": lambda v: V.flag_counters(v.drafts),
    "v8_review_ledger": lambda v: V.review_ledger(_jobs(v)),
    "m1_text_classifier": _classified,
    "m2_mastery": lambda v: V.mastery(_answers(v)),
    "m3_calibration": lambda v: V.calibration(v.questions.join(v.responses, "question_id").select((F.col("difficulty") / 6.0).alias("p"), F.coalesce((F.col("choice_no") == F.col("key_no")).cast("int"), F.lit(0)).alias("y"))),
    "m4_rank_candidates": lambda v: V.rank_candidates(V.mastery(_answers(v)), v.questions, graded(v)),
    "m5_top_k_vectors": lambda v: V.top_k_vectors(v.embeddings.filter("vec_id % 20 = 0"), v.embeddings),
    "m2_item_ratings": _difficulties,
    "m4_assign_candidates": _candidates,
    "m5_indexed_vectors": lambda v: X.search(v.embeddings.filter("vec_id % 20 = 0"), v.embeddings, X.fit_index(v.embeddings)),
    "m5_near_vectors": lambda v: X.near_vectors(v.embeddings, X.fit_index(v.embeddings), 0.5),
    "st1_daily_activity": lambda v: L.daily_activity(v.reviews.withColumn("created_at", F.col("created_at").cast("timestamp"))),
    "st6_sessions": lambda v: L.sessions(_stream_events(v)),
    "st7_latencies": lambda v: L.latencies(_stream_events(v), "1 day", "12 hours"),
}

_W = "((p + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) {s} {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n)) / (1 + {z} * {z} / n))"
_RATES = "select {keys} metric, part, whole, floor(p * 1000000.0 + 0.5) / 1000000.0 as value, case when whole > 0 then floor(greatest(0.0, " + _W.format(z=1.959963984540054, s="-") + ") * 1000000.0 + 0.5) / 1000000.0 end as low, case when whole > 0 then floor(least(1.0, " + _W.format(z=1.959963984540054, s="+") + ") * 1000000.0 + 0.5) / 1000000.0 end as high from (select *, part::double / nullif(whole, 0) as p, whole::double as n from ({rows}))"



def _duck(*names: str) -> str:
    return ", ".join(f"{n} as ({_INPUTS[n].format(documents='documents', labels='labels')})" for n in names)


def _metrics(keys: str, rows: str, ratios: dict[str, tuple[str, str]]) -> str:
    return " union all ".join(f"select {keys} '{m}' as metric, {part} as part, {whole} as whole from {rows}" for m, (part, whole) in ratios.items())


_EXACT = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"
_SAME = f"{_EXACT.format('g.{0}')} = {_EXACT.format('p.{0}')}"
_V1 = f"""with {_duck("gold_questions", "predicted_questions")}, p as (select *, count(*) over (partition by id) as times from predicted_questions qualify row_number() over (partition by id order by seq desc) = 1),
j as (select g.lang, p.times, g.id is not null as gold, g.id is not null and p.id is not null as hit, {_SAME.format("prompt")} as prompt, g.passage is not null as has_passage, {_SAME.format("passage")} as passage, len(g.choices) > 0 as has_choices, g.choices = p.choices as choices,
  p.answer is not null as keyed, {_SAME.format("answer")} as answer, g.visual, p.visual_correct, p.review_state from gold_questions g full join p on g.id = p.id),
c as (select lang, coalesce(sum(times), 0)::bigint as n_pred, coalesce(sum(times) filter (hit), 0)::bigint as matched_rows, count(*) filter (gold) as n_gold, count(*) filter (hit) as matched, count(*) filter (hit and prompt) as prompts, count(*) filter (hit and has_passage) as passage_rows,
  count(*) filter (hit and has_passage and passage) as passages, count(*) filter (hit and has_choices) as choice_rows, count(*) filter (hit and has_choices and choices) as choice_lists, count(*) filter (hit and keyed) as keyed, count(*) filter (hit and keyed and answer) as keys_right, count(*) filter (hit and visual) as visual_rows,
  count(*) filter (hit and visual and visual_correct) as visuals, count(*) filter (hit and review_state = 'complete') as complete, count(*) filter (hit and review_state = 'review') as review, count(*) filter (hit and review_state = 'failed') as failed from j group by lang) """ + _RATES.format(
    keys="lang,",
    rows=_metrics("lang,", "c", {
        "question_precision": ("matched_rows", "n_pred"), "question_recall": ("matched", "n_gold"), "prompt_exact": ("prompts", "matched"), "passage_exact": ("passages", "passage_rows"), "choice_exact": ("choice_lists", "choice_rows"), "key_coverage": ("keyed", "matched"),
        "key_accuracy": ("keys_right", "keyed"), "visual_association": ("visuals", "visual_rows"), "complete_coverage": ("complete", "matched"), "human_review_rate": ("review", "matched"), "failed_rate": ("failed", "matched"),
    }),
)
_V2 = f"""with {_duck("gold_questions", "gold_findings", "predicted_findings", "last_predicted")}, pk as (select distinct id, issue_type, coalesce(field, '-') as field, page from predicted_findings), gk as (select *  replace (coalesce(field, '-') as field) from gold_findings),
c as (select (select count(*) from (select distinct id, issue_type, field, page from gk) d join pk using (id, issue_type, field, page)) as hit, (select count(*) from predicted_findings) as n_pred, (select count(*) from gk) as n_gold, (select count(*) from gk where severity = 'major') as n_serious,
  (select count(*) from gk join pk using (id, issue_type, field, page) where severity = 'major') as hit_serious, count(*) filter (clean) as n_clean, count(*) filter (clean and not noted) as left_alone, count(*) filter (state = 'complete') as n_complete, count(*) filter (state = 'complete' and serious) as defective
  from (select q.id not in (select id from gold_findings) as clean, q.id in (select id from predicted_findings) as noted, q.id in (select id from gold_findings where severity = 'major') as serious, l.review_state as state from gold_questions q left join last_predicted l on q.id = l.id) x) """ + _RATES.format(
    keys="", rows=_metrics("", "c", {"precision": ("hit", "n_pred"), "recall": ("hit", "n_gold"), "serious_recall": ("hit_serious", "n_serious"), "clean_specificity": ("left_alone", "n_clean"), "serious_defect_complete": ("defective", "n_complete")})
)

SQL = {
    "v1_evaluate_extraction": _V1,
    "v2_finding_match": _V2,
    "v3_slices": "select slice, count(*) as n from (select unnest(['lang:' || lang, case when n_chars > 2000 then 'long' end, case when source = 'src0' then 'hot_source' end]) as slice from documents) where slice is not null group by 1",
    "v4_nearest_rank": sql("select event_type, count(*) as samples, count_if(event_id % 20 = 0) as errors, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as max from events group by 1"),
    "v5_before_after": "select event_type, before, after, floor((after - before) * 1000.0 + 0.5) / 1000.0 as delta, floor((after - before) / nullif(before, 0) * 100 * 10.0 + 0.5) / 10.0 as change_pct, case when after <= 140.0 then 'pass' else 'miss' end as verdict from (select event_type, quantile_disc(value, 0.95) filter (where event_id % 2 = 0) as before, quantile_disc(value, 0.95) filter (where event_id % 2 = 1) as after from events group by 1)",
    "v6_ops_ratios": sql("select user_id, floor(count_if(event_type = 'error')::double / count(*)::double * 10000.0 + 0.5) / 10000.0 as error_rate, floor(count_if(event_type = 'purchase')::double / nullif(count_if(event_type = 'click'), 0)::double * 10000.0 + 0.5) / 10000.0 as buy_per_click from events group by 1"),
    "v7_flag_counters": sql("select import_id, coalesce(flag, 'none') as flag, count(*) as n, count_if(answer is null) as unresolved from drafts group by 1, 2"),
    "v8_review_ledger": sql("select model, version, count(*) as imports, sum(tokens)::bigint as tokens, count_if(not ok) as failed from (select event_type as model, user_id % 3 as version, floor(value)::bigint as tokens, event_id % 5 <> 0 as ok, row_number() over (partition by user_id % 60 order by ts desc, event_id desc) as r from events) where r = 1 group by 1, 2"),
    "m3_calibration": sql("select least(floor(p * 10), 9)::int as bucket, count(*) as n, sum(y)::bigint as positives, floor(avg(p) * 10000.0 + 0.5) / 10000.0 as mean_p, floor(avg((p - y) * (p - y)) * 10000.0 + 0.5) / 10000.0 as brier, floor(avg(-ln(least(greatest(case when y = 1 then p else 1 - p end, 1e-9), 1))) * 10000.0 + 0.5) / 10000.0 as log_loss, floor(greatest(avg(y), 1 - avg(y)) * 10000.0 + 0.5) / 10000.0 as baseline from (select difficulty / 6.0::double as p, coalesce((choice_no = key_no)::int, 0) as y from questions join responses using (question_id)) group by 1"),
    "m5_top_k_vectors": "select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, v.vec_id, floor(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) * 1000000 + 0.5)::bigint as score from (select vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 0) q join (select vec_id, embedding::double[] as e from embeddings) v on q.vec_id <> v.vec_id)) where rank <= 5",
    "m5_near_vectors": "with e as (select min(vec_id) as vec_id, embedding::double[] as e from embeddings group by embedding), s as (select a.vec_id as query_id, b.vec_id, floor(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) * 1000000 + 0.5)::bigint as score from e a join e b on a.vec_id < b.vec_id) select * from s where score >= 500000",
    "st1_daily_activity": sql("select student_id, reviewed_on::varchar as reviewed_on, count(*) as reviews, count_if(rating >= 3) as correct from reviews group by 1, 2"),
    "st6_sessions": "select user_id, floor(epoch(min(ts)))::bigint as start, floor(epoch(max(ts) + interval 30 minutes))::bigint as end, count(*) as events from (select *, sum(n) over (partition by user_id order by ts, event_id) as s from (select *, (lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minutes)::int as n from events)) group by user_id, s",
    "st7_latencies": sql("select event_type, (h - 43200 * k)::bigint as start, count(*) as samples, count_if(event_type = 'error') as errors, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as max from (select *, floor(epoch(ts) / 43200)::bigint * 43200 as h from events) cross join (values (0), (1)) t(k) group by 1, 2"),
}
