"""Queries of the ingestion and audit families and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import expressions as E
from gradeloom.operators import audits as A
from gradeloom.operators import ingestion as D
from gradeloom.plans.adapters import Views, sql
from gradeloom.sources import tables as S


def _pages(v: Views):
    return v.draft_texts.select("import_id", "id", F.col("rn").cast("int").alias("page_number"), "text")


def _content(v: Views):
    choice = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    kind = F.when(F.col("n_chars") % 7 == 0, "typed").otherwise("multiple_choice").alias("kind")
    choices = F.when(F.col("n_chars") % 7 > 0, F.array(choice("a", F.upper("lang")), choice("B", F.lit(" ( No ) .. way "))))
    answer = F.when(F.col("n_chars") % 6 > 0, F.expr("substr('ABCD', n_chars % 4 + 1, 1)")).alias("answer")
    return v.documents.select("doc_id", "source", "n_chars", F.col("lang").alias("section"), kind, F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("From “"), "lang", F.lit("”"))).alias("passage"), F.col("text").alias("prompt"), choices.alias("choices"), answer)


def _bank(v: Views):
    return D.question_blocks(S.lines(v.bank_pages, ["import_id", "page_number"]), F.col("line").rlike("(?i)^question id"))


def _questions(v: Views):
    return v.lineitem.select((F.col("l_orderkey") % 50).alias("import_id"), (F.col("l_suppkey") % 4).cast("int").alias("module"), (F.col("l_partkey") % 30 + 1).cast("int").alias("number"), F.col("l_linenumber").alias("page_number"))


def _seq(v: Views):
    return v.events.select(F.col("user_id").alias("import_id"), "event_id", F.row_number().over(D.Window.partitionBy("user_id").orderBy("event_id")).alias("seq")).withColumn("number", F.when(F.col("event_id") % 5 != 0, F.col("seq") + F.when(F.col("event_id") % 11 == 0, 3).otherwise(0)))


def _match_questions(v: Views):
    return v.drafts.select("import_id", F.col("rn").alias("seq"), "module", F.when(F.col("id") % 5 != 0, F.col("number")).alias("number"))


def _match_keys(v: Views):
    named = ~F.col("import_id").isin("src5", "src7")  # the keys of two imports name no module; one has a key for each question
    return v.drafts.filter("answer is not null or id % 4 = 0 or import_id = 'src5'").select("import_id", F.col("rn").alias("entry"), F.when(named, F.col("module")).alias("module"), "number", F.coalesce("answer", F.lit("A")).alias("answer"))


def _matches(v: Views):
    return D.match_answers(_match_questions(v), _match_keys(v))


#: Imports of 98 drafts, some with declared modules, and their states, in the SQL that both engines share.
_READY = {
    "ready_drafts": """select import_id, id, status, n_chars, case when n_chars % 197 = 0 then null when b % 5 < 3 then floor(p / 3) + 1 else page_number end as page_number,
      cast(case when b % 5 < 3 then p - case pm when 0 then 0 when 1 then 27 when 2 then 54 else 76 end + 1 when n_chars % 10 > 0 then number end as int) as number, case lang when 'en' then 'Reading & Writing' when 'fr' then 'math' when 'de' then 'RW' end as section,
      cast(case when b % 4 = 0 then pm when b % 4 = 1 then null when id % 3 = 0 then pm when n_chars % 50 = 0 then 3 - pm end as int) as module, case when b % 3 = 0 then coalesce(answer, 'A') else answer end as answer, case when n_chars % 29 = 0 then 2 else 0 end as keys, n_chars % 301 = 0 and b % 2 = 1 as conflict
      from (select concat(import_id, '-', b) as import_id, id, status, n_chars, section as lang, page_number, number, answer, b, p, case when p < 27 then 0 when p < 54 then 1 when p < 76 then 2 else 3 end as pm from (select *, cast(floor((rn - 1) / 98.0) as int) as b, (rn - 1) % 98 as p from {drafts}) x) y""",
    "ready_imports": """select import_id, case when b % 7 = 5 then 'running' when b % 7 = 6 then 'failed' else 'completed' end as status, c + case when b % 4 = 3 then 200 else 0 end as raw_keys
      from (select concat(import_id, '-', cast(floor((rn - 1) / 98.0) as int)) as import_id, max(cast(floor((rn - 1) / 98.0) as int)) as b, count(answer) as c from {drafts} group by concat(import_id, '-', cast(floor((rn - 1) / 98.0) as int))) x union all select 'empty', 'completed', null""",
}


_RISK = {
    "risk_drafts": """select import_id, id, case when n_chars % 211 = 0 then null when n_chars % 223 = 0 then 0 else page_number end as page_number, case when n_chars % 19 = 0 then concat(' ', section, ' ') else prompt end as prompt,
      case when n_chars % 4 > 0 then 'multiple_choice' else 'typed' end as question_type, case when n_chars % 31 = 0 then '  ' else answer end as answer,
      case when n_chars % 7 = 0 then split('recovered_from_page_replay,recovered_from_page_replay', ',') when n_chars % 11 = 0 then split('mystery,source_question_id_unresolved', ',') end as flags,
      case when n_chars % 12 = 1 then split('a,b,c', ',') when n_chars % 12 = 2 then split('a,b, ,d', ',') when n_chars % 12 > 3 then split('a,b,c,d', ',') end as choices, case when n_chars % 8 = 0 then 'inferred' end as number_origin,
      case when n_chars % 15 = 0 then 'low' when n_chars % 2 = 0 then 'high' end as key_confidence, case when n_chars % 14 = 0 then 'module_position' end as key_method, n_chars % 5 = 0 as has_visual, case when n_chars % 10 = 0 then 'x' end as visual_code,
      case when n_chars % 3 > 0 then 'image' end as image, case when n_chars % 9 = 1 then 'confirmed' end as crop from ({draft_texts}) x""",
    "risk_imports": """select import_id, case when b % 7 = 6 then 'failed' else 'completed' end as status, case when b % 5 = 4 then 'bank' else 'full_test' end as family, b % 3 as pages_failed, b % 4 as retries_failed, b % 2 as inferred_numbers, case when b % 3 = 0 then 'complete' when b % 3 = 1 then 'partial' end as key_status,
      case when b % 4 = 1 then 'model' when b % 4 = 2 then 'parsed' end as key_source, b % 6 as fallback_matches, b % 8 as key_diagnostics, b % 2 as parser_warnings from (select import_id, cast(split(import_id, '-')[{last}] as int) as b from ({ready_drafts}) x group by import_id) y
      union all select 'empty', 'completed', 'full_test', 0, 0, 0, 'complete', null, 0, null, 0""",
    "placed_drafts": "select import_id, id, module, case when n_chars % 77 = 0 then 2 - module % 2 when n_chars % 2 = 0 then module % 2 + 1 end as position, case when n_chars % 91 = 0 then 'math' when n_chars % 3 = 0 then case when module >= 2 then 'math' else 'reading_writing' end end as section, number from ({ready_drafts}) x",
}


def _ready_rows(v: Views, name: str):
    return v.spark.sql(_READY[name], drafts=v.drafts)


def _risk_rows(v: Views, name: str):
    if name == "risk_drafts":
        return v.spark.sql(_RISK[name].replace("({draft_texts})", "{t}"), t=v.draft_texts)
    return v.spark.sql(_RISK[name].replace("({ready_drafts})", "{r}").replace("{last}", "1"), r=_ready_rows(v, "ready_drafts"))


def _readiness(v: Views, even: bool = False):
    rows = _ready_rows(v, "ready_drafts")
    return A.import_readiness(rows.filter("status <> 'rejected'") if even else rows, _ready_rows(v, "ready_imports"))


def _labels(v: Views, which):
    month = F.element_at(F.array(*[F.lit(m) for m in ("March", "may", "Oct", "December 5")]), (F.col("page_id") % 4 + 1).cast("int"))
    return v.pages.filter(which).select(F.col("page_id").alias("id"), F.concat_ws(" ", month, (F.col("page_id") % 3 + 2022).cast("string"), F.when(F.col("page_id") % 5 == 0, "US").when(F.col("page_id") % 5 == 1, "International"), F.when(F.col("page_id") % 7 == 0, "Form A").when(F.col("page_id") % 7 == 1, "Form B")).alias("label"))


def _figures(v: Views):
    q = v.pages.select((F.col("page_id") % 40).alias("page_id"), F.col("page_id").alias("seq"), (F.length("url") % 3).alias("markers"))
    return D.attribute_figures(q, v.benchmark.select((F.col("item_id") % 40).alias("page_id"), F.col("item_id").alias("box_id")).union(v.pages.select((F.col("page_id") % 40).alias("page_id"), (F.col("page_id") + 1_000).alias("box_id"))))


def _decisions(v: Views):
    rows = _ready_rows(v, "ready_drafts").select("import_id", F.col("n_chars").alias("fp"), "status")
    removed = A.verified_removals(rows, rows.filter("status <> 'rejected'"))
    return A.promotion_decision(_readiness(v).filter("import_id not like '%-1'"), _readiness(v, True).filter("import_id <> 'src3-0'"), removed)


#: Lines of answer keys, one entry each, with the headings of four modules, some of them read too early; and rows of key tables, in the SQL that both engines share.
_SCOPED = """select import_id, cast(floor(q / 40.0) as int) as page_number, cast(q % 40 as int) as line_no, case when h then concat(case when m = 3 then '## ' else '' end, case when m < 2 then 'Reading and Writing Module ' else 'math module ' end, m % 2 + 1, ' Answers ') when import_id % 3 = 0 and p_size % 41 = 0 then 'a line of prose' when import_id % 3 = 0 and p_size % 43 = 0 then concat(n, '. ') else concat('**', n, case when p_size % 3 = 0 then ')' else '.' end, '** ', substr('ABCD', cast(p_size % 4 as int) + 1, 1), ' ** ') end as line
  from (select *, q in (0, 28, 56 - e, 79) as h, case when q >= 79 then 3 when q >= 56 - e then 2 when q >= 28 then 1 else 0 end as m, q - case when q < 28 then 0 when q < 56 - e then 28 when q < 57 then 29 when q < 79 then 56 else 79 end as n
    from (select p_size, cast(floor((p_partkey - 1) / 102.0) as bigint) as import_id, (p_partkey - 1) % 102 as q, cast(floor((p_partkey - 1) / 102.0) as bigint) % 4 as e from {part}) x) y"""
_TABLE = "select p_partkey % 10 as import_id, cast(floor(p_partkey / 200.0) as int) as page_number, cast(p_partkey % 200 as int) as line_no, concat(cast(floor(p_partkey / 10.0) as int) % 27 + 1, '. ', substr('ABCD', cast(p_size % 4 as int) + 1, 1), case when p_size % 11 > 0 then concat('   ', cast(floor(p_partkey / 10.0) as int) % 27 + 1 + case when p_size % 13 = 0 then 8 else 7 end, ') B') else '' end) as line from {part} where p_size % 9 > 0"


def _lines_of(v: Views, text: str):
    return v.spark.sql(text, part=v.part)


QUERIES = {
    "d3_scoped_keys": lambda v: D.scoped_keys(_lines_of(v, _SCOPED)),
    "d3_scoped_exactness": lambda v: D.scoped_exactness(D.scoped_keys(_lines_of(v, _SCOPED))),
    "d4_key_columns": lambda v: D.key_columns(_lines_of(v, _TABLE)),
    "s3_split_pages": lambda v: S.split_pages(v.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda p, i: F.concat(F.lit("===== PAGE "), (i + 1).cast("string"), F.lit(" =====\n"), p)), "\n").alias("dump")), "doc_id", "dump"),
    "s4_lines": lambda v: S.lines(v.documents, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("line_no").alias("last"), F.sum(F.length("line")).alias("chars")),
    "f6_phantoms": lambda v: v.draft_texts.select("import_id", "id", D.is_phantom(F.col("prompt")).alias("phantom")),
    "f7_source_images": lambda v: v.pages.select("page_id", F.col("url").rlike(r"(?i)^https?://(blog|m)\.[^/]+/(en|fr)/\d+").alias("is_source")),
    "e2_key_answer": lambda v: v.part.select("p_partkey", E.key_answer(F.concat(F.lit(r" \frac{"), F.col("p_size").cast("string"), F.lit("}{4} or −1,"), F.lit("250 "))).alias("key")),
    "e9_module_name": lambda v: v.documents.select("doc_id", E.module_name(F.concat(F.element_at(F.array(F.lit("Math"), F.lit("Reading and Writing"), F.lit("Other")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit(" Module "), (F.col("n_chars") % 3).cast("string"))).alias("module")),
    "e18_snapshot_hash": lambda v: v.customer.select("c_custkey", E.snapshot_hash("c_nationkey", "c_name", "c_custkey").alias("hash")),
    "d1_normalize_pages": lambda v: D.normalize_pages(v.documents.select("doc_id", F.regexp_replace("text", "the ", "m o d u l e \\\\_\\\\_\\\\_ ").alias("text")), "doc_id").select("doc_id", "changed", "before", "after"),
    "d2_text_quality": lambda v: D.text_quality(v.bank_pages, "import_id"),
    "d3_extract_keys": lambda v: D.extract_keys(v.key_lines),
    "d3_key_exactness": lambda v: D.key_exactness(D.extract_keys(v.key_lines)),
    "d4_key_runs": lambda v: D.key_runs(v.lineitem.select(F.col("l_orderkey").alias("import_id"), F.col("l_linenumber").alias("number")), 2),
    "d5_question_blocks": lambda v: _bank(v),
    "d5_bank_blocks": lambda v: D.bank_blocks(_bank(v)),
    "d6_module_completeness": lambda v: D.module_completeness(_questions(v)),
    "d7_repair_numbers": lambda v: D.repair_numbers(_seq(v)),
    "d7_fill_runs": lambda v: D.fill_runs(_seq(v)),
    "d8_section_transition": lambda v: D.section_transition(v.draft_texts.select("import_id", F.col("rn").alias("seq"), "text"), "text"),
    "d9_exact_duplicates": lambda v: D.exact_duplicates(_content(v), "doc_id", ["source", "n_chars"]),
    "d10_near_buckets": lambda v: D.near_buckets(v.documents, "doc_id", F.col("lang"), F.col("text"), F.lit(4)),
    "d11_coalesce_repeats": lambda v: D.coalesce_repeats(v.draft_texts.select("import_id", (F.col("n_chars") % 2).alias("module"), (F.length("prompt") % 3).alias("number"), "id", "page_number", "prompt", F.array_compact(F.array("answer")).alias("choices"), F.array_compact(F.array("flag")).alias("flags"))),
    "d12_attribute_figures": _figures,
    "d13_match_answers": _matches,
    "d13_unmatched_keys": lambda v: D.unmatched_keys(_match_questions(v), _match_keys(v), _matches(v)),
    "d14_assess_keys": lambda v: D.assess_keys(_matches(v), _match_keys(v)),
    "d15_source_evidence": lambda v: D.source_evidence(v.draft_texts.select("import_id", "id", (F.col("rn") + F.col("n_chars") % 3).cast("int").alias("page_number"), "prompt"), _pages(v)),
    "d16_choices_preserved": lambda v: D.choices_preserved(v.draft_texts.select("import_id", "id", F.col("rn").cast("int").alias("page_number"), F.explode(F.split("text", "\n")).alias("choice")), v.draft_texts.filter("status <> 'rejected'").select("import_id", F.col("rn").cast("int").alias("page_number"), F.explode(F.split("text", "\n")).alias("choice"))),
    "d17_import_readiness": _readiness,
    "d18_find_existing": lambda v: D.find_existing(_labels(v, F.col("url").contains("?")), _labels(v, ~F.col("url").contains("?"))),
    "d19_import_listing": lambda v: A.import_listing(v.drafts),
    "d19_module_summary": lambda v: A.module_summary(v.drafts),
    "d20_draft_risks": lambda v: A.draft_risks(_risk_rows(v, "risk_drafts")),
    "d20_import_risks": lambda v: A.import_risks(_risk_rows(v, "placed_drafts"), _risk_rows(v, "risk_imports")),
    "d21_approval_warnings": lambda v: A.approval_warnings(v.draft_texts),
    "d22_import_audit": lambda v: A.import_audit(v.draft_texts),
    "d23_key_agreement": lambda v: A.key_agreement(v.drafts.select("import_id", "module", "number", "answer").dropDuplicates(["import_id", "module", "number", "answer"]), v.drafts.filter("status <> 'rejected'").groupBy("import_id", "module", "number").agg(F.max("answer").alias("answer"))),
    "d24_retry_pages": lambda v: A.retry_pages(v.draft_texts.groupBy("import_id", "page_number").agg(F.min("text").alias("text")), v.drafts),
    "d25_display_order": lambda v: D.display_order(v.drafts),
    "d26_assemble_test": lambda v: A.assemble_test(v.drafts),
    "d27_unused_images": lambda v: A.image_provenance(v.orders.filter("o_orderstatus = 'P'").select((F.col("o_custkey") % 90).alias("import_id")), v.lineitem.filter("l_quantity > 49").select((F.col("l_suppkey") % 60).alias("import_id")), v.nation.select(F.col("n_nationkey").cast("long").alias("import_id")), v.pages.select(F.col("page_id").alias("image_id"), (F.col("page_id") % 110).alias("import_id"))).select("image_id", "import_id"),
    "d28_promotion_decision": _decisions,
    "d29_cohort_report": lambda v: A.cohort_report(_decisions(v)),
    "d30_corpus_triage": lambda v: A.corpus_triage(D.text_quality(v.documents.withColumnRenamed("doc_id", "id"), "id")),
    "d31_new_files": lambda v: D.new_files(v.pages.select(F.col("page_id").alias("file_id"), F.col("url").alias("name")), v.pages.filter(F.col("url").contains("?")).select(F.col("page_id").alias("file_id")), F.col("file_id") < 100),
    "d32_backfill_diff": lambda v: D.normalize_pages(v.documents, "doc_id").filter("changed").select("doc_id", "before", "after"),
    "d33_review_selection": lambda v: A.review_selection(A.draft_risks(_risk_rows(v, "risk_drafts")), 2),
    "d34_parity": lambda v: A.parity(v.documents.select("doc_id", "source", F.when(F.col("doc_id") % 50 != 0, F.col("lang")).alias("lang"), "n_chars"), v.documents, "doc_id", ["source", "lang", "n_chars"]),
    "d35_cohort_selection": lambda v: A.cohort_selection(_readiness(v)),
}

_PHANTOM = "regexp_matches({x}, '(?i)(student-produced response directions|more than one correct answer|answer preview|rectangular box[^.]{{0,120}}(write|enter|blank|answer)|mark for review|hide\\s+calculator|back\\s+next)')"
_KEYS = "keys as (select import_id, module, page_number, line_no, (u.i - 1)::int as place, regexp_extract(u.pair, '^(\\d+)', 1)::int as number, right(u.pair, 1) as answer from (select *, last_value(nullif(regexp_extract(line, '(?i)\\bmodule\\s+(\\d)\\b', 1), '')::int ignore nulls) over (partition by import_id order by page_number, line_no) as module from key_lines) l, lateral (select unnest(ps) as pair, generate_subscripts(ps, 1) as i from (select regexp_extract_all(l.line, '\\b(\\d{1,2})[.)]?\\s+([A-D])\\b') as ps)) u where module is not null)"
_BANK = """bl as (select import_id, page_number as pn, row_number() over (partition by import_id order by page_number) as block, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from bank_pages)"""
_SEQ = "q as (select *, case when event_id % 5 <> 0 then seq + case when event_id % 11 = 0 then 3 else 0 end end as number from (select user_id as import_id, event_id, row_number() over (partition by user_id order by event_id) as seq from events))"
_Q = "'" * 8
_WS = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_CONTENT = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), '“”«»„‟‘’‚‛—–―', '\"\"\"\"\"\"{_Q}---'), '\\.{{2,}}', ' ', 'g'), '_{{2,}}', ' ____ ', 'g'), '{_WS}+', ' ', 'g'), '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g'))"
_STOP = "'the', 'and', 'for', 'with', 'from', 'that', 'this', 'which', 'what', 'choice', 'best', 'most', 'text', 'based', 'according', 'following'"
_MQ = "mq as (select import_id, rn as seq, module, case when id % 5 <> 0 then number end as number from drafts), mk as (select import_id, rn as entry, case when import_id not in ('src5', 'src7') then module end as module, number, coalesce(answer, 'A') as answer from drafts where answer is not null or id % 4 = 0 or import_id = 'src5')"
_MATCH = f"""{_MQ}, m1 as (select import_id, seq, entry, answer, 'question_id' as method, 'high' as confidence from (select import_id, module, number, min(seq) as seq from mq where number is not null and module is not null group by 1, 2, 3 having count(*) = 1) join (select import_id, module, number, min(answer) as answer, min(entry) as entry from mk group by 1, 2, 3 having count(*) = 1) using (import_id, module, number)),
  wq as (select *, row_number() over (partition by import_id, module order by seq) as k, count(*) over (partition by import_id, module) as n from mq), wk as (select *, row_number() over (partition by import_id, module order by entry) as k, count(*) over (partition by import_id, module) as n from mk),
  pl as (select wq.import_id, wq.module, wq.seq, wk.entry, wk.answer, m1.entry as known from wq join wk using (import_id, module, k, n) left join m1 on m1.import_id = wq.import_id and m1.seq = wq.seq),
  m2 as (select import_id, seq, entry, answer, 'module_position' as method, 'low' as confidence from pl where known is null and (import_id, module) not in (select (import_id, module) from pl where known <> entry)),
  dq as (select *, row_number() over (partition by import_id order by seq) as k, count(*) over (partition by import_id) as n from mq), dk as (select *, row_number() over (partition by import_id order by entry) as k, count(*) over (partition by import_id) as n, count(module) over (partition by import_id) as named from mk),
  m3 as (select dq.import_id, dq.seq, dk.entry, dk.answer, 'document_position' as method, 'low' as confidence from dq join dk on dq.import_id = dk.import_id and dq.k = dk.k and dq.n = dk.n where named = 0),
  ms as (select mq.import_id, mq.seq, mq.module, mq.number, entry, answer, coalesce(method, 'unmatched') as method, confidence from mq left join (select * from m1 union all select * from m2 union all select * from m3) using (import_id, seq))"""


#: The words and formulas of math questions.
_MATH = (
    "(?i)\\b(equation|expression|solution|slope|function|triangle|circle|radius|diameter|quadratic|perpendicular|coordinate|xy-plane|kilograms?|joules?|inches?|centimeters?|area|perimeter|percent|system of equations)\\b",
    "\\$[^$]*(?:=|\\\\frac|\\\\sqrt|\\^|[<>])[^$]*\\$",
)
_PLACE = "page_number nulls last, number nulls last, id"
_RD = ", ".join(f"{n} as ({q.format(drafts='drafts')})" for n, q in _READY.items())
_M, _X = ("m0", "m1", "m2", "m3"), ("unclassified", "overflow_rw", "overflow_math")
_K = (*[m.replace("m", "k") for m in _M], *[f"k_{x}" for x in _X])
_COUNTS = ("questions", "mapped", "matched", "duplicate_keys", "inferred", "conflicts", "duplicates", *_M, *_K[:4], *_X, *_K[4:])


def _ready(name: str, where: str) -> str:
    """The readiness of imports in SQL: drafts placed, counted, judged."""
    section = "translate(replace(lower(section), '&', 'and'), '_', ' ')"
    named = f"case when regexp_matches({section}, '\\bmath\\b') then 'math' when regexp_matches({section}, '\\b(reading|writing|rw)\\b') then 'reading_writing' end"
    own = {f"m{i}": f"m = {i}" for i in range(4)} | {"unclassified": "m is null and s is null", "overflow_rw": "m is null and s = 'reading_writing'", "overflow_math": "m is null and s = 'math'"}
    counted = ", ".join([f"count(*) filter ({c}) as {n}" for n, c in own.items()] + [f"coalesce(sum(keyed) filter ({c}), 0)::bigint as {k}" for k, c in zip(_K, own.values())])
    sure, zero = "conflicts = 0 and not ambiguous", lambda names: " + ".join(names) + " = 0"
    exact = lambda x: f"{x}0 = 27 and {x}1 = 27 and {x}2 = 22 and {x}3 = 22"
    base = "when status in ('failed', 'cancelled') then 'failed' when status <> 'completed' then 'processing'"
    return f"""{name}_s as (select *, coalesce({named}, case when module >= 2 then 'math' when module >= 0 then 'reading_writing' end) as s, greatest(coalesce(keys, 0), case when trim(coalesce(answer, '')) <> '' then 1 else 0 end) as keyed from ready_drafts where {where}),
 {name}_w as (select *, row_number() over (partition by import_id order by {_PLACE}) as rn, count(*) over (partition by import_id) as n, count(*) filter (module is null) over (partition by import_id) as undeclared, count(*) filter (module is null) over (partition by import_id, s order by {_PLACE} rows between unbounded preceding and 1 preceding) as k from {name}_s),
 {name}_p as (select *, case when undeclared = 0 then module when n = 98 then case when rn <= 27 then 0 when rn <= 54 then 1 when rn <= 76 then 2 else 3 end else coalesce(module, case when s = 'reading_writing' and k < 54 then k // 27 when s = 'math' and k < 44 then k // 22 + 2 end) end as m from {name}_w),
 {name}_c as (select import_id, count(*) as questions, sum(keyed)::bigint as mapped, count(*) filter (keyed > 0) as matched, count(*) filter (keyed > 1) as duplicate_keys, count(*) filter (module is null) as inferred, count(*) filter (n = 98 and undeclared > 0 and module <> m) as conflicts, {counted} from {name}_p group by 1),
 {name}_d as (select import_id, count(*) as duplicates from (select import_id from {name}_p where m is not null and number > 0 group by import_id, m, number having count(*) > 1 or bool_or(conflict)) x group by 1),
 {name}_u as (select distinct import_id, true as unclear from {name}_p group by import_id, page_number, number having page_number is null or count(*) > 1),
 {name}_j as (select i.import_id, i.status, greatest(coalesce(raw_keys, 0), 0) as raw, {", ".join(f"coalesce({c}, 0) as {c}" for c in _COUNTS)}, coalesce(unclear, false) and coalesce(inferred, 0) > 0 as ambiguous from ready_imports i left join {name}_c using (import_id) left join {name}_d using (import_id) left join {name}_u using (import_id)),
 {name}_q as (select *, case {base} when questions = 0 then 'failed' when questions = 98 and {exact("m")} and {zero(_X)} and {sure} and duplicates = 0 then 'complete' else 'partial' end as question_status from {name}_j),
 {name} as (select import_id, {", ".join(_COUNTS)}, ambiguous, question_status, case {base} when greatest(mapped, raw) = 0 then 'failed' when question_status = 'complete' and mapped = 98 and {exact("k")} and {zero(_K[4:])} and duplicate_keys = 0 and raw <= mapped and {sure} then 'complete' else 'partial' end as key_status from {name}_q)"""


_R0, _R1 = f"{_RD}, {_ready('r0', 'true')}", _ready("r1", "status <> 'rejected'")


def _fall(status: str, actual: str, modules: tuple[str, ...], extras: tuple[str, ...], removed: str, label: str) -> tuple[str, str]:
    """A metric's first reason to fall, as ``when`` branches, and whether it rose."""
    rank = lambda c: f"list_position(['processing', 'failed', 'partial', 'complete'], {c})"
    rose = f"{rank(f'a.{status}')} > {rank(f'b.{status}')}"
    lost = lambda c: f"a.{c} < b.{c}"
    covered = lambda c: f"({removed} >= b.{c} - a.{c} and {rose})"
    out = [(f"{rank(f'a.{status}')} < {rank(f'b.{status}')}", "status_fell"), (f"{lost(actual)} and not {covered(actual)}", "count_fell")]
    if label == "keys":
        out.append((f"{lost('matched')} and not {covered('matched')}", "matched_fell"))
    for c, n in zip(modules, (27, 27, 22, 22)):
        out.append((f"{lost(c)} and not ({covered(c)} and b.{c} > {n} and a.{c} = {n})", f"{c}_fell"))
    for c in extras:
        moved = f"a.{actual} >= b.{actual} and {' + '.join(f'a.{x}' for x in extras)} = 0" if "overflow" in c else "false"
        out += [(f"b.{c} > 0 and a.{c} = 0 and not ({moved})", f"{c}_disappeared"), (f"a.{c} > 0 and {lost(c)}", f"{c}_fell")]
    more = [actual, *(["matched"] if label == "keys" else []), *modules, *extras]
    return " ".join(f"when {c} then '{label}_{r}'" for c, r in out), " or ".join([rose, *[f"a.{c} > b.{c}" for c in more]])


_QF, _KF = _fall("question_status", "questions", _M, _X, "coalesce(removed, 0)", "questions"), _fall("key_status", "mapped", _K[:4], _K[4:], "0", "keys")
_DECIDE = f"""{_R0}, {_R1}, gone as (select import_id, sum(greatest(nb - na, 0))::bigint as removed from (select import_id, n_chars, count(*) as nb, count(*) filter (status <> 'rejected') as na from ready_drafts group by 1, 2) x where na > 0 group by 1),
 dd as (select coalesce(b.import_id, a.import_id) as import_id, b.questions as q0, a.questions as q1, b.mapped as a0, a.mapped as a1, case when a.import_id is null then 'lost' when b.import_id is null then 'added' {_QF[0]} {_KF[0]} when {_QF[1]} or {_KF[1]} then 'improved' else 'unchanged' end as reason
  from (select * from r0 where import_id not like '%-1') b full join (select * from r1 where import_id <> 'src3-0') a on a.import_id = b.import_id left join gone g on g.import_id = coalesce(b.import_id, a.import_id))"""
_MINOR = "'parser:recovered_from_page_replay', 'prompt_suspect', 'choice_structure', 'question_number_inferred', 'answer_alignment_low_confidence', 'crop_unconfirmed'"
_UNSEEN = "has_visual and visual_code is null"
_RISKS = f"""risk_drafts as ({_RISK["risk_drafts"].format(draft_texts="select * from draft_texts")}), risks as (select import_id, id, list_concat(list_transform(list_sort(list_distinct(coalesce(flags, []))), lambda x: 'parser:' || x), list_filter([
  case when page_number is null or page_number < 1 then 'source_evidence_missing' end, case when length(trim(coalesce(prompt, ''))) < 8 then 'prompt_suspect' end, case when trim(coalesce(answer, '')) = '' then 'required_answer_missing' end,
  case when question_type = 'multiple_choice' and (coalesce(len(choices), 0) <> 4 or len(list_filter(choices, lambda x: trim(x) = '')) > 0) then 'choice_structure' end, case when number_origin = 'inferred' then 'question_number_inferred' end,
  case when coalesce(key_confidence, '') = 'low' or key_method in ('recovered_question_id', 'module_position', 'document_position') then 'answer_alignment_low_confidence' end,
  case when {_UNSEEN} and image is null then 'visual_source_missing' end, case when {_UNSEEN} and image is not null and coalesce(crop, '') <> 'confirmed' then 'crop_unconfirmed' end], lambda x: x is not null)) as c from risk_drafts),
 rs as (select import_id, id, array_to_string(c, ',') as codes, len(c)::int as n, case when len(list_filter(c, lambda x: x not in ({_MINOR}))) > 0 then 'major' when len(c) > 0 then 'minor' else 'complete' end as state from risks)"""
_IMPORT_RISKS = f"""{_RD}, placed_drafts as ({_RISK["placed_drafts"].format(ready_drafts="select * from ready_drafts")}), risk_imports as ({_RISK["risk_imports"].format(ready_drafts="select * from ready_drafts", last=2)}),
 o as (select import_id, count(*) as n, count(*) filter (module is null) as ua, count(*) filter (module < 2 and section = 'math' or module >= 2 and section = 'reading_writing' or position <> module % 2 + 1) as cl, {", ".join(f"count(*) filter (module = {m}) as m{m}" for m in range(4))},
  count(*) filter (module is not null and number > 0) > count(distinct (module, number)) filter (module is not null and number > 0) as tw from placed_drafts group by 1), j as (select *, coalesce(n, 0) as q, family = 'full_test' and n > 0 as f from risk_imports left join o using (import_id))
 select import_id, q as questions, array_to_string(list_filter([case when status in ('failed', 'cancelled') then 'import_processing_failed' end, case when q = 0 then 'no_readable_questions' end, case when f and q <> 98 then 'full_test_question_count' end, case when f and cl > 0 then 'explicit_module_order_conflict' end,
  case when f and (m0 <> 27 or m1 <> 27 or m2 <> 22 or m3 <> 22) then 'module_distribution' end, case when f and ua > 0 then 'module_assignment' end, case when f and tw then 'duplicate_question_identity' end], lambda x: x is not null), ',') as major,
  array_to_string(list_filter([case when pages_failed > 0 then 'ocr_page_failure' end, case when retries_failed > 0 then 'ocr_retry_warning' end, case when inferred_numbers > 0 then 'inferred_question_numbers' end, case when coalesce(key_status, '') <> 'complete' then 'answer_key_warning' end,
  case when key_source <> 'parsed' then 'answer_key_source' end, case when fallback_matches > 0 then 'positional_key_matches' end, case when key_diagnostics > 0 then 'answer_key_diagnostics' end, case when parser_warnings > 0 then 'parser_warnings' end], lambda x: x is not null), ',') as warnings from j"""
_Q2 = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_QUALITY = "tq as (select {key}, words, chars, question_marks, choice_marks, lines, thin_pages, pages, coalesce(floor(chars::double / nullif(lines, 0)::double + 0.5), 0)::bigint as line_length, case when words > 50 and floor(chars::double / nullif(lines, 0)::double + 0.5) > 15 and (question_marks >= 1 or choice_marks >= 2) then 'good' else 'poor' end as quality from (select {key}, sum(w)::bigint as words, sum(length(text))::bigint as chars, sum(len(regexp_extract_all(text, '(?m)^\\s*\\d{{1,3}}\\s*[.)]\\s+\\S')))::bigint as question_marks, sum(len(regexp_extract_all(text, '(?m)^\\s*[A-H]\\s*[.)]\\s+\\S')))::bigint as choice_marks, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::bigint as lines, count_if(w < 15) as thin_pages, count(*) as pages from (select *, len(" + _Q2 + ") as w from {source}) group by 1))"

_WORDS = "'question', 'questions', 'reading', 'writing', 'math', 'module', 'choice', 'choices', 'answer', 'answers', 'key', 'passage', 'passages', 'section', 'test', 'continue', 'which', 'used'"
_KNOWN = f"case when lower(regexp_replace(m, '\\s+', '', 'g')) in ({_WORDS}) then regexp_replace(m, '\\s+', '', 'g') else m end"


def _fixed(source: str) -> str:
    """Repaired texts as ``fixed`` beside the columns of ``source``, step by step."""
    out = f"select *, text as fixed from ({source})"
    for pattern, change in (("(?:\\\\_){3,}", "repeat('_', length(m) // 2)"), ("\\b[A-Za-z](?:[^\\S\\n]+[A-Za-z]{1,2})+\\b", _KNOWN), ("\\b[A-Za-z][^\\S\\n]+[A-Za-z]{3,}\\b", _KNOWN)):
        out = f"select * replace (array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(ms[i], '')), '') as fixed) from (select * exclude (ps, ms), ps, list_transform(ms, lambda m: {change}) as ms from (select *, string_split_regex(fixed, '{pattern}') as ps, regexp_extract_all(fixed, '{pattern}') as ms from ({out})))"
        out = f"select * exclude (ps, ms) from ({out})"
    steps = (("(?m)^(\\s*)([A-H])\\s*[.)]\\s*", "'\\1\\2. '"), ("(?m)^(\\s*\\d{1,3})\\s+\\.\\s+([A-Ha-h]|[+-]?\\d+(?:\\.\\d+)?(?:\\s*/\\s*\\d+)?)\\s*$", "'\\1. \\2'"), ("(?m)^(\\s*)(Module\\s+\\d)\\s*:\\s*(Reading and Writing|Math)\\s+(Question\\s+\\d)\\s*$", "'\\1\\3 \\2' || chr(10) || '\\1\\4'"), ("(?m)^(\\s*)(Module\\s+\\d)\\s*:\\s*(Reading and Writing|Math)\\s*$", "'\\1\\3 \\2'"))
    fixed = "fixed"
    for pattern, new in steps:
        fixed = f"regexp_replace({fixed}, '{pattern}', {new}, 'g')"
    return f"select * replace ({fixed} as fixed) from ({out})"


_FOLDED = f"""with recursive l as ({_SCOPED.format(part="part")}),
 a as (select *, case when regexp_matches(line, '(?i)^#*\\s*(Reading and Writing|Math)\\s+Module\\s+([12])\\s+Answers?\\s*$') then case when lower(line) like '%math%' then 2 else 0 end + regexp_extract(line, '(?i)module\\s+([12])', 1)::int - 1 end as opens from (select * replace (trim(line) as line) from l)),
 u as (select *, last_value(opens ignore nulls) over (partition by import_id order by page_number, line_no) as heading, try_cast(regexp_extract(line, '^\\*{{0,2}}(\\d{{1,2}})[.)]\\*{{0,2}}\\s+(.+?)\\s*$', 1) as int) as number, trim(regexp_replace(regexp_extract(line, '^\\*{{0,2}}(\\d{{1,2}})[.)]\\*{{0,2}}\\s+(.+?)\\s*$', 2), '\\*+\\s*$', '')) as answer from a),
 o as (select *, row_number() over (partition by import_id order by page_number, line_no) as k from u where opens is null and number is not null and answer <> '' and heading is not null),
 f as (select import_id, 0::bigint as k, [0, 0, 0, 0] as have, -1 as module from (select distinct import_id from o) union all
  select import_id, k, list_transform(have, lambda x, i: x + (i = m + 1)::int), m from (select o.import_id, o.k, f.have, case when o.heading > 0 and o.number > [27, 27, 22, 22][o.heading + 1] and o.number = f.have[o.heading] + 1 and o.number <= [27, 27, 22, 22][o.heading] then o.heading - 1 else o.heading end as m from f join o on o.import_id = f.import_id and o.k = f.k + 1)),
 s as (select o.import_id, o.page_number, o.line_no, o.heading, f.module, f.have[f.module + 1] as place, o.number, o.answer from o join f on f.import_id = o.import_id and f.k = o.k)"""

SQL = {
    "d3_scoped_keys": f"{_FOLDED} select * from s",
    "d3_scoped_exactness": f"{_FOLDED} select *, astray = 0 and c0 = 27 and c1 = 27 and c2 = 22 and c3 = 22 as exact from (select import_id, count(*) filter (module = 0) as c0, count(*) filter (module = 1) as c1, count(*) filter (module = 2) as c2, count(*) filter (module = 3) as c3, count(*) filter (number <> place) as astray from s group by 1)",
    "d4_key_columns": f"""with l as ({_TABLE.format(part="part")}), r as (select * from (select import_id, page_number, line_no, list_transform(regexp_extract_all(line, '\\b(\\d{{1,2}})[.)]?\\s+[A-D]\\b', 1), lambda x: x::int) as ns from l) where len(ns) > 0),
      p as (select *, lag(ns) over (partition by import_id order by page_number, line_no) as ps from r),
      b as (select *, sum((not coalesce(case when len(ps) >= 1 then list_slice(ns, 1, least(len(ns), len(ps))) = list_transform(list_slice(ps, 1, least(len(ns), len(ps))), lambda x: x + 1) or (len(ns) = len(ps) and list_min(ns) = list_max(ps) + 1) end, false))::int) over (partition by import_id order by page_number, line_no) as block from p)
      select import_id, block::bigint as block, page_number, line_no, i - 1 as "column", ns[i] as number from (select *, unnest(range(1, len(ns) + 1))::int as i from b)""",
    "s3_split_pages": "select doc_id, i as page_number, trim(case when i = n then regexp_replace(p, '\\n$', '') else p end) as text from (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1)::int as i, len(ps) as n from (select doc_id, string_split(text, chr(10)) as ps from documents))",
    "s4_lines": "select doc_id, count(*) as lines, max(i - 1)::int as last, sum(length(line))::bigint as chars from (select doc_id, trim(unnest(ls)) as line, generate_subscripts(ls, 1) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)) where line <> '' group by 1",
    "f6_phantoms": sql(f"select import_id, id, {_PHANTOM.format(x='prompt')} as phantom from draft_texts"),
    "f7_source_images": "select page_id, regexp_matches(url, '(?i)^https?://(blog|m)\\.[^/]+/(en|fr)/\\d+') as is_source from pages",
    "e2_key_answer": "select p_partkey, p_size || '/4 | -1250' as key from part",
    "e9_module_name": "select doc_id, case when doc_id % 3 = 0 and n_chars % 3 > 0 then 'math' || n_chars % 3 when doc_id % 3 = 1 and n_chars % 3 > 0 then 'rw' || n_chars % 3 end as module from documents",
    "e18_snapshot_hash": "select c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}') as hash from customer",
    "d1_normalize_pages": f"select doc_id, fixed <> text as changed, length(text) as before, length(fixed) as after from ({_fixed("select doc_id, replace(text, 'the ', 'm o d u l e \\_\\_\\_ ') as text from documents")})",
    "d2_text_quality": sql(f"with {_QUALITY.format(key='import_id', source='bank_pages')} select * from tq"),
    "d3_extract_keys": sql(f"with {_KEYS} select * from keys"),
    "d3_key_exactness": sql(f"with {_KEYS} select import_id, module, count(*) as entries, count(distinct number) as numbers, case when module < 2 then 27 when module < 4 then 22 end as expected, count(*) = count(distinct number) and count(distinct number) = max(number) and count(distinct number) = case when module < 2 then 27 when module < 4 then 22 end as exact from keys group by 1, 2"),
    "d4_key_runs": "select import_id, min(number) as first, max(number) as last, count(*) as length, min(number) = 1 as starts from (select import_id, number, number - row_number() over (partition by import_id order by number) as i from (select distinct l_orderkey as import_id, l_linenumber as number from lineitem)) group by import_id, i having count(*) >= 2",
    "d5_question_blocks": sql(f"with {_BANK} select import_id, block, len(ls) as lines, pn as first_page, pn as last_page, len(list_filter(ls, lambda x: regexp_matches(x, '^\\(?[A-D][.)]'))) as choices, array_to_string(list_filter(ls, lambda x: not regexp_matches(x, '^\\(?[A-D][.)]')), ' ') as prompt from bl"),
    "d5_bank_blocks": sql(f"with {_BANK} select import_id, block, regexp_extract(text, 'ID: (\\w+)', 1) as question_id, nullif(regexp_extract(text, 'Answer: (\\w)', 1), '') as key, null::varchar as rationale, n as choices, case when regexp_extract(text, 'Answer: (\\w)', 1) = '' then 'no_key' when n not in (0, 4) then 'bad_choices' end as error from (select *, len(list_filter(ls, lambda x: regexp_matches(x, '^\\(?[A-D][.)]'))) as n from bl)"),
    "d6_module_completeness": "select import_id, module, expected, actual, greatest(expected - actual, 0) as missing, greatest(actual - expected, 0) as over, first_page, last_page, case when actual = expected then 'complete' when actual < expected then 'partial' else 'over' end as status from (select distinct l_orderkey % 50 as import_id from lineitem) cross join (values (0, 27), (1, 27), (2, 22), (3, 22)) t(module, expected) left join (select l_orderkey % 50 as import_id, l_suppkey % 4 as module, count(distinct l_partkey % 30) as a, min(l_linenumber) as first_page, max(l_linenumber) as last_page from lineitem group by 1, 2) using (import_id, module), lateral (select coalesce(a, 0) as actual)",
    "d7_repair_numbers": f"with {_SEQ} select import_id, seq, number, case when b + 2 = f and number is distinct from b + 1 then b + 1 else number end as repaired from (select *, lag(number) over w as b, lead(number) over w as f from q window w as (partition by import_id order by seq))",
    "d7_fill_runs": f"with {_SEQ}, w as (select *, last_value(number ignore nulls) over (partition by import_id order by seq rows between unbounded preceding and 1 preceding) as b, first_value(number ignore nulls) over (partition by import_id order by seq rows between 1 following and unbounded following) as f, count(number) over (partition by import_id order by seq) as run from q) select import_id, seq, number, coalesce(number, case when f - b - 1 = n then b + k - h end)::int as filled from (select *, row_number() over (partition by import_id, run order by seq) as k, count_if(number is null) over (partition by import_id, run) as n, count(number) over (partition by import_id, run) as h from w)".replace("count_if(number is null)", "count(case when number is null then 1 end)"),
    "d8_section_transition": sql(f"select import_id, min(case when s >= 3 and c = 5 and place > 20 then seq end) as transition from (select import_id, rn as seq, sum((regexp_matches(text, '{_MATH[0]}') or regexp_matches(text, '{_MATH[1]}'))::int) over ahead as s, count(*) over ahead as c, row_number() over (partition by import_id order by rn) as place from draft_texts window ahead as (partition by import_id order by rn rows between current row and 4 following)) group by 1"),
    "d9_exact_duplicates": f"""with t as (select doc_id, source, n_chars, coalesce(lang, '') as section, case when n_chars % 7 = 0 then 'typed' else 'multiple_choice' end as kind, case when n_chars % 5 = 0 then 'from "' || lower(lang) || '"' else '' end as passage, {_CONTENT} as prompt, case when n_chars % 7 > 0 then chr(10) || 'A=' || lower(lang) || chr(10) || 'B=(no) way' else '' end as choices, case when n_chars % 6 > 0 then chr(10) || 'key=' || substr('abcd', (n_chars % 4 + 1)::int, 1) else '' end as answer, trim(coalesce(text, '')) <> '' or n_chars % 5 = 0 or n_chars % 7 > 0 as has from documents),
      r as (select doc_id, source, n_chars, substr(sha256(section || chr(10) || kind || chr(10) || passage || chr(10) || coalesce(prompt, '') || choices || answer), 1, 32) as fp from t where has)
      select doc_id, fp, size, canonical, doc_id <> canonical as is_copy from r join (select fp, count(*) as size, arg_min(doc_id, (source, n_chars, doc_id)) as canonical from r group by 1 having count(*) > 1) using (fp)""",
    "d10_near_buckets": f"select bucket, count(*) as size, min(doc_id) as first_id, max(doc_id) as last_id from (select doc_id, concat_ws('|', lang, 'mc4', array_to_string(list_filter(regexp_split_to_array(regexp_replace({_CONTENT}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 and w not in ({_STOP}))[1:10], ' ')) as bucket from documents) group by 1 having count(*) > 1",
    "d11_coalesce_repeats": sql("with d as (select import_id, n_chars % 2 as module, length(prompt) % 3 as number, id, page_number as page, answer, flag, length(prompt) + coalesce(length(answer), 0) as rich, list_distinct(list_filter(regexp_split_to_array(lower(prompt), '[^a-z0-9]+'), lambda w: length(w) > 2)) as t from draft_texts) select import_id, module, number, case when r1 >= r2 then i1 else i2 end as kept, case when r1 >= r2 then i2 else i1 end as dropped, page as page_number, floor(o * 1000 + 0.5)::bigint as overlap_permille, array_to_string(list_sort(list_distinct(list_filter([f1, f2, 'repeated_source_question_coalesced'], lambda x: x is not null))), ',') as flags from (select a.import_id, a.module, a.number, a.id as i1, b.id as i2, a.rich as r1, b.rich as r2, a.flag as f1, b.flag as f2, least(a.page, b.page) as page, coalesce(len(list_intersect(a.t, b.t))::double / nullif(least(len(a.t), len(b.t)), 0)::double, 0) as o from d a join d b on a.import_id = b.import_id and a.module = b.module and a.number = b.number and a.id < b.id and abs(a.page - b.page) <= 3 and (a.answer is null or b.answer is null or a.answer = b.answer)) where o >= 0.82"),
    "d12_attribute_figures": "with q as (select page_id % 40 as pid, page_id as seq, length(url) % 3 as markers, sum(length(url) % 3) over (partition by page_id % 40 order by page_id) as upto from pages), b as (select pid, box_id, row_number() over (partition by pid order by box_id) as k from (select item_id % 40 as pid, item_id as box_id from benchmark union all select page_id % 40, page_id + 1000 from pages)) select b.pid as page_id, box_id, k, seq, case when seq is null then 'needs_review' else 'attributed' end as status from b left join q on b.pid = q.pid and k > upto - markers and k <= upto",
    "d13_match_answers": sql(f"with {_MATCH} select * from ms"),
    "d13_unmatched_keys": sql(f"with {_MATCH} select import_id, entry, module, number, case when target > 0 and target <> size then 'question_key_count_mismatch' else 'no_matching_question' end as reason from (select *, case when module is null then (select count(*) from mq where mq.import_id = k.import_id) else (select count(*) from mq where mq.import_id = k.import_id and mq.module = k.module) end as target, count(*) over (partition by import_id, module) as size from mk k) where not exists (select 1 from ms where ms.import_id = k.import_id and ms.entry = k.entry)".replace(" from mk k) where", " from mk k) k where")),
    "d14_assess_keys": sql(f"with {_MATCH} select import_id, questions, matched, by_position, entries, case when entries = 0 then 'missing' when by_position * 2 > matched then 'low_confidence' when matched = questions then 'complete' else 'partial' end as status, array_to_string(list_filter([case when entries > questions then 'extra_entries' end, case when entries < questions then 'short_key' end, case when by_position > 0 then 'matched_by_position' end], lambda x: x is not null), ',') as warnings from (select import_id, count(*) as questions, count(entry) as matched, count_if(confidence = 'low') as by_position from ms group by 1) left join (select import_id, count(*) as e from mk group by 1) using (import_id), lateral (select coalesce(e, 0) as entries)"),
    "d15_source_evidence": sql("select d.import_id, d.id, bool_or(contains(e, substr(regexp_replace(lower(d.prompt), '[^\\p{L}\\p{N}]+', '', 'g'), 1, 48))) as found, count(*) as pages from draft_texts d join (select import_id, rn as p, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') as e from draft_texts) x on x.import_id = d.import_id and x.p between d.rn + d.n_chars % 3 - 1 and d.rn + d.n_chars % 3 + 1 group by 1, 2"),
    "d16_choices_preserved": sql("with o as (select import_id, id, rn, regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\\p{L}\\p{N}]+', '', 'g') as c from draft_texts), n as (select import_id, rn, regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\\p{L}\\p{N}]+', '', 'g') as d from draft_texts where status <> 'rejected') select import_id, id, bool_and(kept) as preserved, count(*) as choices from (select o.import_id, o.id, o.c, coalesce(bool_or(o.c = n.d or (length(o.c) >= 12 and starts_with(n.d, o.c))), false) as kept from o left join n on n.import_id = o.import_id and abs(n.rn - o.rn) <= 1 where o.c <> '' group by 1, 2, 3) group by 1, 2"),
    "d17_import_readiness": sql(f"with {_R0} select * from r0"),
    "d18_find_existing": "with l as (select page_id as id, contains(url, '?') as fresh, page_id % 4 as m, page_id % 3 as y, case page_id % 5 when 0 then 'us' when 1 then 'international' end as r, case page_id % 7 when 0 then 'A' when 1 then 'B' end as v from pages), h as (select a.id, bool_or(a.r is not distinct from b.r and a.v is not distinct from b.v) as sure from (select * from l where fresh) a join (select * from l where not fresh) b on a.m = b.m and a.y = b.y and coalesce(a.r = b.r, true) and coalesce(a.v = b.v, true) group by 1) select l.id, case when sure then 'duplicate' when sure is not null then 'review' else 'new' end as verdict from l left join h using (id) where l.fresh",
    "d19_import_listing": sql("select import_id, count_if(status = 'approved') as approved, count_if(status = 'pending') as pending, count_if(status = 'rejected') as rejected from drafts group by 1"),
    "d19_module_summary": sql("select import_id, section, module, count(*) as total, count_if(status = 'approved') as approved, count_if(status = 'rejected') as rejected, count(answer) as with_key from drafts group by 1, 2, 3"),
    "d20_draft_risks": sql(f"with {_RISKS} select * from rs"),
    "d20_import_risks": sql(f"with {_IMPORT_RISKS}"),
    "d21_approval_warnings": sql("select import_id, count_if(status = 'pending') as pending, count_if(answer is null) as missing_answers, count_if(flag is not null) as flagged, count_if(length(trim(prompt)) < 8) as short_prompts, count(*) - count(distinct (module, number)) as duplicate_numbers from draft_texts group by 1"),
    "d22_import_audit": sql(f"select import_id, count(*) as drafts, count(answer) as keyed, count(flag) as flagged, count_if({_PHANTOM.format(x='prompt')}) as phantoms, count_if(status = 'approved') as approved from draft_texts group by rollup (import_id)"),
    "d23_key_agreement": sql('select import_id, count_if(answer = again) as "match", count_if(answer <> again) as mismatch, count_if(answer is not null and again is null) as unverified from (select distinct import_id, module, number, answer from drafts) left join (select import_id, module, number, max(answer) as again from drafts where status <> \'rejected\' group by 1, 2, 3) using (import_id, module, number) group by 1'),
    "d24_retry_pages": sql("with s as (select import_id, page_number, 100 as score, 'failed' as reason from (select import_id, page_number, min(text) as text from draft_texts group by 1, 2) where length(trim(text)) < 20 union all select import_id, page_number, 85, 'unresolved' from drafts where answer is null and flag is not null union all select import_id, page_number, 75, 'gap' from (select *, lead(number) over (partition by import_id, module order by number, id) as f from drafts) where f > number + 1 union all select import_id, max(page_number), 10, 'tail' from drafts group by 1) select * from (select *, row_number() over (partition by import_id order by score desc, page_number) as rank from (select import_id, page_number, max(score) as score, string_agg(distinct reason, ',' order by reason) as reasons from s group by 1, 2)) where rank <= 4"),
    "d25_display_order": sql("select import_id, module, id, row_number() over (partition by import_id, module order by number nulls last, id) as place, count(*) over (partition by import_id, module) + 1 as next_place from drafts"),
    "d26_assemble_test": sql("select import_id, id, dense_rank() over (partition by import_id order by module) as module_position, row_number() over (partition by import_id, module order by number, id) as position, count(answer) over (partition by import_id, module) = count(*) over (partition by import_id, module) as key_complete from drafts where status = 'approved'"),
    "d27_unused_images": "select page_id as image_id, page_id % 110 as import_id from pages where page_id % 110 not in (select o_custkey % 90 from orders where o_orderstatus = 'P' union select l_suppkey % 60 from lineitem where l_quantity > 49 union select n_nationkey from nation)",
    "d28_promotion_decision": sql(f"with {_DECIDE} select *, reason in ('added', 'improved') as promote from dd"),
    "d29_cohort_report": sql(f"with {_DECIDE} select reason, count(*) as imports, sum(coalesce(q1, 0) - coalesce(q0, 0))::bigint as question_gain, sum(coalesce(a1, 0) - coalesce(a0, 0))::bigint as answer_gain from dd group by 1"),
    "d30_corpus_triage": sql(f"with {_QUALITY.format(key='doc_id', source='documents')} select status, count(*) as documents, sum(words)::bigint as words from (select *, case when chars = 0 then 'failed' when quality = 'poor' then 'needs_ocr' when choice_marks < question_marks * 4 then 'partial' else 'success' end as status from tq) group by 1"),
    "d31_new_files": "select page_id as file_id, case when not regexp_matches(lower(url), '/(en|fr)/') then 'ignored' when page_id < 100 then 'baseline' else 'pending' end as state, substr(sha256(page_id || '|' || url), 1, 16) as import_key from pages where not contains(url, '?')",
    "d32_backfill_diff": f"select doc_id, length(text) as before, length(fixed) as after from ({_fixed("select doc_id, text from documents")}) where fixed <> text",
    "d33_review_selection": sql(f"with {_RISKS} select import_id, id, case when state = 'major' then 'blocked' when state = 'complete' or k <= 2 then 'batch_ready' else 'individual_review' end as route from (select *, row_number() over (partition by import_id, state order by id) as k from rs)"),
    "d34_parity": "select count(*) as rows, 0::bigint as differ_source, count(case when doc_id % 50 = 0 then 1 end) as differ_lang, 0::bigint as differ_n_chars, sum(('0x' || substr(md5(concat_ws('|', source, case when doc_id % 50 <> 0 then lang end, n_chars::varchar)), 1, 8))::bigint)::bigint as fingerprint from documents",
    "d35_cohort_selection": sql(f"with {_R0} select case when question_status = 'complete' and key_status = 'complete' then 'control' when question_status = 'partial' or key_status = 'partial' then 'cohort' else 'none' end as cohort, question_status, key_status, count(*) as imports from r0 group by 1, 2, 3"),
}
