"""Domain inputs as views over the benchmark tables, in the SQL that Spark and DuckDB share.

``{name}`` stands for a table; ``{k}`` for the JSON key ``k`` of an event's properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.functions.relational import spread

NOW = "2024-01-31 12:00:00"

VIEWS = {
    "attempts": "select o_orderkey as attempt_id, o_custkey as student_id, o_custkey * 10 + o_orderkey % 5 as assignment_id, o_orderkey % 5 as test_id, o_orderdate as started_at, case o_orderstatus when 'F' then 'graded' when 'P' then 'submitted' else 'in_progress' end as status from {orders}",
    "assignments": "select o_custkey * 10 + o_orderkey % 5 as assignment_id, o_custkey as student_id, min(o_orderkey % 5) as test_id, (o_custkey * 10 + min(o_orderkey % 5)) % 50 as batch_id, min(o_orderdate) as assigned_at, case when o_custkey % 2 = 0 then min(o_orderdate) + interval '30' day end as due_at, case when o_custkey % 11 = 0 then 'expired' else 'assigned' end as status from {orders} group by o_custkey * 10 + o_orderkey % 5, o_custkey",
    "questions": "select p_partkey as question_id, case when p_partkey % 2 = 0 then 'math' else 'reading_writing' end as section, p_brand as domain, case when p_size % 10 = 0 then null else p_type end as skill, p_size % 5 + 1 as difficulty, p_size % 4 as key_no, case when p_partkey % 7 = 0 then 'typed' else 'choice' end as question_type, concat(p_size, '/4') as key_text, p_name as prompt, case when p_size % 3 = 0 then 'archived' else 'active' end as status from {part}",
    "roster": "select l_orderkey as attempt_id, l_partkey as question_id, min(l_suppkey) % 4 as module_id, 1 as points from {lineitem} group by l_orderkey, l_partkey",
    "responses": "select l_orderkey as attempt_id, l_partkey as question_id, min(l_suppkey) % 4 as module_id, case when cast(min(l_quantity) as int) % 5 = 4 then null else cast(min(l_quantity) as int) % 5 end as choice_no, case when cast(min(l_quantity) as int) % 5 = 4 then null else concat(cast(min(l_quantity) as int) * 25, '/100') end as typed_text, min(l_linenumber) * 10 as seconds from {lineitem} where l_returnflag <> 'A' group by l_orderkey, l_partkey",
    "students": "select c_custkey as student_id, c_name as name, c_nationkey as class_id, c_mktsegment as profile from {customer}",
    "classes": "select n_nationkey as class_id, n_name as class_name from {nation}",
    "reviews": "select event_id as review_id, user_id as student_id, cast({k} as int) % 10 as card_id, (cast({k} as int) % 10) % 3 as deck_id, case when event_type = 'signup' then 'sprint' else 'study' end as mode, case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 when 'purchase' then 4 else 3 end as rating, case when event_id % 7 = 0 then null else cast(floor(value * 100) as int) end as response_ms, ts as created_at, cast(ts as date) as reviewed_on from {events}",
    "drafts": "select *, cast(floor(rn / 3.0) as int) as page_number, cast(least(floor((rn - 1) / 13.0), 3) as int) as module, cast((rn - 1) % 13 + case when id % 17 = 0 then 2 else 1 end as int) as number from (select source as import_id, doc_id as id, row_number() over (partition by source order by doc_id) as rn, lang as section, n_chars, case when n_chars % 6 = 0 then null else substr('ABCD', cast(n_chars % 4 as int) + 1, 1) end as answer, case when n_chars % 9 = 0 then 'rejected' when n_chars % 5 = 0 then 'approved' else 'pending' end as status, case when n_chars % 7 = 0 then 'number_inferred' when n_chars % 11 = 0 then 'ocr_low' when n_chars % 13 = 0 then 'mystery' end as flag from {documents}) d",
    "key_lines": "select p_partkey % 10 as import_id, cast(floor(p_partkey / 200.0) as int) as page_number, cast(p_partkey % 200 as int) as line_no, case when p_partkey % 70 < 10 then concat('Reading and Writing Module ', cast(p_size % 4 as int), ' Answers') else concat(p_partkey % 27 + 1, '. ', substr('ABCD', cast(p_size % 4 as int) + 1, 1), '   ', p_size % 22 + 1, ' ', substr('DCBA', cast(p_partkey % 4 as int) + 1, 1)) end as line from {part}",
    "bank_pages": "select p_partkey % 10 as import_id, cast(p_partkey as int) as page_number, concat('Question ID: q', p_partkey, {nl}, p_name, ' is what?', {nl}, 'A) ', p_type, {nl}, 'B) two', {nl}, 'C) three', {nl}, case when p_size % 5 = 0 then '' else 'D) four' end, {nl}, case when p_size % 7 = 0 then '' else concat('Correct Answer: ', substr('ABCD', cast(p_size % 4 as int) + 1, 1)) end) as text from {part}",
}
#: Drafts are numbered without their texts, which are joined to them afterwards.
VIEWS["draft_texts"] = f"select n.*, t.text, t.text as prompt from ({VIEWS['drafts']}) n join {{documents}} t on n.id = t.doc_id"
_TABLES = {"attempts": "orders", "assignments": "orders", "questions": "part", "roster": "lineitem", "responses": "lineitem", "students": "customer", "classes": "nation", "reviews": "events", "drafts": "documents", "draft_texts": "documents", "key_lines": "part", "bank_pages": "part"}
#: Rows of views that are grouped and then joined by their keys are dealt by these keys before, so that adaptive execution merges none of their partitions.
_DEALT = {"roster": ("l_orderkey", "l_partkey"), "responses": ("l_orderkey", "l_partkey")}


class Views:
    """The domain inputs of a folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        source = _TABLES[name]
        rows = spread(self.table(source), *_DEALT[name]) if name in _DEALT else self.table(source)
        return self.spark.sql(VIEWS[name].replace("{k}", "get_json_object(props, '$.k')").replace("{nl}", "char(10)"), **{source: rows})


def _longs(query: str) -> str:
    """``count_if`` as Spark has it: a bigint, and 0 rather than null where the condition is never known."""
    at = query.find("count_if(")
    while at >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(query[end], 0)
            end += 1
        query = f"{query[:at]}count(case when {query[at + len('count_if(') : end - 1]} then 1 end){query[end:]}"
        at = query.find("count_if(")
    return query


def sql(query: str) -> str:
    """A query over the views as DuckDB SQL: those it names become common table expressions."""
    query = _longs(query)
    names = [n for n in VIEWS if any(f"{word} {n}" in f" {' '.join(query.split())} " for word in ("from", "join"))]
    view = lambda n: VIEWS[n].replace("{k}", "json_extract_string(props, '$.k')").replace("{nl}", "chr(10)").replace("{" + _TABLES[n] + "}", _TABLES[n])
    ctes = ", ".join(f"{n} as ({view(n)})" for n in names)
    body = " ".join(query.split())
    if not names:
        return body
    if body.startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    return f"with {ctes}, {body[5:]}" if body.startswith("with ") else f"with {ctes} {body}"


def plain(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines return the same kind."""
    return df.select([df[c].cast("string").alias(c) if kind == "date" else df[c] for c, kind in df.dtypes])


def dated(query: str, *columns: str) -> str:
    """The same for a DuckDB query."""
    return f"select * replace ({', '.join(f'{c}::varchar as {c}' for c in columns)}) from ({query})"
