"""Document fingerprints as threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the
document's, sketches of parts merge into the sketch of the whole, and the share of one sketch that is in
another estimates containment, however unequal the documents. Only DataFrame functions are used.

The hash of a shingle is the first 16 hex digits of its MD5; with 8 as the scale, those below ``2000...`` stay.
"""

from __future__ import annotations

import json
import string
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm._common import read

SHINGLE_WORDS = 5
#: One hash in so many stays.
SCALE = 8
#: Rows of a range of ids on average, and ranges at most (the table of ranges is broadcast, so this bounds it).
RANGE_ROWS, MOST_RANGES = 4_000, 65_536
#: Ids that are looked at for each range, to find where ranges begin.
SAMPLED = 20

_SPACE = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words between ASCII white space, A-Z in lower case."""
    flat = F.translate(text, string.ascii_uppercase + _SPACE, string.ascii_lowercase + " " * len(_SPACE))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def shingle_hashes(word_col: str, n: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``n`` words of an array column; of the whole array if it is shorter."""
    w = F.col(word_col)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
    hashes = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, n), " ")), 1, 16))
    return F.when(F.size(w) > 0, hashes).otherwise(F.array().cast("array<string>"))


def scaled(hashes: Column, scale: int = SCALE) -> Column:
    """The hashes below the threshold, in order, once each; the smallest hash if none is below it."""
    bound = F.lit(f"{2**64 // scale:016x}")
    low = F.filter(hashes, lambda h: h < bound)
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return F.array_sort(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(least)))


def sketch(df: DataFrame, text_col: str, out_col: str, scale: int = SCALE) -> DataFrame:
    """Add the sketch of a text column as an array of hashes; null and empty texts have an empty sketch."""
    df = df.withColumn("_w", words(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("_h", shingle_hashes("_w"))
    return df.withColumn(out_col, scaled(F.col("_h"), scale)).drop("_w", "_h")


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return scaled(F.array_union(a, b), scale)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the smaller sketch's shingles that the other has: 1 for two empty ones, else 0 with one."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / least.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """The estimated share of the shingles of both that either has."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both).cast("double"))


def _begins(df: DataFrame, key: str, range_rows: int) -> list[int | None]:
    """The keys at which ranges of about equally many rows begin, in order, null first; a key that fills several ranges is there several times.

    From a sample of ``SAMPLED`` rows a range, so the driver sees a bounded number of keys. How even the ranges are depends on it, no result does.
    """
    n = df.count()
    ranges = min(MOST_RANGES, n // range_rows)
    if ranges < 2:
        return []
    keys = [r[0] for r in df.select(F.col(key).cast("long")).sample(min(1.0, SAMPLED * ranges / n), 7).collect()]
    keys.sort(key=lambda k: (k is not None, k or 0))
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []


def _reached(key: Column, begins: list[int]) -> Column:
    """How many of the sorted ``begins`` a key has reached, looked up in two steps."""
    if not begins:
        return F.lit(0)
    wide = int(len(begins) ** 0.5) + 1
    runs = [begins[i : i + wide] for i in range(0, len(begins), wide)]
    table = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    firsts = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>")
    upto = lambda values: F.size(F.filter(values, lambda b: b <= key))
    run = upto(firsts)
    return F.when(run == 0, F.lit(0)).otherwise((run - 1) * wide + upto(F.element_at(table, F.greatest(run, F.lit(1)))))


def _range(key: Column, tie: Column, begins: list[int | None]) -> tuple[Column, Column]:
    """The range of a row, ordered like ``key`` (null first) and ``tie`` (hex), and the part of ``tie`` that it depends on: of keys that fill several ranges only."""
    parts = Counter(begins)
    nulls = parts.pop(None, 0)
    heavy = [k for k, m in parts.items() if m > 1]
    reached = _reached(key, sorted(parts)) + 1
    if not heavy and not nulls:
        return F.when(key.isNull(), F.lit(0)).otherwise(reached).cast("long") * 2 * MOST_RANGES, F.lit("")
    many = F.lit(nulls + 1)
    if heavy:
        table = F.from_json(F.lit(json.dumps({str(k): parts[k] for k in heavy})), "map<string,int>")
        many = F.when(key.isNull(), many).otherwise(F.coalesce(F.element_at(table, key.cast("string")), F.lit(0)))
    else:
        many = F.when(key.isNull(), many).otherwise(F.lit(0))
    # a heavy key's rows are dealt by its tie; keys after it in the same range come last
    part = F.when(many == 0, F.lit(2 * MOST_RANGES - 1)).otherwise(F.floor(F.conv(F.substring(tie, 1, 8), 16, 10).cast("double") / 2**32 * many))
    return F.when(key.isNull(), F.lit(0)).otherwise(reached).cast("long") * 2 * MOST_RANGES + part.cast("long"), F.when(many == 0, F.lit("")).otherwise(tie)


def with_next(df: DataFrame, key: str, carried: list[str], tie: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the next row by ``key``, cyclically.

    Null keys come first; equal keys are in the order of ``tie``, an MD5 in hex. Rows are dealt by ranges of about ``range_rows`` rows, whatever the keys are, and the first
    rows of each range also go to the range before it, so that no task needs more than a range. ``key`` is an integer column.
    """
    begins = _begins(df, key, range_rows)
    place, told = _range(F.col(key), tie, begins)
    first = F.struct(F.col(key).alias("k"), told.alias("t"))
    ranges = df.select(place.alias("_r"), first.alias("_f")).groupBy("_r").agg(F.min("_f").alias("_first"))
    every = Window.partitionBy(F.lit(0)).orderBy("_r")  # a row for each range
    ranges = ranges.withColumn("_before", F.coalesce(F.lag("_r").over(every), F.max("_r").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    own = F.struct(F.col("_r").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("r"), F.lit(True).alias("guest"))
    dealt = df.withColumns({"_r": place, "_f": first, "_tie": tie}).join(F.broadcast(ranges), "_r")
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_f").eqNullSafe(F.col("_first")), F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select(*df.columns, "_tie", F.col("_at.r").alias("_to"), F.col("_at.guest").alias("_guest"))
    run = Window.partitionBy("_to").orderBy("_guest", F.col(key).asc_nulls_first(), "_tie")
    dealt = dealt.select("*", *[F.lead(c).over(run).alias(f"next_{c}") for c in carried])
    return dealt.filter(~F.col("_guest")).drop("_to", "_guest", "_tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprint every whole text, and the text in which the next document's start stands for the last half.

    Returns a row for each document: ``id_col``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (the
    hashes of the sketch, joined), ``near_edited``, ``near_next`` (containment) and ``jaccard_edited``, ``jaccard_next``. Null
    texts count as empty; an empty fingerprint is like an empty one only. With null or repeated ids the next document is
    the next in the order of id (null first), MD5 of the text. Other columns are not read. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = with_next(sketch(slim, "text", "fp", scale), "id", ["text", "fp"], F.md5("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    df = sketch(df.drop("next_text"), "edited", "edited_fp", scale)
    return df.select(
        F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array_join("fp", "").alias("fingerprint"), F.array_join("edited_fp", "").alias("edited_fingerprint"),
        containment(F.col("fp"), F.col("edited_fp")).alias("near_edited"), containment(F.col("fp"), F.col("next_fp")).alias("near_next"), jaccard(F.col("fp"), F.col("edited_fp")).alias("jaccard_edited"), jaccard(F.col("fp"), F.col("next_fp")).alias("jaccard_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def _sketch_sql(text: str) -> str:
    """DuckDB: a sorted list of hashes of the expression ``text``."""
    words_sql = f"list_filter(string_split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda w: w <> '')"
    hashes = f"[substr(md5(array_to_string(ws[i:i+4], ' ')), 1, 16) for i in range(1, 1 + greatest(len(ws) - 4, least(len(ws), 1)))]"
    keep = f"list_filter(hs, lambda h: h < '{2**64 // SCALE:016x}')"
    return f"(select list_sort(list_distinct(case when len({keep}) > 0 then {keep} when len(hs) > 0 then [list_min(hs)] else [] end)) from (select {hashes} as hs from (select {words_sql} as ws)))"


def _near_sql(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0::double when least(len({a}), len({b})) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / least(len({a}), len({b}))::double end"


def _jaccard_sql(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0::double else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::double end"


OP10_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text from d),
e as (select *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) as edited from n),
s as (select *, {_sketch_sql("text")} as fp, {_sketch_sql("edited")} as efp, {_sketch_sql("next_text")} as nfp from e)
select doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(fp, '') as fingerprint, array_to_string(efp, '') as edited_fingerprint,
  {_near_sql("fp", "efp")} as near_edited, {_near_sql("fp", "nfp")} as near_next, {_jaccard_sql("fp", "efp")} as jaccard_edited, {_jaccard_sql("fp", "nfp")} as jaccard_next
from s
"""
