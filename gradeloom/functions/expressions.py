"""Column expressions of the grading and ingestion jobs; all but ``nfkc`` are built-in functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that OCR spaces out, stop words of stem buckets, months.
SPACED_WORDS = ("question", "questions", "reading", "writing", "math", "module", "choice", "choices", "answer", "answers", "key", "passage", "passages", "section", "test", "continue", "which", "used")
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "which", "what", "choice", "best", "most", "text", "based", "according", "following")
#: Quotes and dashes that are written plainly.
QUOTES, PLAIN_QUOTES = "“”«»„‟‘’‚‛—–―", "\"\"\"\"\"\"" + "'" * 4 + "---"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: White space, that of Unicode included.
_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _prefix_number(x: Column) -> Column:
    """The number that a string starts with; null if it starts with none."""
    return F.nullif(F.regexp_extract(x, _NUMBER, 1), F.lit("")).try_cast("double")


def math_value(answer: Column) -> Column:
    """A typed answer as a number to six decimals: commas dropped, one fraction evaluated, a zero denominator null."""
    text = F.regexp_replace(F.trim(answer), ",", "")
    over, under = _prefix_number(F.regexp_extract(text, r"^([^/]+)/([^/]+)$", 1)), _prefix_number(F.regexp_extract(text, r"^([^/]+)/([^/]+)$", 2))
    value = F.when(F.contains(text, F.lit("/")), F.try_divide(over, F.when(under != 0, under))).otherwise(_prefix_number(text))
    return F.floor(value * 1000000 + 0.5) / 1000000


def answers_match(submitted: Column, key: Column) -> Column:
    """Does a typed answer equal one of the alternatives of a key (split at ``|``), as numbers or else as trimmed strings?"""
    mine = F.lower(F.trim(submitted))
    value = math_value(submitted)
    same = F.exists(F.split(key, r"\|"), lambda k: F.when(value.isNotNull() & math_value(k).isNotNull(), value == math_value(k)).otherwise(F.when(value.isNull() & math_value(k).isNull(), mine == F.lower(F.trim(k))).otherwise(F.lit(False))))
    zero = F.coalesce(_prefix_number(F.regexp_extract(submitted, r"^([^/]+)/([^/]+)$", 2)) == 0, F.lit(False))  # such a fraction equals nothing
    blank = zero | submitted.isNull() | key.isNull() | (F.trim(submitted) == "") | F.contains(submitted, F.lit("|"))
    return F.when(blank, F.lit(False)).otherwise(F.coalesce(same, F.lit(False)))


def key_answer(answer: Column) -> Column:
    """A key's answer in one spelling: LaTeX fractions and bars, ``or``, minus signs, commas, upper case."""
    x = F.regexp_replace(answer, r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    x = F.regexp_replace(x, r"\\mid|\s+or\s+", " | ")
    x = F.regexp_replace(x, "[−–]", "-")
    x = F.regexp_replace(x, r"(\d),(?=\d{3}\b)", "$1")
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def content_text(x: Column) -> Column:
    """Text in one spelling for duplicates: lower case, plain quotes and dashes, runs of dots and spaces as one space, blanks of one length, no space in parentheses."""
    y = F.translate(F.lower(x), QUOTES, PLAIN_QUOTES)
    y = F.regexp_replace(F.regexp_replace(y, r"\.{2,}", " "), r"_{2,}", " ____ ")
    y = F.regexp_replace(y, rf"{_SPACE}+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(y, r"\(\s+", "("), r"\s+\)", ")"))


def fingerprint(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts that are not null, one to a line."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 32)


def question_fingerprint(section: Column, kind: Column, passage: Column, prompt: Column, choices: Column, answer: Column) -> Column:
    """The fingerprint of a question's content: section, type, passage, prompt, its labelled choices in order and its answer, if it has one.

    Where a question comes from is no part of it. ``choices`` is an array of structs of label and text; null texts are empty.
    """
    text = lambda x: content_text(F.coalesce(x, F.lit("")))
    labelled = F.transform(F.coalesce(choices, F.array().cast("array<struct<label:string,text:string>>")), lambda c: F.concat(F.upper(F.coalesce(c["label"], F.lit(""))), F.lit("="), text(c["text"])))
    key = F.when(answer != "", F.concat(F.lit("key="), content_text(answer)))
    lines = F.concat(F.array(F.coalesce(section, F.lit("")), F.coalesce(kind, F.lit("")), text(passage), text(prompt)), labelled, F.array_compact(F.array(key)))
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 32)


def stem_bucket(section: Column, prompt: Column, choices: Column) -> Column:
    """Section, number of choices and the first ten telling words of a prompt."""
    found = F.filter(F.split(F.regexp_replace(content_text(prompt), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.concat_ws("|", section, F.concat(F.lit("mc"), choices.cast("string")), F.array_join(F.slice(found, 1, 10), " "))


def rewritten(x: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """A text with each match of a pattern changed by an expression."""
    between, found = F.split(x, pattern), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(between, found, lambda b, f: F.array(F.coalesce(b, F.lit("")), F.when(f.isNotNull(), change(f)).otherwise("")))), "")


def repaired(text: Column) -> Column:
    """OCR repair: escaped blanks of three or more, known words that are spaced out, choice markers, spaced key entries, module headings."""
    joined = lambda run: F.regexp_replace(run, r"\s+", "")
    known = lambda run: F.when(F.lower(joined(run)).isin(*SPACED_WORDS), joined(run)).otherwise(run)
    x = rewritten(text, r"(?:\\_){3,}", lambda run: F.repeat(F.lit("_"), (F.length(run) / 2).cast("int")))
    x = rewritten(x, r"(?<![A-Za-z0-9_])[A-Za-z](?:[^\S\n]+[A-Za-z]{1,2})+(?![A-Za-z0-9_])", known)
    x = rewritten(x, r"(?<![A-Za-z0-9_])[A-Za-z][^\S\n]+[A-Za-z]{3,}(?![A-Za-z0-9_])", known)
    x = F.regexp_replace(x, r"(?md)^(\s*)([A-H])\s*[.)]\s*", "$1$2. ")
    x = F.regexp_replace(x, r"(?md)^(\s*\d{1,3})\s+\.\s+([A-Ha-h]|[+-]?\d+(?:\.\d+)?(?:\s*/\s*\d+)?)\s*$", "$1. $2")
    x = F.regexp_replace(x, r"(?md)^(\s*)(Module\s+\d)\s*:\s*(Reading and Writing|Math)\s+(Question\s+\d)\s*$", "$1$3 $2\n$1$4")
    return F.regexp_replace(x, r"(?md)^(\s*)(Module\s+\d)\s*:\s*(Reading and Writing|Math)\s*$", "$1$3 $2")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(x: Column) -> Column:
    """Unicode's compatibility composition. Spark has no function for it; only texts that aren't ASCII are sent to Python, in Arrow batches."""
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def exact_text(x: Column) -> Column:
    """Text in one spelling for comparisons to the letter: NFKC, plain quotes and dashes, runs of white space as one space; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(nfkc(x), F.lit("")), QUOTES, PLAIN_QUOTES), rf"{_SPACE}+", " "))


def evidence(x: Column) -> Column:
    """Letters and digits only, in NFKC and lower case."""
    return F.regexp_replace(F.lower(nfkc(x)), r"[^\p{L}\p{N}]+", "")


def tokens(x: Column) -> Column:
    """The distinct words longer than two letters."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller of two sets that both have; 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def module_name(x: Column) -> Column:
    """``rw1``, ``rw2``, ``math1`` or ``math2``; null if a name gives no section or number."""
    section = F.when(F.lower(x).rlike("math"), "math").when(F.lower(x).rlike("read|writ|english|verbal"), "rw")
    number = F.nullif(F.regexp_extract(F.lower(x), r"(?:module|part|m)\s*([12])\b", 1), F.lit(""))
    return F.when(section.isNotNull() & number.isNotNull(), F.concat(section, number))


def label_year(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int")


def label_month(x: Column) -> Column:
    """The month that a label names or abbreviates, 1 to 12."""
    out = F.lit(None).cast("int")
    for i in range(12, 0, -1):
        name = MONTHS[i - 1]
        out = F.when(F.lower(x).rlike(rf"\b({name}|{name[:3]})\b"), F.lit(i)).otherwise(out)
    return out


def label_region(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.rlike(r"\b(us|usa|domestic)\b"), "us").when(low.rlike(r"\b(int|intl|international|asia)\b"), "international")


def label_variant(x: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(x, r"(?i)\b(?:form|version|v|test)\s*([a-z0-9])\b", 1)), F.lit(""))


def progress_status(assigned: Column, due: Column, attempt: Column, now: Column) -> Column:
    """The latest attempt decides; else what is not ``assigned`` passes through, and what is past due is overdue."""
    return F.when(attempt == "graded", "completed").when(attempt.isNotNull(), "in_progress").when(assigned != "assigned", assigned).when(due < now, "overdue").otherwise("assigned")


def explanations_open(released: Column, submitted: Column, now: Column) -> Column:
    """By hand, or seven days after submission; never for a null or future submission."""
    return F.coalesce(released, F.lit(False)) | F.coalesce((submitted <= now) & (submitted + F.expr("interval 7 days") <= now), F.lit(False))


def remaining_seconds(remaining: Column, limit_minutes: Column, elapsed: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.coalesce(remaining.cast("double"), limit_minutes * 60.0) - elapsed)).cast("long")


def difficulty_label(d: Column) -> Column:
    return F.when(d <= 2, "easy").when(d >= 4, "hard").otherwise("medium")


def profile_complete(*fields: Column) -> Column:
    return F.forall(F.array(*[F.coalesce(F.trim(f), F.lit("")) for f in fields]), lambda x: x != "")


def retrievability(elapsed_days: Column, stability: Column, decay: float = 0.1542) -> Column:
    """The power forgetting curve of FSRS-6: 0.9 when the elapsed days equal the stability."""
    factor = 0.9 ** (-1 / decay) - 1
    return F.pow(1 + factor * elapsed_days / stability, F.lit(-decay))


def next_interval(stability: Column, retention: float = 0.95, decay: float = 0.1542, most: int = 36_500) -> Column:
    factor = 0.9 ** (-1 / decay) - 1
    return F.least(F.greatest(F.floor(stability / factor * (retention ** (-1 / decay) - 1) + 0.5), F.lit(1)), F.lit(most)).cast("long")


def snapshot_hash(*cols: str) -> Column:
    """SHA-256 of a row's JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def local_date(ts: Column, offset_hours: int) -> Column:
    return F.to_date(ts + F.expr(f"interval {offset_hours} hours"))
