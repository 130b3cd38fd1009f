"""Document ingestion: page text to blocks, keys, matches and duplicates, for whole corpora at once.

Every operator keeps to ``import_id`` (and module) as its partitioning, so a plan of several shuffles once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.expressions import content_text, evidence, label_month, label_region, label_variant, label_year, overlap, question_fingerprint, repaired, stem_bucket, tokens
from gradeloom.functions.lineage import cut
from gradeloom.functions.relational import islands

#: Questions of the four modules of a full test, and the signs of a phantom prompt.
MODULES = ((0, 27), (1, 27), (2, 22), (3, 22))
PHANTOM = (r"(?i)student-produced response directions", r"(?i)more than one correct answer", r"(?i)answer preview", r"(?i)rectangular box[^.]{0,120}(write|enter|blank|answer)", r"(?i)mark for review", r"(?i)hide\s+calculator", r"(?i)back\s+next")
#: Fixed value: the flag of a question that took in its repeat.
REPEATED = "repeated_source_question_coalesced"
#: Words of a math question, and a formula that compares, divides or raises.
MATH_WORDS = r"(?i)\b(equation|expression|solution|slope|function|triangle|circle|radius|diameter|quadratic|perpendicular|coordinate|xy-plane|kilograms?|joules?|inches?|centimeters?|area|perimeter|percent|system of equations)\b"
MATH_FORMULA = r"\$[^$]*(?:=|\\frac|\\sqrt|\^|[<>])[^$]*\$"


def normalize_pages(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Repaired text, whether it changed, and its lengths before and after."""
    fixed = repaired(F.col(text))
    return pages.select(key, fixed.alias("text"), (fixed != F.col(text)).alias("changed"), F.length(text).alias("before"), F.length(fixed).alias("after"))


def text_quality(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Words, characters, markers, mean line length and thin pages (which need OCR) of a document, and a verdict: good if it has more than 50 words in lines of more than 15 characters, and a question or two choices."""
    t = F.col(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    rows = pages.select(key, words.alias("w"), F.length(t).alias("c"), F.regexp_count(t, F.lit(r"(?md)^\s*\d{1,3}\s*[.)]\s+\S")).alias("q"), F.regexp_count(t, F.lit(r"(?md)^\s*[A-H]\s*[.)]\s+\S")).alias("k"), lines.alias("l"))
    out = rows.groupBy(key).agg(F.sum("w").alias("words"), F.sum("c").alias("chars"), F.sum("q").alias("question_marks"), F.sum("k").alias("choice_marks"), F.sum("l").alias("lines"), F.count_if(F.col("w") < 15).alias("thin_pages"), F.count("*").alias("pages"))
    out = out.withColumn("line_length", F.coalesce(F.floor(F.try_divide(F.col("chars").cast("double"), F.col("lines").cast("double")) + 0.5), F.lit(0)).cast("long"))
    substance = (F.col("words") > 50) & (F.col("line_length") > 15)
    return out.withColumn("quality", F.when(substance & ((F.col("question_marks") >= 1) | (F.col("choice_marks") >= 2)), "good").otherwise("poor"))


def extract_keys(lines: DataFrame) -> DataFrame:
    """Answer-key entries of lines (import_id, page_number, line_no, line) under the module heading that stands before them.

    A heading is a line with ``Module n``; entries are ``n. X`` pairs, several to a line.
    """
    order = Window.partitionBy("import_id").orderBy("page_number", "line_no")
    heading = F.nullif(F.regexp_extract("line", r"(?i)\bmodule\s+(\d)\b", 1), F.lit("")).try_cast("int")
    under = lines.withColumn("module", F.last(heading, ignorenulls=True).over(order))
    pairs = F.regexp_extract_all("line", F.lit(r"\b(\d{1,2})[.)]?\s+([A-D])\b"), F.lit(0))
    hits = under.filter("module is not null").select("import_id", "module", "page_number", "line_no", F.posexplode(pairs).alias("place", "pair"))
    return hits.select("import_id", "module", "page_number", "line_no", "place", F.regexp_extract("pair", r"^(\d+)", 1).cast("int").alias("number"), F.substring("pair", -1, 1).alias("answer"))


#: The heading of a module's answers and one answer of it.
KEY_HEADING = r"(?i)^#*\s*(Reading and Writing|Math)\s+Module\s+([12])\s+Answers?\s*$"
KEY_LINE = r"^\*{0,2}(\d{1,2})[.)]\*{0,2}\s+(.+?)\s*$"


def scoped_keys(lines: DataFrame) -> DataFrame:
    """Answer-key entries, one to a line, under the heading of their module: ``module`` (0 to 3), ``heading`` (that of the heading), ``number``, ``answer`` and ``place`` in the module.

    A heading that was read too early stands above the last entries of the module before it: an entry whose number is beyond its module, and
    the next one that the module before lacks, goes back there. Whether it is depends on the entries that went back before it, so the entries of
    each import, one document's, are folded in order. ``lines``: import_id, page_number, line_no, line.
    """
    line = F.trim("line")
    number = F.nullif(F.regexp_extract(line, KEY_LINE, 1), F.lit("")).try_cast("int")
    answer = F.trim(F.regexp_replace(F.regexp_extract(line, KEY_LINE, 2), r"\*+\s*$", ""))
    module = F.when(F.lower(F.regexp_extract(line, KEY_HEADING, 1)) == "math", 1).otherwise(-1) + F.nullif(F.regexp_extract(line, KEY_HEADING, 2), F.lit("")).try_cast("int")
    marked = lines.select("import_id", "page_number", "line_no", module.alias("opens"), F.when(module.isNull() & (answer != ""), number).alias("number"), answer.alias("answer"))
    order = Window.partitionBy("import_id").orderBy("page_number", "line_no")
    under = marked.withColumn("heading", F.last("opens", ignorenulls=True).over(order)).filter("number is not null and heading is not null")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page_number", "line_no"])
        have, modules, places = [0, 0, 0, 0], [], []
        for n, h in zip(rows["number"].tolist(), rows["heading"].tolist()):
            back = h > 0 and n > MODULES[h][1] and n == have[h - 1] + 1 and n <= MODULES[h - 1][1]
            m = h - 1 if back else h
            have[m] += 1
            modules.append(m)
            places.append(have[m])
        return rows.assign(module=modules, place=places)[["import_id", "page_number", "line_no", "heading", "module", "place", "number", "answer"]]

    kind = dict(lines.dtypes)
    out = f"import_id {kind['import_id']}, page_number int, line_no int, heading int, module int, place int, number int, answer string"
    slim = under.select("import_id", F.col("page_number").cast("int").alias("page_number"), F.col("line_no").cast("int").alias("line_no"), "heading", "number", "answer")
    return slim.groupBy("import_id").applyInPandas(fold, out)


def scoped_exactness(keys: DataFrame) -> DataFrame:
    """For each import with scoped keys: entries of the four modules, and whether each has all its numbers in order (``exact``)."""
    right = F.col("number") == F.col("place")
    counts = [F.count_if(F.col("module") == m).alias(f"c{m}") for m, _ in MODULES]
    out = keys.groupBy("import_id").agg(*counts, F.count_if(~right).alias("astray"))
    exact = F.col("astray") == 0
    for m, n in MODULES:
        exact = exact & (F.col(f"c{m}") == n)
    return out.select("import_id", *[f"c{m}" for m, _ in MODULES], "astray", exact.alias("exact"))


def rows_continue(before: Column, after: Column) -> Column:
    """Does a row of a key's table (an array of numbers) go on with the row before it? Either every column does, or it begins after the largest number of an equally long one."""
    k = F.least(F.size(before), F.size(after))
    columns = F.forall(F.arrays_zip(F.slice(before, F.lit(1), k).alias("b"), F.slice(after, F.lit(1), k).alias("a")), lambda x: x["a"] == x["b"] + 1)
    along = (F.size(before) == F.size(after)) & (F.array_min(after) == F.array_max(before) + 1)
    return F.coalesce((k > 0) & (columns | along), F.lit(False))


def key_columns(lines: DataFrame) -> DataFrame:
    """Rows of key tables, lines with several ``n. X`` pairs, in blocks that go on from row to row: ``block``, and ``column`` and ``number`` of each pair.

    ``lines``: import_id, page_number, line_no, line. A line without a pair ends no block; a row that doesn't continue the one before begins a new one.
    """
    pairs = F.transform(F.regexp_extract_all("line", F.lit(r"\b(\d{1,2})[.)]?\s+[A-D]\b"), F.lit(1)), lambda n: n.cast("int"))
    rows = lines.select("import_id", "page_number", "line_no", pairs.alias("numbers")).filter(F.size("numbers") > 0)
    order = Window.partitionBy("import_id").orderBy("page_number", "line_no")
    starts = ~rows_continue(F.coalesce(F.lag("numbers").over(order), F.array().cast("array<int>")), F.col("numbers"))
    blocks = rows.withColumn("starts", starts.cast("int")).withColumn("block", F.sum("starts").over(order))
    return blocks.select("import_id", "block", "page_number", "line_no", F.posexplode("numbers").alias("column", "number"))


def key_exactness(keys: DataFrame) -> DataFrame:
    """Whether a module's key has each number once, and how many it should have."""
    expected = F.element_at(F.create_map(*[F.lit(x) for pair in MODULES for x in pair]), F.col("module"))
    out = keys.groupBy("import_id", "module").agg(F.count("*").alias("entries"), F.countDistinct("number").alias("numbers"), F.max("number").alias("top"))
    return out.select("import_id", "module", "entries", "numbers", expected.alias("expected"), ((F.col("entries") == F.col("numbers")) & (F.col("numbers") == F.col("top")) & (F.col("numbers") == expected)).alias("exact"))


def key_runs(numbers: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive key numbers of an import; those that start at 1 begin a column, the others go on with one."""
    runs = islands(numbers.select("import_id", "number").distinct(), ["import_id"], "number").groupBy("import_id", "island").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("length"))
    return runs.filter(F.col("length") >= least).select("import_id", "first", "last", "length", (F.col("first") == 1).alias("starts"))


def question_blocks(lines: DataFrame, start: Column) -> DataFrame:
    """Blocks of lines from one start to the next: their number, lines, pages, prompt and choices. Lines before the first start are in none."""
    order = Window.partitionBy("import_id").orderBy("page_number", "line_no")
    marked = lines.withColumn("block", F.sum(start.cast("int")).over(order)).filter("block > 0")
    choice = F.col("line").rlike(r"^\(?[A-D][.)]")
    parts = F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line", choice.alias("choice"))))  # the lines of one block
    out = marked.groupBy("import_id", "block").agg(F.count("*").alias("lines"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count_if(choice).alias("choices"), parts.alias("parts"))
    prompt = F.array_join(F.transform(F.filter("parts", lambda p: ~p["choice"]), lambda p: p["line"]), " ")
    return out.select("import_id", "block", "lines", "first_page", "last_page", "choices", prompt.alias("prompt"))


def bank_blocks(blocks: DataFrame) -> DataFrame:
    """Bank questions of blocks that start with ``Question ID``: id, key, rationale, and why a block can't be used."""
    p = F.col("prompt")
    out = blocks.withColumns({"question_id": F.nullif(F.regexp_extract(p, r"(?i)question id:?\s*(\w+)", 1), F.lit("")), "key": F.nullif(F.regexp_extract(p, r"(?i)correct answer:?\s*(\S+)", 1), F.lit("")), "rationale": F.nullif(F.trim(F.regexp_extract(p, r"(?i)rationale:?\s*(.*)$", 1)), F.lit(""))})
    return out.withColumn("error", F.when(F.col("question_id").isNull(), "no_id").when(F.col("key").isNull(), "no_key").when(~F.col("choices").isin(0, 4), "bad_choices")).select("import_id", "block", "question_id", "key", "rationale", "choices", "error")


def module_completeness(questions: DataFrame) -> DataFrame:
    """Questions of each import's module against the expected number, missing modules included."""
    spine = F.explode(F.array(*[F.struct(F.lit(m).alias("module"), F.lit(n).alias("expected")) for m, n in MODULES]))
    have = questions.groupBy("import_id", "module").agg(F.countDistinct("number").alias("actual"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    full = questions.select("import_id").distinct().withColumn("m", spine).select("import_id", "m.module", "m.expected").join(have, ["import_id", "module"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    gap = F.col("expected") - F.col("actual")
    return full.select("import_id", "module", "expected", "actual", F.greatest(gap, F.lit(0)).alias("missing"), F.greatest(-gap, F.lit(0)).alias("over"), "first_page", "last_page", F.when(gap == 0, "complete").when(gap > 0, "partial").otherwise("over").alias("status"))


def repair_numbers(rows: DataFrame) -> DataFrame:
    """Numbers restored from both neighbours: where a row's number is missing or cut off and its neighbours are n-1 and n+1."""
    along = Window.partitionBy("import_id").orderBy("seq")
    fits = F.lag("number").over(along) + 2 == F.lead("number").over(along)
    fixed = F.when(fits & ~F.col("number").eqNullSafe(F.lag("number").over(along) + 1), F.lag("number").over(along) + 1).otherwise(F.col("number"))
    return rows.select("import_id", "seq", "number", fixed.alias("repaired"))


def fill_runs(rows: DataFrame) -> DataFrame:
    """Numbers of a run of rows without one, if the free numbers between its observed neighbours are as many as the run."""
    along = Window.partitionBy("import_id").orderBy("seq")
    before = F.last("number", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("number", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    run = F.count("number").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumns({"before": before, "after": after, "run": run})
    inside = Window.partitionBy("import_id", "run")
    marked = marked.withColumns({"k": F.row_number().over(inside.orderBy("seq")), "n": F.count_if(F.col("number").isNull()).over(inside), "has": F.count("number").over(inside)})
    filled = F.when(F.col("number").isNull() & (F.col("after") - F.col("before") - 1 == F.col("n")), F.col("before") + F.col("k") - F.col("has"))
    return marked.select("import_id", "seq", "number", F.coalesce("number", filled).cast("int").alias("filled"))


def section_transition(rows: DataFrame, text: str, width: int = 5, least: int = 3, skipped: int = 20) -> DataFrame:
    """The first place, after ``skipped`` texts, from which ``least`` of the next ``width`` texts are math; null if there is none with so many after it."""
    along = Window.partitionBy("import_id").orderBy("seq")
    ahead = along.rowsBetween(0, width - 1)
    math = (F.col(text).rlike(MATH_WORDS) | F.col(text).rlike(MATH_FORMULA)).cast("int")
    signs = rows.select("import_id", "seq", math.alias("math")).withColumns({"signs": F.sum("math").over(ahead), "wide": F.count("*").over(ahead), "place": F.row_number().over(along)})
    found = (F.col("signs") >= least) & (F.col("wide") == width) & (F.col("place") > skipped)
    return signs.groupBy("import_id").agg(F.min(F.when(found, F.col("seq"))).alias("transition"))


def exact_duplicates(questions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Questions whose content another has too: fingerprint, ``size`` of its group, ``canonical`` (the key of the first by ``order``) and whether one is a later copy.

    ``questions``: key, section, kind, passage, prompt, choices (label and text), answer and the columns of ``order``. Questions without a
    prompt, passage or choice are left out. Fingerprints are made once and written, before they are grouped and joined.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = blank(F.col("prompt")) & blank(F.col("passage")) & (F.coalesce(F.size("choices"), F.lit(0)) <= 0)
    fp = question_fingerprint(*[F.col(c) for c in ("section", "kind", "passage", "prompt", "choices", "answer")])
    rows = cut(questions.filter(~empty).select(key, fp.alias("fp"), F.struct(*order, key).alias("o")))
    groups = rows.groupBy("fp").agg(F.count("*").alias("size"), F.min_by(key, "o").alias("canonical")).filter("size > 1")
    return rows.join(groups, "fp").select(key, "fp", "size", "canonical", (F.col(key) != F.col("canonical")).alias("is_copy"))


def near_buckets(docs: DataFrame, key: str, section: Column, prompt: Column, choices: Column) -> DataFrame:
    """Buckets of documents with the same telling first words, for review."""
    rows = docs.select(key, stem_bucket(section, prompt, choices).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).filter("size > 1")


def coalesce_repeats(drafts: DataFrame, pages: int = 3, least: float = 0.82) -> DataFrame:
    """Repeats of a question on near pages: pairs of one module and number with nearly the same prompt and, where both have some, the same choices.

    The richer one (prompt and choices together; the smaller id on a tie) stays, on the earlier page, with the flags of both and ``REPEATED``.
    ``drafts``: import_id, module, number, id, page_number, prompt, and choices and flags as arrays. Pages meet in buckets as wide as the distance.
    """
    plain = F.transform("choices", lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")))
    rich = F.length("prompt") + F.aggregate("choices", F.lit(0), lambda n, c: n + F.length(c))
    rows = drafts.select("import_id", "module", "number", "id", "page_number", "flags", plain.alias("choices"), rich.alias("rich"), tokens(F.col("prompt")).alias("tokens"))
    key = ["import_id", "module", "number"]
    side = lambda i, bucket: rows.select(*key, bucket.alias("bucket"), *[F.col(c).alias(f"{c}{i}") for c in rows.columns if c not in key])
    at = F.floor(F.col("page_number") / (pages + 1))
    pairs = side(1, at).join(side(2, F.explode(F.sequence(at - 1, at + 1))), [*key, "bucket"]).filter((F.col("id1") < F.col("id2")) & (F.abs(F.col("page_number1") - F.col("page_number2")) <= pages))
    agree = (F.size("choices1") == 0) | (F.size("choices2") == 0) | (F.col("choices1") == F.col("choices2"))
    same = pairs.filter(agree).withColumn("overlap", overlap(F.col("tokens1"), F.col("tokens2"))).filter(F.col("overlap") >= least)
    first = F.col("rich1") >= F.col("rich2")
    kept, dropped = F.when(first, F.col("id1")).otherwise(F.col("id2")), F.when(first, F.col("id2")).otherwise(F.col("id1"))
    flags = F.array_join(F.array_sort(F.array_union(F.array_union("flags1", "flags2"), F.array(F.lit(REPEATED)))), ",")
    return same.select(*key, kept.alias("kept"), dropped.alias("dropped"), F.least("page_number1", "page_number2").alias("page_number"), F.floor(F.col("overlap") * 1000 + 0.5).cast("long").alias("overlap_permille"), flags.alias("flags"))


def attribute_figures(questions: DataFrame, boxes: DataFrame) -> DataFrame:
    """The k-th box of a page goes to the question whose running count of markers first reaches k; what is left has no question."""
    run = Window.partitionBy("page_id").orderBy("seq")
    q = questions.withColumn("upto", F.sum("markers").over(run)).withColumn("from", F.col("upto") - F.col("markers"))
    b = boxes.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("box_id")))
    hit = b.join(q.select("page_id", "seq", "from", "upto"), (b["page_id"] == q["page_id"]) & (b["k"] > q["from"]) & (b["k"] <= q["upto"]), "left")
    return hit.select(b["page_id"], "box_id", "k", "seq", F.when(F.col("seq").isNull(), "needs_review").otherwise("attributed").alias("status"))


def match_answers(questions: DataFrame, keys: DataFrame, positional: DataFrame | None = None) -> DataFrame:
    """Match key entries to questions in a cascade of ``question_id``, ``module_position`` and ``document_position``.

    A question takes the entry of its module and number if both are unique. What is left of a module goes by position only if the module has one
    entry for each question and the earlier matches agree with that order; bare entries go by position in the document only if there is one for
    each question and no entry names a module. ``positional`` has the import_id of documents that may do the last; all, if it is left out.
    ``questions``: import_id, seq, module, number; ``keys``: import_id, entry, module, number, answer. Modules and numbers may be null.
    """
    one_key = keys.filter("module is not null").groupBy("import_id", "module", "number").agg(F.count("*").alias("n"), F.min("answer").alias("answer"), F.min("entry").alias("entry")).filter("n = 1")
    one_question = questions.filter("module is not null and number is not null").groupBy("import_id", "module", "number").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).filter("n = 1")
    found = lambda df, method, sure: df.select("import_id", "seq", "entry", "answer", F.lit(method).alias("method"), F.lit(sure).alias("confidence"))
    first = found(one_question.drop("n").join(one_key.drop("n"), ["import_id", "module", "number"]), "question_id", "high")
    place = lambda df, by, keys: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))

    module = ["import_id", "module"]
    even = questions.groupBy(*module).agg(F.count("*").alias("n")).join(keys.groupBy(*module).agg(F.count("*").alias("n")), [*module, "n"]).select(*module)
    placed = place(questions.join(even, module, "left_semi"), "seq", module).join(place(keys.join(even, module, "left_semi"), "entry", module).select(*module, "k", "entry", "answer"), [*module, "k"])
    placed = placed.join(first.select("import_id", "seq", F.col("entry").alias("known")), ["import_id", "seq"], "left")
    agreed = placed.groupBy(*module).agg(F.bool_and(F.coalesce(F.col("known") == F.col("entry"), F.lit(True))).alias("agrees")).filter("agrees")
    second = found(placed.filter("known is null").join(agreed, module, "left_semi"), "module_position", "low")

    bare = keys.groupBy("import_id").agg(F.count("*").alias("n"), F.count("module").alias("named")).filter("named = 0").join(questions.groupBy("import_id").agg(F.count("*").alias("n")), ["import_id", "n"]).select("import_id")
    bare = bare if positional is None else bare.join(positional, "import_id", "left_semi")
    both = place(questions.join(bare, "import_id", "left_semi"), "seq", ["import_id"]).join(place(keys.join(bare, "import_id", "left_semi"), "entry", ["import_id"]).select("import_id", "k", "entry", "answer"), ["import_id", "k"])
    matched = first.unionByName(second).unionByName(found(both, "document_position", "low"))
    return questions.select("import_id", "seq", "module", "number").join(matched, ["import_id", "seq"], "left").withColumn("method", F.coalesce("method", F.lit("unmatched")))


def unmatched_keys(questions: DataFrame, keys: DataFrame, matches: DataFrame) -> DataFrame:
    """Key entries that no question took, and why: another number of questions than of entries in their module (or document), or no such question."""
    free = keys.join(matches.filter("entry is not null").select("import_id", "entry"), ["import_id", "entry"], "left_anti")
    some = lambda df, name: df.groupBy("import_id", "module").agg(F.count("*").alias(name))
    all_questions = questions.groupBy("import_id").agg(F.count("*").alias("all"))
    nk, nq = some(keys, "nk").withColumnRenamed("module", "m"), some(questions, "nq").withColumnRenamed("module", "m")
    rows = free.withColumnRenamed("import_id", "i")
    rows = rows.join(nk, (F.col("i") == nk["import_id"]) & F.col("module").eqNullSafe(nk["m"]), "left").drop("import_id", "m")
    rows = rows.join(nq, (F.col("i") == nq["import_id"]) & (F.col("module") == nq["m"]), "left").drop("import_id", "m").withColumnRenamed("i", "import_id").join(all_questions, "import_id", "left")
    target = F.coalesce(F.when(F.col("module").isNull(), F.col("all")).otherwise(F.col("nq")), F.lit(0))
    reason = F.when((target > 0) & (F.col("nk") != target), "question_key_count_mismatch").otherwise("no_matching_question")
    return rows.select("import_id", "entry", "module", "number", reason.alias("reason"))


def assess_keys(matches: DataFrame, keys: DataFrame) -> DataFrame:
    """Complete, partial, missing or low-confidence keys of an import, and warnings."""
    n = keys.groupBy("import_id").agg(F.count("*").alias("entries"))
    out = matches.groupBy("import_id").agg(F.count("*").alias("questions"), F.count("entry").alias("matched"), F.count_if(F.col("confidence") == "low").alias("by_position")).join(n, "import_id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    status = F.when(F.col("entries") == 0, "missing").when(F.col("by_position") * 2 > F.col("matched"), "low_confidence").when(F.col("matched") == F.col("questions"), "complete").otherwise("partial")
    warnings = F.array_compact(F.array(F.when(F.col("entries") > F.col("questions"), F.lit("extra_entries")), F.when(F.col("entries") < F.col("questions"), F.lit("short_key")), F.when(F.col("by_position") > 0, F.lit("matched_by_position"))))
    return out.select("import_id", "questions", "matched", "by_position", "entries", status.alias("status"), F.array_join(warnings, ",").alias("warnings"))


def find_existing(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """For each incoming label: ``duplicate`` of a source with the same label or identity, ``review`` if region or variant is unknown on a side, else ``new``."""

    def identity(df: DataFrame, prefix: str) -> DataFrame:
        x = F.col("label")
        return df.select(F.col("id").alias(f"{prefix}id"), F.lower(F.trim(x)).alias(f"{prefix}label"), label_year(x).alias("year"), label_month(x).alias("month"), label_region(x).alias(f"{prefix}region"), label_variant(x).alias(f"{prefix}variant"))

    mine, theirs = identity(labels, ""), identity(sources, "s_")
    same = mine.join(theirs.select("year", "month", "s_region", "s_variant").distinct(), ["year", "month"])
    clash = lambda a, b: (F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()
    vague = ~F.col("region").eqNullSafe(F.col("s_region")) | ~F.col("variant").eqNullSafe(F.col("s_variant"))
    by_identity = same.filter(~F.coalesce(clash("region", "s_region"), F.lit(False)) & ~F.coalesce(clash("variant", "s_variant"), F.lit(False))).groupBy("id").agg(F.bool_or(~vague).alias("sure"))
    by_label = mine.join(theirs.select("s_label").distinct(), F.col("label") == F.col("s_label")).select("id", F.lit(True).alias("exact")).distinct()
    out = mine.select("id").join(by_identity, "id", "left").join(by_label, "id", "left")
    return out.select("id", F.when(F.coalesce("exact", F.lit(False)) | F.coalesce("sure", F.lit(False)), "duplicate").when(F.col("sure").isNotNull(), "review").otherwise("new").alias("verdict"))


def source_evidence(drafts: DataFrame, pages: DataFrame, anchor: int = 48) -> DataFrame:
    """Is the start of a draft's prompt in the text of its page or of one beside it?"""
    near = drafts.withColumn("p", F.explode(F.array(F.col("page_number") - 1, F.col("page_number"), F.col("page_number") + 1)))
    text = pages.select("import_id", F.col("page_number").alias("p"), evidence(F.col("text")).alias("e"))
    hit = near.join(text, ["import_id", "p"]).withColumn("found", F.contains(F.col("e"), F.substring(evidence(F.col("prompt")), 1, anchor)))
    return hit.groupBy("import_id", "id").agg(F.bool_or("found").alias("found"), F.count("*").alias("pages"))


def choices_preserved(old: DataFrame, new: DataFrame, pages: int = 1, least: int = 12) -> DataFrame:
    """Is every old choice that is not blank equal to, or (from ``least`` characters on) the start of, a new one within a page?

    Either way both have the same first ``least`` characters, or are the same shorter text, so only these meet.
    """
    before = old.select("import_id", "id", "page_number", evidence(F.col("choice")).alias("c")).filter("c <> ''").withColumn("head", F.substring("c", 1, least))
    after = new.select("import_id", F.explode(F.sequence(F.col("page_number") - pages, F.col("page_number") + pages)).alias("page_number"), evidence(F.col("choice")).alias("d")).distinct().withColumn("head", F.substring("d", 1, least))
    joined = before.join(after, ["import_id", "page_number", "head"], "left")
    kept = joined.groupBy("import_id", "id", "c").agg(F.bool_or((F.col("c") == F.col("d")) | ((F.length("c") >= least) & F.col("d").startswith(F.col("c")))).alias("kept"))
    return kept.groupBy("import_id", "id").agg(F.bool_and(F.coalesce("kept", F.lit(False))).alias("preserved"), F.count("*").alias("choices"))


def display_order(drafts: DataFrame) -> DataFrame:
    """The place of each draft in its import and module, and the next free one."""
    inside = Window.partitionBy("import_id", "module")
    return drafts.select("import_id", "module", "id", F.row_number().over(inside.orderBy(F.col("number").asc_nulls_last(), "id")).alias("place"), (F.count("*").over(inside) + 1).alias("next_place"))


def is_phantom(prompt: Column) -> Column:
    out = F.lit(False)
    for sign in PHANTOM:
        out = out | prompt.rlike(sign)
    return out


def new_files(files: DataFrame, known: DataFrame, baseline: Column) -> DataFrame:
    """Files not seen before: older than the baseline ones are noted, documents wait in a stable order, others are ignored."""
    fresh = files.join(known.select("file_id").distinct(), "file_id", "left_anti")
    state = F.when(~F.lower("name").rlike(r"/(en|fr)/"), "ignored").when(baseline, "baseline").otherwise("pending")
    return fresh.select("file_id", state.alias("state"), F.substring(F.sha2(F.concat_ws("|", F.col("file_id").cast("string"), "name"), 256), 1, 16).alias("import_key"))
