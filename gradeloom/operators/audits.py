"""Audits of ingested drafts: readiness, risks, approvals, promotion and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.relational import rule_array
from gradeloom.operators.ingestion import MODULES, is_phantom

#: Flags of a parser with a known severity (any other is major), the shortest prompt, and the ranks of a status.
MAJOR_FLAGS = ("duplicate_source_number_conflict", "source_question_id_unresolved", "screenshot_section_unresolved", "source_global_id_ocr_unresolved", "number_inference_after_duplicate")
MINOR_FLAGS = (
    "question_id_recovered_from_neighbors", "source_choice_table_truncated_review_required", "recovered_from_page_replay", "recovered_from_global_marker_block", "source_global_id_positional_slot", "positional_answer_review_required", "repeated_source_question_coalesced",
    "legacy_parser_unverified",
)
LOW_CONFIDENCE_METHODS = ("recovered_question_id", "module_position", "document_position")
SHORTEST_PROMPT = 8
RANKS = {"processing": 0, "failed": 1, "partial": 2, "complete": 3}
#: Sections by the number of their questions in a module, and the first of their two modules.
SECTIONS = {"reading_writing": (27, 0), "math": (22, 2)}
TOTAL = sum(n for _, n in MODULES)


def section_of(x: Column) -> Column:
    """``math`` or ``reading_writing``, as a section's name says; null if it says neither."""
    name = F.translate(F.regexp_replace(F.lower(x), "&", "and"), "_", " ")
    return F.when(name.rlike(r"\bmath\b"), "math").when(name.rlike(r"\b(reading|writing|rw)\b"), "reading_writing")


def assigned_modules(drafts: DataFrame) -> DataFrame:
    """Drafts in their order with the module ``m`` (null if none fits), ``undeclared`` (drafts of the import without a declared module) and ``n``.

    Drafts stand by page, number and id, nulls last. If all declare a module, that is theirs. An import of exactly 98 has the fixed sequence of
    27, 27, 22 and 22, whatever some declare. Else a draft that declares none takes its place among those of its section: the first 27
    (22) are the first module, the next ones the second, and further ones have none. ``drafts``: import_id, id, page_number, number, section, module.
    """
    by_place = [F.col("page_number").asc_nulls_last(), F.col("number").asc_nulls_last(), "id"]
    every = Window.partitionBy("import_id")
    order = every.orderBy(*by_place)
    open_ = F.col("module").isNull()
    section = F.coalesce(section_of(F.col("section")), F.when(F.col("module") >= 2, "math").when(F.col("module") >= 0, "reading_writing"))
    placed = drafts.withColumn("s", section).withColumns({"rn": F.row_number().over(order), "n": F.count("*").over(every), "undeclared": F.count_if(open_).over(every)})
    before = Window.partitionBy("import_id", "s").orderBy(*by_place).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("k", F.coalesce(F.count_if(open_).over(before), F.lit(0)))
    in_section = F.lit(None).cast("int")
    for name, (size, first) in SECTIONS.items():
        in_section = F.when((F.col("s") == name) & (F.col("k") < 2 * size), (F.floor(F.col("k") / size) + first).cast("int")).otherwise(in_section)
    ends, sequence = [sum(n for _, n in MODULES[: i + 1]) for i in range(4)], F.lit(3)
    for i in (2, 1, 0):
        sequence = F.when(F.col("rn") <= ends[i], i).otherwise(sequence)
    m = F.when(F.col("undeclared") == 0, F.col("module")).when(F.col("n") == TOTAL, sequence).otherwise(F.coalesce("module", in_section))
    return placed.withColumn("m", m.cast("int")).drop("rn", "k")


def import_readiness(drafts: DataFrame, imports: DataFrame) -> DataFrame:
    """Question and key status of every import, with counts by module.

    ``drafts``: import_id, id, page_number, number, section, module (0 to 3, null if not declared), answer, keys (its answer keys that are not
    rejected) and conflict (it is flagged as a duplicate number); ``imports``: import_id, status, raw_keys. Modules come from ``assigned_modules``.
    Where some were inferred, the order is ``ambiguous`` if a draft has no page, or a page two drafts with one number, or two without. Declared
    modules that contradict the sequence of 98 are ``conflicts``. A draft has as many keys as ``keys``, one at least if it has an answer.
    """
    placed = assigned_modules(drafts)
    inferred = F.col("undeclared") > 0
    spot = placed.groupBy("import_id", "page_number", "number").agg(F.count("*").alias("c"))
    unclear = spot.filter("page_number is null or c > 1").select("import_id").distinct().withColumn("unclear", F.lit(True))
    numbered = F.col("m").isNotNull() & (F.col("number") > 0)
    same = placed.filter(numbered).groupBy("import_id", "m", "number").agg(F.count("*").alias("c"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("flagged"))
    same = same.filter((F.col("c") > 1) | F.col("flagged")).groupBy("import_id").agg(F.count("*").alias("duplicates"))
    keyed = F.greatest(F.coalesce("keys", F.lit(0)), F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", 1).otherwise(0)).cast("long")
    rows = placed.withColumn("keyed", keyed)
    none = {"unclassified": F.col("m").isNull() & F.col("s").isNull(), "overflow_rw": F.col("m").isNull() & (F.col("s") == "reading_writing"), "overflow_math": F.col("m").isNull() & (F.col("s") == "math")}
    counts = [F.count_if(F.col("m") == m).alias(f"m{m}") for m, _ in MODULES] + [F.count_if(c).alias(n) for n, c in none.items()]
    keys = [F.coalesce(F.sum(F.when(F.col("m") == m, F.col("keyed"))), F.lit(0)).alias(f"k{m}") for m, _ in MODULES] + [F.coalesce(F.sum(F.when(c, F.col("keyed"))), F.lit(0)).alias(f"k_{n}") for n, c in none.items()]
    clash = (F.col("n") == TOTAL) & inferred & (F.col("module") != F.col("m"))
    own = rows.groupBy("import_id").agg(F.count("*").alias("questions"), F.sum("keyed").alias("mapped"), F.count_if(F.col("keyed") > 0).alias("matched"), F.count_if(F.col("keyed") > 1).alias("duplicate_keys"), F.count_if(F.col("module").isNull()).alias("inferred"), F.count_if(clash).alias("conflicts"), *counts, *keys)
    out = imports.select("import_id", "status", "raw_keys").join(own, "import_id", "left").join(same, "import_id", "left").join(unclear, "import_id", "left")
    names = ["questions", "mapped", "matched", "duplicate_keys", "inferred", "conflicts", "duplicates", *[f"{x}{m}" for x in "mk" for m, _ in MODULES], *none, *[f"k_{n}" for n in none]]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names}).withColumn("ambiguous", F.coalesce("unclear", F.lit(False)) & (F.col("inferred") > 0))
    exact, exact_keys = (sum((F.col(f"{x}_{n}" if x == "k" else n) for n in none), F.lit(0)) == 0 for x in "mk")
    for m, n in MODULES:
        exact, exact_keys = exact & (F.col(f"m{m}") == n), exact_keys & (F.col(f"k{m}") == n)
    sure = (F.col("conflicts") == 0) & ~F.col("ambiguous")
    raw = F.greatest(F.coalesce("raw_keys", F.lit(0)), F.lit(0))
    base = F.when(F.col("status").isin("failed", "cancelled"), "failed").when(~F.col("status").eqNullSafe("completed"), "processing")
    question = F.coalesce(base, F.when(F.col("questions") == 0, "failed").when((F.col("questions") == TOTAL) & exact & sure & (F.col("duplicates") == 0), "complete").otherwise("partial"))
    whole = (F.col("question_status") == "complete") & (F.col("mapped") == TOTAL) & exact_keys & (F.col("duplicate_keys") == 0) & (raw <= F.col("mapped")) & sure
    key = F.coalesce(base, F.when(F.greatest(F.col("mapped"), raw) == 0, "failed").when(whole, "complete").otherwise("partial"))
    return out.withColumn("question_status", question).select("import_id", *names, "ambiguous", "question_status", key.alias("key_status"))


def import_listing(drafts: DataFrame) -> DataFrame:
    """Drafts of every import by status, one column each."""
    return drafts.groupBy("import_id").pivot("status", ["approved", "pending", "rejected"]).count().na.fill(0)


def module_summary(drafts: DataFrame) -> DataFrame:
    return drafts.groupBy("import_id", "section", "module").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count("answer").alias("with_key"))


def draft_risks(drafts: DataFrame) -> DataFrame:
    """The codes of each draft's risks, their number, and ``state``: its worst severity, or ``complete`` without a risk.

    ``drafts``: import_id, id, page_number, prompt, question_type, answer, flags, choices, number_origin, key_confidence, key_method, has_visual,
    visual_code, image and crop. Each flag of the parser is a risk of its own, once, first; flags that aren't known are major.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    parsed = F.transform(F.array_distinct(F.coalesce("flags", F.array().cast("array<string>"))), lambda f: F.struct(F.concat(F.lit("parser:"), f).alias("code"), F.when(f.isin(*MINOR_FLAGS), "minor").otherwise("major").alias("severity")))
    choices = F.coalesce("choices", F.array().cast("array<string>"))
    unseen = F.coalesce("has_visual", F.lit(False)) & blank(F.col("visual_code"))
    rules = rule_array(
        (F.col("page_number").isNull() | (F.col("page_number") < 1), "source_evidence_missing", "major"), (F.length(F.trim(F.coalesce("prompt", F.lit("")))) < SHORTEST_PROMPT, "prompt_suspect", "minor"), (blank(F.col("answer")), "required_answer_missing", "major"),
        ((F.col("question_type") == "multiple_choice") & ((F.size(choices) != 4) | F.exists(choices, blank)), "choice_structure", "minor"), (F.col("number_origin") == "inferred", "question_number_inferred", "minor"),
        (F.col("key_confidence").eqNullSafe("low") | F.coalesce(F.col("key_method").isin(*LOW_CONFIDENCE_METHODS), F.lit(False)), "answer_alignment_low_confidence", "minor"),
        (unseen & F.col("image").isNull(), "visual_source_missing", "major"), (unseen & F.col("image").isNotNull() & ~F.col("crop").eqNullSafe("confirmed"), "crop_unconfirmed", "minor"),
    )
    out = drafts.select("import_id", "id", F.concat(parsed, rules).alias("risks"))
    worst = F.when(F.exists("risks", lambda r: r["severity"] == "major"), "major").when(F.size("risks") > 0, "minor")
    return out.select("import_id", "id", F.array_join(F.transform("risks", lambda r: r["code"]), ",").alias("codes"), F.size("risks").alias("n"), F.coalesce(worst, F.lit("complete")).alias("state"))


def import_risks(drafts: DataFrame, imports: DataFrame) -> DataFrame:
    """The codes of the risks of whole imports, ``major`` and ``warnings``, imports without drafts included.

    ``drafts``: import_id, module (0 to 3, null if not declared or unknown), position (1 or 2, of the module), section, number; ``imports``: import_id, status,
    family, pages_failed, retries_failed, inferred_numbers, key_status, key_source, fallback_matches, key_diagnostics and parser_warnings, all counts but
    status, family, key_status and key_source. Numbers, sections and modules of drafts are looked at in full tests only.
    """
    known = F.col("module").isNotNull()
    math = F.col("module") >= 2
    clash = known & (((F.col("section") == "math") & ~math) | ((F.col("section") == "reading_writing") & math) | (F.col("position") != F.col("module") % 2 + 1))
    own = drafts.groupBy("import_id").agg(F.count("*").alias("n"), F.count_if(~known).alias("unassigned"), F.count_if(clash).alias("clashes"), *[F.count_if(F.col("module") == m).alias(f"m{m}") for m, _ in MODULES])
    twice = drafts.filter(known & (F.col("number") > 0)).groupBy("import_id", "module", "number").count().filter("count > 1").select("import_id").distinct().withColumn("twice", F.lit(True))
    rows = imports.join(own, "import_id", "left").join(twice, "import_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = (F.col("family") == "full_test") & (F.col("n") > 0)
    spread = F.lit(False)
    for m, n in MODULES:
        spread = spread | (F.col(f"m{m}") != n)
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    major = rule_array(
        (F.col("status").isin("failed", "cancelled"), "import_processing_failed", "major"), (F.col("n") == 0, "no_readable_questions", "major"), (full & (F.col("n") != TOTAL), "full_test_question_count", "major"), (full & some("clashes"), "explicit_module_order_conflict", "major"),
        (full & spread, "module_distribution", "major"), (full & some("unassigned"), "module_assignment", "major"), (full & F.col("twice"), "duplicate_question_identity", "major"),
    )
    warnings = rule_array(
        (some("pages_failed"), "ocr_page_failure", "minor"), (some("retries_failed"), "ocr_retry_warning", "minor"), (some("inferred_numbers"), "inferred_question_numbers", "minor"), (~F.col("key_status").eqNullSafe("complete"), "answer_key_warning", "minor"),
        (F.coalesce("key_source", F.lit("")).isin("", "parsed") == F.lit(False), "answer_key_source", "minor"), (some("fallback_matches"), "positional_key_matches", "minor"), (some("key_diagnostics"), "answer_key_diagnostics", "minor"), (some("parser_warnings"), "parser_warnings", "minor"),
    )
    code = lambda rules: F.array_join(F.transform(rules, lambda r: r["code"]), ",")
    return rows.select("import_id", F.col("n").alias("questions"), code(major).alias("major"), code(warnings).alias("warnings"))


def approval_warnings(drafts: DataFrame) -> DataFrame:
    """Five counted checks of an import before approval."""
    return drafts.groupBy("import_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("answer").isNull()).alias("missing_answers"), F.count_if(F.col("flag").isNotNull()).alias("flagged"), F.count_if(F.length(F.trim("prompt")) < SHORTEST_PROMPT).alias("short_prompts"), (F.count("*") - F.countDistinct("module", "number")).alias("duplicate_numbers"))


def import_audit(drafts: DataFrame) -> DataFrame:
    """Drafts, keys, flags and phantoms of each import and in all (a null import), in one rollup."""
    return drafts.rollup("import_id").agg(F.count("*").alias("drafts"), F.count("answer").alias("keyed"), F.count("flag").alias("flagged"), F.count_if(is_phantom(F.col("prompt"))).alias("phantoms"), F.count_if(F.col("status") == "approved").alias("approved"))


def key_agreement(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """Stored answers that a second extraction confirms, contradicts or doesn't have."""
    e = extracted.select("import_id", "module", "number", F.col("answer").alias("again"))
    rows = stored.join(e, ["import_id", "module", "number"], "left")
    return rows.groupBy("import_id").agg(F.count_if(F.col("answer") == F.col("again")).alias("match"), F.count_if(F.col("answer") != F.col("again")).alias("mismatch"), F.count_if(F.col("answer").isNotNull() & F.col("again").isNull()).alias("unverified"))


def retry_pages(pages: DataFrame, drafts: DataFrame, most: int = 4) -> DataFrame:
    """Pages worth another reading: failed 100, unresolved 85, before a gap of numbers 75, the last 10; the best ``most`` of an import."""
    failed = pages.filter(F.length(F.trim("text")) < 20).select("import_id", "page_number", F.lit(100).alias("score"), F.lit("failed").alias("reason"))
    unresolved = drafts.filter("answer is null and flag is not null").select("import_id", "page_number", F.lit(85).alias("score"), F.lit("unresolved").alias("reason"))
    along = Window.partitionBy("import_id", "module").orderBy("number", "id")
    gaps = drafts.withColumn("after", F.lead("number").over(along)).filter("after > number + 1").select("import_id", "page_number", F.lit(75).alias("score"), F.lit("gap").alias("reason"))
    tail = pages.groupBy("import_id").agg(F.max("page_number").alias("page_number")).select("import_id", "page_number", F.lit(10).alias("score"), F.lit("tail").alias("reason"))
    best = failed.unionByName(unresolved).unionByName(gaps).unionByName(tail).groupBy("import_id", "page_number").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("import_id").orderBy(F.desc("score"), "page_number"))).filter(F.col("rank") <= most)


def assemble_test(drafts: DataFrame) -> DataFrame:
    """Approved drafts as a test: the place of their module and of themselves, and whether the module's key is whole."""
    rows = drafts.filter("status = 'approved'")
    inside = Window.partitionBy("import_id", "module")
    return rows.select("import_id", "id", F.dense_rank().over(Window.partitionBy("import_id").orderBy("module")).alias("module_position"), F.row_number().over(inside.orderBy("number", "id")).alias("position"), (F.count("answer").over(inside) == F.count("*").over(inside)).alias("key_complete"))


def image_provenance(direct: DataFrame, by_draft: DataFrame, by_source: DataFrame, images: DataFrame) -> DataFrame:
    """Images whose import stands behind no published test in any of three ways."""
    used = direct.select("import_id").union(by_draft.select("import_id")).union(by_source.select("import_id")).distinct()
    return images.join(used, "import_id", "left_anti")


def verified_removals(before: DataFrame, after: DataFrame, fp: str = "fp") -> DataFrame:
    """How many drafts of each import went because another with the same fingerprint stayed: evidence that lets a count fall."""
    b, a = (x.groupBy("import_id", fp).agg(F.count("*").alias(n)) for x, n in ((before, "b"), (after, "a")))
    return b.join(a, ["import_id", fp]).groupBy("import_id").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("removed"))


def _rank(c: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col(c))


def _compared(status: str, actual: str, prefix: str, removed: Column) -> tuple[Column, Column]:
    """Why a metric fell (null if it didn't), and whether it rose. Columns of the old reading end in 0, of the new in 1."""
    rose, fell = (_rank(f"{status}1") > _rank(f"{status}0")), (_rank(f"{status}1") < _rank(f"{status}0"))
    less = lambda c: F.col(f"{c}1") < F.col(f"{c}0")
    covered = lambda c: (removed >= F.col(f"{c}0") - F.col(f"{c}1")) & rose
    modules = [(f"{prefix}{m}", n) for m, n in MODULES]
    extra = [("k_" if prefix == "k" else "") + n for n in ("unclassified", "overflow_rw", "overflow_math")]
    none_left = sum((F.col(f"{c}1") for c in extra), F.lit(0)) == 0
    reason = F.when(fell, "status_fell").when(less(actual) & ~covered(actual), "count_fell").when(less("matched") & ~covered("matched") if prefix == "k" else F.lit(False), "matched_fell")
    for c, n in modules:
        reason = reason.when(less(c) & ~(covered(c) & (F.col(f"{c}0") > n) & (F.col(f"{c}1") == n)), f"{c}_fell")
    for c in extra:
        moved = F.lit("overflow" in c) & (F.col(f"{actual}1") >= F.col(f"{actual}0")) & none_left
        reason = reason.when((F.col(f"{c}0") > 0) & (F.col(f"{c}1") == 0) & ~moved, f"{c}_disappeared").when((F.col(f"{c}1") > 0) & less(c), f"{c}_fell")
    more = [F.col(f"{c}1") > F.col(f"{c}0") for c in (actual, *(["matched"] if prefix == "k" else []), *[c for c, _ in modules], *extra)]
    better = rose
    for c in more:
        better = better | c
    return reason, better


def promotion_decision(before: DataFrame, after: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """May an import's new reading replace the old one? Never if a status, a count or a module's count falls; yes if one rises. The first reason is given.

    Questions are looked at first, then keys. Fewer questions are let through where the status rises and at least as many were verified duplicates
    (``removed``: import_id, removed). An overflow of modules may vanish into the four modules. Both readings come from ``import_readiness``.
    """
    names = [c for c in before.columns if c not in ("import_id", "ambiguous")]
    b, a = (x.select("import_id", *[F.col(c).alias(f"{c}{i}") for c in names], F.lit(True).alias(f"has{i}")) for i, x in ((0, before), (1, after)))
    both = b.join(a, "import_id", "full")
    both = both.join(removed.select("import_id", "removed"), "import_id", "left") if removed is not None else both.withColumn("removed", F.lit(0))
    q_reason, q_better = _compared("question_status", "questions", "m", F.coalesce("removed", F.lit(0)))
    k_reason, k_better = _compared("key_status", "mapped", "k", F.lit(0))
    reason = F.when(F.col("has1").isNull(), "lost").when(F.col("has0").isNull(), "added").otherwise(F.coalesce(F.concat(F.lit("questions_"), q_reason), F.concat(F.lit("keys_"), k_reason), F.when(q_better | k_better, "improved").otherwise("unchanged")))
    return both.select("import_id", F.col("questions0").alias("q0"), F.col("questions1").alias("q1"), F.col("mapped0").alias("a0"), F.col("mapped1").alias("a1"), reason.alias("reason"), reason.isin("added", "improved").alias("promote"))


def cohort_report(decisions: DataFrame) -> DataFrame:
    """Imports and gains by decision."""
    return decisions.groupBy("reason").agg(F.count("*").alias("imports"), F.sum(F.coalesce("q1", F.lit(0)) - F.coalesce("q0", F.lit(0))).alias("question_gain"), F.sum(F.coalesce("a1", F.lit(0)) - F.coalesce("a0", F.lit(0))).alias("answer_gain"))


def cohort_selection(readiness: DataFrame) -> DataFrame:
    cohort = F.when((F.col("question_status") == "complete") & (F.col("key_status") == "complete"), "control").when((F.col("question_status") == "partial") | (F.col("key_status") == "partial"), "cohort").otherwise("none")
    return readiness.groupBy(cohort.alias("cohort"), "question_status", "key_status").agg(F.count("*").alias("imports"))


def corpus_triage(quality: DataFrame) -> DataFrame:
    """What a document needs, from its text quality."""
    status = F.when(F.col("chars") == 0, "failed").when(F.col("quality") == "poor", "needs_ocr").when(F.col("choice_marks") < F.col("question_marks") * 4, "partial").otherwise("success")
    return quality.withColumn("status", status).groupBy("status").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


def review_selection(risks: DataFrame, cap: int) -> DataFrame:
    """Drafts with minor risks go to a batch, ``cap`` an import at most, the rest to people; major ones are blocked."""
    rows = risks.withColumn("k", F.row_number().over(Window.partitionBy("import_id", "state").orderBy("id")))
    return rows.select("import_id", "id", F.when(F.col("state") == "major", "blocked").when(F.col("state") == "complete", "batch_ready").when(F.col("k") <= cap, "batch_ready").otherwise("individual_review").alias("route"))


def parity(published: DataFrame, drafts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many published rows differ from their draft, column by column, and a fingerprint of the whole table."""
    d = drafts.select(key, *[F.col(c).alias(f"d_{c}") for c in columns])
    rows = published.join(d, key, "left")
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"d_{c}"))).alias(f"differ_{c}") for c in columns], F.sum(digest).alias("fingerprint"))
