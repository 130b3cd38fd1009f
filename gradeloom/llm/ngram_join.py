"""Exact Jaccard self-join on word n-grams by vertical partitioning.

Documents with the same n-gram set are one class. The join then has four steps.

1. Thinning. N-grams have a fixed global order, by hash, and the order is cut into fragments. If a set of n n-grams has a
   partner, at most n - ceil(t n) of its n-grams are not shared; so of its first n - ceil(t n) + s, at least s are. Each fragment counts
   which of its n-grams more than one class has, the counts are summed for each class, and classes short of s are done. A task sends an
   n-gram once however often its documents have it, so a passage in every document costs a row for each run of documents.
2. Ordering. Over the classes left, n-grams are ordered anew, by magnitude of document frequency and then by hash; the
   first n - ceil(t n) + 1 of each class are its prefix.
3. Candidates and partial overlaps. Two classes of one component need not be compared if others link them, so each
   prefix n-gram first proposes the pairs with the class that has the smallest share of n-grams of its own (of edited copies, the one they were
   made from), and after those are settled, all pairs of classes that are not yet in
   one component; the length and position filters of prefix joins hold in both. For proposed pairs every fragment of the order counts
   its own overlap, and the counts are summed for each pair.
4. Components of the links, by star contraction.

N-grams and classes are known by 64-bit hashes; two n-grams are only compared within a pair, where a collision has a chance of
about 2**-45 even for texts of a thousand words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import hinted_small, in_arrow, read, salted_join, shared_checkpoint, slices, unused
from gradeloom.llm.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: The share of a set by which thinning looks further than a prefix must.
SLACK = 0.1
#: Bytes of text for each fragment of the first order, and fragments at least; class keys that are broadcast at most.
FRAGMENT_BYTES, LEAST_FRAGMENTS, BROADCAST_KEYS = 2_000_000, 64, 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
#: Words whose hashes a worker keeps; documents whose n-grams it counts together, and n-grams at most but for one document's.
_WORD_CACHE, TASK_ROWS, TASK_GRAMS = 80_000, 4_096, 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHashes()


def shingle_set(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words of a UTF-8 text; of the whole sequence if it is shorter."""
    w = np.fromiter(map(_words.__getitem__, text.translate(_LOWER).split()), dtype=np.uint64)
    if not len(w):
        return w
    runs = max(len(w) - n + 1, 1)
    h = np.full(runs, min(len(w), n), dtype=np.uint64)
    for j in range(min(len(w), n)):
        h = h * _P + w[j : j + runs]
    h = (h ^ (h >> _SHIFT)) * _A
    h = (h ^ (h >> _SHIFT)) * _B
    return np.unique(h ^ (h >> _SHIFT))


def _key(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def _needed(n: int | np.ndarray, num: int, den: int):
    """The least overlap of a set of n with a partner: ceil(n num / den)."""
    return -(-n * num // den)


_PART = "frag int, id long, row long, n int, k long, c long, h binary, ks binary"
_COUNTS = ["id", "row", "n", "k", "c"]


def _thin(docs: DataFrame, n_words: int, num: int, den: int, slack: float, fragments: int) -> DataFrame:
    """``id``, ``row``, ``n``, ``k`` for each document, and ``k``, ``c`` for shared n-grams that fragments have counted."""
    width = np.uint64(2**64 // fragments + 1)
    names = [x.split(" ")[0] for x in _PART.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, own, prefixes, docs, grams = 0, {}, [], [], 0
        for batch in slices(batches):
            for i, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer()
                s = shingle_set(data.to_pybytes() if data is not None else b"", n_words)
                k = _key(s) if len(s) else None
                docs.append((-1 - (turn + len(docs)) % fragments, i, row, len(s), k))
                if k is not None and k not in own:
                    own[k] = len(own)
                    prefixes.append(s[: len(s) - _needed(len(s), num, den) + math.ceil(slack * len(s))].copy())
                    grams += len(prefixes[-1])
            if len(docs) >= TASK_ROWS or grams >= TASK_GRAMS:
                yield from sent(docs, own, prefixes)
                turn, own, prefixes, docs, grams = turn + len(docs), {}, [], [], 0
        if docs:
            yield from sent(docs, own, prefixes)
        _words.clear()  # workers live on for other stages

    def sent(docs: list[tuple], own: dict[int, int], prefixes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The rows of a run of documents, and those of its n-grams by fragment, each n-gram once."""
        counted, rows = np.zeros(len(own), np.int64), []
        if own:
            keys = np.fromiter(own, np.int64)
            at = np.repeat(np.arange(len(own)), [len(p) for p in prefixes])
            h, first, back, times = np.unique(np.concatenate(prefixes), return_index=True, return_inverse=True, return_counts=True)
            here = times > 1
            counted = np.bincount(at[here[back]], minlength=len(own))
            frag = (h // width).astype(np.int64)
            known = np.where(here, -1, at[first])
            starts = np.searchsorted(frag, np.arange(fragments + 1))
            for f in np.flatnonzero(np.diff(starts)):
                x = slice(starts[f], starts[f + 1])
                alone = known[x] >= 0
                rows.append((int(f), h[x][alone].tobytes() + h[x][~alone].tobytes(), keys[known[x][alone]].tobytes()))
        seen: set[int] = set()
        c = [0 if d[4] is None or d[4] in seen else seen.add(d[4]) or int(counted[own[d[4]]]) for d in docs]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        none = pa.nulls(len(docs), pa.binary())
        yield pa.RecordBatch.from_arrays([*[pa.array([d[j] for d in docs], t) for j, t in enumerate(kinds)], pa.array(c, pa.int64()), none, none], names)
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            no = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), no, no, no.cast(pa.int32()), no, no, pa.array([r[1] for r in some], pa.binary()), pa.array([r[2] for r in some], pa.binary())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragment after fragment: which n-grams do several classes have, and how many of these has each class? A task's fragments are summed up together."""
        frag, held, sums, size = None, [], [], 0
        for batch in batches:
            frags = batch.column(0).to_numpy()
            own = int(np.searchsorted(frags, 0))
            if own:
                yield batch.slice(0, own).select(_COUNTS)
            for j in range(own, batch.num_rows):
                if frags[j] != frag:
                    sums.append(_shared(held))
                    frag, held, size = frags[j], [], size + len(sums[-1][0])
                    if size >= TASK_GRAMS:
                        yield from summed(sums)
                        sums, size = [], 0
                held.append((np.frombuffer(batch.column(6)[j].as_buffer(), np.uint64).copy(), np.frombuffer(batch.column(7)[j].as_buffer(), np.int64).copy()))
        yield from summed([*sums, _shared(held)])

    def summed(sums: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, back = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in sums]), len(k)).astype(np.int64)
        for at in range(0, len(k), 65_536):
            no = pa.nulls(len(k[at : at + 65_536]), pa.int64())
            yield pa.RecordBatch.from_arrays([no, no, no.cast(pa.int32()), pa.array(k[at : at + 65_536]), pa.array(n[at : at + 65_536])], _COUNTS)

    parts = in_arrow(docs, cut, _PART).repartition("frag").sortWithinPartitions("frag")
    return in_arrow(parts, count, "id long, row long, n int, k long, c long")


def _shared(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of a fragment's rows: the classes that sent an n-gram alone which others have too, and how many each."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the n-grams that one class of a run of documents had come first, with that class; then those that several had
    h = np.concatenate([h for h, _ in held])
    k = np.concatenate([np.concatenate([k, np.zeros(len(h) - len(k), np.int64)]) for h, k in held])
    several = np.concatenate([np.arange(len(h)) >= len(k) for h, k in held])
    order = np.argsort(h, kind="stable")
    h, k, several = h[order], k[order], several[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    shared = np.logical_or.reduceat(several, at)
    # only what is alone in its run has a class here; with a smallest and a largest class there are two
    shared |= np.minimum.reduceat(k, at) != np.maximum.reduceat(k, at)
    hit = np.repeat(shared, np.diff(np.r_[at, len(h)])) & ~several
    return np.unique(k[hit], return_counts=True)


def _sets(docs: DataFrame, n_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [s for text in batch.column(0).slice(at, 256) if len(s := shingle_set(text.as_buffer().to_pybytes(), n_words))]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["k", "hs"])
        _words.clear()

    return in_arrow(docs, run, "k long, hs array<long>").dropDuplicates(["k"])


def _may_link(n1: Column, n2: Column, num: int, den: int) -> Column:
    return F.least(n1, n2) * den >= F.greatest(n1, n2) * num


def _reaches(left1: Column, left2: Column, n1: Column, n2: Column, num: int, den: int) -> Column:
    """Can the n-grams from this one on still give the overlap that a link needs?"""
    return F.least(left1, left2) * (den + num) >= (n1 + n2) * num


def _linked(pairs: DataFrame, ordered: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose overlaps, counted by fragment and summed, make a link."""
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    own = ordered.join(ends, "k", "left_semi").select("k", "n", "items", F.explode(F.array_distinct(F.transform("items", lambda x: F.shiftrightunsigned(x, 58)))).alias("frag"))
    own = own.select("k", "n", "frag", F.filter("items", lambda x: F.shiftrightunsigned(x, 58) == F.col("frag")).alias("seg"))
    left = pairs.join(own.select(F.col("k").alias("a"), F.col("n").alias("n1"), "frag", F.col("seg").alias("s1")), "a")
    both = left.join(own.select(F.col("k").alias("b"), F.col("n").alias("n2"), "frag", F.col("seg").alias("s2")), ["b", "frag"])
    overlap = both.groupBy("a", "b", "n1", "n2").agg(F.sum(F.size(F.array_intersect("s1", "s2"))).alias("o"))
    return shared_checkpoint(overlap.filter(F.col("o") * (den + num) >= (F.col("n1") + F.col("n2")) * num).select("a", "b"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, slack: float = SLACK, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets and the components of their links.

    Returns ``id``, ``row`` (what ``row_col`` has, if given), ``n``, ``k`` for every document (``k`` is null for one without words) and ``k``, ``root`` for every class that has a link.
    """
    num, den = numerator, denominator
    row = F.col(row_col) if row_col else F.lit(None)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), row.cast("long").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, size // FRAGMENT_BYTES)
    counts = shared_checkpoint(_thin(slim, n_words, num, den, slack, fragments))
    classes = counts.filter("k is not null").groupBy("k").agg(F.max("n").alias("n"), F.min("id").alias("id"), F.sum("c").alias("c"), F.count("id").alias("ids"))
    alive = shared_checkpoint(classes.filter(F.col("c") >= F.ceil(F.col("n") * slack)).select("k", "id"))

    keys = alive.select("id").distinct()
    texts = slim.join(hinted_small(keys, alive.count(), BROADCAST_KEYS), slim["id"].eqNullSafe(keys["id"]), "left_semi").select("text")
    sets = shared_checkpoint(_sets(texts, n_words))
    grams = sets.select("k", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    often = grams.groupBy("h").count().filter("count > 1")
    # an item: the magnitude of the frequency, six steps to a doubling, then 56 bits of the hash; four steps are a fragment
    item = F.shiftleft(F.least(F.floor(F.log2("count") * 6), F.lit(127)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned("h", 8))
    ordered = grams.join(often, "h").select("k", "n", item.alias("item")).groupBy("k", "n").agg(F.array_sort(F.collect_list("item")).alias("items"))  # one document's n-grams
    ordered = ordered.filter(F.size("items") * den >= F.col("n") * num)
    ordered = shared_checkpoint(ordered)
    rare = F.col("n") - F.size("items")
    length = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1 - rare
    prefix = ordered.filter(length > 0).select("k", "n", rare.alias("rare"), F.posexplode(F.slice("items", F.lit(1), length)).alias("pos", "item"))
    prefix = shared_checkpoint(prefix.select("item", "k", "n", (F.col("rare") / F.col("n")).alias("own"), (F.col("n") - F.col("rare") - F.col("pos")).alias("left")))

    hubs = prefix.groupBy("item").agg(F.min(F.struct("own", "k", "n")).alias("hub"), F.count("*").alias("times")).filter("times > 1")
    near = prefix.join(hubs, "item").filter((F.col("k") != F.col("hub.k")) & _may_link(F.col("n"), F.col("hub.n"), num, den))
    first = shared_checkpoint(near.select(F.col("hub.k").alias("a"), F.col("k").alias("b")).distinct())
    links = _linked(first, ordered, num, den)
    roots = components(links)
    placed = prefix.join(roots, prefix["k"] == roots["node"], "left").select("item", "k", "n", "left", F.coalesce("root", "k").alias("l"))
    mixed = placed.groupBy("item").agg(F.min("l").alias("x"), F.max("l").alias("y")).filter("x != y").select("item")
    placed = shared_checkpoint(placed.join(mixed, "item", "left_semi"))
    p, q = (placed.select("item", *[F.col(c).alias(f"{c}{i}") for c in ("k", "n", "left", "l")]) for i in (1, 2))
    rest = p.join(q, "item").filter((F.col("k1") < F.col("k2")) & (F.col("l1") != F.col("l2")) & _may_link(F.col("n1"), F.col("n2"), num, den) & _reaches(F.col("left1"), F.col("left2"), F.col("n1"), F.col("n2"), num, den))
    second = shared_checkpoint(rest.select(F.col("k1").alias("a"), F.col("k2").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    more = _linked(second, ordered, num, den)
    roots = components(links.union(more)).select(F.col("node").alias("k"), "root")
    return counts.filter("n is not null").select("id", "row", "n", "k"), roots


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``k`` and ``best``, the least ``best`` of its component, for every class. The rows of a large component are dealt over several tasks."""
    linked = classes.join(roots, "k")
    least = linked.groupBy("root").agg(F.min("best").alias("best"))
    alone = classes.join(roots, "k", "left_anti")
    return salted_join(linked.select("k", "root"), least, "root", "inner").select("k", "best").unionAll(alone.select("k", "best"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """A row for each document: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id that links reach, itself included.

    Two documents link if the Jaccard similarity of their sets of word n-grams is ``numerator / denominator`` or more. Sets ignore
    A-Z case; a text with fewer words is one n-gram; null and empty texts have an empty set and link with nothing. Rows with a null id take
    part, but never give a component its id unless all its ids are null. Repeated rows are kept. Other columns are not read. An empty table
    gives an empty result.
    """
    own, roots = jaccard_classes(docs, id_col, text_col, n_words, numerator, denominator)
    named = _named(own.filter("k is not null").groupBy("k").agg(F.min("id").alias("best")), roots)
    out = salted_join(own.drop("row"), named, "k", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("best")).alias("component_id"))


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row of each component, with all its columns: that with the least id, null last.

    Rows are told apart by the JSON of all their columns, so ids may be null or repeated, and columns of any names and of types that JSON
    has, maps too; of rows that are equal in every column one stays. Rows without words link with nothing and all stay.
    """
    words = F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    every, row, whole = [F.col(f"`{c}`") for c in docs.columns], unused("_row", docs.columns), unused("_whole", docs.columns)
    json = F.to_json(F.struct(*every), {"ignoreNullFields": "false"})
    rows = docs.filter(words).withColumn(row, F.xxhash64(json))
    own, roots = jaccard_classes(rows, id_col, text_col, n_words, numerator, denominator, row_col=row)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    classes = own.groupBy("k").agg(best)
    # a class or component has one best row, so the rows to keep are as many as components
    keep = classes.join(roots, "k", "left").groupBy(F.coalesce("root", "k").alias("root")).agg(F.min("best").alias("best"))
    kept = rows.join(keep.select(F.col("best.row").alias(row)).distinct(), row, "left_semi").withColumn(whole, F.md5(json)).dropDuplicates([whole])
    return docs.filter(~words).unionAll(kept.select(every))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))


OP7_SQL = f"""
with recursive w as (
  select doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct([array_to_string(ws[i:i+{WORDS - 1}], ' ') for i in range(1, 1 + greatest(len(ws) - {WORDS - 1}, least(len(ws), 1)))]) as hs from w),
g as (select doc_id, len(hs) as n, unnest(hs) as h from s),
o as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as n1, any_value(y.n) as n2, count(*) as o from g x join g y on x.h = y.h and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from o where {DENOMINATOR} * o >= {NUMERATOR} * (n1 + n2 - o)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by 1)
select s.doc_id, len(s.hs)::bigint as n_shingles, c.component_id from s join c using (doc_id)
"""
