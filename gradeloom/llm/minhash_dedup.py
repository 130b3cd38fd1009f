"""Near duplicates by MinHash bands, with sequential Bayesian verification of the candidates (after BayesLSH, Satuluri and Parthasarathy, 2012).

1. Signatures. Texts with the same shingle set are one class, known by 128 bits. A class has ``ROWS_OF_BAND * bands`` MinHash values
   of 16 bits; ``bands`` is the least number with which a pair at the threshold shares no band with probability ``miss`` at most.
2. Candidates. Classes with an equal band share a bucket. The bucket first proposes the pairs of all its members with one hub, the
   member that meets most others. After their links are settled, members of different components are compared with each other, in tiles of
   two blocks of a bucket, but for those that can't link because of the shingles that no other open class has. So a group of near copies
   costs a row for each member, strangers among them are compared without making their pairs rows, and no pair of a bucket is passed over.
3. Sequential verification. The signatures of a pair are compared a batch at a time. With a uniform prior, m matches of n give the
   similarity the posterior Beta(m + 1, n - m + 1); a pair whose probability of reaching the threshold is under ``miss`` goes at once.
4. Survivors are confirmed on their whole shingle sets, and components found by star contraction.

A link is lost only if the signatures are: each of the two tests errs with probability ``miss`` at the threshold, less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import hinted_small, in_arrow, read, salted_join, shared_checkpoint, slices
from gradeloom.llm.components import components
from gradeloom.llm.ngram_join import WORDS, _words, shingle_set

NUMERATOR, DENOMINATOR = 85, 100
#: Values of a band; chance of missing a pair at the threshold, in the bands and in each look at a pair; values of a batch.
ROWS_OF_BAND, MISS, BATCH = 6, 1e-6, 30
#: Shingles hashed together (they fit a core's cache).
HASHED = 1 << 15
#: Members of a bucket in a block of its tiles.
TILE = 256
#: Ids that are broadcast at most, by their counted number.
BROADCAST_KEYS = 1_000_000

_P, _A = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_SHIFT, _HIGH = np.uint64(32), np.uint64(48)


def bands_for(threshold: float, rows: int = ROWS_OF_BAND, miss: float = MISS) -> int:
    """The least number of bands of ``rows`` values with which a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


@lru_cache(maxsize=32)
def least_matches(threshold: float, values: int, batch: int = BATCH, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """After each batch: how many values were compared, and the fewest matches with which a pair goes on.

    The posterior probability of a similarity of ``threshold`` or more after m matches of n is that of m successes at most in n + 1 draws.
    """
    out = []
    for n in [*range(batch, values, batch), values]:
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def _multipliers(values: int) -> np.ndarray:
    return np.random.default_rng(12).integers(0, 2**63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """A row of MinHash values of 16 bits for each set, none of them empty."""
    out, odd, at = np.empty((len(sets), values), np.uint16), _multipliers(values), 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= HASHED:
            size, end = size + len(sets[end]), end + 1
        flat = np.concatenate(sets[at:end])
        starts = np.r_[0, np.cumsum([len(s) for s in sets[at : end - 1]])].astype(np.int64)
        hashed = np.empty_like(flat)
        for j in range(values):
            np.multiply(flat, odd[j], out=hashed)
            low = np.minimum.reduceat(hashed, starts)
            low = (low ^ (low >> _SHIFT)) * _A
            out[at:end, j] = (low >> _HIGH).astype(np.uint16)
        at = end
    return out


def _key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _signed(docs: DataFrame, n_words: int, values: int) -> DataFrame:
    """``id``, ``n``, the class ``k`` (null without words) and its signature for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t.as_buffer().to_pybytes(), n_words) for t in part.column(1)]
            full = [s for s in sets if len(s)]
            found = iter(signatures(full, values))
            keys = [_key(s) if len(s) else None for s in sets]
            signed = [next(found).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int32()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], ["id", "n", "k", "sig"])
        _words.clear()  # workers live on for other stages

    return in_arrow(docs, run, "id long, n int, k binary, sig binary")


def _buckets(classes: DataFrame, values: int, rows: int) -> DataFrame:
    """``bucket``, ``k`` and ``n``: each class in the bucket of each of its bands."""
    bands = values // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_048):
            m = part.num_rows
            sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(m, bands, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (m, bands)) * _A
            for j in range(rows):
                h = (h ^ (h >> _SHIFT)) * _P + sig[:, :, j]
            h = (h ^ (h >> _SHIFT)) * _A
            h ^= h >> _SHIFT
            keys = np.repeat(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(m, 16), bands, axis=0)
            offsets = np.arange(0, 16 * (m * bands + 1), 16, dtype=np.int32)
            k = pa.Array.from_buffers(pa.binary(), m * bands, [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), k, pa.array(np.repeat(part.column(1).to_numpy(), bands))], ["bucket", "k", "n"])

    return in_arrow(classes.select("k", "n", "sig"), run, "bucket long, k binary, n int")


def _may_link(n1: Column, n2: Column, num: int, den: int) -> Column:
    return F.least(n1, n2) * den >= F.greatest(n1, n2) * num


def survivors(pairs: DataFrame, classes: DataFrame, values: int, threshold: float, miss: float = MISS) -> DataFrame:
    """The pairs ``a``, ``b`` whose signatures, compared a batch at a time, leave the posterior chance of a link at ``miss`` or more."""
    looks = least_matches(threshold, values, BATCH, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4_096):
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, values) for c in (2, 3))
            left, matches, begin = np.arange(part.num_rows), np.zeros(part.num_rows, np.int32), 0
            for n, fewest in looks:
                matches = matches + (x[left, begin:n] == y[left, begin:n]).sum(axis=1)
                on = matches >= fewest
                left, matches, begin = left[on], matches[on], n
            yield part.select([0, 1]).take(pa.array(left))

    sigs = classes.select("k", "sig")
    both = pairs.join(sigs.select(F.col("k").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("k").alias("b"), F.col("sig").alias("y")), "b")
    return in_arrow(both.select("a", "b", "x", "y"), run, "a binary, b binary")


def _in_tiles(members: DataFrame, classes: DataFrame, sets: DataFrame, values: int, rows: int, num: int, den: int, miss: float) -> DataFrame:
    """Pairs of members of a bucket with different ``l`` that may link by their signatures and by 32 bits of each shingle.

    A bucket is dealt into blocks of about ``TILE`` members, and a task compares two blocks at a time, so pairs that fail are never rows. A pair
    is compared in the first bucket that it shares.
    """
    looks = least_matches(num / den, values, BATCH, miss)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ends = part.column(1).offsets.to_numpy()
            flat = (part.column(1).values.to_numpy().view(np.uint64) >> _SHIFT).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(flat[i:j]).tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())], ["k", "half"])

    def tile(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        side, k, n, label, shared, sig, half = zip(*held)
        side, n, shared = np.array(side), np.array(n, np.int64), np.array(shared, np.int64)
        label = np.unique(np.array(label, object), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(sig), np.uint16).reshape(len(k), values)
        half = [np.frombuffer(h, np.uint32) for h in half]
        bands = sig.reshape(len(k), -1, rows)
        mine = (bands == bands[0]).all(axis=(0, 2))  # the band of this bucket
        found = []
        for i in range(len(k)):
            others = np.arange(i + 1, len(k)) if side[i] == 2 else np.flatnonzero(side == 1) if side[i] == 0 else np.zeros(0, np.int64)
            both = n[others] + n[i]
            left = others[(label[others] != label[i]) & (np.minimum(shared[others], shared[i]) * (den + num) >= both * num)]
            matches, begin = np.zeros(len(left), np.int32), 0
            for end, fewest in looks:
                matches = matches + (sig[left, begin:end] == sig[i, begin:end]).sum(axis=1)
                on = matches >= fewest
                left, matches, begin = left[on], matches[on], end
            if len(left):
                first = (bands[left] == bands[i]).all(axis=2).argmax(axis=1)
                for j in left[mine[first]].tolist():
                    overlap = len(half[i]) + len(half[j]) - len(np.unique(np.concatenate([half[i], half[j]])))
                    # shingles that are one by their 32 bits count for all
                    overlap += (n[i] - len(half[i])) + (n[j] - len(half[j]))
                    if overlap * (den + num) >= (n[i] + n[j]) * num:
                        found.append((min(k[i], k[j]), max(k[i], k[j])))
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, x, y, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (bucket, x, y) != at:
                    if held:
                        yield from tile(held)
                    at, held = (bucket, x, y), []
                held.append(tuple(row))
        if held:
            yield from tile(held)

    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("k", F.lit(3)), F.col("blocks")).cast("int").alias("block")
    dealt = members.join(sizes, "bucket").select("bucket", "k", "n", "l", "shared", block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    own = classes.select("k", "sig").join(in_arrow(sets, short, "k binary, half binary"), "k")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")
    tiles = dealt.join(own, "k").select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side, "k", "n", "l", "shared", "sig", "half")
    tiles = tiles.repartition(F.xxhash64("bucket", "x", "y")).sortWithinPartitions("bucket", "x", "y")
    return in_arrow(tiles, run, "a binary, b binary")


def _sets(docs: DataFrame, n_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [s for t in part.column(0) if len(s := shingle_set(t.as_buffer().to_pybytes(), n_words))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["k", "hs"])
        _words.clear()

    return in_arrow(docs, run, "k binary, hs array<long>").dropDuplicates(["k"])


def _sets_of(keys: DataFrame, classes: DataFrame, slim: DataFrame, n_words: int) -> DataFrame:
    """The whole sets of some classes, made again from a text of each."""
    ends = shared_checkpoint(keys.join(classes.select("k", "id"), "k"))
    ids = ends.select("id").distinct()
    texts = slim.join(hinted_small(ids, ends.count(), BROADCAST_KEYS), slim["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    return _sets(texts, n_words).join(ends.select("k"), "k", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link by their whole sets."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("hs").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return shared_checkpoint(both.filter(shared * (den + num) >= (F.size("x") + F.size("y")) * num).select("a", "b"))


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, rows: int = ROWS_OF_BAND, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """``id``, ``n``, ``k`` for every document (``k`` null without words), and ``node``, ``root`` for every class that has a link."""
    num, den = numerator, denominator
    values = rows * bands_for(num / den, rows, miss)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    signed = shared_checkpoint(_signed(slim, n_words, values))
    named = signed.filter("k is not null").groupBy("k").agg(F.max("n").alias("n"), F.min("id").alias("id"), F.first("sig").alias("sig"))
    classes = shared_checkpoint(named)

    member = _buckets(classes, values, rows)
    often = member.groupBy("bucket").agg(F.count("*").alias("times")).filter("times > 1")
    met = shared_checkpoint(member.join(often, "bucket"))
    meets = met.groupBy("k").agg(F.sum("times").alias("meets"))
    met = shared_checkpoint(met.drop("times").join(meets, "k"))
    hubs = met.groupBy("bucket").agg(F.max(F.struct("meets", "k", "n")).alias("hub"))
    near = met.join(hubs, "bucket").filter((F.col("k") != F.col("hub.k")) & _may_link(F.col("n"), F.col("hub.n"), num, den))
    pairs = near.select(F.col("hub.k").alias("a"), F.col("k").alias("b")).distinct()
    alive = shared_checkpoint(survivors(pairs, classes, values, num / den, miss))
    links = _confirmed(alive, _sets_of(_ends(alive), classes, slim, n_words), num, den)
    roots = components(links)

    # the hub was compared with all others of its bucket; of these, members of different components are left
    rest = met.join(hubs.select("bucket", F.col("hub.k").alias("done")), "bucket").filter("k != done").select("bucket", "k", "n")
    rest = rest.join(roots, rest["k"] == roots["node"], "left").select("bucket", "k", "n", F.coalesce("root", "k").alias("l"))
    mixed = rest.groupBy("bucket").agg(F.min("l").alias("l1"), F.max("l").alias("l2")).filter("l1 != l2").select("bucket")
    rest = shared_checkpoint(rest.join(mixed, "bucket", "left_semi"))
    sets = shared_checkpoint(_sets_of(rest.select("k").distinct(), classes, slim, n_words))
    lone = sets.select("k", F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("times"), F.min("k").alias("k")).filter("times = 1").groupBy("k").agg(F.count("*").alias("lone"))
    # what only one class has is in no overlap
    shared = F.col("n") - F.coalesce("lone", F.lit(0))
    rest = shared_checkpoint(rest.join(lone, "k", "left").withColumn("shared", shared).filter(F.col("shared") * den >= F.col("n") * num))
    alive = shared_checkpoint(_in_tiles(rest, classes, sets, values, rows, num, den, miss).distinct())
    more = _confirmed(alive, sets, num, den)
    if more.take(1):
        roots = components(links.union(more))
    return signed.select("id", "n", "k"), roots


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, rows: int = ROWS_OF_BAND, miss: float = MISS) -> DataFrame:
    """A row for each document: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id that links reach, itself included) and ``kept`` (it is that one).

    Two documents link if the Jaccard similarity of their sets of word n-grams is ``numerator / denominator`` or more. Sets ignore
    A-Z case; a text with fewer words is one n-gram; null and empty texts have an empty set, link with nothing and are kept. Rows with
    a null id take part, but never give a component its id unless all its ids are null, and are kept only then. Repeated rows are
    kept as rows and have the same values. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    own, roots = linked_classes(docs, id_col, text_col, n_words, numerator, denominator, rows, miss)
    named = own.filter("k is not null").groupBy("k").agg(F.min("id").alias("best"))
    linked = named.join(roots.withColumnRenamed("node", "k"), "k")
    least = linked.groupBy("root").agg(F.min("best").alias("best"))
    best = salted_join(linked.select("k", "root"), least, "root", "inner").select("k", "best").unionAll(named.join(roots, named["k"] == roots["node"], "left_anti").select("k", "best"))
    out = salted_join(own, best, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("best"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP12_SQL = f"""
with recursive w as (
  select doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct([array_to_string(ws[i:i+{WORDS - 1}], ' ') for i in range(1, 1 + greatest(len(ws) - {WORDS - 1}, least(len(ws), 1)))]) as hs from w),
g as (select doc_id, len(hs) as n, unnest(hs) as h from s),
o as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as n1, any_value(y.n) as n2, count(*) as o from g x join g y on x.h = y.h and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from o where {DENOMINATOR} * o >= {NUMERATOR} * (n1 + n2 - o)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by 1)
select s.doc_id, len(s.hs)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept from s join c using (doc_id)
"""
