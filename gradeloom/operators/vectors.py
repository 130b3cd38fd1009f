"""Retrieval and near-duplicate joins over embeddings, by a coarse index of lists around centroids.

The index is fitted on a bounded sample, but every vector is in it. A list that is large is cut into slices, and the queries that probe it into
blocks, by counted sizes: a task multiplies one slice with one block and hands on its best rows only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.lineage import cut, forget

#: Vectors that an index is fitted on at most, those of them whose neighbours are looked up to set the number of probes, and most lists.
SAMPLE, TRIALS, MOST_LISTS = 20_000, 400, 1_024
#: Vectors of a slice and queries of a block.
SLICE, BLOCK = 4_096, 1_024
#: Pairs of a vector and a list that a task weighs, and may hand on, at once.
WEIGHED = 1 << 16
#: Bytes of vectors in a partition of slices; a task that pairs two partitions holds one of them.
PART = 32 << 20


@dataclass(frozen=True)
class Index:
    """Unit centroids, a row each, and how many of them a query probes."""

    centroids: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 5, sample: int = SAMPLE, seed: int = 7) -> Index:
    """Centroids by k-means on the ``sample`` vectors whose ids hash lowest, and the fewest probes that find ``recall`` of the ``k`` nearest.

    The probes are set on ``TRIALS`` vectors of the sample against all of it. ``lists`` is by default the root of the sample's size.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(sample)
    known = _unit(np.array([r["v"] for r in rows.collect()], np.float64))  # ``sample`` rows at most
    lists = min(lists or max(1, math.isqrt(len(known))), MOST_LISTS, len(known))
    frame = vectors.sparkSession.createDataFrame([(x.tolist(),) for x in known], "v array<double>").select(array_to_vector("v").alias("features"))
    centroids = _unit(np.array(KMeans(k=lists, seed=seed, maxIter=15, distanceMeasure="cosine").fit(frame).clusterCenters())) if lists > 1 else known[:1]
    tried = known[:TRIALS]
    scores = tried @ known.T
    scores[np.arange(len(tried)), np.arange(len(tried))] = -2
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(known) - 1)]
    home = (known @ centroids.T).argmax(axis=1)
    order = np.argsort(-(tried @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, home[best], axis=1).reshape(-1))  # probes less one that find each neighbour
    probes = int(needed[math.ceil(recall * len(needed)) - 1]) + 1 if len(needed) else 1
    return Index(centroids, probes)


def _few(batches, width: int):
    """Batches cut so that each of their vectors can be held against ``width`` lists at once."""
    rows = max(1, WEIGHED // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_lists(vectors: DataFrame, index: Index, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = 1) -> DataFrame:
    """``id_col``, ``vector_col`` and ``list``: each vector in its ``probes`` nearest lists."""
    centroids = index.centroids.T.copy()

    def assign(batches):
        for batch in _few(batches, centroids.shape[1]):
            near = np.argsort(-(_unit(_matrix(batch.column(1))) @ centroids), axis=1, kind="stable")[:, :probes]
            rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.reshape(-1), pa.int32())], [id_col, vector_col, "list"])

    kind = dict(vectors.dtypes)
    slim = vectors.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    return slim.mapInArrow(assign, f"{id_col} {kind[id_col]}, {vector_col} {kind[vector_col]}, list int")


def _parts(rows: DataFrame, most: int, name: str) -> DataFrame:
    """How many parts of about ``most`` rows each list makes: a row for each list."""
    return rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def _tiles(queries: DataFrame, vectors: DataFrame, id_col: str, score) -> DataFrame:
    """Each block of a list's queries with each slice of its vectors, given to ``score`` as two Arrow tables."""
    sizes = _parts(queries, BLOCK, "blocks").join(_parts(vectors, SLICE, "slices"), "list")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(id_col), F.col(f"{own}s")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        return rows.join(sizes, "list").select(id_col, "v", "list", mine, every)

    keys = ["list", "block", "slice"]
    return dealt(queries, "block", "slice").groupBy(*keys).cogroup(dealt(vectors, "slice", "block").groupBy(*keys)).applyInArrow(score, f"query_id {dict(vectors.dtypes)[id_col]}, {id_col} {dict(vectors.dtypes)[id_col]}, score long")


def _scores(left: pa.Table, right: pa.Table, id_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines as whole millionths, and the ids of rows and columns."""
    cosine = _unit(_matrix(left.column("v"))) @ _unit(_matrix(right.column("v"))).T
    return np.floor(cosine * 1_000_000 + 0.5).astype(np.int64), left.column(id_col).to_numpy(), right.column(id_col).to_numpy()


def search(queries: DataFrame, vectors: DataFrame, index: Index, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``id_col``, ``score`` (cosine in millionths) and ``rank``: the ``k`` best vectors in the lists that each query probes, ties by id."""

    renamed = lambda rows: rows.withColumnRenamed(vector_col, "v")
    return _best(renamed(in_lists(queries, index, id_col, vector_col, index.probes)), renamed(in_lists(vectors, index, id_col, vector_col)), k, id_col)


def search_all(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same against all vectors: each block of queries with each slice of vectors."""
    one = lambda rows: rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias(id_col), F.col(vector_col).alias("v"), F.lit(0).alias("list"))
    return _best(one(queries), one(vectors), k, id_col)


def _best(queries: DataFrame, vectors: DataFrame, k: int, id_col: str) -> DataFrame:
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": left.column(id_col)[:0], id_col: left.column(id_col)[:0], "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        right = right.sort_by(id_col)
        scores, q, v = _scores(left, right, id_col)
        scores[q[:, None] == v[None, :]] = -2_000_000
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows, columns = np.repeat(np.arange(len(q)), top.shape[1]), top.reshape(-1)
        keep = scores[rows, columns] > -2_000_000
        rows, columns = rows[keep], columns[keep]
        return pa.table({"query_id": pa.array(q[rows]), id_col: pa.array(v[columns]), "score": pa.array(scores[rows, columns])})

    found = _tiles(queries, vectors, id_col, best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall_at_k(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """How many of the exact neighbours were found: ``found``, ``exact`` and ``recall``."""
    hits = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    sums = hits.agg(F.count("hit").alias("found"), F.count("*").alias("exact"))
    return sums.withColumn("recall", F.try_divide(F.col("found").cast("double"), F.col("exact").cast("double")))


def equal_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col`` and ``class_id``, the smallest id with the same vector; null vectors are classes of their own."""
    known = vectors.filter(F.col(vector_col).isNotNull())
    least = known.groupBy(vector_col).agg(F.min(id_col).alias("class_id"))
    same = known.join(least, vector_col).select(id_col, "class_id")
    return same.unionAll(vectors.filter(F.col(vector_col).isNull()).select(id_col, F.col(id_col).alias("class_id")))


def near_vectors(vectors: DataFrame, index: Index, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """All pairs of different vectors with a cosine of ``threshold`` or more, by class: ``query_id`` < ``id_col`` and ``score`` in millionths.

    No pair is lost: the slices of two lists meet unless the angles of their vectors to the other's centroid, and the largest angle in it, leave no
    room for a pair, and of both slices those vectors are multiplied that could have a partner in the other. Slices are rows, and tasks read the
    partitions of both sides as they are, so no vector is written more than a few times, however many slices it meets. The number of products
    still grows with the square of the vectors where directions have no clusters. Equal vectors are one class (``equal_vectors``), so copies make no pairs.
    """
    own = vectors.filter(F.col(vector_col).isNotNull()).groupBy(vector_col).agg(F.min(id_col).alias(id_col)).select(id_col, vector_col)
    homes = cut(in_lists(own, index, id_col, vector_col))
    sizes = F.broadcast(_parts(homes, SLICE, "slices"))  # a row for each list
    slices = cut(_slices(homes, sizes, index, id_col, vector_col))
    least = math.floor(threshold * 1_000_000 + 0.5)
    lowest = (least - 0.5) / 1_000_000  # what is rounded up to ``least``
    reach = math.acos(min(1.0, max(-1.0, lowest))) + 1e-7
    forget(homes)
    parts = max(1, -(-slices.count() // max(1, PART // (SLICE * index.centroids.shape[1] * 8))))
    left, right = (slices.repartition(parts).select(*[F.col(c).alias(f"{side}_{c}") for c in slices.columns]) for side in ("a", "b"))
    room = lambda a, b: F.element_at(f"{a}_away", F.col(f"{b}_list") + 1) <= F.col(f"{b}_radius") + reach
    met = left.hint("shuffle_replicate_nl").join(right, (F.col("a_no") <= F.col("b_no")) & room("a", "b") & room("b", "a"))
    centroids = index.centroids

    def pairs(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                value = lambda name: row.column(name)[0].as_py()
                items = lambda name: row.column(name).flatten()
                a, b = (_unit(items(f"{side}_v").to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centroids.shape[1])) for side in "ab")
                ids = [items(f"{side}_id").to_numpy(zero_copy_only=False) for side in "ab"]
                near = [np.flatnonzero(x @ centroids[value(f"{other}_list")] >= math.cos(min(math.pi, value(f"{other}_radius") + reach))) for x, other in ((a, "b"), (b, "a"))]
                a, b, one = a[near[0]], b[near[1]].T, value("a_no") == value("b_no")
                for begin in range(0, len(a), BLOCK):
                    cosine = a[begin : begin + BLOCK] @ b
                    rows, columns = np.nonzero(cosine >= lowest - 1e-9)
                    score = np.floor(cosine[rows, columns] * 1_000_000 + 0.5).astype(np.int64)
                    q, v = ids[0][near[0][begin + rows]], ids[1][near[1][columns]]
                    keep = (score >= least) & ((q < v) if one else True)
                    q, v, score = q[keep], v[keep], score[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(q, v), items("a_id").type), pa.array(np.maximum(q, v), items("a_id").type), pa.array(score)], ["query_id", id_col, "score"])

    kind = dict(vectors.dtypes)[id_col]
    names = ("no", "list", "radius", "id", "v")
    return met.select(*[f"{side}_{n}" for side in "ab" for n in names]).mapInArrow(pairs, f"query_id {kind}, {id_col} {kind}, score long")


def _slices(homes: DataFrame, sizes: DataFrame, index: Index, id_col: str, vector_col: str) -> DataFrame:
    """A row for each slice of a list: ``no``, its ids and vectors end to end, ``radius``, the largest angle from the list's centroid, and ``away``, the smallest to each centroid."""
    kind, centroids = dict(homes.dtypes), index.centroids.T.copy()

    def pack(rows: pa.Table) -> pa.Table:
        vectors = rows.column(vector_col).combine_chunks()
        at = rows.column("list")[0].as_py()
        angles = np.arccos(np.clip(_unit(_matrix(vectors)) @ centroids, -1, 1))
        one = lambda x: pa.array([x.to_pylist()], pa.list_(x.type))
        return pa.table({"no": rows.column("no")[:1], "list": rows.column("list")[:1], "radius": [float(np.fmax.reduce(angles[:, at]))], "away": one(pa.array(np.fmin.reduce(angles, axis=0))), "id": one(rows.column(id_col)), "v": one(vectors.flatten())})

    dealt = homes.join(sizes, "list").withColumn("no", F.col("list").cast("long") * (1 << 32) + F.pmod(F.xxhash64(id_col), F.col("slices")))
    return dealt.groupBy("no").applyInArrow(pack, f"no long, list int, radius double, away array<double>, id array<{kind[id_col]}>, v {kind[vector_col]}")
