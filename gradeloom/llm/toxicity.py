"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

Features are the distinct words of a text and their first four and five letters, hashed; the model keeps those whose log-likelihood
ratio between toxic and clean texts exceeds twice the log of the number of features. Labels say only toxic or not, so grades are derived from
them: kept features that toxic texts have far more often are marked, and a toxic text is of grade 1, 2
or 3 by how many of its words are marked (at most ``GRADE_WORDS[0]``, at most ``GRADE_WORDS[1]``, more). The model has one weight for each
feature, shared by the ordered thresholds: P(grade > g) = logistic(w.x - threshold_g). A text's severity is its expected grade.

The fit uses a bounded sample of labelled texts outside the held-out fold (``FIT_ROWS``, a parameter): toxic ones first, up to half of it, then clean
ones, each kind the first by a hash of the id and weighted by its share of all labels. Of copies of one label in it only one is used. Texts
are hashed and features counted in Spark; the driver sees signatures, counts and the kept features. Every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm._common import fold, in_arrow, map_texts, read, shared_checkpoint, slices, unused
from gradeloom.llm.quality import one_label

#: Labelled texts that a fit uses at most; texts that a feature is in at least.
FIT_ROWS, LEAST_TEXTS = 12_000, 3
GRADE_WORDS = (1, 4)
HELD_OUT, REJECT = 2, 0.5
#: Marked features: toxic texts must have them so many times as often as clean ones.
MARK_RATIO = 20.0
#: Texts of one label whose runs of five words agree in this share (by so many minima, looked up in bands of four) are copies.
COPY, MINIMA, BAND = 0.8, 64, 4
_WORD = re.compile(r"\w+")
#: Words that a worker keeps.
_CACHE = 60_000


def word_hashes(word: str) -> tuple[int, ...]:
    """The feature hashes of a word: itself and its starts."""
    return tuple({xxhash.xxh3_64_intdigest(word) >> 1, *(xxhash.xxh3_64_intdigest(f"{word[:n]}-") >> 1 for n in (4, 5) if len(word) >= n)})


class _Hashes(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        found = word_hashes(word)
        if len(self) < _CACHE:
            self[word] = found
        return found


_hashes = _Hashes()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(tokens: list[str]) -> set[int]:
    return {h for w in set(tokens) for h in _hashes[w]}


class Ordinal(NamedTuple):
    weights: dict[int, float]
    thresholds: np.ndarray

    def above(self, texts: list[str], plain: set[str]) -> np.ndarray:
        """The probabilities that the grades of texts exceed 0, 1, ...; ``plain`` gathers words without a weight."""
        totals = []
        for text in texts:
            hits: set[int] = set()
            for w in set(words(text)) - plain:
                mine = [h for h in word_hashes(w) if h in self.weights]
                if mine:
                    hits.update(mine)
                elif len(plain) < _CACHE:
                    plain.add(w)
            totals.append(sum(map(self.weights.__getitem__, sorted(hits))))
        return 1 / (1 + np.exp(-np.clip(np.array(totals)[:, None] - self.thresholds, -30, 30)))


def fit_ordinal(x: list[np.ndarray], grade: np.ndarray, grades: int, weight: np.ndarray | None = None, l2: float = 1e-5, steps: int = 600, rate: float = 0.3) -> tuple[dict[int, float], np.ndarray]:
    """Weights by feature and increasing thresholds, by full-batch adaptive gradient ascent of the likelihood.

    Thresholds are a first one and exponentials of steps, so they stay in order. ``weight`` has the rows' weights, 1 on the mean.
    """
    weight = np.ones(len(x)) if weight is None else weight
    names, at = np.unique(np.concatenate(x) if x else np.zeros(0, np.int64), return_inverse=True)
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    w, cuts = np.zeros(len(names)), np.r_[1.0, np.zeros(grades - 2)]
    gw, gc = np.full(len(w), 1e-8), np.full(len(cuts), 1e-8)
    for _ in range(steps):
        theta = np.r_[cuts[0], cuts[0] + np.cumsum(np.exp(cuts[1:]))]
        score = np.bincount(rows, w[at], minlength=len(x))
        below = 1 / (1 + np.exp(-np.clip(theta - score[:, None], -30, 30)))
        upper = np.c_[below, np.ones(len(x))][np.arange(len(x)), grade]
        lower = np.c_[np.zeros(len(x)), below][np.arange(len(x)), grade]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        to_w = np.bincount(at, (dl - du)[rows], minlength=len(w)) / len(x) - l2 * w
        to_theta = np.array([du[grade == g].sum() - dl[grade == g + 1].sum() for g in range(grades - 1)]) / len(x)
        tail = np.cumsum(to_theta[::-1])[::-1]
        to_cuts = np.r_[tail[0], tail[1:] * np.exp(cuts[1:])]
        gw += to_w**2
        gc += to_cuts**2
        w += rate * to_w / np.sqrt(gw)
        cuts += rate * to_cuts / np.sqrt(gc)
    theta = np.r_[cuts[0], cuts[0] + np.cumsum(np.exp(cuts[1:]))]
    return dict(zip(names.tolist(), w.tolist())), theta


_ODD = np.random.default_rng(1).integers(0, 2**63, (2, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(tokens: list[str]) -> np.ndarray:
    """Minima of the runs of five words of a text under ``MINIMA`` orders."""
    runs = {" ".join(tokens[j : j + 5]) for j in range(max(len(tokens) - 4, 1))}
    h = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in runs), np.uint64, len(runs))
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4_096):
        out = np.minimum(out, (h[at : at + 4_096, None] * _ODD[0] + _ODD[1]).min(axis=0))
    return out.view(np.int64)


def without_copies(signatures: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rows that are no copy of an earlier kept one of their label."""
    bands: dict[tuple[int, int, bytes], list[int]] = {}
    kept = []
    for i, row in enumerate(signatures):
        keys = [(int(y[i]), k, row[k : k + BAND].tobytes()) for k in range(0, MINIMA, BAND)]
        near = {j for key in keys for j in bands.get(key, ())}
        if any((signatures[j] == row).mean() >= COPY for j in near):
            continue
        kept.append(i)
        for key in keys:
            bands.setdefault(key, []).append(i)
    return np.array(kept, dtype=np.int64)


def _ratio(bad: np.ndarray, good: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The log-likelihood ratio of texts with a feature, ``bad`` of ``n1`` and ``good`` of ``n0``."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    share = (bad + good) / (n1 + n0)
    return 2 * (part(bad, n1 * share) + part(good, n0 * share) + part(n1 - bad, n1 * (1 - share)) + part(n0 - good, n0 * (1 - share)))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _sample(ids: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """The labelled ids to fit on, toxic ones first, up to half of them, and how many labels of each kind there are."""
    many = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    toxic = min(many.get(1, 0), max(fit_rows // 2, fit_rows - many.get(0, 0)))
    first = lambda y, n: ids.filter(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(n)
    return first(1, toxic).unionAll(first(0, fit_rows - toxic)), many


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        tokens = [words(t) for t in part.column(2).to_pylist()]
        columns = [pa.array([sorted(features(t)) for t in tokens], pa.list_(pa.int64())), pa.array([signature(t) for t in tokens], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, part.column(2)], ["id", "y", "features", "signature", "text"])
    _hashes.clear()


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Ordinal | None:
    """Derive grades and fit on ``fit_rows`` labelled ids at most outside the held-out fold; of an id's texts the least counts. None if one of the labels is missing."""
    ids = shared_checkpoint(one_label(labels, id_col, label_col).filter(fold("id") != HELD_OUT))
    some, many = _sample(ids, fit_rows)
    texts = _slim(docs, id_col, text_col).join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = shared_checkpoint(in_arrow(texts, _hashed, "id long, y int, features array<long>, signature array<long>, text string"))
    table = rows.select("id", "y", "signature").orderBy(F.xxhash64("id", F.lit(7)), "id").toArrow()
    if not table.num_rows:
        return None
    y = table.column("y").to_numpy()
    kept = without_copies(np.asarray(table.column("signature").combine_chunks().flatten()).reshape(len(y), MINIMA), y)
    ids_kept, y = table.column("id").to_numpy()[kept], y[kept]
    if y.min() == y.max():
        return None
    n1, n0 = int(y.sum()), int((1 - y).sum())
    own = docs.sparkSession.createDataFrame(pa.table({"id": ids_kept}))
    rows = rows.join(F.broadcast(own), "id")
    counts = rows.select("y", F.explode("features").alias("h")).groupBy("h").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_TEXTS).orderBy("h").toArrow()
    if not counts.num_rows:
        return None
    names, in_bad = counts.column("h").to_numpy(), counts.column("bad").to_numpy()
    in_good = counts.column("n").to_numpy() - in_bad
    tells = _ratio(in_bad, in_good, n1, n0) > 2 * np.log(len(names))
    marked = set(names[tells & (in_bad / n1 >= MARK_RATIO * in_good / n0)].tolist())
    telling = set(names[tells].tolist())

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grades = []
            for label, text in zip(part.column(1).to_pylist(), part.column(3).to_pylist()):
                hits = sum(not marked.isdisjoint(_hashes[w]) for w in words(text)) if label else 0
                grades.append(label and 1 + sum(hits > g for g in GRADE_WORDS))
            x = [[h for h in r if h in telling] for r in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.list_(pa.int64())), pa.array(grades, pa.int32())], ["id", "y", "x", "grade"])
        _hashes.clear()

    table = in_arrow(rows.select("id", "y", "features", "text"), graded, "id long, y int, x array<long>, grade int").orderBy(F.xxhash64("id", F.lit(7)), "id").toArrow()
    y, x = table.column("y").to_numpy(), [np.array(r, dtype=np.int64) for r in table.column("x").to_pylist()]
    seen = np.array([(table.num_rows - int(y.sum())), int(y.sum())]) / np.array([many[0], many[1]])
    weight = 1 / seen[y]
    return Ordinal(*fit_ordinal(x, table.column("grade").to_numpy().astype(np.int64), len(GRADE_WORDS) + 2, weight / weight.mean()))


def graded(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The columns ``keep`` of every row and, last, severity, score and grade, by a model fitted on labelled rows of ``docs``. These are ``_severity``, ``_score`` and ``_grade``, or those with underscores if a kept column has the name."""
    model = docs.sparkSession.sparkContext.broadcast(fit_from(docs, labels, id_col, text_col, label_col, fit_rows))

    def make():
        m, plain = model.value, set()

        def grade(texts: list[str]) -> list[pa.Array]:
            above = m.above(texts, plain) if m and texts else np.zeros((len(texts), len(GRADE_WORDS) + 1))
            each = np.c_[np.ones(len(texts)), above] - np.c_[above, np.zeros(len(texts))]
            return [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32))]

        return grade

    added = T.StructType([T.StructField(unused(n, keep), t) for n, t in (("_severity", T.DoubleType()), ("_score", T.DoubleType()), ("_grade", T.IntegerType()))])
    return map_texts(docs, text_col, keep, added, make, _hashes.clear)  # workers live on for other stages


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """Grade every whole text: ``id_col``, ``held_out``, ``severity`` (the expected grade, 0 to 3), ``score`` (the probability of a
    grade above 0), ``grade`` (the likeliest) and ``toxic`` (``score >= reject``).

    Null texts count as empty; null ids are graded and give nothing to the fit. Without labels of both kinds all texts have severity, score and grade 0.
    Rows are kept one for one; other columns are not read.
    """
    out = graded(docs, labels, [id_col], id_col, text_col, label_col, fit_rows)
    held_out = F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out")
    return out.select(F.col(id_col).cast("long").alias(id_col), held_out, F.col("_severity").alias("severity"), F.col("_score").alias("score"), F.col("_grade").alias("grade"), (F.col("_score") >= reject).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose own text is not rejected, with all their columns and values, whatever the columns' names."""
    rows = graded(docs, labels, docs.columns, id_col, text_col, label_col, fit_rows)
    return rows.filter(F.col(rows.columns[-2]) < reject).select([F.col(f"`{c}`") for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
