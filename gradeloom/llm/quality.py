"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a few statistics of its characters, words and lines, on log or ratio scales. Each class has a Gaussian with its
own mean and a covariance shrunk towards a multiple of the identity; a score is the logistic of the difference of the two log
densities, which are Mahalanobis distances by Cholesky factors that are computed once and shipped with the job. The
sums from which means and covariances come are taken in Spark over all labelled rows outside the held-out fold.
"""

from __future__ import annotations

import math
import operator
from itertools import combinations_with_replacement, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm._common import fold, map_texts, read, unused

#: Weight of the identity in each covariance, the divisor of log-density differences, and the least score of a kept document.
SHRINKAGE, TEMPERATURE, KEEP = 0.02, 8.0, 0.7
HELD_OUT = 2
#: The step to which statistics are rounded, and the bits of a product's lower part.
STEP, HALF = 2.0**-16, 21
STATISTICS = ("words", "word_length", "upper", "signs", "repeats", "distinct", "digits", "bare", "line_length", "stops")

_SIGN = np.zeros(128, dtype=bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?/@"]] = True


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; an empty one has those of no words."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    lower = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    n = max(len(points), 1)
    same = min(len(points), len(lower))
    ascii_ = points[points < 128]
    words = text.split()
    w = max(len(words), 1)
    spaces = n - sum(map(len, words))
    letters = max(n - spaces, 1)
    repeats = sum(map(operator.eq, words, words[1:]))
    distinct = len(set(words))
    bare = sum(1 for x in words if len(x) < 4 and not x[0].isalnum() and not x[-1].isalnum())
    ends = text.count(".") + text.count("?")
    return [
        math.log1p(len(words)), math.log((n - spaces + 1) / w), math.log(int((points[:same] != lower[:same]).sum()) / letters + 0.01), math.log(int(_SIGN[ascii_].sum()) / letters + 0.005),
        math.log(repeats / w + 0.01), math.log(distinct + 1) / math.log(w + 2), math.log(int(((ascii_ > 47) & (ascii_ < 58)).sum()) / letters + 0.01), math.log(bare / w + 0.01), math.log(n / (text.count("\n") + 1) + 10), math.log(ends / w + 0.02),
    ]


def in_steps(text: str) -> list[int]:
    return [round(x / STEP) for x in statistics(text)]


class Gaussian(NamedTuple):
    mean: np.ndarray
    whiten: np.ndarray  # the inverse of the covariance's Cholesky factor
    constant: float  # log prior less half the log determinant

    def density(self, x: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * np.square((x - self.mean) @ self.whiten.T).sum(axis=1)


class Discriminant(NamedTuple):
    centre: np.ndarray
    spread: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.centre) / self.spread, -12, 12)
        low, high = self.classes
        return 1 / (1 + np.exp(-np.clip((high.density(z) - low.density(z)) / TEMPERATURE, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on all labelled rows outside fold 2. Only a row of sums for each class reaches the driver.

    Statistics are rounded to whole steps of ``STEP`` and their products summed in two whole parts, so the sums, and with them every
    score, are the same whatever the order of rows. Each row of a repeated id counts.
    """
    d = len(STATISTICS)
    learnt = docs.filter(F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT))
    steps = map_texts(learnt, text_col, [id_col], T.StructType([T.StructField("q", T.ArrayType(T.LongType()))]), lambda: lambda texts: [pa.array([in_steps(t) for t in texts], pa.list_(pa.int64()))])
    rows = steps.select(F.col(id_col).cast("long").alias("id"), "q").join(one_label(labels, id_col, label_col), "id")
    q = F.col("q")
    sums = [F.count("*").alias("n"), *[F.sum(q[i]).alias(f"s{i}") for i in range(d)]]
    for i, j in combinations_with_replacement(range(d), 2):
        sums += [F.sum(F.shiftright(q[i] * q[j], HALF)).alias(f"h{i}_{j}"), F.sum((q[i] * q[j]).bitwiseAND(F.lit(2**HALF - 1))).alias(f"l{i}_{j}")]
    found = {r["y"]: r for r in rows.groupBy("y").agg(*sums).collect()}
    if set(found) != {0, 1} or min(r["n"] for r in found.values()) < 2:
        return Discriminant(np.zeros(d), np.ones(d), None)
    n = np.array([found[c]["n"] for c in (0, 1)], dtype=float)
    total = np.array([[found[c][f"s{i}"] * STEP for i in range(d)] for c in (0, 1)])
    second = np.zeros((2, d, d))
    for c, (i, j) in product((0, 1), combinations_with_replacement(range(d), 2)):
        second[c, i, j] = second[c, j, i] = (found[c][f"h{i}_{j}"] * 2**HALF + found[c][f"l{i}_{j}"]) * STEP**2
    return discriminant(n, total, second, shrinkage)


def discriminant(n: np.ndarray, total: np.ndarray, second: np.ndarray, shrinkage: float) -> Discriminant:
    """The model of each class's number of rows, sums of statistics and sums of their products."""
    d = total.shape[1]
    # each class weighs the same in the scale, so that a rare class is not lost in it
    centre = (total / n[:, None]).mean(axis=0)
    spread = np.sqrt(np.maximum((np.einsum("cii->ci", second) / n[:, None]).mean(axis=0) - centre**2, 1e-6))
    classes = []
    for c in (0, 1):
        mean = total[c] / n[c]
        covariance = (second[c] / n[c] - np.outer(mean, mean)) / np.outer(spread, spread)
        covariance = (1 - shrinkage) * covariance + shrinkage * max(np.trace(covariance) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(covariance)
        classes.append(Gaussian((mean - centre) / spread, np.linalg.inv(factor), math.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum()))
    return Discriminant(centre, spread, (classes[0], classes[1]))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``id`` and ``y`` for ids whose rows all have one label, 0 or 1; null ids and labels, and ids with both, are left out."""
    y = F.col(label_col).cast("int")
    found = labels.filter(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(y).alias("y"), F.max(y).alias("z"))
    return found.filter("y = z").select("id", "y")


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The columns ``keep`` of every row and, last, the score, by a model fitted on the labelled rows of ``docs``. It is ``_score``, or that with underscores if a kept column has that name."""
    model = fit(docs, labels, id_col, text_col, label_col)
    score = lambda texts: [pa.array(model.score(np.array([in_steps(t) for t in texts]).reshape(-1, len(STATISTICS)) * STEP))]
    return map_texts(docs, text_col, keep, T.StructType([T.StructField(unused("_score", keep), T.DoubleType())]), lambda: score)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """Score every whole text: ``id_col``, ``held_out`` (fold 2 of crc32(id) mod 4, from which nothing is learnt), ``score`` (0 to 1) and ``predicted``.

    Null texts count as empty ones; null ids are scored, are in no fold and give nothing to the fit; all rows of a repeated id are scored and learnt from. With no
    label of one of the classes all scores are 0.5. Rows are kept one for one; other columns are not read.
    """
    out = scored(docs, labels, [id_col], id_col, text_col, label_col)
    return out.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= keep).cast("int").alias("predicted"))


def without_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose own text scores ``keep`` or more, with all their columns and values, whatever the columns' names."""
    rows = scored(docs, labels, docs.columns, id_col, text_col, label_col)
    return rows.filter(F.col(rows.columns[-1]) >= keep).select([F.col(f"`{c}`") for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
