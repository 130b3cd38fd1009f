"""A training-corpus pipeline of the training-text operators: each stage works on all that the one before it kept.

Columns that the input has beside those of ``documents``, whatever their names, come through with their values; an empty table gives no rows.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame; all but the last return the columns of ``documents``. Each result is written
as Parquet and read again as the next stage's input. A stage decides on every row by the row itself, not by its id: rows with a null or a
repeated id are judged by their text like others. The operators say what they do with null, empty and repeated texts.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import read, shared_folder
from gradeloom.llm.mixing import in_shards, mixed
from gradeloom.llm.ngram_join import one_of_each_component
from gradeloom.llm.piece_codec import piece_codes
from gradeloom.llm.quality import without_poor
from gradeloom.llm.toxicity import without_toxic

MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return without_poor(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates stays; documents without words stay as they are."""
    return one_of_each_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard by shard and shuffled inside each, with all its columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return in_shards(mixed(docs.select("doc_id", "source", "text", row))).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row encoded with an end id, and the digest of what its ids decode to."""
    return piece_codes(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", one_of_each_group),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Classifiers fitted in the stages, hypergeometric draws and sentencepiece ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; results between them go to the shared folder in ``spark.checkpoint.dir``.

    A stage's result is removed once the next one is written; the last one stays, since the returned DataFrame reads it.
    """
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if k:
            _remove(spark, f"{at}/{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
