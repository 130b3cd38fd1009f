"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handled at once inside an Arrow batch; keeps Python lists small when texts are long.
SLICE_ROWS = 256
#: Bytes of an Arrow batch on its way to a Python worker, where the session has no smaller bound: buffers of both sides grow with it.
BATCH_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short runs of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without that setting (a test) gets a temporary one; on a cluster it is an error."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def shared_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage in the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is ``shared_folder``'s.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of ``BATCH_BYTES`` at most; this bound stays set in the session."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = re.match(r"(-?\d+)([kmgt]?)", conf.get(bound).lower())
    size = int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[now[2]] if now else -1
    if not 0 < size <= BATCH_BYTES:
        conf.set(bound, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # workers live on for other stages

    return df.mapInArrow(task, schema)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(docs: DataFrame, text_col: str, keep: list[str], added: T.StructType, make: Callable[[], Callable[[list[str]], list[pa.Array]]], done: Callable[[], None] = lambda: None) -> DataFrame:
    """The columns ``keep`` of every row and, after them, the columns ``added``, which are made of whole texts (null: empty).

    ``make`` is called once in each task and gives a function from a list of texts to the arrays of the added columns; ``done`` is
    called when the task ends. Rows keep their order and number, whatever is null or repeated in them.
    """
    names = [f"c{i}" for i in range(len(keep))]
    at = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType == T.StringType() else len(keep)
    sent = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *[F.col(f"`{text_col}`").cast("string").alias("t")] * (at == len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches):
            columns = work([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], [*names, *added.names])
        done()

    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, names)], *added.fields])
    out = in_arrow(sent, run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *added.names)


def salted_join(rows: DataFrame, table: DataFrame, key: str, how: str, salts: int = 16) -> DataFrame:
    """Join ``rows`` to ``table`` (one row for each ``key``) with the rows of each key dealt over ``salts`` tasks; ``table`` is sent that often."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    every = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(every, [key, "_salt"], how).drop("_salt")


def hinted_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast ``df`` only if its counted ``rows`` do not exceed ``most``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df


def fold(id_col: str = "doc_id"):
    """The fold of a document, 0 to 3; fold 2 is held out from every fit."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
