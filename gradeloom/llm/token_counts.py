"""Token counts of whole texts by a two-tier, map-side lookup.

Tier one is a compact table of the lengths (in tokens) of the corpus' most frequent pre-tokens. It has at
most ``table_size`` entries whatever the corpus, so it is broadcast. Tier two is a bounded cache in the Python
worker of each task for the rest: what neither tier knows is encoded by the library, all of a slice's unknown
pre-tokens in one call. Pre-tokens are never shuffled.

The table is fitted on all texts: each task hands on one row with its leading counts, and these summaries are summed up in a
tree. The table only decides how fast a length is found, so pruned counts never change a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import in_arrow, read, slices
from gradeloom.llm._pretokens import library_ids, pretokens, processor

TABLE_SIZE = 32_768
#: Entries of a task's cache (some 40 MB), and the longest pre-token, in characters, that is kept in it.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64
#: Task summaries that are summed up together, and how often.
FAN, LEVELS = 32, 3
TOKEN_LIMIT = 4_096


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")


def _top(counts: Counter, size: int) -> pa.RecordBatch:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return pa.RecordBatch.from_arrays([pa.array([[t for t, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["tokens", "counts"])


def frequent_pretokens(docs: DataFrame, text_col: str = "text", table_size: int = TABLE_SIZE) -> list[str]:
    """The pre-tokens with the highest summed counts over all texts; ties by code point. ``table_size`` at most.

    A task sums up its own counts, of which it keeps the leading ones, as one row; sums of ``FAN`` rows are made ``LEVELS`` times over. So what
    moves is a bounded summary of each task, not its pre-tokens, and the driver gets one row of every ``FAN ** LEVELS`` tasks.
    """

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                counts.update(pretokens(text))
            if len(counts) > 8 * table_size:
                counts = Counter(dict(counts.most_common(2 * table_size)))
        short = Counter({t: n for t, n in counts.items() if len(t) <= CACHE_CHARS})
        at = pa.array([TaskContext.get().partitionId()], pa.int64())
        yield pa.RecordBatch.from_arrays([at, *_top(short, table_size).columns], ["at", "tokens", "counts"])

    def together(group: pa.Table) -> pa.Table:
        counts: Counter[str] = Counter()
        for tokens, many in zip(group.column("tokens").to_pylist(), group.column("counts").to_pylist()):
            for t, n in zip(tokens, many):
                counts[t] += n
        top = pa.Table.from_batches([_top(counts, table_size)])
        return top.add_column(0, "at", [pc.divide(group.column("at")[:1], FAN)])

    schema = "at long, tokens array<string>, counts array<long>"
    sums = in_arrow(docs.select(_text(text_col)), leading, schema)
    for _ in range(LEVELS):
        sums = sums.groupBy(F.floor(F.col("at") / FAN)).applyInArrow(together, schema)
    counts: Counter[str] = Counter()
    for r in sums.collect():
        counts.update(dict(zip(r["tokens"], r["counts"])))
    return _top(counts, table_size).column(0)[0].as_py()


class _Lengths(dict):
    """Tier one, with what a task has found of tier two beside it."""

    def __init__(self, table: dict[str, int], model_path: str):
        super().__init__(table)
        self.model, self.cache, self.rest = processor(model_path), {}, {}

    def learn(self, tokens: set[str]) -> None:
        """Have the library encode what neither tier knows."""
        tokens = tokens - self.keys()
        if len(self.cache) + len(tokens) > CACHE_ENTRIES:
            self.cache.clear()
        new = list(tokens - self.cache.keys())
        found = dict(zip(new, map(len, library_ids(self.model, new)))) if new else {}
        self.cache.update((t, n) for t, n in found.items() if len(t) <= CACHE_CHARS)
        self.rest = {**self.cache, **found} if any(len(t) > CACHE_CHARS for t in new) else self.cache

    def __missing__(self, token: str) -> int:
        return self.rest[token]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, table_size: int = TABLE_SIZE) -> DataFrame:
    """Count the tokens of every whole text as the sentencepiece library does, without begin or end ids.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``), a row for
    each input row. Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows are kept as
    they are; other input columns, whatever their names, are not read. An empty table gives an empty result.
    """
    tokens = frequent_pretokens(docs, text_col, table_size)
    lengths = dict(zip(tokens, map(len, library_ids(processor(model_path), tokens)))) if tokens else {}
    table = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = _Lengths(table.value, model_path)
        for part in slices(batches):
            texts = [pretokens(t) for t in part.column(1).to_pylist()]
            tiers.learn(set().union(*texts))
            n = [sum(map(tiers.__getitem__, x)) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(part.column(1)), pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), _text(text_col))
    counted = in_arrow(slim, count, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
