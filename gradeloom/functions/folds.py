"""Folds over ordered histories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(rows: DataFrame, keys: list[str], order: list[Column], values: list[str], step: Callable, finish: Callable, schema: str) -> DataFrame:
    """A row for each key: ``finish(state)`` after ``state = step(state, *values)`` for its rows in ``order``; the state is None at first.

    Rows are dealt by a hash of their keys and sorted within partitions, and a task walks along its partition with the state of one key, which goes
    on over batches. So there is no call for each key, and a history of any length takes no more memory. ``schema`` has the keys,
    then the results: int, long or double.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kinds = None, None, None
        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            kinds = [c.type for c in batch.columns[: len(keys)]]
            for at, *row in zip(zip(*columns[: len(keys)]), *columns[len(keys) :]):
                if at != key:
                    if key is not None:
                        done.append((*key, *finish(state)))
                    key, state = at, None
                state = step(state, *row)
            if done:
                yield table(done, kinds)
        if key is not None:
            yield table([(*key, *finish(state))], kinds)

    of = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    names, types = zip(*(f.split() for f in schema.split(", ")))

    def table(done: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k] if k < len(kinds) else of[types[k]]) for k, c in enumerate(zip(*done))], list(names))

    dealt = rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *values).mapInArrow(walk, schema)
