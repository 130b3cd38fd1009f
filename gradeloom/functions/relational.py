"""Small relational helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, halves up; null if the whole is 0 or null."""
    return F.floor(F.try_divide(part.cast("double"), whole.cast("double")) * 1000 + 0.5) / 10


def half_up(x: Column, digits: int = 1) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, by one aggregate with map-side combination."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by a hash of their keys to all of the session's shuffle partitions.

    Adaptive execution merges other shuffles' partitions up to 64 MB of compressed rows, whatever the sorts and hash tables after them hold; a
    task with many of these needs several GB then. The joins and aggregates by the same keys that follow use these partitions as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def upsert_sum(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Add a delta's totals to a base's: ``on conflict do update set n = n + excluded.n`` as a union and a sum."""
    rest = [c for c in base.columns if c not in keys]
    return base.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest])


def replace_latest(base: DataFrame, delta: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Last write wins by ``version``."""
    return latest_by(base.unionByName(delta), keys, version)


def islands(df: DataFrame, keys: list[str], position: str, out: str = "island") -> DataFrame:
    """Mark runs of consecutive integers of ``position`` (distinct within the keys)."""
    return df.withColumn(out, F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position)))


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], cutoff: str, at: str, take: Column, out: str) -> DataFrame:
    """Add ``take`` of the first right row of the same keys with ``at >= cutoff``; null if there is none.

    Both sides are put together and sorted once by keys and time, latest first, and each left row takes the last right row before it in
    that order. So a left row is never paired with all later right rows. Equal ``at`` leave the choice open; null ``at`` or cutoffs never match.
    """
    own = left.columns
    mine = left.select(*own, F.col(cutoff).alias("_t"), F.lit(None).alias("_right"), F.lit(0).alias("_side"))
    blank = [F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own]
    other = right.filter(F.col(at).isNotNull()).select(*blank, F.col(at).alias("_t"), F.struct(take.alias("v")).alias("_right"), F.lit(1).alias("_side"))
    both = mine.unionAll(other)
    latest_first = Window.partitionBy(*keys).orderBy(F.col("_t").desc_nulls_first(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_right", ignorenulls=True).over(latest_first)["v"]).filter("_side = 0").select(*own, out)


def rule_array(*rules: tuple[Column, str, str]) -> Column:
    """The (code, severity) structs of the rules that hold."""
    return F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for cond, code, severity in rules]))


def wilson(part: Column, whole: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The bounds of the 95 % Wilson interval; null if the whole is 0."""
    n = F.when(whole > 0, whole.cast("double"))
    p = part.cast("double") / n
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)), F.when(n > 0, F.least(F.lit(1.0), centre + spread))
