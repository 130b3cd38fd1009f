"""Sources and sinks: typed scans, page dumps, delimited cards, JSON artifacts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed formats: the separator between pages of a dump, and the fields of a card file in order.
PAGE_SEPARATOR = r"(?m)^=====\s*PAGE\s+(\d+)\s*=====[ \t]*$"
CARD_FIELDS = ("word", "definition", "part_of_speech", "example", "tags")
CARD_LIMITS = {"word": 200, "definition": 4_000, "part_of_speech": 100, "example": 4_000, "tags": 1_000}


def scan(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table with a given schema, projected at the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(f"{path}/{table}.parquet")
    return df.select(*columns) if columns else df


def jdbc_scan(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **properties: str) -> DataFrame:
    """A table of a database, read in ranges of a key at once."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties=properties)


def semi_scan(df: DataFrame, keys: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows whose key is in a driving table; its keys are broadcast only if they were counted and are ``most`` at most."""
    wanted = keys.select(key).distinct()
    few = wanted.limit(most + 1).count() <= most
    return df.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def split_pages(dumps: DataFrame, key: str, text: str) -> DataFrame:
    """The pages of dumps: ``key``, ``page_number``, ``text``. What stands before the first separator is no page."""
    marked = F.regexp_replace(F.col(text), PAGE_SEPARATOR, "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    pages = dumps.select(key, F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("_p"))
    return pages.select(key, F.substring_index("_p", "\u0002", 1).cast("int").alias("page_number"), F.trim(F.regexp_replace(F.substring_index("_p", "\u0002", -1), r"\A\n|\n\z", "")).alias("text"))


def page_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Pages of dump files, one file a document."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("import_id"), "value")
    return split_pages(files, "import_id", "value")


def lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The lines of pages that are not blank, trimmed, with their place."""
    out = pages.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return out.withColumn("line", F.trim("line")).filter("line <> ''")


def _checked(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    reason: Column = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.trim(F.coalesce("word", F.lit(""))) == "", "no_word").when(F.trim(F.coalesce("definition", F.lit(""))) == "", "no_definition")
    for name, most in CARD_LIMITS.items():
        reason = reason.when(F.length(name) > most, f"long_{name}")
    cards = cards.withColumn("reason", reason)
    return cards.filter("reason is null").drop("reason", "_corrupt"), cards.filter("reason is not null").drop("_corrupt")


def card_file(spark: SparkSession, path: str, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected cards of a delimited file; a tab outside quotes in its first record makes it tab-separated."""
    first = (spark.read.text(path).first() or [""])[0].lstrip("﻿")
    unquoted = "".join(first.split('"')[::2])
    schema = T.StructType([T.StructField(f, T.StringType()) for f in CARD_FIELDS] + [T.StructField("_corrupt", T.StringType())])
    cards = spark.read.csv(path, schema=schema, sep="\t" if "\t" in unquoted else ",", multiLine=True, quote='"', escape='"', header=header, enforceSchema=True, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE").cache()
    # Spark marks a record with fewer fields too; only one with more is malformed
    few = F.col("_corrupt").isNotNull() & F.col("tags").isNull()
    return _checked(cards.withColumn("_corrupt", F.when(~few, F.col("_corrupt"))).withColumn("word", F.regexp_replace("word", "^﻿", "")))


def json_artifact(spark: SparkSession, path: str, schema: T.StructType, rows: str) -> DataFrame:
    """The rows of an array field of JSON documents."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(rows).alias("_r")).select("_r.*")


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)
