"""Helpers shared by the operators: reading tables, word patterns, tables staged in the shared folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.session import run_folder

# The six characters that separate words, as a Java and Python class and as plain text.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = run_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is not in ``listed``.

    The list grows with the rows, so it is not broadcast at any size: both sides go to the key's partition once, and the
    plan that small tables show is the one that large ones get.
    """
    return rows.join(listed.hint("merge"), key, "left_anti")


def lower_ascii(col: Column) -> Column:
    """``A`` to ``Z`` in lower case, all other characters as they are."""
    return F.translate(col, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of ``text`` as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, f"{BLANK_CLASS}+")).otherwise(F.array().cast("array<string>"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` in batches of whole texts: fewer rows at once than Spark's default, unless the session has chosen."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == "10000":
        conf.set(BATCH_SETTING, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, size: int) -> list:
    """About ``size`` rows (at most twice that expected), spread over all of ``df``, on the driver.

    Rows are chosen one by one, so that a text with very many copies is not taken with all of them.  Each task sends what
    it chose and no more, however many tasks there are.
    """
    step = max(1, df.count() // size)
    mark = unused(df, "_mark")
    marked = df.withColumn(mark, F.xxhash64(F.monotonically_increasing_id()))
    return marked.where(F.pmod(mark, F.lit(step)) == 0).select(*df.columns).collect()
