"""Metadata dumps: one ``path HEX`` line per key, the root of the tree first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "dump_root"


def write_kv_dump(kv: DataFrame, path: str, root: str) -> None:
    """Write the tree below ``root`` of (path, value BINARY) rows.

    The root names the folder of the files (``dump_root=...``), so that every file carries it; range partitioning keeps
    the files in path order, parents first.
    """
    below = (F.col("path") == root) | F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/"))
    line = F.concat(F.col("path"), F.lit(" "), F.hex("value"))
    laid = kv.filter(below).repartitionByRange("path").sortWithinPartitions("path")
    laid.select(F.lit(root).alias(ROOT), line.alias("value")).write.partitionBy(ROOT).text(path)


def read_kv_dump(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(dump_root, path, value) of dumps.

    The root is the given one, or else the one that the files' folder names.  A file that comes from elsewhere has its
    root as its first line; there it is the path that all others of the file lie below.  A dump without its root
    fails by name.
    """
    lines = spark.read.text(path)
    if root is None and ROOT in lines.columns:
        kv = parse_kv_lines(lines.withColumn(ROOT, F.col(ROOT).cast("string")))
        lacking = kv.groupBy(ROOT).agg(F.bool_or(F.col("path") == F.col(ROOT)).alias("there")).filter(~F.col("there"))
        names = [row[ROOT] for row in lacking.limit(10).collect()]
        if names:
            raise ValueError(f"{path}: dump without its root {', '.join(names)}")
        return kv
    if root is not None:
        kv = parse_kv_lines(lines.select("value")).withColumn(ROOT, F.lit(root))
        if kv.filter(F.col("path") == root).limit(1).count() == 0:
            raise ValueError(f"{path}: dump without its root {root}")
        return kv
    from_file = parse_kv_lines(lines.select("value", F.col("_metadata.file_path").alias("_file")))
    roots = from_file.groupBy("_file").agg(F.min_by("path", F.length("path")).alias(ROOT))
    joined = from_file.join(roots, "_file")
    below = (F.col("path") == F.col(ROOT)) | F.startswith(F.col("path"), F.concat(F.rtrim(F.col(ROOT), F.lit("/")), F.lit("/")))
    odd = F.raise_error(F.concat(F.col("_file"), F.lit(": dump without its root: "), F.col("path")))
    return joined.select(F.when(below, F.col(ROOT)).otherwise(odd.cast("string")).alias(ROOT), "path", "value")


def parse_kv_lines(lines: DataFrame) -> DataFrame:
    """``path`` and ``value`` of dump lines; other columns stay, lines without a path are left out.

    The last blank of a line ends its path, which may hold blanks itself.
    """
    others = [c for c in lines.columns if c != "value"]
    long = F.length("value") - F.instr(F.reverse("value"), " ")
    return lines.filter(F.instr("value", " ") > 1).select(
        *others,
        F.substr("value", F.lit(1), long).alias("path"),
        F.unhex(F.substr("value", long + 2)).alias("value"),
    )


def reroot(kv: DataFrame, new_root: str) -> DataFrame:
    """Move dumps below ``new_root``: the length of each row's root is cut from its path."""
    return kv.select(F.concat(F.lit(new_root), F.substr("path", F.length(ROOT) + 1)).alias("path"), "value")
