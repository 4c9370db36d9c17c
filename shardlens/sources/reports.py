"""Node reports and stored memberships as relational rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlens.schema import MEMBERSHIP_JSON, REPORTS_RAW, SCOPE


def read_reports(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(items, servers) of recorded node reports; JSON is read with the fixed schema, never inferred."""
    reader = spark.read.schema(REPORTS_RAW) if fmt == "json" else spark.read
    return flatten_reports(reader.format(fmt).load(path))


def flatten_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports to one row per reported item, and one row per server.

    ``results`` and ``infos`` are parallel arrays.  Of an item's peers only the reporting node's own entry counts;
    items without one, or with a bad status, keep their row so that verdicts can be given (see ``accepted_facts``).
    """
    pairs = raw.select(
        *SCOPE, "node_id", "host", "port", F.posexplode(F.arrays_zip("results", "infos")).alias("item_no", "item"))
    own = F.get(
        F.filter(F.col("item.infos.peers"), lambda p: (p["host"] == F.col("host")) & (p["port"] == F.col("port"))), F.lit(0))
    items = pairs.withColumn("own", own).select(
        *SCOPE, "node_id", "item_no", F.col("item.infos.table_id").alias("table_id"),
        F.col("item.infos.partition_id").alias("partition_id"), F.coalesce("item.results.code", F.lit(-1)).alias("code"),
        F.col("own").isNotNull().alias("has_own_peer"), F.col("item.infos.membership_version").alias("membership_version"),
        F.col("item.infos.split_version").alias("split_version"), F.col("own.role").alias("role"),
        F.coalesce("own.ready_to_promote", F.lit(False)).alias("ready_to_promote"),
        F.coalesce("own.restore_version", F.lit(0)).alias("restore_version"),
        F.coalesce("own.split_cleanup_version", F.lit(0)).alias("split_cleanup_version"), F.col("own.statistics").alias("statistics"),
    )
    return items, raw.select(*SCOPE, "node_id", "host", "port", "statistics")


def accepted_facts(items: DataFrame) -> DataFrame:
    return items.filter((F.col("code") == 0) & F.col("has_own_peer")).drop("code", "has_own_peer", "item_no")


def read_memberships(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, rejects) of stored membership values: (scope, table_id, partition_id, value JSON) rows.

    One row per peer; a missing restore version is 0.  Values that do not parse go to ``rejects``.
    """
    parsed = stored.withColumn("m", F.from_json("value", MEMBERSHIP_JSON)).withColumn("bad", F.col("m.peers").isNull())
    # Values that do not parse have no peers and give no rows; a filter on them would parse every value twice.
    members = parsed.select(
        *SCOPE, "table_id", "partition_id", F.explode("m.peers").alias("node_id", "role"), "m.membership_version",
        "m.split_version", F.col("m.restore_version").alias("_restore"),
    )
    restore = F.coalesce(F.try_element_at("_restore", F.col("node_id")), F.lit(0)).cast("long")
    return members.withColumn("restore_version", restore).drop("_restore"), parsed.filter("bad").drop("m", "bad")
