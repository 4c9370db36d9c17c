"""Fleet-shaped views over the star-schema test tables, and the same views as SQL text.

``FleetViews`` derives every operator input from the parquet tables with DataFrames; ``SQL_VIEWS`` states the same
views for the checking engine.  One service and one snapshot; the operators themselves work for many.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.functions.exprs import int_div
from shardlens.functions.scoring import node_score
from shardlens.operators.placement import estimate_replicas, node_profile
from shardlens.schema import GIB, SCOPE
from shardlens.session import tune, widen

SERVICE, SNAPSHOT = "fleet", 1704067200


def scoped(df: DataFrame) -> DataFrame:
    """Add the scope columns.  The first column of ``df`` must be a key (never null).

    The service name is made from a row value, so that the optimizer cannot fold the scope keys away: joins keep
    the hash-join shape they have on recorded tables of many services.
    """
    nothing = F.substring(F.col(df.columns[0]).cast("string"), 1, 0)
    return df.withColumn("service", F.concat(F.lit(SERVICE), nothing)).withColumn("snapshot_ts", F.lit(SNAPSHOT).cast("long"))


# Table schemas by path: one footer read per table and process, not one per use.
_SCHEMAS: dict[str, T.StructType] = {}


class FleetViews:
    """Lazily built inputs for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir.rstrip("/")
        widen(self.spark, self.sf_dir)

    scoped = staticmethod(scoped)

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @cached_property
    def hubs(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        no_primary = F.col("n_nationkey") % 5 == 0
        return scoped(
            joined.select(
                F.col("n_name").alias("hub_name"),
                F.col("r_name").alias("az"),
                F.col("n_nationkey").cast("long").alias("hub_no"),
                no_primary.alias("no_primary"),
                F.when(no_primary, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("disallowed_roles"),
            )
        )

    @cached_property
    def nodes(self) -> DataFrame:
        s, key = self.table("supplier"), F.col("s_suppkey")
        hubs = self.hubs.drop(*SCOPE, "disallowed_roles")
        disk = F.floor(F.abs("s_acctbal")).cast("long") * F.lit(GIB).cast("long")
        resource = F.create_map(
            F.lit("DISK_CAP"), disk, F.lit("CPU"), key % 7 * 95, F.lit("KSAT_CPU"), key % 9 * 33
        )
        df = s.join(hubs, s.s_nationkey == hubs.hub_no).select(
            key.alias("node_id"),
            F.concat(F.lit("host"), (key - key % 2).cast("string")).alias("host"),
            (F.lit(9000) + key % 2).cast("int").alias("port"),
            (F.lit(8000) + key % 2).cast("int").alias("biz_port"),
            (key * 3 + 1).alias("process_id"),
            "hub_name",
            "az",
            "no_primary",
            (F.col("s_acctbal") >= 0).alias("is_alive"),
            F.when(key % 10 == 3, 2).when(key % 10 == 7, 1).otherwise(0).alias("op"),
            ((key % 5 + 1).cast("double") / 2).cast("float").alias("weight"),
            disk.alias("disk_cap"),
            resource.alias("resource"),
        )
        # The fleet dimension is read by many branches of one plan; keep it rather than joining it up each time.
        return scoped(df.withColumn("score", node_score("resource", "disk_cap"))).persist()

    @cached_property
    def tables(self) -> DataFrame:
        key = F.col("p_partkey")
        return scoped(
            self.table("part").select(
                key.alias("table_id"),
                F.col("p_name").alias("table_label"),
                F.col("p_size").cast("long").alias("parts_count"),
                (key % 2).alias("split_version"),
                F.when(key % 10 == 9, key - 9).alias("base_table"),
                F.when(key % 4 == 1, F.concat(F.lit('{"msg_queue_shards": '), (key % 6 + 1).cast("string"), F.lit("}")))
                .when(key % 4 == 2, F.lit("not json"))
                .otherwise(F.lit("{}"))
                .alias("json_args"),
            )
        )

    @cached_property
    def members(self) -> DataFrame:
        li, tables = self.table("lineitem"), self.tables.select("table_id", "parts_count")
        flag = F.col("l_returnflag")
        raw = (
            li.join(tables, F.col("l_partkey") == F.col("table_id"))
            .groupBy("table_id", (F.col("l_orderkey") % F.col("parts_count")).alias("partition_id"),
                     F.col("l_suppkey").alias("node_id"))
            .agg(
                F.min(F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)).alias("want_role"),
                F.min("l_linenumber").cast("long").alias("ln"),
                F.min("l_quantity").cast("long").alias("qty"),
            )
        )
        order = Window.partitionBy("table_id", "partition_id").orderBy("want_role", "node_id")
        demoted = (F.col("want_role") == 0) & (F.row_number().over(order) > 1)
        return scoped(
            raw.select(
                "table_id",
                "partition_id",
                "node_id",
                F.when(demoted, 1).otherwise(F.col("want_role")).alias("role"),
                F.lit(7).cast("long").alias("membership_version"),
                "ln",
                "qty",
                # A parent that has not split yet is one version behind its table; restores lag on some replicas.
                F.when(F.col("partition_id") % 3 == 0, 0).otherwise(F.col("table_id") % 2).cast("long")
                .alias("split_version"),
                (F.col("qty") % 3).alias("restore_version"),
            )
        )

    @cached_property
    def profile(self) -> DataFrame:
        return node_profile(self.nodes).persist()

    @cached_property
    def estimates(self) -> DataFrame:
        return estimate_replicas(self.nodes, self.tables, self.profile)

    @cached_property
    def facts(self) -> DataFrame:
        qty = F.col("qty")
        stats = F.create_map(
            F.lit("seq"), (qty * 100).cast("string"),
            F.lit("db_storage_limit_bytes"), F.when(qty % 5 == 0, "n/a").otherwise((qty * 1000 + 1).cast("string")),
        )
        return self.members.filter("ln < 7").select(
            *SCOPE, "table_id", "partition_id", "node_id",
            F.when(qty % 11 == 0, 2).otherwise(F.col("role")).alias("role"),
            F.when(qty % 3 == 0, 6).otherwise(7).cast("long").alias("membership_version"),
            (qty * 100).alias("seq"),
            (F.col("ln") <= 5).alias("ready_to_promote"),
            (qty % 4).alias("restore_version"),
            (qty % 2).alias("split_cleanup_version"),
            stats.alias("statistics"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        """Reported items, some of them off the mark: unknown nodes and tables, wrong partitions, bad status."""
        qty, ln, far = F.col("qty"), F.col("ln"), 1000000
        return self.members.select(
            *SCOPE,
            (F.col("table_id") + F.when(qty % 13 == 0, far).otherwise(0)).alias("table_id"),
            (F.col("partition_id") + F.when(qty % 23 == 0, 1000).otherwise(0)).alias("partition_id"),
            (F.col("node_id") + F.when(qty % 17 == 0, far).otherwise(0)).alias("node_id"),
            F.when((ln == 4) & (qty % 5 == 0), 1).otherwise(0).alias("code"),
            (~((ln == 5) & (qty % 7 == 0))).alias("has_own_peer"),
            F.when(qty % 19 == 0, 8).otherwise(7).cast("long").alias("membership_version"),
            (qty % 4).alias("restore_version"),
        )

    @cached_property
    def recycle(self) -> DataFrame:
        """Ids of dropped tables: the even ones of those nobody knows."""
        return self.tables.filter("table_id % 2 = 0").select("service", (F.col("table_id") + 1000000).alias("table_id"))

    @cached_property
    def dead(self) -> DataFrame:
        return self.nodes.filter("not is_alive").select(*SCOPE, "node_id")

    @cached_property
    def later_members(self) -> DataFrame:
        """The same partitions one plan later."""
        qty = F.col("qty")
        return self.members.filter(qty % 29 != 0).withColumn(
            "role", F.when(qty % 31 == 0, (F.col("role") + 1) % 3).otherwise(F.col("role"))
        ).withColumn("membership_version", F.when(qty % 37 == 0, 8).otherwise(7).cast("long"))

    # Hubs and nodes with real zone names, by hub number.
    GEO = ("ZW", "YZ", "GZ1", "TXSGP1", "HB2AZ1", "TXVA2")

    def geo(self, df: DataFrame) -> DataFrame:
        names = F.element_at(F.array(*[F.lit(z) for z in self.GEO]), (F.col("hub_no") % 6 + 1).cast("int"))
        return df.withColumn("az", names)

    @cached_property
    def geo_hubs(self) -> DataFrame:
        return self.geo(self.hubs)

    @cached_property
    def geo_nodes(self) -> DataFrame:
        return self.geo(self.nodes.join(self.hubs.select("hub_name", "hub_no"), "hub_name"))

    @cached_property
    def runs(self) -> DataFrame:
        """Orders as task runs: status 0 finished, 1 cancelled, null while running (finish 0)."""
        start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
        return scoped(
            self.table("orders").select(
                F.col("o_custkey").alias("task_id"),
                F.col("o_orderkey").alias("session_id"),
                start.alias("start_sec"),
                F.when(status.isNotNull(), start + F.col("o_orderkey") % 7200 + 1).otherwise(F.lit(0)).cast("long")
                .alias("finish_sec"),
                status.alias("finish_status"),
            )
        )

    @cached_property
    def tasks(self) -> DataFrame:
        key = F.col("c_custkey")
        return scoped(
            self.table("customer").select(
                key.alias("task_id"),
                F.lit(820454400).cast("long").alias("first_trigger_sec"),
                ((key % 30 + 1) * 86400).alias("period_sec"),
                (key % 11 == 0).alias("paused"),
                (key % 13 == 0).alias("frozen"),
                F.when(key % 5 == 4, -1).otherwise(key % 5).cast("long").alias("keep_nums"),
            )
        )

    @cached_property
    def rounds(self) -> DataFrame:
        """Events as discovery rounds of six hours: 'error' means the node was not listed, 'signup' a new process."""
        ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
        six_hours = F.lit(21600).cast("long")
        return (
            scoped(self.table("events"))
            .select(
                *SCOPE[:1], F.col("user_id").alias("node_id"), int_div(ts, six_hours).alias("round_no"),
                F.col("event_type"), F.col("event_id"),
            )
            .groupBy("service", "node_id", "round_no")
            .agg(
                F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("boot"),
                F.min(F.when(F.col("event_type") == "error", 0).otherwise(1)).alias("listed"),
                F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("port_no"),
            )
            .filter("listed = 1")
            .select(
                "service", "round_no", "node_id",
                F.coalesce("boot", F.lit(0)).cast("long").alias("process_id"),
                F.concat(F.lit("host"), F.col("node_id").cast("string")).alias("host"),
                F.lit(9000).cast("int").alias("port"),
                (F.lit(8000) + F.col("port_no")).cast("int").alias("biz_port"),
                F.lit("ZW").alias("az"),
            )
        )


# The same views as text.  They run unchanged in Spark and in the checking engine, except where noted.
SQL_VIEWS: dict[str, str] = {
    "f_hubs": """
SELECT n_name AS hub_name, r_name AS az, n_nationkey AS hub_no, (n_nationkey % 5 = 0) AS no_primary
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "f_nodes": """
SELECT s_suppkey AS node_id, concat('host', CAST(s_suppkey - s_suppkey % 2 AS VARCHAR(20))) AS host,
       CAST(9000 + s_suppkey % 2 AS INT) AS port, hub_name, az, no_primary, (s_acctbal >= 0) AS is_alive,
       CASE s_suppkey % 10 WHEN 3 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS op,
       CAST((s_suppkey % 5) + 1 AS DOUBLE) / 2 AS weight,
       CAST(floor(abs(s_acctbal)) AS BIGINT) * 1073741824 AS disk_cap
FROM supplier JOIN f_hubs ON s_nationkey = hub_no""",
    "f_tables": """
SELECT p_partkey AS table_id, p_name AS table_label, p_size AS parts_count, CAST(p_partkey % 2 AS INT) AS split_version,
       CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 9 END AS base_table
FROM part""",
    "f_raw": """
SELECT l_partkey AS table_id, l_orderkey % parts_count AS partition_id, l_suppkey AS node_id,
       min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS want_role,
       min(l_linenumber) AS ln, CAST(min(l_quantity) AS BIGINT) AS qty
FROM lineitem JOIN f_tables ON l_partkey = table_id
GROUP BY l_partkey, l_orderkey % parts_count, l_suppkey""",
    "f_members": """
SELECT table_id, partition_id, node_id,
       CASE WHEN want_role = 0 AND row_number() OVER (PARTITION BY table_id, partition_id ORDER BY want_role, node_id) > 1
            THEN 1 ELSE want_role END AS role,
       7 AS membership_version, ln, qty,
       CASE WHEN partition_id % 3 = 0 THEN 0 ELSE table_id % 2 END AS split_version, qty % 3 AS restore_version
FROM f_raw""",
    "f_facts": """
SELECT table_id, partition_id, node_id, CASE WHEN qty % 11 = 0 THEN 2 ELSE role END AS role,
       CASE WHEN qty % 3 = 0 THEN 6 ELSE 7 END AS membership_version, qty * 100 AS seq, (ln <= 5) AS ready_to_promote,
       qty % 4 AS restore_version, qty % 2 AS split_cleanup_version, qty
FROM f_members WHERE ln < 7""",
    # Scores of the disk_cap estimator and weighted scores in single precision.
    "f_scored": """
SELECT *, CASE WHEN score = 0 THEN 0 ELSE greatest(1, CAST(floor(CAST(score AS FLOAT) * CAST(weight AS FLOAT)
            + CAST(0.5 AS FLOAT)) AS BIGINT)) END AS wscore
FROM (SELECT *, CASE WHEN disk_cap = 0 THEN 0
        ELSE least(10000, greatest(1, (disk_cap + 5368709120) // 10737418240)) END AS score FROM f_nodes)""",
    "f_profile": """
SELECT node_id, hub_name, wscore, sum(wscore) OVER (PARTITION BY hub_name) AS total,
       count(*) OVER (PARTITION BY hub_name) AS n, row_number() OVER (PARTITION BY hub_name ORDER BY node_id) AS rn
FROM f_scored WHERE op <> 2""",
    "f_est": """
SELECT table_id, node_id, hub_name, CAST(floor_est + CASE WHEN (rn - 1 + seed) % n
         < parts_count - sum(floor_est) OVER (PARTITION BY table_id, hub_name) THEN 1 ELSE 0 END AS BIGINT) AS est
FROM (SELECT table_id, coalesce(base_table, table_id) AS seed, parts_count, node_id, hub_name, rn, n,
             CAST(wscore * parts_count AS BIGINT) // CAST(total AS BIGINT) AS floor_est
      FROM f_tables CROSS JOIN f_profile)""",
    "f_load": """
SELECT table_id, node_id, count(*) AS load, count(*) FILTER (WHERE role = 0) AS primaries,
       count(*) FILTER (WHERE role = 1) AS secondaries, count(*) FILTER (WHERE role = 2) AS learners
FROM f_members GROUP BY table_id, node_id""",
    "f_reports": """
SELECT table_id + CASE WHEN qty % 13 = 0 THEN 1000000 ELSE 0 END AS table_id,
       partition_id + CASE WHEN qty % 23 = 0 THEN 1000 ELSE 0 END AS partition_id,
       node_id + CASE WHEN qty % 17 = 0 THEN 1000000 ELSE 0 END AS node_id,
       CASE WHEN ln = 4 AND qty % 5 = 0 THEN 1 ELSE 0 END AS code, NOT (ln = 5 AND qty % 7 = 0) AS has_own_peer,
       CASE WHEN qty % 19 = 0 THEN 8 ELSE 7 END AS membership_version, qty % 4 AS restore_version
FROM f_members""",
    "f_later": """
SELECT table_id, partition_id, node_id, CASE WHEN qty % 31 = 0 THEN (role + 1) % 3 ELSE role END AS role,
       CASE WHEN qty % 37 = 0 THEN 8 ELSE 7 END AS membership_version, qty
FROM f_members WHERE qty % 29 <> 0""",
    "f_geo": """
SELECT hub_name, hub_no, CASE hub_no % 6 WHEN 0 THEN 'ZW' WHEN 1 THEN 'YZ' WHEN 2 THEN 'GZ1' WHEN 3 THEN 'TXSGP1' WHEN 4 THEN 'HB2AZ1'
       ELSE 'TXVA2' END AS az, CASE hub_no % 6 WHEN 0 THEN 'HB1' WHEN 1 THEN 'HB1' WHEN 2 THEN 'HN1' WHEN 3 THEN 'SGP' WHEN 4 THEN 'HB2'
       ELSE 'VA' END AS region
FROM f_hubs""",
    "f_runs": """
SELECT o_custkey AS task_id, o_orderkey AS session_id, CAST(epoch(o_orderdate) AS BIGINT) AS start_sec,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS finish_status,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 7200 + 1
            ELSE 0 END AS finish_sec
FROM orders""",
    "f_tasks": """
SELECT c_custkey AS task_id, 820454400 AS first_trigger_sec, (c_custkey % 30 + 1) * 86400 AS period_sec,
       (c_custkey % 11 = 0) AS paused, (c_custkey % 13 = 0) AS frozen,
       CASE WHEN c_custkey % 5 = 4 THEN -1 ELSE c_custkey % 5 END AS keep_nums
FROM customer""",
    "f_rounds": """
SELECT node_id, round_no, coalesce(boot, 0) AS process_id, 8000 + port_no AS biz_port
FROM (SELECT user_id AS node_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) // 21600 AS round_no,
             max(CASE WHEN event_type = 'signup' THEN event_id END) AS boot,
             min(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS listed,
             max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS port_no
      FROM events GROUP BY 1, 2) WHERE listed = 1""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, directly or through other views."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in re.findall(r"\bf_[a-z]+\b", text):
            if name in SQL_VIEWS and name not in wanted:
                wanted.add(name)
                todo.append(SQL_VIEWS[name])
    if not wanted:
        return sql
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in SQL_VIEWS if name in wanted]
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return head + ",\n".join(parts) + ",\n" + body[len(head):]
    return "WITH " + ",\n".join(parts) + "\n" + body
