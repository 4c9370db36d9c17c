"""Route snapshots: building, checking and recovering intent from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlens.functions.exprs import node_of_status, status_of_node
from shardlens.functions.ranking import id_bucket, numbered, part_grid
from shardlens.schema import HUB_KEY, LEARNER, NODE_KEY, PART_KEY, REPLICA_KEY, SCOPE, TABLE_KEY


def route_servers(nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """Servers of a scope's routes: nodes in id order, indexed from 0 over those whose hub exists.

    A node without hub takes no index.  ``hub_id`` is the hub's position in the name-ordered hub list.
    """
    named = hubs.select(*HUB_KEY)
    ids = numbered(named.withColumn("_h", id_bucket(named, "hub_name")), SCOPE, ["_h"], ["hub_name"], out="hub_no")
    placed = nodes.join(ids.select(*HUB_KEY, (F.col("hub_no") - 1).alias("hub_id")), HUB_KEY)
    indexed = numbered(placed.withColumn("_b", id_bucket(placed)), SCOPE, ["_b"], ["node_id"], out="server_index")
    return indexed.select(
        *NODE_KEY, (F.col("server_index") - 1).alias("server_index"), "host", F.col("biz_port").alias("port"), "hub_id",
        "is_alive", "op", status_of_node().alias("status"),
    )


def route_replicas(members: DataFrame, servers: DataFrame, facts: DataFrame) -> DataFrame:
    """Replica rows of the routes: server index, role, reported statistics.  Peers without a server are left out."""
    stats = facts.select(*REPLICA_KEY, "statistics")
    return (
        members.select(*REPLICA_KEY, "role", F.col("membership_version").alias("version"))
        .join(servers.select(*NODE_KEY, "server_index"), NODE_KEY)
        .join(stats, REPLICA_KEY, "left")
        .select(*PART_KEY, "server_index", "role", "version", "statistics")
    )


def build_routes(tables: DataFrame, members: DataFrame, replicas: DataFrame) -> DataFrame:
    """One row per partition, empty ones included, with its replicas in server order.

    Routes stay one row per partition rather than one per table: a table may have a million of them.
    """
    versions = members.groupBy(*PART_KEY).agg(
        F.max("membership_version").alias("version"), F.max("split_version").alias("split_version"))
    lists = replicas.groupBy(*PART_KEY).agg(
        F.sort_array(F.collect_list(F.struct("server_index", "role"))).alias("replicas"))
    grid = part_grid(tables.select(*TABLE_KEY, "parts_count"), "partition_id").drop("parts_count")
    none = F.array().cast("array<struct<server_index:bigint,role:int>>")
    return (
        grid.join(versions, PART_KEY, "left").join(lists, PART_KEY, "left")
        .select(
            *PART_KEY, F.coalesce("version", F.lit(0)).cast("long").alias("version"),
            F.coalesce("split_version", F.lit(0)).cast("long").alias("split_version"),
            F.coalesce(F.col("replicas").cast("array<struct<server_index:bigint,role:int>>"), none).alias("replicas"),
        )
    )


def recover_membership(routes: DataFrame, servers: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members a keeper would take over from routes newer than its own view.

    ``routes``: one row per replica (PART_KEY, version, server_index, role); ``servers``: (scope, server_index, host,
    port).  A replica on an unknown or ambiguous address is dropped, a serving one on a dead node becomes a
    learner, and each of both raises the partition's version by one.
    """
    kept = members.groupBy(*PART_KEY).agg(F.max("membership_version").alias("kept_version"))
    unique = nodes.groupBy(*SCOPE, "host", "port").agg(
        F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"), F.max("is_alive").alias("is_alive")
    ).filter("n = 1").drop("n")
    found = (
        routes.join(kept, PART_KEY, "left")
        .filter("kept_version is null or kept_version < version")
        .join(servers.select(*SCOPE, "server_index", "host", "port"), [*SCOPE, "server_index"])
        .join(unique, [*SCOPE, "host", "port"], "left")
    )
    dropped = F.col("node_id").isNull()
    demoted = ~dropped & ~F.coalesce("is_alive", F.lit(False)) & (F.col("role") != LEARNER)
    judged = found.withColumn("dropped", dropped).withColumn("demoted", F.coalesce(demoted, F.lit(False)))
    bumps = judged.groupBy(*PART_KEY).agg(
        F.sum(F.when(F.col("dropped") | F.col("demoted"), 1).otherwise(0)).cast("long").alias("bumps"))
    return judged.filter("not dropped").join(bumps, PART_KEY).select(
        *PART_KEY, "node_id", F.when(F.col("demoted"), LEARNER).otherwise(F.col("role")).alias("role"),
        (F.col("version") + F.col("bumps")).alias("membership_version"),
    )


def verify_routes(routes: DataFrame, members: DataFrame) -> DataFrame:
    """Partitions whose route is newer than the keeper's own membership.  ``routes``: PART_KEY + version."""
    kept = members.groupBy(*PART_KEY).agg(F.max("membership_version").alias("kept_version"))
    published = routes.groupBy(*PART_KEY).agg(F.max("version").alias("route_version"))
    return published.join(kept, PART_KEY, "left").select(
        *PART_KEY, "route_version", F.coalesce("kept_version", F.lit(0)).cast("long").alias("kept_version")
    ).filter("route_version > kept_version")


def servers_from_status(servers: DataFrame) -> DataFrame:
    """Servers of the older route format: (op, is_alive) read back from the status name."""
    state = node_of_status("status")
    return servers.withColumn("op", state["op"]).withColumn("is_alive", state["is_alive"])
