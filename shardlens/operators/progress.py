"""Progress of restores and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlens.functions.exprs import count_where, int_div
from shardlens.schema import HUB_KEY, NODE_KEY, PART_KEY, PRIMARY, REPLICA_KEY, SCOPE, SECONDARY, TABLE_KEY

TABLE_HUB = [*TABLE_KEY, "hub_name"]
# The same keys with the finest first: a sort compares by the leading one, and scopes hardly tell rows apart.
BY_TABLE, BY_REPLICA = ["table_id", *SCOPE], ["table_id", "partition_id", "node_id", *SCOPE]
# Partitions of a table that lie in one task; a longer table is laid out in several stretches.
STRETCH = 1024
# Nodes that every task may look up in memory, about 100 MB; more are shuffled.
MOST_LOOKED_UP = 1_000_000


def _looked_up(nodes: DataFrame) -> DataFrame:
    """Nodes with a broadcast hint where they are few; else every replica would be shuffled to its node."""
    few = nodes.limit(MOST_LOOKED_UP + 1).count() <= MOST_LOOKED_UP
    return F.broadcast(nodes) if few else nodes


def restore_stages(tables: DataFrame, members: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every replica with its restore stage: pending, running or finished.  ``tables`` carry ``restore_version``.

    Members and facts are stacked and shuffled once, by table and stretch of partitions (``stretch``): replicas meet their
    facts there, and callers count them by partition and hub in the same layout.
    """
    target = tables.select(*TABLE_KEY, "parts_count", F.col("restore_version").alias("table_restore"))
    mine = members.select(*REPLICA_KEY, "role", "restore_version").join(target, BY_TABLE).withColumn("reported", F.lit(False))
    seen = facts.select(*REPLICA_KEY, F.col("restore_version").alias("seen_restore")).dropna(subset=REPLICA_KEY)
    laid = (
        mine.unionByName(seen.withColumn("reported", F.lit(True)), allowMissingColumns=True)
        .withColumn("stretch", int_div("partition_id", F.lit(STRETCH).cast("long"))).repartition(*BY_TABLE, "stretch")
    )
    told = F.collect_list(F.when(F.col("reported"), F.struct("seen_restore"))).over(Window.partitionBy(*BY_REPLICA, "stretch"))
    met = laid.withColumn("told", told).filter(~F.col("reported")).withColumn("told", F.explode_outer("told"))
    have = F.coalesce("restore_version", F.lit(0))
    seen_restore = F.col("told.seen_restore")
    stage = (
        F.when(have < F.col("table_restore"), "pending").when(seen_restore.isNull() | (seen_restore < have), "running")
        .when(F.col("role") == SECONDARY, "finished").otherwise("running")
    )
    return (
        met.join(_looked_up(nodes.select(*NODE_KEY, "hub_name")), NODE_KEY, "left")
        .select(*REPLICA_KEY, "stretch", "hub_name", "role", "parts_count", stage.alias("stage"))
    )


def restore_progress(tables: DataFrame, members: DataFrame, facts: DataFrame, nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """Per (table, hub): partitions by stage and nodes at work.  ``partitions`` that are none of the three have no
    replica in the hub."""
    staged = restore_stages(tables, members, facts, nodes).join(hubs.select(*HUB_KEY), HUB_KEY, "left_semi")
    counted = staged.groupBy(*TABLE_HUB).agg(
        count_where(F.col("stage") == "pending").alias("pending"), count_where(F.col("stage") == "running").alias("running"),
        count_where(F.col("stage") == "finished").alias("finished"),
        F.count_distinct(F.when(F.col("stage") == "running", F.col("node_id"))).alias("running_nodes"),
    )
    grid = tables.select(*TABLE_KEY, "parts_count").join(hubs.select(*HUB_KEY), SCOPE)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pending", "running", "finished", "running_nodes")]
    return grid.join(counted, TABLE_HUB, "left").select(*TABLE_HUB, "parts_count", *zero)


def restore_readiness(tables: DataFrame, members: DataFrame, facts: DataFrame, nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """Per table: is the restore in its per-hub phase, and which hub is next.

    Not ready while a primary is left, a peer sits outside the hubs, or a hub does not hold exactly one replica of
    each partition.
    """
    staged = restore_stages(tables, members, facts, nodes)
    known = hubs.select(*HUB_KEY, F.lit(1).alias("known"))
    cells = staged.join(known, HUB_KEY, "left").groupBy(*TABLE_KEY, "stretch", "hub_name", "partition_id").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("role") == PRIMARY).alias("primaries"),
        F.max("known").alias("known"), count_where(F.col("stage") == "finished").alias("finished"),
        F.max("parts_count").alias("most_parts"),
    )
    finished = F.when(F.col("known").isNotNull(), F.col("finished"))
    per_stretch = cells.groupBy(*TABLE_KEY, "stretch", "hub_name").agg(
        F.sum("primaries").alias("primaries"), count_where(F.col("known").isNull()).alias("outside"),
        count_where(F.col("known").isNotNull() & (F.col("n") == 1)).alias("single"), F.sum(finished).alias("finished"),
        F.max("most_parts").alias("most_parts"),
    )
    sums = [F.sum(c).alias(c) for c in ("primaries", "outside", "single")]
    per_hub = per_stretch.repartition(*BY_TABLE).groupBy(*TABLE_HUB).agg(
        *sums, (F.sum("finished") >= F.max("most_parts")).alias("whole"))
    per_table = per_hub.groupBy(*TABLE_KEY).agg(*sums, F.collect_list(F.when(F.col("whole"), F.col("hub_name"))).alias("whole_hubs"))
    scopes = hubs.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("hub_count"), F.collect_set("hub_name").alias("hub_names"))
    # The first hub, in name order, that has not finished all partitions; hubs nobody sits in have finished none.
    most_parts = F.max("parts_count").over(Window.partitionBy(*BY_TABLE))
    shape = tables.select(*TABLE_KEY, "parts_count", most_parts.alias("most_parts")).dropna(subset=["table_id"])
    left = F.array_except("hub_names", F.coalesce("whole_hubs", F.array().cast("array<string>")))
    next_hub = F.when(F.col("most_parts") > 0, F.array_min(left))
    reason = (
        F.when(F.coalesce("primaries", F.lit(0)) > 0, "primary left").when(F.coalesce("outside", F.lit(0)) > 0, "outside hubs")
        .when(F.coalesce("single", F.lit(0)) < F.col("parts_count") * F.col("hub_count"), "hub not single").otherwise("ready")
    )
    return (
        shape.join(per_table, BY_TABLE, "left").join(scopes, SCOPE)
        .select(*TABLE_KEY, reason.alias("state"), next_hub.alias("next_hub"))
    )


def split_progress(tables: DataFrame, members: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per parent partition: 'not started', 'catching up', 'cleaning' or 'done'.

    Cleaning is unfinished while an alive peer of either half has no report or another cleanup version than its
    membership's split version, and it is not accepted when more than one peer, or all, are dead.
    """
    half = int_div("parts_count", F.lit(2).cast("long"))
    seen = facts.select(*REPLICA_KEY, F.col("split_cleanup_version").alias("cleanup"))
    alive = nodes.select(*NODE_KEY, "is_alive")
    rows = members.select(*REPLICA_KEY, "split_version").join(alive, NODE_KEY).join(seen, REPLICA_KEY, "left")
    dirty = F.col("is_alive") & (F.col("cleanup").isNull() | (F.col("cleanup") != F.col("split_version")))
    parts = rows.groupBy(*PART_KEY).agg(
        F.count(F.lit(1)).alias("peers"), count_where(~F.col("is_alive")).alias("dead"), count_where(dirty).alias("dirty"),
        F.max("split_version").alias("split_version"),
    )
    clean = (F.col("dirty") == 0) & (F.col("dead") <= 1) & (F.col("dead") < F.col("peers"))
    shape = tables.select(*TABLE_KEY, "parts_count", F.col("split_version").alias("table_split_version"))
    sided = parts.join(shape, TABLE_KEY).filter(F.col("partition_id") < half * 2).withColumn("clean", clean)
    first = F.col("partition_id") < half
    pairs = sided.groupBy(
        *TABLE_KEY, F.when(first, F.col("partition_id")).otherwise(F.col("partition_id") - half).alias("parent_id")
    ).agg(
        F.max(F.when(first, F.col("split_version"))).alias("parent_split"), F.max("table_split_version").alias("table_split"),
        F.bool_or(~first).alias("child_exists"), F.bool_and("clean").alias("clean"),
        F.sum("dead").alias("dead"), F.sum("dirty").alias("dirty"),
    )
    behind = F.coalesce("parent_split", F.lit(0)) < F.col("table_split")
    stage = (
        F.when(behind & ~F.col("child_exists"), "not started").when(behind, "catching up")
        .when(F.col("clean"), "done").otherwise("cleaning")
    )
    return pairs.select(*TABLE_KEY, "parent_id", stage.alias("stage"), "dead", "dirty")


