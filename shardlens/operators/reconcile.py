"""Reports against intent: verdicts, consistency, role targets, and what changed between snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlens.functions.exprs import count_where, int_div, is_normal, is_serving, stat_long
from shardlens.functions.rules import near, primary_may_switch, target_role
from shardlens.schema import (
    INVALID_ROLE,
    LEARNER,
    NODE_KEY,
    PART_KEY,
    PRIMARY,
    REPLICA_KEY,
    SCOPE,
    SECONDARY,
    TABLE_KEY,
)


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest row per key by the ``version`` columns, of equal ones the greatest by the others.

    First positions are limited before the shuffle, so a key with very many versions sends one row per task.  Rows go as
    they are, and columns nobody asks for are not read; the finest key leads the sort, since scopes hardly tell rows apart.
    """
    rest = [c for c in df.columns if c not in keys]
    fine = [*[k for k in keys if k not in SCOPE], *[k for k in keys if k in SCOPE]]
    order = [*version, *[c for c in _orderable(df, rest) if c not in version]]
    newest = Window.partitionBy(*fine).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").select(*keys, *rest)


def _orderable(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns that can break ties (maps cannot be ordered)."""
    return [c for c in cols if "map" not in df.schema[c].dataType.simpleString()]


def reconcile_reports(
    reports: DataFrame, nodes: DataFrame, tables: DataFrame, recycle: DataFrame, members: DataFrame
) -> DataFrame:
    """One verdict per reported item, by the first rule that applies.

    ``reports``: REPLICA_KEY + (code, has_own_peer, membership_version, restore_version); ``recycle``: (service,
    table_id) of dropped tables.  Peers of a partition meet a report as one map, so members are shuffled once.
    """
    intent = members.groupBy(*PART_KEY).agg(
        F.max("membership_version").alias("kept_version"),
        F.map_from_entries(F.collect_list(F.struct("node_id", F.coalesce("restore_version", F.lit(0))))).alias("peers"),
    )
    joined = (
        reports.join(nodes.select(*NODE_KEY, F.col("is_alive").alias("_alive")), NODE_KEY, "left")
        .join(tables.select(*TABLE_KEY, F.lit(True).alias("_table")), TABLE_KEY, "left")
        .join(recycle.select("service", "table_id", F.lit(True).alias("_dropped")).distinct(), ["service", "table_id"], "left")
        .join(intent, PART_KEY, "left")
    )
    wanted = F.element_at("peers", F.col("node_id"))
    verdict = (
        F.when(F.col("_alive").isNull(), "skip: unknown node")
        .when(~F.col("_alive"), "skip: dead node")
        .when(F.col("code") != 0, "skip: bad status")
        .when(~F.col("has_own_peer"), "skip: no own peer")
        .when(F.col("_table").isNull() & F.col("_dropped").isNotNull(), "remove: dropped table")
        .when(F.col("_table").isNull(), "keep: orphan")
        .when(F.col("membership_version") > F.col("kept_version"), "breach: newer than intended")
        .when(wanted.isNull(), "remove: not a member")
        .when(wanted > F.col("restore_version"), "reject: older restore")
        .otherwise("accept")
    )
    return joined.select(*REPLICA_KEY, verdict.alias("verdict"))


def membership_consistency(members: DataFrame, nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Per alive peer: 'ok', 'add' (nothing reported) or 'reconfigure' (another version reported)."""
    alive = nodes.filter("is_alive").select(*NODE_KEY)
    seen = facts.select(*REPLICA_KEY, F.col("membership_version").alias("seen_version"))
    verdict = (
        F.when(F.col("seen_version").isNull(), "add")
        .when(F.col("seen_version") != F.col("membership_version"), "reconfigure").otherwise("ok")
    )
    return (
        members.select(*REPLICA_KEY, "role", "membership_version").join(alive, NODE_KEY, "left_semi")
        .join(seen, REPLICA_KEY, "left").select(*REPLICA_KEY, "role", verdict.alias("verdict"))
    )


def consistency_rollup(verdicts: DataFrame) -> DataFrame:
    """Per table: partitions with an alive peer, how many are fully consistent, and open work."""
    parts = verdicts.groupBy(*PART_KEY).agg(
        F.bool_and(F.col("verdict") == "ok").alias("ok"), count_where(F.col("verdict") == "add").alias("adds"),
        count_where(F.col("verdict") == "reconfigure").alias("reconfigures"),
    )
    return parts.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("partitions"), count_where(F.col("ok")).alias("consistent"),
        F.sum("adds").alias("adds"), F.sum("reconfigures").alias("reconfigures"), F.bool_and("ok").alias("table_ok"),
    )


def role_mismatch(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Replicas whose report differs from intent in version or role."""
    seen = facts.select(*REPLICA_KEY, F.col("role").alias("seen_role"), F.col("membership_version").alias("seen_version"))
    return (
        members.select(*REPLICA_KEY, "role", "membership_version").join(seen, REPLICA_KEY)
        .filter("seen_role <> role or seen_version <> membership_version")
    )


def dead_node_impact(members: DataFrame, dead: DataFrame) -> DataFrame:
    """Replicas on dead nodes: serving ones become learners, which raises their partition's version by one each;
    learners only have their report refreshed to the new version."""
    hit = members.join(dead.select(*NODE_KEY), NODE_KEY, "left_semi")
    bumps = hit.groupBy(*PART_KEY).agg(count_where(is_serving()).alias("bumps"))
    return hit.join(bumps, PART_KEY).select(
        *REPLICA_KEY, F.col("role").alias("old_role"), F.lit(LEARNER).alias("new_role"),
        F.when(is_serving(), "downgrade").otherwise("refresh").alias("action"),
        (F.col("membership_version") + F.col("bumps")).alias("new_version"),
    )


# --- role targets -------------------------------------------------------------------------------------------------


def sibling_state(facts: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Facts with what the rules need to know about the other replicas.

    Everything about siblings comes from one window over the partition, whose size is its replica count.
    ``parents`` names split children: (PART_KEY of the child, parent_id).
    """
    seq = stat_long("statistics", "seq")
    part = Window.partitionBy(*PART_KEY)
    order = part.orderBy("seq").rangeBetween(Window.currentRow + 1, Window.unboundedFollowing)
    pri = F.col("role") == PRIMARY
    rows = facts.withColumn("seq", seq)
    rows = rows.select(
        "*",
        F.count(F.when(pri, 1)).over(part).alias("_pris"),
        F.max(F.when(pri, F.col("seq"))).over(part).alias("_pri_seq"),
        F.count(F.lit(1)).over(part).alias("_all"),
        F.count(F.when(F.col("seq") == -1, 1)).over(part).alias("_unknown"),
        F.count(F.lit(1)).over(order).alias("larger"),
    )
    own_pri = F.when(pri, 1).otherwise(0)
    base = rows.withColumn("has_primary", F.col("_pris") > own_pri).withColumn(
        "unknown", F.col("_unknown") - F.when(F.col("seq") == -1, 1).otherwise(0)
    ).withColumn("not_larger", F.col("_all") - 1 - F.col("larger")).withColumn(
        "primary_seq", F.coalesce("_pri_seq", F.lit(-1)).cast("long")
    ).drop("_pris", "_pri_seq", "_all", "_unknown")
    if parents is None:
        return base.withColumn("is_child", F.lit(False))
    parent_pri = (
        facts.filter(pri).groupBy(*TABLE_KEY, F.col("partition_id").alias("parent_id"))
        .agg(F.max(stat_long("statistics", "seq")).alias("_parent_seq"))
    )
    child = parents.select(*PART_KEY, "parent_id").join(parent_pri, [*TABLE_KEY, "parent_id"], "left").select(
        *PART_KEY, F.lit(True).alias("_child"), "_parent_seq"
    )
    is_child = F.coalesce("_child", F.lit(False))
    return (
        base.join(child, PART_KEY, "left")
        .withColumn("is_child", is_child)
        .withColumn("has_primary", F.when(is_child, F.col("_parent_seq").isNotNull()).otherwise(F.col("has_primary")))
        .withColumn("primary_seq", F.when(is_child, F.coalesce("_parent_seq", F.lit(-1))).otherwise(F.col("primary_seq")).cast("long"))
        .drop("_child", "_parent_seq")
    )


def split_children(members: DataFrame, tables: DataFrame) -> DataFrame:
    """Partitions still behind their table's split version in the upper half, with their parent's id."""
    half = int_div("parts_count", F.lit(2).cast("long"))
    behind = members.groupBy(*PART_KEY).agg(F.max("split_version").alias("split_version"))
    shape = tables.select(*TABLE_KEY, "parts_count", F.col("split_version").alias("table_split_version"))
    return (
        behind.join(shape, TABLE_KEY)
        .filter((F.col("split_version") < F.col("table_split_version")) & (F.col("partition_id") >= half))
        .select(*PART_KEY, (F.col("partition_id") - half).alias("parent_id"))
    )


def passive_role_targets(
    members: DataFrame, facts: DataFrame, nodes: DataFrame, tables: DataFrame, service_type: str,
    restoring: DataFrame | None = None, rules: dict[str, Callable[[], Column]] | None = None,
) -> DataFrame:
    """Role changes that reports call for this round: at most one per partition, primaries first.

    Only replicas on normal nodes whose report agrees with intent are judged.  A target of 'invalid' asks for
    removal.  ``restoring`` lists tables (TABLE_KEY) in restore; ``rules`` are the caller's own role rules.
    """
    state = sibling_state(facts, split_children(members, tables))
    if restoring is None:
        state = state.withColumn("restoring", F.lit(False))
    else:
        marked = restoring.select(*TABLE_KEY, F.lit(True).alias("restoring")).distinct()
        state = state.join(marked, TABLE_KEY, "left")
    judged = state.withColumn("target", target_role(service_type, rules))
    intent = members.select(*REPLICA_KEY, F.col("role").alias("_role"), F.col("membership_version").alias("_version"))
    normal = nodes.filter(is_normal()).select(*NODE_KEY)
    changes = (
        judged.join(intent, REPLICA_KEY)
        .filter("role = _role and membership_version = _version and target <> role")
        .join(normal, NODE_KEY, "left_semi")
    )
    first = F.min(F.struct("role", "node_id", "target"))
    return changes.groupBy(*PART_KEY).agg(first.alias("f")).select(
        *PART_KEY, F.col("f.node_id").alias("node_id"), F.col("f.role").alias("role"), F.col("f.target").alias("target"),
        F.when(F.col("f.target") == INVALID_ROLE, "remove").otherwise("transform").alias("action"),
    )


def primary_switch_safe(facts: DataFrame, guarded: bool = True) -> DataFrame:
    """For every (primary, secondary) of a partition: may the primary move there now?"""
    pri = facts.filter(F.col("role") == PRIMARY).select(
        *PART_KEY, F.col("node_id").alias("from_node"), F.col("statistics").alias("from_stats"))
    sec = facts.filter(F.col("role") == SECONDARY).select(
        *PART_KEY, F.col("node_id").alias("to_node"), F.col("statistics").alias("to_stats"))
    return pri.join(sec, PART_KEY).select(
        *PART_KEY, "from_node", "to_node", primary_may_switch(F.col("from_stats"), F.col("to_stats"), guarded).alias("safe")
    )


def replication_lag(facts: DataFrame) -> DataFrame:
    """Sequence distance of every non-primary replica to its partition's primary, and whether it is too far."""
    rows = facts.select(*PART_KEY, "node_id", "role", stat_long("statistics", "seq").alias("seq")).filter("seq <> -1")
    pri = rows.filter(F.col("role") == PRIMARY).groupBy(*PART_KEY).agg(F.max("seq").alias("primary_seq"))
    return rows.filter(F.col("role") != PRIMARY).join(pri, PART_KEY).select(
        *PART_KEY, "node_id", "role", (F.col("primary_seq") - F.col("seq")).alias("lag"),
        (~near(F.col("seq"), F.col("primary_seq"))).alias("too_far"),
    )


# --- set operations -----------------------------------------------------------------------------------------------


def diff3(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of two sets with where they occur: 'left', 'shared' or 'right'.

    One aggregation over the union: it combines before the shuffle and needs no outer join.
    """
    both = a.select(*keys, F.lit(1).alias("_side")).unionByName(b.select(*keys, F.lit(2).alias("_side")))
    side = F.bit_or("_side")
    return both.groupBy(*keys).agg(side.alias("_s")).select(
        *keys, F.when(F.col("_s") == 1, "left").when(F.col("_s") == 2, "right").otherwise("shared").alias("side")
    )


def hub_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hubs removed from or added to a service."""
    return diff3(old, new, ["service", "hub_name"]).filter("side <> 'shared'").select(
        "service", "hub_name", F.when(F.col("side") == "left", "removed").otherwise("added").alias("change")
    )


def all_tables(parts: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of all keepers, and the keepers that did not answer.

    ``parts`` is the union of what keepers sent with a ``keeper`` column; a missing one voids the whole listing.
    """
    absent = expected.select("keeper").join(parts.select("keeper").distinct(), "keeper", "left_anti")
    gate = absent.agg(F.count(F.lit(1)).alias("_absent")).filter("_absent = 0").select(F.lit(1).alias("_ok"))
    return parts.withColumn("_ok", F.lit(1)).join(gate, "_ok", "left_semi").drop("_ok"), absent


def placement_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Replicas that differ between two snapshots of the same partitions (PART_KEY without the snapshot).

    'illegal' marks a learner that became primary: every plan has it serve as secondary in between.
    """
    keys = ["service", "table_id", "partition_id", "node_id"]
    side = lambda df, p: df.select(*keys, F.col("role").alias(f"{p}_role"), F.col("membership_version").alias(f"{p}_version"))
    both = side(before, "old").join(side(after, "new"), keys, "full_outer")
    change = (
        F.when(F.col("old_role").isNull(), "added").when(F.col("new_role").isNull(), "removed")
        .when(F.col("old_role") != F.col("new_role"), "role")
        .when(F.col("old_version") != F.col("new_version"), "version")
    )
    straight = (F.col("new_role") == PRIMARY) & (F.col("old_role") == LEARNER)
    return both.withColumn("change", change).filter("change is not null").select(
        *keys, "change", F.coalesce("old_role", F.lit(INVALID_ROLE)).alias("old_role"),
        F.coalesce("new_role", F.lit(INVALID_ROLE)).alias("new_role"), F.coalesce(straight, F.lit(False)).alias("illegal"),
    )


def partition_detail(members: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per peer: role and restore version from intent, address from the node, the rest from the report."""
    seen = facts.select(
        *REPLICA_KEY, F.col("ready_to_promote").alias("ready"), F.col("split_cleanup_version").alias("cleanup"),
        "statistics", F.lit(True).alias("reported"),
    )
    where = nodes.select(*NODE_KEY, "host", "port", "hub_name")
    return (
        members.select(*REPLICA_KEY, "role", "membership_version", "restore_version").join(where, NODE_KEY)
        .join(seen, REPLICA_KEY, "left")
        .select(
            *REPLICA_KEY, "role", "membership_version", "restore_version", "host", "port", "hub_name",
            F.coalesce("ready", F.lit(False)).alias("ready"), F.coalesce("cleanup", F.lit(0)).alias("cleanup_version"),
            "statistics", F.coalesce("reported", F.lit(False)).alias("reported"),
        )
    )


def detail_by_partition(detail: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Peers of each partition as one sorted list; with ``tasks`` (TABLE_KEY, task_name) the table's tasks too."""
    out = detail.groupBy(*PART_KEY).agg(
        F.max("membership_version").alias("membership_version"),
        F.array_sort(F.collect_list(F.struct("role", "node_id", "host", "port", "hub_name", "ready"))).alias("peers"),
    )
    if tasks is None:
        return out
    named = tasks.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_set("task_name")).alias("tasks"))
    return out.join(named, TABLE_KEY, "left")


def partition_page(
    members: DataFrame, tables: DataFrame, start: int | None = None, end: int | None = None, page_size: int | None = None
) -> DataFrame:
    """Member rows of one page of partitions: ids in [start, end], an absent bound being open.

    ``page_size`` bounds the page to that many ids from ``start`` (0) on; without it nothing is left out.  A negative
    start gives nothing.  The id condition stands alone, so it reaches the scan.
    """
    if page_size is not None:
        last = (start or 0) + page_size - 1
        end = last if end is None else min(end, last)
    page = members
    if start is not None:
        page = page.filter(F.col("partition_id") >= start) if start >= 0 else page.filter(F.lit(False))
    if end is not None:
        page = page.filter(F.col("partition_id") <= end)
    return page.join(tables.select(*TABLE_KEY, "parts_count"), TABLE_KEY).filter("partition_id < parts_count").drop("parts_count")
