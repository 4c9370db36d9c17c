"""Periodic tasks: runs, retention, receivers, progress, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlens.functions.exprs import (
    checkpoint_parts, checkpoint_path, count_where, int_div, is_servable, run_duration_text, sec_to_ts)
from shardlens.functions.ranking import id_bucket, numbered, part_grid
from shardlens.schema import LEARNER, NODE_KEY, PART_KEY, PRIMARY, REPLICA_KEY, SCOPE, TABLE_KEY, az_dimension

TASK_KEY = [*SCOPE, "task_id"]
FINISHED, CANCELLED = 0, 1
# Names below a checkpoint.
DONE_MARK, PART_PREFIX = "done", "part_"


# --- run history --------------------------------------------------------------------------------------------------


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    """The newest ``k`` runs of every task with readable times.  The rank limit is applied before the shuffle too."""
    newest = Window.partitionBy(*TASK_KEY).orderBy(F.col("start_sec").desc(), F.col("session_id").desc())
    ranked = runs.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= k)
    return ranked.select(
        *TASK_KEY, "session_id", "age",
        F.date_format(sec_to_ts("start_sec"), "yyyy-MM-dd HH:mm:ss").alias("started"),
        F.when(F.col("finish_sec") == 0, "-").otherwise(F.date_format(sec_to_ts("finish_sec"), "yyyy-MM-dd HH:mm:ss")).alias("finished"),
        run_duration_text("start_sec", "finish_sec").alias("duration"),
    )


def with_checkpoint(runs: DataFrame, prefix: str) -> DataFrame:
    """Runs with the checkpoint path they wrote or restored from.  ``runs`` carry ``table_id`` and ``restore_path``.

    A restored path is shared unless it lies under this table's own prefix; shared ones are never to be deleted.
    """
    restored = F.coalesce(F.col("restore_path"), F.lit("")) != ""
    parts = checkpoint_parts("restore_path")
    foreign = parts.isNull() | (parts["prefix"] != prefix) | (parts["table_id"] != F.col("table_id"))
    own = checkpoint_path(F.lit(prefix), "table_id", "session_id", "start_sec")
    return (
        runs.withColumn("path", F.when(restored, F.col("restore_path")).otherwise(own))
        .withColumn("restored", restored)
        .withColumn("shared", restored & F.coalesce(foreign, F.lit(True)))
    )


def retention(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs to drop so that each task keeps ``keep_nums`` finished ones (-1 keeps all).

    History is dropped from the oldest on, up to and including the last surplus finished run; whatever else is that
    old goes too.  The cut is found per task by position, so a task with very many runs is not sorted in one task.
    """
    finished = runs.filter(F.col("finish_status") == FINISHED).select(*TASK_KEY, "session_id", "start_sec")
    finished = finished.withColumn("_b", id_bucket(finished, "start_sec", "session_id", named_by=TASK_KEY))
    limits = tasks.filter("keep_nums >= 0").select(*TASK_KEY, "keep_nums")
    totals = finished.groupBy(*TASK_KEY).agg(F.count(F.lit(1)).alias("finished_runs"))
    surplus = totals.join(limits, TASK_KEY).filter("finished_runs > keep_nums").select(
        *TASK_KEY, (F.col("finished_runs") - F.col("keep_nums")).alias("surplus"))
    cut = (
        numbered(finished, TASK_KEY, ["_b"], ["start_sec", "session_id"])
        .join(surplus, TASK_KEY)
        .filter("rn = surplus")
        .select(*TASK_KEY, F.col("start_sec").alias("cut_sec"), F.col("session_id").alias("cut_session"))
    )
    old = (F.col("start_sec") < F.col("cut_sec")) | (
        (F.col("start_sec") == F.col("cut_sec")) & (F.col("session_id") <= F.col("cut_session")))
    return runs.join(cut, TASK_KEY).filter(old).drop("cut_sec", "cut_session")


def checkpoint_list(runs: DataFrame, prefix: str) -> DataFrame:
    """Lines ``session path`` of every table's finished runs, with the columns that order them."""
    done = with_checkpoint(runs.filter(F.col("finish_status") == FINISHED), prefix)
    return done.select(
        *TABLE_KEY, "start_sec", "session_id", F.concat_ws(" ", F.col("session_id").cast("string"), "path").alias("line"))


def task_due(tasks: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """What each task should do at ``now``: start a run, or why not; running ones longer than a period are overdue."""
    last = runs.groupBy(*TASK_KEY).agg(
        F.max(F.struct("start_sec", "session_id", "finish_sec"))["start_sec"].alias("last_start"),
        F.max(F.struct("start_sec", "session_id", "finish_sec"))["finish_sec"].alias("last_finish"),
    )
    t, never = F.lit(now).cast("long"), F.col("last_start").isNull()
    period = int_div(t - F.col("first_trigger_sec"), "period_sec")
    begin = F.col("first_trigger_sec") + period * F.col("period_sec")
    inside = (F.col("last_start") >= begin) & (F.col("last_start") < begin + F.col("period_sec"))
    running = ~never & (F.col("last_finish") == 0)
    verdict = (
        F.when(F.col("paused"), "paused")
        .when(running & (t - F.col("last_start") > F.col("period_sec")), "overdue").when(running, "running")
        .when(F.col("frozen"), "frozen").when(F.col("first_trigger_sec") > t, "not yet")
        .when(F.coalesce(inside, F.lit(False)), "done").otherwise("due")
    )
    return tasks.join(last, TASK_KEY, "left").select(*TASK_KEY, period.alias("period_id"), verdict.alias("verdict"))


def overrun_tasks(tasks: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """Runs still going after one period of their task."""
    going = runs.filter("finish_sec = 0").join(tasks.select(*TASK_KEY, "period_sec"), TASK_KEY)
    return going.filter(F.lit(now) - F.col("start_sec") > F.col("period_sec")).select(
        *TASK_KEY, "session_id", "start_sec", (F.col("start_sec") + F.col("period_sec")).alias("due_sec"))


def due_cleanups(waiting: DataFrame, in_use: DataFrame, now: int) -> DataFrame:
    """Waiting items (service, table_id, due_sec, cleaned) whose time has come and whose id nobody uses."""
    return waiting.filter((F.col("due_sec") <= now) & ~F.col("cleaned")).join(
        in_use.select("service", "table_id"), ["service", "table_id"], "left_anti")


# --- receivers ----------------------------------------------------------------------------------------------------


def _all_parts(tables: DataFrame) -> DataFrame:
    return part_grid(tables.select(*TABLE_KEY, "parts_count"), "partition_id").drop("parts_count")


def task_receivers(
    members: DataFrame, nodes: DataFrame, hubs: DataFrame, tables: DataFrame, mode: str, previous: DataFrame | None = None
) -> DataFrame:
    """Which replicas a command goes to: 'leader', 'all' or one per region ('every_region').

    Partitions (or regions of one) without a fit replica give a row with a null node.  Per region a previous receiver
    (REPLICA_KEY) stays; otherwise the choice turns with the partition id among the fit nodes, which hands every node
    about as many commands of the round.
    """
    fit = nodes.filter(is_servable()).select(*NODE_KEY, "hub_name", "az")
    held = members.select(*REPLICA_KEY, "role").join(fit, NODE_KEY)
    if mode in ("leader", "all"):
        chosen = (held.filter(F.col("role") == PRIMARY) if mode == "leader" else held).select(*PART_KEY, "node_id", "hub_name")
        return _all_parts(tables).join(chosen, PART_KEY, "left")
    if mode != "every_region":
        raise ValueError(f"unknown notify mode {mode!r}")
    regions = F.broadcast(az_dimension(members.sparkSession).select("az", "region"))
    rows = held.filter(F.col("role") != LEARNER).join(regions, "az")
    if previous is not None:
        rows = rows.join(previous.select(*REPLICA_KEY, F.lit(True).alias("kept")), REPLICA_KEY, "left")
    else:
        rows = rows.withColumn("kept", F.lit(None).cast("boolean"))
    place = F.struct("node_id", "hub_name")
    # A partition has a handful of replicas a region; which of them is taken turns with the partition id, so that
    # partitions held by the same nodes are spread over them.
    best = rows.groupBy(*PART_KEY, "region").agg(
        F.min(F.when(F.col("kept"), place)).alias("stays"), F.array_sort(F.collect_list(place)).alias("fit")
    ).withColumn("b", F.coalesce("stays", F.get("fit", F.pmod(F.col("partition_id"), F.size("fit")).cast("int")))).select(
        *PART_KEY, "region", F.col("b.node_id").alias("node_id"), F.col("b.hub_name").alias("hub_name"))
    wanted = hubs.join(regions, "az").groupBy(*SCOPE).agg(F.collect_set("region").alias("all_regions"))
    have = best.groupBy(*PART_KEY).agg(F.collect_set("region").alias("have"))
    none = F.array().cast("array<string>")
    uncovered = (
        _all_parts(tables).join(have, PART_KEY, "left").join(wanted, SCOPE)
        .select(*PART_KEY, F.explode(F.array_except("all_regions", F.coalesce("have", none))).alias("region"))
    )
    return best.unionByName(uncovered, allowMissingColumns=True)


def concurrency_slice(receivers: DataFrame, max_hubs: int = 0, max_nodes: int = 0, max_per_node: int = 0) -> DataFrame:
    """The part of a table's receivers that may run at once; 0 and below mean no limit.

    Receivers may carry ``progress`` (100: finished, they leave and free their slot) and ``running`` (they keep their
    slot before new ones are let in).  Beside that, hubs, nodes and partitions are taken in name or id order.
    """
    open_rows = receivers.filter("node_id is not null")
    if "progress" in receivers.columns:
        open_rows = open_rows.filter(F.coalesce("progress", F.lit(0)) < 100)
    busy = F.coalesce("running", F.lit(False)) if "running" in receivers.columns else F.lit(False)
    open_rows = open_rows.withColumn("_new", (~busy).cast("int"))
    nodes = open_rows.groupBy(*TABLE_KEY, "hub_name", "node_id").agg(F.min("_new").alias("_new"))
    if max_hubs > 0:
        hubs = nodes.groupBy(*TABLE_KEY, "hub_name").agg(F.min("_new").alias("_new"))
        rank = F.row_number().over(Window.partitionBy(*TABLE_KEY).orderBy("_new", "hub_name"))
        hubs = hubs.withColumn("_h", rank).filter(F.col("_h") <= max_hubs)
        nodes = nodes.join(hubs.select(*TABLE_KEY, "hub_name"), [*TABLE_KEY, "hub_name"], "left_semi")
    if max_nodes > 0:
        rank = F.row_number().over(Window.partitionBy(*TABLE_KEY).orderBy("_new", "hub_name", "node_id"))
        nodes = nodes.withColumn("_n", rank).filter(F.col("_n") <= max_nodes)
    chosen = open_rows.join(nodes.select(*TABLE_KEY, "hub_name", "node_id"), [*TABLE_KEY, "hub_name", "node_id"], "left_semi")
    if max_per_node > 0:
        rank = F.row_number().over(Window.partitionBy(*TABLE_KEY, "node_id").orderBy("_new", "partition_id"))
        chosen = chosen.withColumn("_p", rank).filter(F.col("_p") <= max_per_node).drop("_p")
    return chosen.drop("_new").select(*receivers.columns)


def task_round_progress(progress: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: finished partitions of all.  A partition is finished when it has receivers and all are at 100.

    ``progress``: (task key, session_id, partition_id, progress); ``sessions``: (task key, session_id, parts_count).
    """
    key = [*TASK_KEY, "session_id"]
    parts = progress.groupBy(*key, "partition_id").agg(F.bool_and(F.col("progress") == 100).alias("done"))
    done = parts.groupBy(*key).agg(count_where(F.col("done")).alias("finished_parts"))
    return sessions.select(*key, "parts_count").join(done, key, "left").select(
        *key, "parts_count", F.coalesce("finished_parts", F.lit(0)).cast("long").alias("finished_parts"),
        (F.coalesce("finished_parts", F.lit(0)) == F.col("parts_count")).alias("round_done"),
    )


# --- checkpoints --------------------------------------------------------------------------------------------------


def restorable_checkpoints(listing: DataFrame, tables: DataFrame, regions: DataFrame) -> DataFrame:
    """Per (table, path): may it be restored?  Needs the done file and every part directory in every region.

    ``listing``: (TABLE_KEY, path, region, type, suffix); ``regions``: (service, region) wanted.  Parts are counted,
    not collected: a table may have a million.
    """
    number = F.regexp_extract("suffix", f"^{PART_PREFIX}(0|[1-9][0-9]*)$", 1).try_cast("bigint")
    shape = tables.select(*TABLE_KEY, "parts_count")
    rows = listing.join(shape, TABLE_KEY).withColumn("part", F.when(F.col("type") == "DIRECTORY", number))
    in_range = F.col("part").isNotNull() & (F.col("part") < F.col("parts_count"))
    place = [*TABLE_KEY, "path", "region"]
    parts = rows.filter(in_range).select(*place, "part").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("parts"))
    marks = rows.groupBy(*place, "parts_count").agg(
        F.bool_or((F.col("type") == "FILE") & (F.col("suffix") == DONE_MARK)).alias("done"))
    wanted = regions.groupBy("service").agg(F.count_distinct("region").alias("regions"))
    seen = marks.join(regions.select("service", "region").distinct(), ["service", "region"], "left_semi").join(parts, place, "left")
    per_path = seen.groupBy(*TABLE_KEY, "path", "parts_count").agg(
        F.count(F.lit(1)).alias("seen_regions"), F.bool_and("done").alias("all_done"),
        F.min(F.coalesce("parts", F.lit(0))).cast("long").alias("fewest_parts"),
    )
    return per_path.join(wanted, "service").select(
        *TABLE_KEY, "path", "all_done", (F.col("parts_count") - F.col("fewest_parts")).alias("missing_parts"),
        (F.col("all_done") & (F.col("fewest_parts") == F.col("parts_count")) & (F.col("seen_regions") == F.col("regions")))
        .alias("restorable"),
    )


def missing_checkpoint_parts(listing: DataFrame, tables: DataFrame) -> DataFrame:
    """Part numbers absent from each (table, path, region) that was listed at all."""
    place = [*TABLE_KEY, "path", "region"]
    number = F.regexp_extract("suffix", f"^{PART_PREFIX}(0|[1-9][0-9]*)$", 1).try_cast("bigint")
    have = listing.filter(F.col("type") == "DIRECTORY").select(*place, number.alias("part")).filter("part is not null")
    listed = listing.select(*place).distinct().join(tables.select(*TABLE_KEY, "parts_count"), TABLE_KEY)
    want = part_grid(listed, "part").select(*place, "part")
    return want.join(have, [*place, "part"], "left_anti")
