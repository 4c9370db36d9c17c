"""Registered queries that publish route sets and checkpoint lists and read them back."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from shardlens.functions.exprs import checkpoint_parts
from shardlens.operators import routes as RT
from shardlens.operators import tasks as TK
from shardlens.plans.queries_reconcile import ROUTE_SQL, replicas_text, servers_of
from shardlens.plans.registry import query
from shardlens.schema import REPLICA_KEY, SCOPE
from shardlens.session import run_folder, widened
from shardlens.sources.sinks import list_checkpoints, read_checkpoint_list, read_routes, route_publisher, write_checkpoint_list, write_routes
from shardlens.streaming.runner import drain_batches, read_stream


@query("published_routes", ROUTE_SQL + """
SELECT t.table_id, p.partition_id, coalesce(max(m.membership_version), 0) AS version,
  coalesce(string_agg(concat(server_index, ':', role), ',' ORDER BY server_index) FILTER (WHERE server_index IS NOT NULL), '') AS replicas
FROM f_tables t CROSS JOIN LATERAL (SELECT unnest(range(t.parts_count)) AS partition_id) p
LEFT JOIN f_later m ON m.table_id = t.table_id AND m.partition_id = p.partition_id LEFT JOIN srv ON srv.node_id = m.node_id
GROUP BY 1, 2""", ints="version")
def _(v):
    """Two plans published one after the other, the second one twice; readers see the second as it was first written."""
    folder, target = run_folder(v.spark, "plans"), run_folder(v.spark, "routes")
    files = max(4, widened(v.spark))  # no file may stay empty: a micro-batch is one plan
    columns = [*REPLICA_KEY, "role", "membership_version", "split_version"]
    for plan in (v.members, v.later_members):
        plan.select(*columns).repartition(files).write.mode("append").parquet(folder)
    stream = read_stream(v.spark, folder, v.members.select(*columns).schema, files_per_batch=files)
    servers = servers_of(v)
    build = lambda members: RT.build_routes(v.tables, members, RT.route_replicas(members, servers, v.facts))
    drain_batches(stream, "publishing", route_publisher(build, [target]))
    again = write_routes(build(v.members).limit(0), [target], batch_id=1)
    if again.written or again.error:
        raise RuntimeError(f"a repeated batch was published: {again}")
    return read_routes(v.spark, target).withColumn("replicas", replicas_text()).drop("split_version")


LISTED_SQL = """
WITH newest AS (SELECT task_id AS t, max_by(session_id, start_sec * 100000000 + session_id) AS session_id FROM f_runs WHERE finish_status = 0 GROUP BY 1)"""


def listed(v):
    """The newest checkpoint of every table: put into a checkpoint list, made as folders, read back and listed."""
    finished = v.runs.filter("finish_status = 0")
    newest = finished.groupBy(*SCOPE, "task_id").agg(F.max(F.struct("start_sec", "session_id")).alias("last"))
    runs = newest.select(
        *SCOPE, "task_id", F.col("task_id").alias("table_id"), "last.start_sec", "last.session_id",
        F.lit(0).alias("finish_status"), F.lit(None).cast("string").alias("restore_path"))
    lists = run_folder(v.spark, "lists")
    write_checkpoint_list(TK.checkpoint_list(runs, run_folder(v.spark, "checkpoints")), lists)
    known = v.scoped(read_checkpoint_list(v.spark, lists))

    def make(batches):
        for batch in batches:
            for table_id, path in zip(batch["table_id"], batch["path"]):
                folder = Path(path.removeprefix("file:"))
                for k in range(2 + table_id % 3):
                    if not (table_id % 5 == 1 and k == 1 + table_id % 3):
                        (folder / f"part_{k}").mkdir(parents=True, exist_ok=True)
                if table_id % 7 != 2:
                    (folder / TK.DONE_MARK).touch()
            yield batch[["table_id"]]

    known.select("table_id", "path").mapInPandas(make, "table_id bigint").write.format("noop").mode("overwrite").save()
    return list_checkpoints(known, "HB1")


@query("checkpoint_listing", LISTED_SQL + """
, entries AS (
  SELECT t, session_id, 'DIRECTORY' AS type, concat('part_', k) AS suffix FROM newest, (VALUES (0), (1), (2), (3)) x(k)
    WHERE k < 2 + t % 3 AND NOT (t % 5 = 1 AND k = 1 + t % 3)
  UNION ALL SELECT t, session_id, 'FILE', 'done' FROM newest WHERE t % 7 <> 2)
SELECT t AS table_id, session_id, type, suffix FROM entries""")
def _(v):
    return listed(v).withColumn("session_id", checkpoint_parts("path")["session_id"]).drop("path", "region")


@query("restorable_listed", LISTED_SQL + """
SELECT t AS table_id, session_id, t % 7 <> 2 AS all_done, CASE WHEN t % 5 = 1 THEN 1 ELSE 0 END AS missing_parts, t % 7 <> 2 AND t % 5 <> 1 AS restorable
FROM newest""", ints="missing_parts")
def _(v):
    tables = v.tasks.select(*SCOPE, F.col("task_id").alias("table_id"), (F.col("task_id") % 3 + 2).alias("parts_count"))
    regions = v.tasks.select("service", F.lit("HB1").alias("region")).distinct()
    found = TK.restorable_checkpoints(listed(v), tables, regions)
    return found.withColumn("session_id", checkpoint_parts("path")["session_id"]).drop("path")
