"""Registered queries that run as streams over the given tables; each is checked against its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardlens.functions.exprs import int_div
from shardlens.operators import liveness as L
from shardlens.plans.queries_sources import LIVENESS_SQL
from shardlens.plans.registry import query
from shardlens.plans.views import FleetViews
from shardlens.schema import REPLICA_KEY
from shardlens.session import first_partitions, run_folder
from shardlens.streaming import facts as SF
from shardlens.streaming import stateful as ST
from shardlens.streaming.runner import close_input, drain, read_stream


def stored(v: FleetViews, df, label: str, files_per_batch: int | None = None, closing=None, **values):
    """Put a derived table where a file stream can pick it up.  ``closing``: (time column, its last value)."""
    folder = run_folder(v.spark, label)
    df.write.parquet(folder)
    if closing:
        close_input(df, folder, *closing, **values)
    return read_stream(v.spark, folder, df.schema, files_per_batch)


BATCHES = 4


def files_a_batch(v: FleetViews, batches: int) -> int:
    """Files of one of ``batches`` micro-batches: as many tasks write and read them as a shuffle has."""
    return -(-first_partitions(v.spark) // batches)


def out_of_order(v: FleetViews, df, label: str, sec, delay: int, closing):
    """A stream of ``BATCHES`` micro-batches and a closing record; rows come up to ``delay`` behind others in ``sec``."""
    whole = run_folder(v.spark, f"{label}-whole")
    df.write.parquet(whole)  # worked out once, for the bounds and for every micro-batch
    df = v.spark.read.schema(df.schema).parquet(whole)
    low, high = df.agg(F.min(sec), F.max(sec)).first()
    span = ((high or 0) - (low or 0)) // BATCHES + 1
    behind = F.pmod(F.hash(*df.columns), F.lit(delay))
    turn = F.least(F.lit(BATCHES - 1).cast("long"), int_div(sec - F.lit(low) + behind, F.lit(span).cast("long")))
    folder = run_folder(v.spark, label)
    for k in range(BATCHES):  # one after the other: a file stream goes by the files' times
        df.filter(turn == k).repartition(1).write.mode("append").parquet(folder)
    close_input(df, folder, *closing)
    return read_stream(v.spark, folder, df.schema, files_per_batch=1)


KIND_SQL = "CASE event_type WHEN 'view' THEN 'alive' WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'learner' WHEN 'purchase' THEN 'abnormal' ELSE 'other' END"


def kinds(events):
    t = F.col("event_type")
    kind = F.when(t == "view", "alive").when(t == "error", "dead").when(t == "signup", "learner").when(t == "purchase", "abnormal").otherwise("other")
    return events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("service"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))


COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("alive", "dead", "learner", "abnormal"))


@query("stream_fleet_counters", f"""
WITH e AS (SELECT concat('s', user_id % 3) AS service, epoch_us(ts) // 1000000 // 3600 * 3600 AS start_sec, {KIND_SQL} AS kind FROM events)
SELECT service AS svc, start_sec, {COUNTS} FROM e GROUP BY 1, 2""")
def _(v):
    # Append mode gives every window once, when the watermark has passed its end; the closing record ends the last one.
    late = 7200
    stream = out_of_order(v, kinds(v.table("events")), "kinds", F.unix_timestamp("at"), late, ("at", F.max("at") + F.expr("INTERVAL 4 HOURS")))
    out = drain(SF.windowed_counters(stream, delay=f"{late} seconds"), "counters").filter("service is not null")
    return out.withColumn("start_sec", F.unix_timestamp("window_start")).drop("window_start", "window_end").withColumnRenamed("service", "svc")


@query("fleet_counter_trend", f"""
WITH e AS (SELECT concat('s', user_id % 3) AS service, (epoch_us(ts) // 1000000 // 1800 - k) * 1800 AS start_sec, {KIND_SQL} AS kind FROM events, (VALUES (0), (1), (2), (3)) x(k))
SELECT service AS svc, start_sec, {COUNTS} FROM e GROUP BY 1, 2""", ints="start_sec")
def _(v):
    out = SF.windowed_counters(kinds(v.table("events")), "2 hours", "30 minutes")
    return out.withColumn("start_sec", F.unix_timestamp("window_start")).drop("window_start", "window_end").withColumnRenamed("service", "svc")


@query("member_counters", """
SELECT 1704067200 // 3600 * 3600 AS start_sec, (SELECT count(*) FROM f_members WHERE role = 2) AS learner,
  (SELECT count(*) FROM (SELECT 1 FROM f_members GROUP BY table_id, partition_id
    HAVING count(*) FILTER (WHERE role = 2) > 0 OR count(*) FILTER (WHERE role = 0) <> 1)) AS abnormal""", ints="start_sec")
def _(v):
    out = SF.windowed_counters(SF.member_kinds(v.members))
    return out.select(F.unix_timestamp("window_start").alias("start_sec"), "learner", "abnormal")


FIRST, SECOND = 1704067200, 1704067205


def reported(v):
    """Facts as two collections, the second of which renews some reports; some of the first come twice."""
    qty = int_div("seq", F.lit(100).cast("long"))
    report = lambda version, sec: F.struct(version.alias("membership_version"), F.lit(sec).cast("long").alias("report_sec"))
    base, newer = report(F.col("membership_version"), FIRST), report(F.lit(7).cast("long"), SECOND)
    told = F.when(qty % 4 == 0, F.array(base, base)).when(qty % 4 == 1, F.array(base, newer)).otherwise(F.array(base))
    rows = v.facts.withColumn("_told", F.explode(told)).withColumn("membership_version", F.col("_told.membership_version"))
    rows = rows.withColumn("report_sec", F.col("_told.report_sec")).drop("_told")
    return rows.withColumn("reported_at", F.timestamp_seconds("report_sec"))


@query("stream_facts", """
SELECT f.table_id, f.partition_id, f.node_id, f.role, CASE WHEN f.qty % 4 = 1 THEN 7 ELSE f.membership_version END AS membership_version,
  CASE WHEN f.qty % 4 = 1 THEN 1704067205 ELSE 1704067200 END AS report_sec, f.restore_version
FROM f_facts f JOIN f_members m ON m.table_id = f.table_id AND m.partition_id = f.partition_id AND m.node_id = f.node_id
WHERE f.restore_version >= m.restore_version""", ints="role membership_version report_sec")
def _(v):
    files = files_a_batch(v, 3)
    # The first collection comes in two micro-batches, the second in another; which file a row goes to needs no draw of rows.
    share = lambda n: F.pmod(F.hash("table_id", "partition_id"), F.lit(n))
    file = F.when(F.col("report_sec") == FIRST, share(2 * files)).otherwise(share(files) + 2 * files)
    reports = stored(v, reported(v).repartitionById(3 * files, file), "reports", files_per_batch=files)
    log = SF.collect_facts(SF.deduplicated_reports(reports), compact_every=2)
    return SF.current_facts(v.spark, log, v.members).select(*REPLICA_KEY, "role", "membership_version", "report_sec", "restore_version")


@query("stream_replication_lag", """
SELECT f.table_id, f.partition_id, f.node_id, f.role, p.s - f.seq AS lag, f.seq + 1000 <= p.s AS too_far
FROM f_facts f JOIN (SELECT table_id, partition_id, max(seq) AS s FROM f_facts WHERE role = 0 GROUP BY 1, 2) p
  ON p.table_id = f.table_id AND p.partition_id = f.partition_id WHERE f.role <> 0""", ints="role")
def _(v):
    # Dealt by node: a partition's primary and its followers come in different micro-batches.
    files = files_a_batch(v, 4)
    stream = stored(v, v.facts.repartition(4 * files, "node_id"), "facts", files_per_batch=files)
    return SF.current_lag(v.spark, SF.follow_lag(stream, compact_every=2))


@query("stream_liveness", LIVENESS_SQL + """
SELECT node_id, seq, change, shown AS process_id FROM st WHERE change IS NOT NULL""")
def _(v):
    order = L.round_sequence(v.rounds)
    pings = v.rounds.join(order, ["service", "round_no"]).select(
        "service", "node_id", "seq", "process_id", "host", F.col("port").cast("long").alias("port"), F.col("biz_port").cast("long").alias("biz_port"))
    late = 10
    stream = out_of_order(v, pings, "pings", F.col("seq"), late, ("seq", F.max("seq") + late + 1))
    return drain(ST.stream_liveness(stream, round_seconds=5, delay=f"{late * 5} seconds"), "liveness", timers=True)


ALERT_SQL = """
WITH RECURSIVE obs AS (SELECT concat('s', user_id % 3) AS service, epoch_us(ts) // 1000000 // 600 * 600 AS at_sec, count(*) FILTER (WHERE event_type = 'error') AS dead
    FROM events GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY at_sec) AS i FROM obs),
  st AS (SELECT service, i, at_sec, dead, at_sec AS since, CAST(0 AS BIGINT) AS alert FROM o WHERE i = 1
    UNION ALL SELECT o.service, o.i, o.at_sec, o.dead, CASE WHEN o.dead > 0 AND o.at_sec - since > 3600 THEN o.at_sec ELSE since END,
      CASE WHEN o.dead > 0 AND o.at_sec - since > 3600 THEN 0 WHEN o.dead > 0 AND o.at_sec - since > 300 THEN o.dead ELSE 0 END
    FROM st JOIN o ON o.service = st.service AND o.i = st.i + 1)
SELECT service AS svc, at_sec, dead, alert FROM st"""


@query("stream_dead_node_alert", ALERT_SQL)
def _(v):
    e = v.table("events")
    counts = e.groupBy(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("service"),
        (int_div(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(600).cast("long")) * 600).alias("at_sec"),
    ).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("dead"))
    late = 6 * 3600
    stream = out_of_order(v, counts, "dead", F.col("at_sec"), late, ("at_sec", F.max("at_sec") + late))
    return drain(ST.dead_node_alert(stream, delay=f"{late} seconds"), "alerts", timers=True).withColumnRenamed("service", "svc")


@query("stream_route_feed", """
WITH RECURSIVE c AS (SELECT user_id AS t, epoch_us(ts) // 1000000 AS at_sec, max(event_id) AS ver FROM events GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY at_sec) AS i FROM c), fin AS (SELECT max(at_sec) AS e FROM c),
  st AS (SELECT t, i, at_sec AS last, ver, false AS waiting, at_sec AS out_sec, 'change' AS reason FROM o WHERE i = 1
    UNION ALL
    SELECT t, CASE WHEN rings THEN i ELSE i + 1 END, CASE WHEN rings THEN bell WHEN at_sec >= last + 3600 THEN at_sec ELSE last END,
      CASE WHEN rings THEN ver ELSE greatest(ver, new_ver) END, NOT rings AND at_sec < last + 3600,
      CASE WHEN rings THEN bell WHEN at_sec >= last + 3600 THEN at_sec END, CASE WHEN rings AND NOT waiting THEN 'refresh' ELSE 'change' END
    FROM (SELECT st.*, o.at_sec, o.ver AS new_ver, last + CASE WHEN waiting THEN 3600 ELSE 14400 END AS bell,
        (o.at_sec IS NULL OR last + CASE WHEN waiting THEN 3600 ELSE 14400 END <= o.at_sec) AS rings
      FROM st LEFT JOIN o ON o.t = st.t AND o.i = st.i + 1)
    WHERE NOT rings OR bell <= (SELECT e FROM fin))
SELECT t AS table_id, out_sec AS publish_sec, ver AS version, reason FROM st WHERE out_sec IS NOT NULL""")
def _(v):
    e = v.table("events")
    changes = v.scoped(e.select(
        F.col("user_id").alias("table_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_sec"), F.col("event_id").alias("version"))
    ).drop("snapshot_ts")
    late = 12 * 3600
    stream = out_of_order(v, changes, "changes", F.col("at_sec"), late, ("at_sec", F.max("at_sec") + late))
    return drain(ST.route_feed(stream, f"{late} seconds", min_gap=3600, max_gap=4 * 3600), "feed", timers=True)


@query("stream_due_cleanups", """
WITH p AS (SELECT p_partkey AS t, 1704067200 + p_partkey % 50 * 10 + 600 + p_size * 10 AS due, p_partkey % 4 AS fails,
    p_partkey % 11 = 0 OR p_partkey % 7 = 3 AS unheard FROM part WHERE p_partkey % 13 <> 5),
  a AS (SELECT t, due, k, due + CAST(60 * (power(2, k) - 1) AS BIGINT) + CASE WHEN unheard THEN 0 ELSE 5 * k END AS at_sec
    FROM p, (VALUES (0), (1), (2), (3)) x(k) WHERE k <= fails)
SELECT t AS table_id, at_sec, k + 1 AS attempt FROM a WHERE NOT (t % 7 = 3 AND at_sec <= due + 100)""", ints="attempt")
def _(v):
    """Dropped tables whose clean-up fails up to three times; of some attempts nothing is heard, some ids are in use again."""
    key = F.col("p_partkey")
    opened = F.lit(1704067200).cast("long") + key % 50 * 10
    tries = v.table("part").select(
        key.alias("table_id"), opened.alias("opened"), (opened + 600 + F.col("p_size") * 10).alias("due"),
        ((key % 11 == 0) | (key % 7 == 3)).alias("unheard"), (key % 4).alias("fails"),
        F.explode(F.sequence(F.lit(0), (key % 4).cast("int"))).alias("k"),
    ).withColumn("at", F.col("due") + F.expr("shiftleft(60, k)") - 60 + F.when(F.col("unheard"), 0).otherwise(F.col("k") * 5))

    def event(rows, at, kind):
        return rows.select("table_id", at.cast("long").alias("at_sec"), F.lit(kind).alias("kind"), F.col("due").alias("due_sec"))

    first = tries.filter("k = 0")
    events = (
        event(first, F.col("opened"), ST.DROPPED)
        .unionByName(event(tries.filter("k < fails and not unheard"), F.col("at") + 5, ST.FAILED))
        .unionByName(event(tries.filter("k = fails"), F.col("at") + 7, ST.CLEANED))
        .unionByName(event(first.filter("table_id % 13 = 5"), F.col("due") - 20, ST.REUSED))
    )
    late = 120
    stream = out_of_order(v, v.scoped(events).drop("snapshot_ts"), "drops", F.col("at_sec"), late, ("at_sec", F.max("at_sec") + late))
    used = v.scoped(first.filter("table_id % 7 = 3").select("table_id", F.col("due").alias("from_sec"), (F.col("due") + 100).alias("to_sec")))
    out = ST.stream_due_cleanups(stream, lambda: used, delay=f"{late} seconds", retry=60)
    return v.spark.read.schema(ST.CLEANUP_OUT).option("recursiveFileLookup", "true").parquet(out)


@query("stream_overrun_tasks", """
SELECT session_id AS item_id, start_sec + period_sec AS due_sec FROM f_runs r JOIN f_tasks t ON t.task_id = r.task_id
WHERE finish_sec = 0 OR finish_sec > start_sec + period_sec""")
def _(v):
    runs = v.runs.join(v.tasks.select("task_id", "period_sec"), "task_id")
    due = F.col("start_sec") + F.col("period_sec")
    opened = runs.select("service", F.col("session_id").alias("item_id"), due.alias("due_sec"))
    ended = runs.filter("finish_sec > 0").select("service", F.col("session_id").alias("item_id"), F.col("finish_sec").alias("at_sec"))
    # An item is looked for as long as its task's longest period.
    longest = v.tasks.agg(F.max("period_sec")).first()[0] or 0
    # Both inputs close far behind every due time, so that no item stays undecided.
    far = 10 * longest + 10**8
    opened = stored(v, opened, "opened", closing=("due_sec", F.max("due_sec") + far))
    ended = stored(v, ended, "ended", closing=("at_sec", F.max("at_sec") + far), service="", item_id=-1)
    return drain(ST.overdue_items(opened, ended, f"{longest} seconds"), "overdue").filter("item_id is not null")
