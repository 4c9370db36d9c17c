"""Registered queries over sources, liveness and the streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardlens.functions.exprs import int_div
from shardlens.operators import liveness as L
from shardlens.plans.registry import query
from shardlens.schema import PART_KEY, SCOPE
from shardlens.session import run_folder
from shardlens.sources import kv, reports
from shardlens.sources.pings import read_pings

PEER_FIELDS = ("node_id", "host", "port", "role", "ready_to_promote", "restore_version", "split_cleanup_version", "statistics")


def raw_reports(v):
    """Nested reports: one per (node, table), each item listing its own peer and, for ln 2, only a stranger."""
    f = v.members.join(v.nodes.select("node_id", "host", "port"), "node_id")
    qty, ln = F.col("qty"), F.col("ln")
    stats = F.create_map(F.lit("seq"), (qty * 100).cast("string"))
    peer = lambda host: F.struct(
        F.col("node_id").cast("string").alias("node_id"), host.alias("host"), F.col("port").alias("port"), F.col("role").cast("int").alias("role"),
        (ln <= 5).alias("ready_to_promote"), (qty % 4).alias("restore_version"), (qty % 2).cast("int").alias("split_cleanup_version"), stats.alias("statistics"))
    stranger = peer(F.lit("elsewhere"))
    peers = F.when(ln == 2, F.array(stranger)).otherwise(F.array(stranger, peer(F.col("host"))))
    info = F.struct(
        F.col("table_id"), F.col("partition_id"), F.col("membership_version"), F.col("split_version").cast("int").alias("split_version"), peers.alias("peers"))
    result = F.struct(F.when(ln == 3, 5).otherwise(0).alias("code"), F.lit("").alias("message"))
    packed = f.select(*SCOPE, F.col("node_id").cast("string").alias("node_id"), "host", "port", "table_id", F.struct(result.alias("r"), info.alias("i")).alias("x"))
    made = packed.groupBy(*SCOPE, "node_id", "host", "port", "table_id").agg(F.collect_list("x").alias("xs"))
    return made.select(
        *SCOPE, "node_id", "host", "port", F.create_map(F.lit("cpu_percent"), F.lit("100")).alias("statistics"),
        F.transform("xs", lambda x: x["r"]).alias("results"), F.transform("xs", lambda x: x["i"]).alias("infos"))


@query("flatten_reports", """
SELECT table_id, partition_id, CAST(m.node_id AS VARCHAR) AS node_id, m.role, membership_version, m.ln <= 5 AS ready_to_promote,
  qty % 4 AS restore_version, qty % 2 AS split_cleanup_version, CAST(qty * 100 AS VARCHAR) AS seq_text
FROM f_members m JOIN f_nodes n ON n.node_id = m.node_id WHERE ln NOT IN (2, 3)""", ints="role membership_version")
def _(v):
    items, _ = reports.flatten_reports(raw_reports(v))
    facts = reports.accepted_facts(items)
    return facts.withColumn("seq_text", F.element_at("statistics", F.lit("seq"))).drop("statistics", "split_version")


@query("read_memberships", """
SELECT table_id, partition_id, CAST(node_id AS VARCHAR) AS node_id, role, membership_version, split_version,
  CASE WHEN qty % 2 = 0 THEN restore_version ELSE 0 END AS restore_version FROM f_members WHERE table_id % 9 <> 4""",
       ints="role membership_version split_version")
def _(v):
    m = v.members.withColumn("n", F.col("node_id").cast("string"))
    pairs = lambda xs, c: F.map_from_entries(F.transform(xs, lambda x: F.struct(x["n"], x[c])))
    # One list a partition: two of them would hold every peer twice while they are gathered.
    docs = m.groupBy(*PART_KEY).agg(
        F.max("membership_version").alias("membership_version"), F.max("split_version").alias("split_version"),
        F.collect_list(F.struct("n", "role", "qty", "restore_version")).alias("xs"),
    ).select(
        *PART_KEY, "membership_version", "split_version", pairs(F.col("xs"), "role").alias("peers"),
        pairs(F.filter("xs", lambda x: x["qty"] % 2 == 0), "restore_version").alias("restore_version"))
    value = F.to_json(F.struct("membership_version", "split_version", "peers", "restore_version"))
    stored = docs.select(*PART_KEY, F.when(F.col("table_id") % 9 == 4, "{oops").otherwise(value).alias("value"))
    members, _ = reports.read_memberships(stored)
    return members


def raw_pings(v):
    """Events as discovery records, one per (round, user); some users share an id or report no process."""
    u, r, e = F.col("user_id"), F.col("round_no"), F.col("e")
    seen = v.table("events").groupBy(
        "user_id", int_div(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(21600).cast("long")).alias("round_no")
    ).agg(F.min("event_id").alias("e"))
    node = (u - F.when((r % 7 == 0) & (u % 50 == 1), 1).otherwise(0)).cast("string")
    pid = F.when((r % 11 == 0) & (u % 70 == 3), 0).otherwise(e + 1).cast("string")
    payload = F.concat(F.lit('{"node_id": "n'), node, F.lit('", "process_id": '), pid, F.lit(', "biz_port": 80}'))
    place = F.when(u % 3 == 0, "cn.hb1.zw").when(u % 3 == 1, "as.sgp").otherwise("us.east.nowhere")
    return v.scoped(seen).select(
        "service", "round_no", F.concat(F.lit("grpc:host"), u.cast("string"), F.lit(":9000")).alias("id"), F.lit(9000).alias("port"),
        place.alias("location"), F.lit("").alias("paz"), F.concat(F.lit("DC"), (u % 5).cast("string")).alias("dc"), payload.alias("payload"))


def parsed_pings(v):
    hubs = v.geo_hubs.filter("az in ('ZW', 'TXSGP1')")
    blacklist = v.table("nation").filter("n_nationkey = 4").select(
        F.lit("fleet").alias("service"), F.concat(F.lit("DC"), F.col("n_nationkey").cast("string")).alias("dc"))
    return read_pings(raw_pings(v), hubs, blacklist)


PING_SQL = """
WITH raw AS (SELECT user_id AS u, epoch_us(ts) // 1000000 // 21600 AS r, min(event_id) AS e FROM events GROUP BY 1, 2),
  x AS (SELECT *, u - CASE WHEN r % 7 = 0 AND u % 50 = 1 THEN 1 ELSE 0 END AS node, CASE WHEN r % 11 = 0 AND u % 70 = 3 THEN 0 ELSE e + 1 END AS pid
    FROM raw WHERE u % 3 <> 2 AND u % 5 <> 4),
  j AS (SELECT *, CASE WHEN pid = 0 THEN 'no process_id' WHEN count(*) FILTER (WHERE pid <> 0) OVER (PARTITION BY r, node) > 1 THEN 'duplicate node_id' END AS reason FROM x),
  v AS (SELECT raw.r, coalesce(bool_or(reason IS NOT NULL), false) AS void FROM (SELECT DISTINCT r FROM raw) raw LEFT JOIN j ON j.r = raw.r GROUP BY 1) """


@query("read_pings", PING_SQL + """
SELECT j.r AS round_no, concat('n', node) AS node_id, concat('host', u) AS host, CASE WHEN u % 3 = 0 THEN 'ZW' ELSE 'TXSGP1' END AS az, pid AS process_id
FROM j JOIN v ON v.r = j.r AND NOT void""")
def _(v):
    return parsed_pings(v).pings.select("service", "round_no", "node_id", "host", "az", "process_id")


@query("ping_rejects", PING_SQL + "SELECT r AS round_no, concat('host', u) AS host, reason FROM j WHERE reason IS NOT NULL")
def _(v):
    return parsed_pings(v).rejects.select("service", "round_no", "host", "reason")


@query("ping_rounds", PING_SQL + "SELECT r AS round_no, void FROM v")
def _(v):
    return parsed_pings(v).rounds


@query("kv_dump", """
SELECT CASE WHEN p_partkey = 0 THEN '/new' ELSE concat('/new/tables/', p_partkey) END AS path, concat('{"name":"', p_name, '"}') AS value FROM part""")
def _(v):
    key = F.col("p_partkey")
    path = F.when(key == 0, "/old/root").otherwise(F.concat(F.lit("/old/root/tables/"), key.cast("string")))
    doc = F.concat(F.lit('{"name":"'), F.col("p_name"), F.lit('"}')).cast("binary")
    folder = run_folder(v.spark, "kv")
    kv.write_kv_dump(v.table("part").select(path.alias("path"), doc.alias("value")), folder, "/old/root")
    return kv.reroot(kv.read_kv_dump(v.spark, folder), "/new").withColumn("value", F.col("value").cast("string"))


LIVENESS_SQL = """
WITH RECURSIVE seqs AS (SELECT round_no, row_number() OVER (ORDER BY round_no) AS seq FROM (SELECT DISTINCT round_no FROM f_rounds)),
  grid AS (SELECT n.node_id, s.seq, s.round_no, r.process_id AS pid, r.biz_port AS bp FROM (SELECT DISTINCT node_id FROM f_rounds) n CROSS JOIN seqs s
    LEFT JOIN f_rounds r ON r.node_id = n.node_id AND r.round_no = s.round_no),
  st AS (SELECT node_id, seq, round_no, pid IS NOT NULL AS active, pid, bp, CASE WHEN pid IS NOT NULL THEN 'new' END AS change, pid AS shown FROM grid WHERE seq = 1
    UNION ALL SELECT g.node_id, g.seq, g.round_no, g.pid IS NOT NULL AND NOT (s.active AND s.pid <> g.pid), g.pid, g.bp,
      CASE WHEN g.pid IS NULL THEN CASE WHEN s.active THEN 'vanished' END WHEN NOT s.active THEN 'new' WHEN s.pid <> g.pid THEN 'restarted'
           WHEN s.bp <> g.bp THEN 'changed' END, coalesce(g.pid, s.pid)
    FROM st s JOIN grid g ON g.node_id = s.node_id AND g.seq = s.seq + 1) """


@query("liveness_changes", LIVENESS_SQL + """
SELECT round_no, node_id, change, false AS az_moved, shown AS process_id FROM st WHERE change IS NOT NULL""")
def _(v):
    return L.liveness_changes(v.rounds, v.rounds)


@query("fleet_change_counts", LIVENESS_SQL + """
SELECT round_no, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'restarted') AS restarted,
  count(*) FILTER (WHERE change = 'vanished') AS vanished, count(*) FILTER (WHERE change = 'changed') AS changed
FROM st WHERE change IS NOT NULL GROUP BY 1""")
def _(v):
    return L.fleet_counters(L.liveness_changes(v.rounds, v.rounds))


