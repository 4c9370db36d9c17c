"""Registered queries over reports, role targets, drift, capacity and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardlens.functions import exprs as E
from shardlens.functions.exprs import unpack_partition, unpack_table
from shardlens.operators import capacity as C
from shardlens.operators import reconcile as R
from shardlens.operators import routes as RT
from shardlens.plans.registry import query
from shardlens.schema import INVALID_ROLE, PART_KEY, REPLICA_KEY, SCOPE, TABLE_KEY


@query("reconcile_reports", """
SELECT r.table_id, r.partition_id, r.node_id, CASE WHEN n.node_id IS NULL THEN 'skip: unknown node' WHEN NOT n.is_alive THEN 'skip: dead node'
  WHEN code <> 0 THEN 'skip: bad status' WHEN NOT has_own_peer THEN 'skip: no own peer'
  WHEN t.table_id IS NULL AND r.table_id % 2 = 0 THEN 'remove: dropped table' WHEN t.table_id IS NULL THEN 'keep: orphan'
  WHEN r.membership_version > p.v THEN 'breach: newer than intended' WHEN m.node_id IS NULL THEN 'remove: not a member'
  WHEN m.restore_version > r.restore_version THEN 'reject: older restore' ELSE 'accept' END AS verdict
FROM f_reports r LEFT JOIN f_nodes n ON n.node_id = r.node_id LEFT JOIN f_tables t ON t.table_id = r.table_id
LEFT JOIN (SELECT table_id, partition_id, max(membership_version) AS v FROM f_members GROUP BY 1, 2) p
  ON p.table_id = r.table_id AND p.partition_id = r.partition_id
LEFT JOIN f_members m ON m.table_id = r.table_id AND m.partition_id = r.partition_id AND m.node_id = r.node_id""")
def _(v):
    return R.reconcile_reports(v.reports, v.nodes, v.tables, v.recycle, v.members)


CONSISTENCY_SQL = """
WITH c AS (SELECT m.table_id, m.partition_id, m.node_id, m.role, CASE WHEN f.node_id IS NULL THEN 'add'
    WHEN f.membership_version <> m.membership_version THEN 'reconfigure' ELSE 'ok' END AS verdict
  FROM f_members m JOIN f_nodes n ON n.node_id = m.node_id AND is_alive
  LEFT JOIN f_facts f ON f.table_id = m.table_id AND f.partition_id = m.partition_id AND f.node_id = m.node_id) """


@query("membership_consistency", CONSISTENCY_SQL + "SELECT * FROM c", ints="role")
def _(v):
    return R.membership_consistency(v.members, v.nodes, v.facts)


@query("consistency_rollup", CONSISTENCY_SQL + """
SELECT table_id, count(*) AS partitions, count(*) FILTER (WHERE ok) AS consistent, CAST(sum(a) AS BIGINT) AS adds,
  CAST(sum(r) AS BIGINT) AS reconfigures, bool_and(ok) AS table_ok
FROM (SELECT table_id, partition_id, bool_and(verdict = 'ok') AS ok, count(*) FILTER (WHERE verdict = 'add') AS a,
  count(*) FILTER (WHERE verdict = 'reconfigure') AS r FROM c GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    return R.consistency_rollup(R.membership_consistency(v.members, v.nodes, v.facts))


@query("role_mismatch", """
SELECT m.table_id, m.partition_id, m.node_id, m.role, m.membership_version, f.role AS seen_role, f.membership_version AS seen_version
FROM f_members m JOIN f_facts f ON f.table_id = m.table_id AND f.partition_id = m.partition_id AND f.node_id = m.node_id
WHERE m.role <> f.role OR m.membership_version <> f.membership_version""", ints="role membership_version seen_role seen_version")
def _(v):
    return R.role_mismatch(v.members, v.facts)


@query("dead_node_impact", """
WITH h AS (SELECT m.* FROM f_members m JOIN f_nodes n ON n.node_id = m.node_id AND NOT is_alive)
SELECT table_id, partition_id, node_id, role AS old_role, 2 AS new_role, CASE WHEN role < 2 THEN 'downgrade' ELSE 'refresh' END AS action,
  membership_version + count(*) FILTER (WHERE role < 2) OVER (PARTITION BY table_id, partition_id) AS new_version FROM h""",
       ints="old_role new_role")
def _(v):
    return R.dead_node_impact(v.members, v.dead)


STATE_SQL = """
WITH kids AS (SELECT m.table_id, partition_id, partition_id - max(parts_count) // 2 AS parent_id FROM f_members m JOIN f_tables t ON t.table_id = m.table_id
    GROUP BY 1, 2 HAVING max(m.split_version) < max(t.split_version) AND partition_id >= max(parts_count) // 2),
  pri AS (SELECT table_id, partition_id, max(seq) AS pseq FROM f_facts WHERE role = 0 GROUP BY 1, 2),
  st AS (SELECT f.*, k.partition_id IS NOT NULL AS is_child,
      CASE WHEN k.partition_id IS NOT NULL THEN pp.pseq ELSE
        (SELECT max(o.seq) FROM f_facts o WHERE o.table_id = f.table_id AND o.partition_id = f.partition_id AND o.role = 0 AND o.node_id <> f.node_id) END AS pseq
    FROM f_facts f LEFT JOIN kids k ON k.table_id = f.table_id AND k.partition_id = f.partition_id
    LEFT JOIN pri pp ON pp.table_id = k.table_id AND pp.partition_id = k.parent_id),
  cmp AS (SELECT f.table_id, f.partition_id, f.node_id, count(*) FILTER (WHERE o.seq > f.seq) AS larger, count(*) FILTER (WHERE o.seq <= f.seq) AS not_larger
    FROM f_facts f JOIN f_facts o ON o.table_id = f.table_id AND o.partition_id = f.partition_id AND o.node_id <> f.node_id GROUP BY 1, 2, 3) """
FIRST_CHANGE_SQL = """
SELECT x.table_id, x.partition_id, x.node_id, x.role, target, 'transform' AS action FROM tg x
JOIN f_members m ON m.table_id = x.table_id AND m.partition_id = x.partition_id AND m.node_id = x.node_id
  AND m.role = x.role AND m.membership_version = x.membership_version
JOIN f_nodes n ON n.node_id = x.node_id AND n.is_alive AND n.op = 0 WHERE target <> x.role
QUALIFY row_number() OVER (PARTITION BY x.table_id, x.partition_id ORDER BY x.role, x.node_id) = 1"""


@query("passive_role_targets", """
WITH tg AS (SELECT *, CASE WHEN role = 2 AND ready_to_promote THEN 1 ELSE role END AS target FROM f_facts) """ + FIRST_CHANGE_SQL,
       ints="role target")
def _(v):
    return R.passive_role_targets(v.members, v.facts, v.nodes, v.tables, "standard")


@query("passive_role_targets_log_based", STATE_SQL + """
, tg AS (SELECT st.*, CASE WHEN role = 2 THEN CASE WHEN ready_to_promote AND (CASE WHEN pseq IS NOT NULL THEN st.seq + 1000 > pseq
      ELSE NOT is_child AND (st.table_id % 10 = 0 OR coalesce(larger, 0) <= coalesce(not_larger, 0)) END) THEN 1 ELSE 2 END
    WHEN role = 1 THEN CASE WHEN pseq IS NOT NULL AND st.seq + 1000 <= pseq THEN 2 ELSE 1 END ELSE role END AS target
  FROM st LEFT JOIN cmp c ON c.table_id = st.table_id AND c.partition_id = st.partition_id AND c.node_id = st.node_id) """ + FIRST_CHANGE_SQL,
       ints="role target")
def _(v):
    restoring = v.tables.filter("table_id % 10 = 0").select(*TABLE_KEY)
    return R.passive_role_targets(v.members, v.facts, v.nodes, v.tables, "log_based", restoring)


@query("passive_role_targets_schema", """
WITH tg AS (SELECT *, CASE WHEN qty % 4 = 1 AND role < 2 THEN 2 WHEN qty % 4 = 2 AND role = 2 THEN 1
  WHEN qty % 4 IN (0, 3) AND role = 2 AND ready_to_promote THEN 1 ELSE role END AS target FROM f_facts) """ + FIRST_CHANGE_SQL,
       ints="role target")
def _(v):
    four = F.col("seq") / 100 % 4
    flag = F.when(four == 1, F.create_map(F.lit("schema_changing"), F.lit("true"))).when(
        four == 2, F.create_map(F.lit("schema_changing"), F.lit("false"))).otherwise(F.col("statistics"))
    return R.passive_role_targets(v.members, v.facts.withColumn("statistics", flag), v.nodes, v.tables, "schema_versioned")


@query("passive_role_targets_own_rule", f"""
WITH tg AS (SELECT *, CASE WHEN qty % 5 = 2 THEN {INVALID_ROLE} ELSE role END AS target FROM f_facts) """
       + FIRST_CHANGE_SQL.replace("'transform' AS action", "'remove' AS action"), ints="role target")
def _(v):
    """A service's own rule: replicas that report themselves retired are to be removed."""
    stats = F.when(F.col("seq") / 100 % 5 == 2, F.create_map(F.lit("retired"), F.lit("true"))).otherwise(F.col("statistics"))
    retired = lambda: F.when(F.element_at("statistics", F.lit("retired")) == "true", INVALID_ROLE).otherwise(F.col("role"))
    return R.passive_role_targets(v.members, v.facts.withColumn("statistics", stats), v.nodes, v.tables, "retiring", rules={"retiring": retired})


@query("primary_switch_safe", """
SELECT p.table_id, p.partition_id, p.node_id AS from_node, s.node_id AS to_node,
  p.qty % 2 = 0 AND p.qty % 9 <> 0 AND s.qty % 9 <> 0 AND p.seq <= s.seq AS safe
FROM f_facts p JOIN f_facts s ON s.table_id = p.table_id AND s.partition_id = p.partition_id WHERE p.role = 0 AND s.role = 1""")
def _(v):
    qty = F.col("seq") / 100
    stats = F.create_map(
        F.lit("stream_load_paused"), F.when(qty % 2 == 0, "true").otherwise("false"),
        F.lit("stream_load_offset"), F.when(qty % 9 == 0, "?").otherwise(F.col("seq").cast("string")))
    return R.primary_switch_safe(v.facts.withColumn("statistics", stats))


@query("replication_lag", """
SELECT f.table_id, f.partition_id, f.node_id, f.role, p.s - f.seq AS lag, f.seq + 1000 <= p.s AS too_far
FROM f_facts f JOIN (SELECT table_id, partition_id, max(seq) AS s FROM f_facts WHERE role = 0 GROUP BY 1, 2) p
  ON p.table_id = f.table_id AND p.partition_id = f.partition_id WHERE f.role <> 0""", ints="role")
def _(v):
    return R.replication_lag(v.facts)


@query("latest_facts", """
SELECT l_partkey AS table_id, l_suppkey AS node_id, max(l_orderkey) AS membership_version,
  max_by(l_linenumber, (l_orderkey, l_linenumber)) AS last_line FROM lineitem GROUP BY 1, 2""", ints="last_line")
def _(v):
    seen = v.table("lineitem").select(
        F.col("l_partkey").alias("table_id"), F.col("l_suppkey").alias("node_id"),
        F.col("l_orderkey").alias("membership_version"), F.col("l_linenumber").alias("last_line"))
    return R.latest(seen, ["table_id", "node_id"], ["membership_version"])


@query("diff3", """
SELECT coalesce(m.table_id, f.table_id) AS table_id, coalesce(m.partition_id, f.partition_id) AS partition_id,
  coalesce(m.node_id, f.node_id) AS node_id, CASE WHEN f.node_id IS NULL THEN 'left' WHEN m.node_id IS NULL THEN 'right' ELSE 'shared' END AS side
FROM (SELECT * FROM f_members WHERE qty % 7 <> 0) m FULL OUTER JOIN f_facts f
  ON f.table_id = m.table_id AND f.partition_id = m.partition_id AND f.node_id = m.node_id""")
def _(v):
    return R.diff3(v.members.filter("qty % 7 <> 0"), v.facts, REPLICA_KEY)


@query("hub_diff", """
SELECT hub_name, CASE WHEN hub_no % 3 = 0 THEN 'removed' ELSE 'added' END AS change FROM f_hubs WHERE hub_no % 3 = 0 OR hub_no % 4 = 1
EXCEPT SELECT hub_name, 'removed' FROM f_hubs WHERE hub_no % 3 = 0 AND hub_no % 4 = 1""")
def _(v):
    old = v.hubs.filter("hub_no % 4 <> 1 or hub_no % 3 = 0")
    new = v.hubs.filter("hub_no % 3 <> 0 or hub_no % 4 = 1")
    return R.hub_diff(old, new)


@query("all_tables", """
SELECT table_id, table_label, table_id % 3 AS keeper FROM f_tables""")
def _(v):
    parts = v.tables.select("table_id", "table_label", (F.col("table_id") % 3).alias("keeper"))
    expected = v.table("nation").select((F.col("n_nationkey") % 3).cast("long").alias("keeper")).distinct()
    whole, _ = R.all_tables(parts, expected)
    return whole


@query("all_tables_incomplete", """
SELECT DISTINCT n_nationkey % 4 AS keeper FROM nation WHERE n_nationkey % 4 NOT IN (SELECT table_id % 3 FROM f_tables)""", ints="keeper")
def _(v):
    parts = v.tables.select("table_id", (F.col("table_id") % 3).alias("keeper"))
    expected = v.table("nation").select((F.col("n_nationkey") % 4).cast("long").alias("keeper")).distinct()
    whole, absent = R.all_tables(parts, expected)
    # Nothing is listed while a keeper is silent, so only the silent ones come out.
    return absent.unionByName(whole.select("keeper"))


@query("placement_drift", """
SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a.partition_id, b.partition_id) AS partition_id,
  coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.node_id IS NULL THEN 'added' WHEN b.node_id IS NULL THEN 'removed'
    WHEN a.role <> b.role THEN 'role' ELSE 'version' END AS change,
  coalesce(a.role, 10001) AS old_role, coalesce(b.role, 10001) AS new_role, coalesce(a.role = 2 AND b.role = 0, false) AS illegal
FROM (SELECT * FROM f_members WHERE qty % 41 <> 0) a FULL OUTER JOIN f_later b
  ON a.table_id = b.table_id AND a.partition_id = b.partition_id AND a.node_id = b.node_id
WHERE a.node_id IS NULL OR b.node_id IS NULL OR a.role <> b.role OR a.membership_version <> b.membership_version""",
       ints="old_role new_role")
def _(v):
    return R.placement_drift(v.members.filter("qty % 41 <> 0"), v.later_members)


@query("partition_detail", """
SELECT m.table_id, m.partition_id, m.node_id, m.role, m.membership_version, m.restore_version, host, port, hub_name,
  coalesce(f.ready_to_promote, false) AS ready, coalesce(f.split_cleanup_version, 0) AS cleanup_version, f.node_id IS NOT NULL AS reported,
  CAST(f.seq AS VARCHAR) AS seq_text
FROM f_members m JOIN f_nodes n ON n.node_id = m.node_id
LEFT JOIN f_facts f ON f.table_id = m.table_id AND f.partition_id = m.partition_id AND f.node_id = m.node_id""",
       ints="role membership_version port")
def _(v):
    detail = R.partition_detail(v.members, v.facts, v.nodes)
    return detail.withColumn("seq_text", F.element_at("statistics", F.lit("seq"))).drop("statistics")


@query("partition_detail_lists", """
SELECT table_id, partition_id, max(membership_version) AS membership_version, count(*) AS peers, min(role) AS best_role
FROM f_members GROUP BY 1, 2""", ints="membership_version best_role")
def _(v):
    lists = R.detail_by_partition(R.partition_detail(v.members, v.facts, v.nodes))
    return lists.select(*PART_KEY, "membership_version", F.size("peers").alias("peers"), F.col("peers")[0]["role"].alias("best_role"))


@query("partition_page", "SELECT table_id, partition_id, node_id, role FROM f_members WHERE partition_id BETWEEN 5 AND 11", ints="role")
def _(v):
    return R.partition_page(v.members, v.tables, 5, 11).select(*REPLICA_KEY, "role")


@query("list_keys", """
SELECT table_id, partition_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY CAST(node_id AS VARCHAR)) AS node_key FROM f_members GROUP BY 1, 2""")
def _(v):
    nodes = v.members.groupBy(*PART_KEY).agg(F.collect_list(F.col("node_id").cast("string")).alias("nodes"))
    return nodes.select(*PART_KEY, E.list_key("nodes").alias("node_key"))


@query("partition_page_default", "SELECT table_id, partition_id, node_id, role FROM f_members WHERE partition_id < 128", ints="role")
def _(v):
    return R.partition_page(v.members, v.tables, page_size=128).select(*REPLICA_KEY, "role")


@query("partition_page_small", "SELECT table_id, partition_id, node_id, role FROM f_members WHERE partition_id BETWEEN 4 AND 11", ints="role")
def _(v):
    return R.partition_page(v.members, v.tables, 4, page_size=8).select(*REPLICA_KEY, "role")


@query("partition_page_first_only", "SELECT table_id, partition_id, node_id, role FROM f_members WHERE partition_id = 0", ints="role")
def _(v):
    return R.partition_page(v.members, v.tables, 0, 0).select(*REPLICA_KEY, "role")


@query("partition_page_whole", "SELECT table_id, partition_id, node_id, role FROM f_members", ints="role")
def _(v):
    return R.partition_page(v.members, v.tables).select(*REPLICA_KEY, "role")


# --- capacity -----------------------------------------------------------------------------------------------------


@query("server_resource", """
SELECT s_suppkey AS node_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(floor(abs(s_acctbal)) AS BIGINT) ELSE -1 END AS disk,
  CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 10 ELSE -1 END AS cpu, s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AS failed FROM supplier""")
def _(v):
    key = F.col("s_suppkey")
    stats = F.map_from_arrays(
        F.array(F.lit("dbcap_bytes"), F.lit("dbcpu_cores"), F.lit("other")),
        F.array(F.when(key % 3 == 0, F.floor(F.abs("s_acctbal")).cast("string")).otherwise("x"),
                F.when(key % 4 == 0, (key * 10).cast("string")).otherwise(""), F.lit("1")))
    servers = v.table("supplier").select(key.alias("node_id"), stats.alias("statistics"))
    unit = lambda k: F.coalesce(F.element_at("resource", F.lit(k)), F.lit(-1)).cast("long")
    return C.server_resource(servers, "log_based").select(
        "node_id", unit("DISK_CAP").alias("disk"), unit("CPU").alias("cpu"), F.col("error").isNotNull().alias("failed"))


RES_SQL = """
WITH units AS (SELECT hub_name, host, port, op, node_id, 'DISK_CAP' AS key, disk_cap AS value FROM f_nodes
  UNION ALL SELECT hub_name, host, port, op, node_id, 'CPU', node_id % 7 * 95 FROM f_nodes
  UNION ALL SELECT hub_name, host, port, op, node_id, 'KSAT_CPU', node_id % 9 * 33 FROM f_nodes),
 one AS (SELECT * FROM units WHERE op <> 2 QUALIFY row_number() OVER (PARTITION BY host, key ORDER BY node_id) = 1) """


@query("hub_resources", RES_SQL + """
SELECT hub_name, key, CAST(sum(value) AS BIGINT) AS value FROM units WHERE op <> 2 GROUP BY 1, 2""")
def _(v):
    return C.hub_resources(v.nodes)


@query("hub_resources_by_address", RES_SQL + """
SELECT hub_name, key, CAST(sum(value) AS BIGINT) AS value FROM one GROUP BY 1, 2""")
def _(v):
    return C.hub_resources(v.nodes.withColumn("port", F.lit(9000)), dedupe=True)


USE_SQL = """
WITH smp AS (SELECT f.table_id, f.partition_id, CASE WHEN qty % 5 = 0 THEN NULL ELSE qty * 1000 + 1 END AS r FROM f_facts f
    WHERE role IN (0, 1) AND membership_version = 7),
  pu AS (SELECT table_id, partition_id, (CAST(sum(r) AS BIGINT) + count(r) - 1) // count(r) AS value, count(r) AS sampled FROM smp
    WHERE r IS NOT NULL GROUP BY 1, 2),
  need AS (SELECT table_id, parts_count, (CASE WHEN table_id % 2 = 0 THEN 0 ELSE table_id * 500 END + parts_count - 1) // parts_count AS avg FROM f_tables),
  tu AS (SELECT n.table_id, CAST(coalesce(sum(greatest(value, avg)), 0) + (max(parts_count) - count(value)) * max(avg) AS BIGINT) AS used,
    count(value) AS sampled_parts FROM need n LEFT JOIN pu ON pu.table_id = n.table_id GROUP BY 1) """


def part_units(v):
    return C.partition_resource(C.replica_resource(v.facts, "embedding"), v.members)


def sized_tables(v):
    """Odd tables state a size of 500 bytes per id."""
    args = F.concat(F.lit('{"table_size_bytes": '), (F.col("table_id") * 500 * (F.col("table_id") % 2)).cast("string"), F.lit("}"))
    return C.table_resource(v.tables.withColumn("json_args", args), "embedding")


@query("partition_resource", USE_SQL + "SELECT table_id, partition_id, 'MEM_CAP' AS key, value, sampled FROM pu")
def _(v):
    return part_units(v)


@query("table_resource", """
SELECT table_id, CASE WHEN table_id % 3 = 0 THEN table_id * 1073741824 ELSE table_id * 7 END AS mem FROM f_tables""")
def _(v):
    key = F.col("table_id").cast("string")
    args = F.when(F.col("table_id") % 3 == 0, F.concat(F.lit('{"table_size_gibibytes": '), key, F.lit(', "table_size_bytes": 5}'))).otherwise(
        F.concat(F.lit('{"table_size_bytes": '), (F.col("table_id") * 7).cast("string"), F.lit("}")))
    out = C.table_resource(v.tables.withColumn("json_args", args), "embedding")
    mem = F.col("resource")["MEM_CAP"]
    # Table 0 states zero GiB, so its byte field counts.
    return out.select(*TABLE_KEY, F.when(F.col("table_id") == 0, mem - 5).otherwise(mem).alias("mem"))


@query("table_resource_usage", USE_SQL + "SELECT table_id, 'MEM_CAP' AS key, used, sampled_parts FROM tu")
def _(v):
    return C.table_resource_usage(part_units(v), sized_tables(v))


@query("service_resource_usage", USE_SQL + "SELECT 'MEM_CAP' AS key, CAST(sum(used) AS BIGINT) AS used FROM tu")
def _(v):
    return C.service_resource_usage(C.table_resource_usage(part_units(v), sized_tables(v)))


@query("capacity_audit", RES_SQL + """
, need AS (SELECT key, max(v) // 2 AS need FROM (SELECT hub_name, key, CAST(sum(value) AS BIGINT) AS v FROM units WHERE op <> 2 GROUP BY 1, 2) GROUP BY 1),
  h AS (SELECT hub_name, key, CAST(sum(value) AS BIGINT) AS has FROM units WHERE op <> 2 GROUP BY 1, 2)
SELECT h.hub_name, h.key, has, need FROM h JOIN need ON need.key = h.key WHERE has < need""")
def _(v):
    units = C.hub_resources(v.nodes)
    return C.capacity_audit(units, half_of_largest(units))


def half_of_largest(units):
    return units.groupBy(*SCOPE, "key").agg(F.expr("max(value) div 2").alias("need"))


@query("capacity_without", RES_SQL + """
, need AS (SELECT key, max(v) // 2 AS need FROM (SELECT hub_name, key, CAST(sum(value) AS BIGINT) AS v FROM units WHERE op <> 2 GROUP BY 1, 2) GROUP BY 1),
  h AS (SELECT hub_name, key, CAST(sum(value) AS BIGINT) AS has FROM units WHERE op <> 2 AND node_id % 4 <> 0 GROUP BY 1, 2)
SELECT h.hub_name, h.key, has, need FROM h JOIN need ON need.key = h.key WHERE has < need""")
def _(v):
    return C.capacity_without(v.nodes, v.nodes.filter("node_id % 4 = 0"), half_of_largest(C.hub_resources(v.nodes)))


@query("capacity_with_table", RES_SQL + """
, h AS (SELECT hub_name, key, CAST(sum(value) AS BIGINT) AS has FROM units WHERE op <> 2 GROUP BY 1, 2),
  u AS (SELECT key, min(has) AS used FROM h GROUP BY 1),
  need AS (SELECT key, used + CASE WHEN key = 'CPU' THEN (SELECT max(parts_count) FROM f_tables) ELSE 0 END AS need FROM u)
SELECT h.hub_name, h.key, has, need FROM h JOIN need ON need.key = h.key WHERE has < need""")
def _(v):
    used = C.hub_resources(v.nodes).groupBy(*SCOPE, "key").agg(F.min("value").alias("used"))
    new = v.tables.groupBy(*SCOPE).agg(F.create_map(F.lit("CPU"), F.max("parts_count")).alias("resource"))
    return C.capacity_with_table(v.nodes, used, new)


# --- routes -------------------------------------------------------------------------------------------------------

ROUTE_SQL = """
WITH hid AS (SELECT hub_name, row_number() OVER (ORDER BY hub_name) - 1 AS hub_id FROM f_hubs WHERE hub_no % 6 <> 5),
  srv AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS server_index, host, port AS own_port, CAST(8000 + node_id % 2 AS BIGINT) AS port,
    hub_id, is_alive, CAST(op AS BIGINT) AS op, CASE WHEN op = 1 THEN 'NODE_TEMPDOWN' WHEN op = 2 THEN 'NODE_PREDISABLE' WHEN is_alive THEN 'NODE_ENABLE' ELSE 'NODE_ERROR' END AS status
    FROM f_nodes n JOIN hid ON hid.hub_name = n.hub_name) """


def servers_of(v):
    return RT.route_servers(v.nodes, v.hubs.filter("hub_no % 6 <> 5"))


def replicas_text():
    pair = lambda r: F.concat_ws(":", r["server_index"].cast("string"), r["role"].cast("string"))
    return F.array_join(F.transform("replicas", pair), ",")


@query("route_servers", ROUTE_SQL + "SELECT * EXCLUDE (own_port) FROM srv")
def _(v):
    return servers_of(v)


@query("servers_from_status", ROUTE_SQL + """
SELECT node_id, CASE status WHEN 'NODE_TEMPDOWN' THEN 1 WHEN 'NODE_PREDISABLE' THEN 2 ELSE 0 END AS op, status <> 'NODE_ERROR' AS is_alive FROM srv""", ints="op")
def _(v):
    return RT.servers_from_status(servers_of(v)).select(*SCOPE, "node_id", "op", "is_alive")


@query("route_replicas", ROUTE_SQL + """
SELECT m.table_id, m.partition_id, server_index, m.role, m.membership_version AS version, CAST(f.seq AS VARCHAR) AS seq_text
FROM f_members m JOIN srv ON srv.node_id = m.node_id
LEFT JOIN f_facts f ON f.table_id = m.table_id AND f.partition_id = m.partition_id AND f.node_id = m.node_id""", ints="role version")
def _(v):
    rows = RT.route_replicas(v.members, servers_of(v), v.facts)
    return rows.withColumn("seq_text", F.element_at("statistics", F.lit("seq"))).drop("statistics")


@query("build_routes", ROUTE_SQL + """
SELECT t.table_id, p.partition_id, coalesce(max(m.membership_version), 0) AS version, coalesce(max(m.split_version), 0) AS split_version,
  coalesce(string_agg(concat(server_index, ':', role), ',' ORDER BY server_index) FILTER (WHERE server_index IS NOT NULL), '') AS replicas
FROM f_tables t CROSS JOIN LATERAL (SELECT unnest(range(t.parts_count)) AS partition_id) p
LEFT JOIN f_members m ON m.table_id = t.table_id AND m.partition_id = p.partition_id LEFT JOIN srv ON srv.node_id = m.node_id
GROUP BY 1, 2""", ints="version")
def _(v):
    routes = RT.build_routes(v.tables, v.members, RT.route_replicas(v.members, servers_of(v), v.facts))
    return routes.withColumn("replicas", replicas_text())


def published(v):
    """Routes as once published: some newer than the keeper's view, some servers gone since."""
    servers = servers_of(v).join(v.nodes.select(*SCOPE, "node_id", F.col("port").alias("own_port")), [*SCOPE, "node_id"])
    servers = servers.select(*SCOPE, "server_index", "host", F.when(F.col("node_id") % 9 == 4, 1).otherwise(F.col("own_port")).alias("port"))
    rows = RT.route_replicas(v.members, servers_of(v), v.facts).drop("statistics")
    return rows.withColumn("version", F.lit(6) + F.col("partition_id") % 3), servers


@query("recover_membership", ROUTE_SQL + """
, rt AS (SELECT m.table_id, m.partition_id, m.node_id, m.role, 6 + m.partition_id % 3 AS version, srv.is_alive, srv.node_id % 9 = 4 AS gone
    FROM f_members m JOIN srv ON srv.node_id = m.node_id WHERE 6 + m.partition_id % 3 > 7),
  b AS (SELECT *, count(*) FILTER (WHERE gone OR (NOT is_alive AND role <> 2)) OVER (PARTITION BY table_id, partition_id) AS bumps FROM rt)
SELECT table_id, partition_id, node_id, CASE WHEN NOT is_alive THEN 2 ELSE role END AS role, version + bumps AS membership_version FROM b WHERE NOT gone""", ints="role")
def _(v):
    routes, servers = published(v)
    return RT.recover_membership(routes, servers, v.members, v.nodes)


@query("verify_routes", ROUTE_SQL + """
SELECT m.table_id, m.partition_id, max(6 + m.partition_id % 3) AS route_version, 7 AS kept_version
FROM f_members m JOIN srv ON srv.node_id = m.node_id GROUP BY 1, 2 HAVING max(6 + m.partition_id % 3) > 7""", ints="kept_version")
def _(v):
    routes, _ = published(v)
    return RT.verify_routes(routes, v.members)


@query("packed_ids", """
SELECT table_id * 4294967296 + partition_id AS packed, table_id, partition_id, count(*) AS peers FROM f_members GROUP BY 2, 3""")
def _(v):
    packed = F.shiftleft("table_id", 32) + F.col("partition_id")
    counted = v.members.groupBy(*SCOPE, packed.alias("packed")).agg(F.count(F.lit(1)).alias("peers"))
    return counted.withColumn("table_id", unpack_table("packed")).withColumn("partition_id", unpack_partition("packed"))
