"""Registered queries over node fleets and their admin checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardlens.functions.exprs import host_port, int_div
from shardlens.operators import nodes as N
from shardlens.operators import placement as P
from shardlens.plans.registry import query
from shardlens.schema import SCOPE


def indexed(v):
    """Nodes with an index ``hub.slot``; 25 consecutive ids share a slot number."""
    slot = int_div("node_id", F.lit(25).cast("long")).cast("string")
    return v.nodes.join(v.hubs.select("hub_name", "hub_no"), "hub_name").withColumn(
        "node_index", F.concat_ws(".", F.col("hub_no").cast("string"), slot))


def on_shared_ports(v):
    """Nodes as if both processes of a host had the same address."""
    return v.nodes.withColumn("port", F.lit(9000))


def address_requests(v):
    """Customers ask by address: customer c asks for node c, or for a port nobody has when c % 3 = 0."""
    c, key = v.table("customer"), F.col("c_custkey")
    node = key % 150
    return v.scoped(c.select(
        key.alias("request_id"),
        F.concat(F.lit("host"), (node - node % 2).cast("string")).alias("host"),
        F.when(key % 3 == 0, 9009).otherwise(9000 + key % 2).cast("int").alias("port"),
        (key % 4 % 3).alias("op"),
        ((key % 120).cast("double") / 10).cast("float").alias("weight"),
        F.concat(F.lit("NATION_"), (key % 27).cast("string")).alias("hub_name"),
        (key % 2000).alias("table_id"), (key % 40 - 2).alias("partition_id"),
        F.when(key % 5 == 0, key % 200).alias("unique_id"),
    ))


REQ_SQL = """
WITH req AS (SELECT c_custkey AS request_id, concat('host', c_custkey % 150 - c_custkey % 150 % 2) AS host,
    CASE WHEN c_custkey % 3 = 0 THEN 9009 ELSE 9000 + c_custkey % 2 END AS port, c_custkey % 4 % 3 AS op,
    CAST(CAST(c_custkey % 120 AS DOUBLE) / 10 AS FLOAT) AS weight, concat('NATION_', c_custkey % 27) AS hub_name,
    c_custkey % 2000 AS table_id, c_custkey % 40 - 2 AS partition_id,
    CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 200 END AS unique_id FROM customer),
  exact AS (SELECT r.*, n.node_id FROM req r LEFT JOIN f_nodes n ON n.host = r.host AND n.port = r.port) """


@query("filter_nodes", """
SELECT node_id FROM f_nodes n WHERE is_alive AND op <> 2
  AND node_id NOT IN (SELECT node_id FROM f_members WHERE role = 2 AND qty = 1)
  AND node_id IN (SELECT node_id FROM f_members WHERE role = 0) AND node_id IN (SELECT node_id FROM f_members WHERE role <> 1)""")
def _(v):
    out = N.filter_nodes(
        v.nodes, N.node_filter(alive=True, not_op=2), exclude_members=v.members.filter("role = 2 and qty = 1"),
        with_role=(v.members, 0), without_role=(v.members, 1))
    return out.select(*SCOPE, "node_id")


def spare_nodes(v):
    """Customers as spare nodes that hold nothing."""
    c = F.col("c_custkey")
    return v.scoped(v.table("customer").select(
        (c + 1000000).alias("node_id"), F.concat(F.lit("spare"), (c % 37).cast("string")).alias("host"), F.lit(9000).alias("port"),
        F.when(c % 2 == 0, 2).otherwise(0).alias("op"), (c % 5 == 0).alias("is_alive")))


@query("filter_nodes_unused", """
WITH nd AS (SELECT node_id, op, is_alive FROM f_nodes
    UNION ALL SELECT 1000000 + c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END, c_custkey % 5 = 0 FROM customer)
SELECT node_id FROM nd WHERE is_alive AND op <> 2 AND node_id NOT IN (SELECT node_id FROM f_members)""")
def _(v):
    spare = spare_nodes(v)
    nodes = v.nodes.select(*spare.columns).unionByName(spare)
    return N.filter_nodes(nodes, N.node_filter(alive=True, not_op=2), exclude_members=v.members).select(*SCOPE, "node_id")


@query("filter_nodes_negated", """
SELECT node_id FROM f_nodes WHERE NOT (is_alive AND op = 0) AND hub_name <> 'NATION_3'""")
def _(v):
    cond = N.node_filter(alive=True, op=0, negate=True) & N.node_filter(hub="NATION_3", negate=True)
    return N.filter_nodes(v.nodes, cond).select(*SCOPE, "node_id")


@query("takes_part", """
WITH o AS (SELECT node_id, row_number() OVER (ORDER BY hub_name, node_id) - 1 AS position, count(*) OVER () AS n FROM f_nodes),
  p AS (SELECT DISTINCT table_id, node_id, table_id % 120 - 10 AS grayscale FROM f_members)
SELECT p.table_id, p.node_id, position, grayscale, CASE WHEN grayscale >= 100 THEN true WHEN grayscale <= 0 THEN false
  ELSE CAST(CAST(position + 1 AS FLOAT) / CAST(n AS FLOAT) AS FLOAT) <= CAST(CAST(grayscale AS FLOAT) / CAST(100 AS FLOAT) AS FLOAT) END AS takes_part
FROM p JOIN o ON p.node_id = o.node_id""")
def _(v):
    pairs = v.members.select(*P.TABLE_NODE).distinct()
    return N.takes_part(pairs, v.nodes, v.tables.withColumn("grayscale", F.col("table_id") % 120 - 10))


IDX_SQL = "WITH ix AS (SELECT n.*, hub_no, node_id // 25 AS slot FROM f_nodes n JOIN f_hubs h ON n.hub_name = h.hub_name) "


@query("index_conflicts", IDX_SQL + """
SELECT az, concat(hub_no, '.', slot) AS node_index, count(*) AS claimants, min(node_id) AS first_node, count(*) - 1 AS conflicts
FROM ix WHERE op <> 2 GROUP BY 1, 2 HAVING count(*) > 1""")
def _(v):
    return N.index_conflicts(indexed(v))


@query("missing_indexes", IDX_SQL + """
SELECT t.hub_name, s.sub_no FROM (SELECT hub_name, max(slot) AS top FROM ix WHERE op <> 2 GROUP BY 1) t,
  unnest(range(top + 1)) s(sub_no)
WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.hub_name = t.hub_name AND slot = s.sub_no AND op <> 2)""")
def _(v):
    return N.missing_indexes(indexed(v))


@query("address_conflicts", """
WITH nd AS (SELECT node_id, host, op, is_alive FROM f_nodes
    UNION ALL SELECT 1000000 + c_custkey, concat('spare', c_custkey % 37), CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END, c_custkey % 5 = 0 FROM customer),
  c AS (SELECT n.node_id, host, op, is_alive, count(*) OVER (PARTITION BY host) AS at_address,
    count(*) FILTER (WHERE is_alive) OVER (PARTITION BY host) AS alive_there, coalesce(l.n, 0) AS replicas FROM nd n
  LEFT JOIN (SELECT node_id, count(*) AS n FROM f_members GROUP BY 1) l ON l.node_id = n.node_id)
SELECT node_id, host, CAST(9000 AS BIGINT) AS port, at_address, alive_there, replicas,
  CASE WHEN at_address = 1 THEN CASE WHEN op = 2 AND NOT is_alive AND replicas = 0 THEN 'removable' ELSE 'keep' END
       WHEN alive_there > 1 OR is_alive THEN 'keep'
       WHEN op <> 2 THEN CASE WHEN alive_there = 1 THEN 'mark offline' ELSE 'ambiguous' END
       WHEN replicas = 0 THEN 'removable' ELSE 'keep' END AS verdict FROM c""")
def _(v):
    spare = spare_nodes(v)
    shared = on_shared_ports(v)
    return N.address_conflicts(shared.select(*spare.columns).unionByName(spare), v.members)


SCORES_SQL = """
WITH s AS (SELECT node_id, op, score AS old, CASE WHEN node_id % 7 * 95 = 0 THEN 0
  ELSE least(10000, greatest(1, node_id % 7 * 95 // 10)) END AS fresh FROM f_scored),
r AS (SELECT node_id, old AS old_score, CASE WHEN fresh <> 0 THEN fresh WHEN op = 2 THEN 0 ELSE old END AS new_score,
  CASE WHEN fresh <> 0 THEN CASE WHEN fresh <> old THEN 'updated' ELSE 'unchanged' END
       WHEN op = 2 THEN CASE WHEN old <> 0 THEN 'reset' ELSE 'unchanged' END
       WHEN {force} OR old = 0 THEN 'blocks' ELSE 'kept old' END AS verdict FROM s) """


@query("refresh_scores", SCORES_SQL.format(force="false") + "SELECT *, verdict = 'blocks' AS blocks FROM r")
def _(v):
    return N.refresh_scores(v.nodes, "cpu_core")


@query("scores_ready", SCORES_SQL.format(force="true") + """
SELECT count(*) FILTER (WHERE verdict = 'blocks') = 0 AS ready, count(*) FILTER (WHERE verdict = 'blocks') AS blocking_nodes FROM r""")
def _(v):
    return N.scores_ready(N.refresh_scores(v.nodes, "cpu_core", force=True))


@query("lookup_nodes_exact", REQ_SQL + "SELECT request_id, node_id FROM exact")
def _(v):
    return N.lookup_nodes(v.nodes, address_requests(v), match_port=True).select(*SCOPE, "request_id", "node_id")


@query("lookup_nodes_any_port", REQ_SQL + """
SELECT request_id, CASE WHEN r.port = 9000 THEN a.node_id ELSE h.node_id END AS node_id FROM req r
LEFT JOIN (SELECT host, min(node_id) AS node_id FROM f_nodes GROUP BY 1) h ON h.host = r.host
LEFT JOIN (SELECT host, min(node_id) AS node_id FROM f_nodes GROUP BY 1) a ON a.host = r.host""")
def _(v):
    return N.lookup_nodes(on_shared_ports(v), address_requests(v), match_port=False).select(*SCOPE, "request_id", "node_id")


@query("node_admin_check", REQ_SQL + """
SELECT request_id, e.node_id, CASE WHEN e.node_id IS NULL THEN 'not found' WHEN n.op = e.op THEN 'duplicate'
  WHEN n.op = 2 AND e.op = 1 THEN 'illegal' ELSE 'ok' END AS verdict FROM exact e LEFT JOIN f_nodes n ON n.node_id = e.node_id""")
def _(v):
    return N.node_admin_check(v.nodes, address_requests(v))


@query("weight_update_check", REQ_SQL + """
SELECT request_id, e.node_id, CASE WHEN e.node_id IS NULL THEN 'not found' WHEN CAST(n.weight AS FLOAT) = e.weight THEN 'unchanged'
  WHEN e.weight < CAST(0.1 AS FLOAT) OR e.weight > CAST(10 AS FLOAT) THEN 'out of range' ELSE 'ok' END AS verdict
FROM exact e LEFT JOIN f_nodes n ON n.node_id = e.node_id""")
def _(v):
    return N.weight_update_check(v.nodes, address_requests(v))


@query("assign_hub_check", REQ_SQL + """
SELECT request_id, e.node_id, CASE WHEN h.az IS NULL THEN 'unknown hub' WHEN e.node_id IS NULL THEN 'not found'
  WHEN n.hub_name = e.hub_name THEN 'duplicate' WHEN n.az <> h.az THEN 'other az' ELSE 'ok' END AS verdict
FROM exact e LEFT JOIN f_nodes n ON n.node_id = e.node_id LEFT JOIN f_hubs h ON h.hub_name = e.hub_name""")
def _(v):
    return N.assign_hub_check(v.nodes, v.hubs, address_requests(v))


@query("remove_replicas_check", REQ_SQL + """
SELECT request_id, x.node_id, CASE WHEN x.node_id IS NULL THEN 'unknown node'
  WHEN x.partition_id < 0 OR x.partition_id >= parts_count THEN 'bad partition' WHEN m.node_id IS NULL THEN 'not a member' ELSE 'ok' END AS verdict
FROM (SELECT request_id, table_id, partition_id, CASE WHEN unique_id IS NOT NULL THEN
    (SELECT node_id FROM f_nodes k WHERE k.node_id = unique_id) ELSE node_id END AS node_id FROM exact) x
JOIN f_tables t ON t.table_id = x.table_id
LEFT JOIN f_members m ON m.table_id = x.table_id AND m.partition_id = x.partition_id AND m.node_id = x.node_id""")
def _(v):
    return N.remove_replicas_check(v.members, v.tables, v.nodes, address_requests(v))


def hub_hints(v):
    """Every fifth supplier has a hint by address or by host, some for hubs elsewhere."""
    key = F.col("node_id")
    by_addr = v.nodes.filter(key % 5 == 0).select(
        *SCOPE, host_port().alias("address"), F.concat(F.lit("NATION_"), (key % 30).cast("string")).alias("hinted_hub"))
    by_host = v.nodes.filter(key % 4 == 2).select(
        *SCOPE, F.col("host").alias("address"), F.concat(F.lit("NATION_"), (key % 25).cast("string")).alias("hinted_hub"))
    return by_addr.unionByName(by_host)


HINT_SQL = """
WITH hints AS (SELECT host || ':' || port AS address, concat('NATION_', node_id % 30) AS hinted FROM f_nodes WHERE node_id % 5 = 0
    UNION ALL SELECT host, concat('NATION_', node_id % 25) FROM f_nodes WHERE node_id % 4 = 2),
  chosen AS (SELECT n.*, coalesce(a.hinted, b.hinted) AS hinted_hub FROM f_nodes n
    LEFT JOIN hints a ON a.address = n.host || ':' || n.port LEFT JOIN hints b ON b.address = n.host) """


@query("hint_conflicts", HINT_SQL + """
SELECT node_id, hinted_hub, CASE WHEN hinted_hub IS NULL THEN 'no hint' WHEN h.az IS NULL THEN 'unknown hub'
  WHEN h.az <> c.az THEN 'other az' ELSE 'used' END AS verdict FROM chosen c LEFT JOIN f_hubs h ON h.hub_name = hinted_hub""")
def _(v):
    return N.hint_conflicts(v.nodes, v.hubs, hub_hints(v))


@query("replacement_status", """
WITH pairs AS (SELECT c_custkey AS pair_id, c_custkey // 3 AS request_id, (SELECT node_id FROM f_nodes n WHERE n.node_id = c_custkey % 110) AS src,
    (SELECT node_id FROM f_nodes n WHERE n.node_id = c_custkey * 7 % 130) AS dst FROM customer),
  x AS (SELECT p.*, coalesce(n.op <> 2, false) AS pending FROM pairs p LEFT JOIN f_nodes n ON n.node_id = src),
  w AS (SELECT request_id, count(*) FILTER (WHERE dst IS NULL) > 0 AS waiting, bool_or(pending) AS unfinished FROM x GROUP BY 1)
SELECT x.request_id, pair_id, src AS src_node, dst AS dst_node, CASE WHEN waiting THEN 'wait' WHEN pending THEN 'offline source'
  ELSE 'none' END AS action, NOT waiting AND NOT unfinished AS satisfied FROM x JOIN w ON w.request_id = x.request_id""")
def _(v):
    c, key = v.table("customer"), F.col("c_custkey")
    src, dst = key % 110, key * 7 % 130
    host = lambda n: F.concat(F.lit("host"), (n - n % 2).cast("string"))
    pairs = v.scoped(c.select(
        key.alias("pair_id"), int_div(key, F.lit(3).cast("long")).alias("request_id"),
        host(src).alias("src_host"), (9000 + src % 2).cast("int").alias("src_port"),
        host(dst).alias("dst_host"), (9000 + dst % 2).cast("int").alias("dst_port")))
    return N.replacement_status(v.nodes, pairs)


@query("az_expansion_status", """
WITH names AS (SELECT r_name AS az, r_regionkey AS i FROM region),
  r AS (SELECT c_custkey AS request_id, coalesce(az, 'NOWHERE') AS az, c_custkey % 40 AS new_size FROM customer LEFT JOIN names ON i = c_custkey % 6),
  sz AS (SELECT h.az, count(n.node_id) AS current_size FROM f_hubs h LEFT JOIN f_nodes n ON n.hub_name = h.hub_name AND op <> 2 GROUP BY 1)
SELECT request_id, r.az, new_size, coalesce(current_size, -1) AS current_size, current_size IS NULL OR current_size >= new_size AS reached,
  CASE WHEN current_size IS NULL THEN 'no hub' WHEN new_size <= current_size THEN 'not larger' ELSE 'ok' END AS request
FROM r LEFT JOIN sz ON sz.az = r.az""")
def _(v):
    names = v.table("region").select(F.col("r_name").alias("az"), F.col("r_regionkey").cast("long").alias("i"))
    key = F.col("c_custkey")
    c = v.table("customer").select(key.alias("request_id"), (key % 6).alias("i"), (key % 40).alias("new_size"))
    targets = v.scoped(c.join(names, "i", "left").select(
        "request_id", F.coalesce("az", F.lit("NOWHERE")).alias("az"), "new_size"))
    return N.az_expansion_status(v.nodes, v.hubs, targets)


def shrink_targets(v, size):
    return v.hubs.select(*SCOPE, "az").distinct().withColumn("new_size", F.lit(size).cast("long"))


@query("shrink_by_index", IDX_SQL + """
SELECT node_id, az, hub_name, slot AS sub_no FROM ix WHERE slot > 10 // 5 - 1""")
def _(v):
    return N.shrink_by_index(indexed(v), v.hubs, shrink_targets(v, 10))


@query("shrink_request_check", """
WITH t AS (SELECT az, count(*) AS h FROM f_hubs GROUP BY 1)
SELECT az, s AS new_size, CASE WHEN s <= 0 THEN 'bad size' WHEN s % h <> 0 THEN 'not divisible' ELSE 'ok' END AS verdict
FROM t, (VALUES (CAST(10 AS BIGINT)), (CAST(0 AS BIGINT)), (CAST(7 AS BIGINT))) x(s)""")
def _(v):
    asked = shrink_targets(v, 10).unionByName(shrink_targets(v, 0)).unionByName(shrink_targets(v, 7))
    return N.shrink_request_check(v.hubs, asked, indexed=True)


@query("shrink_by_load", """
WITH live AS (SELECT * FROM f_nodes WHERE op <> 2),
  dom AS (SELECT az, hub_name, host, count(*) AS size, min((CAST(is_alive AS INT), CASE op WHEN 1 THEN 0 ELSE 1 END, node_id)) AS k
    FROM live GROUP BY 1, 2, 3),
  lv AS (SELECT *, sum(size) OVER (PARTITION BY az, hub_name) - coalesce(sum(size) OVER (PARTITION BY az, hub_name ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM dom),
  cut AS (SELECT *, sum(size) OVER (PARTITION BY az) - coalesce(sum(size) OVER (PARTITION BY az ORDER BY level DESC, hub_name
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM lv)
SELECT node_id, n.az, n.hub_name FROM live n JOIN cut c ON c.az = n.az AND c.hub_name = n.hub_name AND c.host = n.host WHERE left_over > 6""")
def _(v):
    return N.shrink_by_load(v.nodes, v.hubs, shrink_targets(v, 6), domain="host")


@query("hub_recommendation", HINT_SQL + """
, live AS (SELECT * FROM f_nodes WHERE op <> 2),
  sized AS (SELECT h.az, h.hub_name, count(DISTINCT (host, port)) FILTER (WHERE node_id IS NOT NULL) AS a
    FROM f_hubs h LEFT JOIN live n ON n.hub_name = h.hub_name GROUP BY 1, 2),
  per AS (SELECT az, count(*) AS hubs, arg_min(hub_name, (a, hub_name)) AS emptiest, min(hub_name) AS first_hub FROM sized GROUP BY 1),
  same AS (SELECT az, host, min(hub_name) AS dh FROM live GROUP BY 1, 2),
  fresh AS (SELECT c.*, CASE WHEN node_id % 6 = 0 THEN concat(node_id % 3, '.', node_id) ELSE '' END AS ni,
     CASE WHEN node_id % 3 = 1 THEN 'newhost' || node_id ELSE host END AS nh FROM chosen c)
SELECT f.node_id, CASE WHEN ni <> '' THEN f.az || '_' || node_id % 3 WHEN hubs = 1 THEN first_hub
   ELSE coalesce(CASE WHEN h.az = f.az THEN hinted_hub END, dh, emptiest) END AS hub_name,
  CASE WHEN ni <> '' THEN 'index' WHEN hubs = 1 THEN 'only hub' WHEN h.az = f.az THEN 'hint' WHEN dh IS NOT NULL THEN 'failure domain'
   ELSE 'fewest addresses' END AS reason
FROM (SELECT fresh.* EXCLUDE (hinted_hub), coalesce(a.hinted, b.hinted) AS hinted_hub FROM fresh
   LEFT JOIN hints a ON a.address = nh || ':' || port LEFT JOIN hints b ON b.address = nh) f
JOIN per ON per.az = f.az LEFT JOIN same ON same.az = f.az AND same.host = nh LEFT JOIN f_hubs h ON h.hub_name = hinted_hub""")
def _(v):
    key = F.col("node_id")
    fresh = v.nodes.withColumn(
        "node_index", F.when(key % 6 == 0, F.concat_ws(".", (key % 3).cast("string"), key.cast("string"))).otherwise("")
    ).withColumn("host", F.when(key % 3 == 1, F.concat(F.lit("newhost"), key.cast("string"))).otherwise(F.col("host")))
    return N.hub_recommendation(fresh, v.nodes, v.hubs, hub_hints(v))


@query("node_state_transitions", """
WITH c AS (SELECT c_custkey AS node_id, c_custkey % 3 <> 0 AS alive, c_custkey * 3 + c_custkey % 2 AS pid FROM customer)
SELECT c.node_id, CASE WHEN n.node_id IS NULL AND NOT alive THEN 'unknown dead' WHEN n.node_id IS NULL THEN 'new' WHEN NOT alive THEN 'dead'
    WHEN op = 1 AND pid <> c.node_id * 3 + 1 THEN 'restarted' ELSE 'refreshed' END AS kind,
  CASE WHEN n.node_id IS NULL OR (alive AND op = 1 AND pid <> c.node_id * 3 + 1) THEN 0 ELSE op END AS op, alive AS is_alive,
  CAST(coalesce(weight, 1.0) AS FLOAT) AS weight, CAST(coalesce(score, 0) AS BIGINT) AS score,
  CASE WHEN alive OR n.node_id IS NULL THEN pid ELSE c.node_id * 3 + 1 END AS process_id
FROM c LEFT JOIN f_scored n ON n.node_id = c.node_id""", ints="op")
def _(v):
    key = F.col("c_custkey")
    changes = v.scoped(v.table("customer").select(
        key.alias("node_id"), (key % 3 != 0).alias("alive"), (key * 3 + key % 2).alias("new_process_id")))
    return N.node_state_transitions(changes, v.nodes)
