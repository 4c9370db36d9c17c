"""Registered queries over replica placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardlens.functions.exprs import padded_node_index
from shardlens.functions.scoring import ESTIMATORS, node_score, weighted_score
from shardlens.operators import nodes as N
from shardlens.operators import placement as P
from shardlens.operators.validate import pick_scheduler
from shardlens.plans.registry import query
from shardlens.schema import SCOPE, TABLE_KEY


def groups_of(v):
    return pick_scheduler(v.tables).filter("scheduler = 'hash_group'").join(
        v.tables.select(*TABLE_KEY, "parts_count"), TABLE_KEY
    )


@query("score_nodes", """
SELECT node_id, CAST(100 AS BIGINT) AS s_default,
  CASE WHEN cpu = 0 THEN 0 ELSE least(10000, greatest(1, cpu // 10)) END AS s_cpu_core,
  CASE WHEN ksat = 0 THEN 0 ELSE least(10000, greatest(1, (ksat + 5) // 10)) END AS s_ksat_core,
  CASE WHEN disk_cap = 0 THEN 0 ELSE least(10000, greatest(1, (disk_cap + 5368709120) // 10737418240)) END AS s_disk_cap
FROM (SELECT *, node_id % 7 * 95 AS cpu, node_id % 9 * 33 AS ksat FROM f_nodes)""")
def _(v):
    return v.nodes.select(*SCOPE, "node_id", *[node_score("resource", e).alias(f"s_{e}") for e in ESTIMATORS])


@query("weighted_score", "SELECT node_id, CAST(wscore AS BIGINT) AS wscore FROM f_scored")
def _(v):
    return v.nodes.select(*SCOPE, "node_id", weighted_score().alias("wscore"))


@query("estimate_replicas", "SELECT table_id, hub_name, node_id, est FROM f_est WHERE est > 0")
def _(v):
    return v.estimates


@query("held_load", """
SELECT l.table_id, l.node_id, primaries, learners, load AS total, coalesce(est, 0) AS est FROM f_load l
LEFT JOIN f_est e ON e.table_id = l.table_id AND e.node_id = l.node_id""")
def _(v):
    return P.held_load(v.members, v.tables, v.profile)


@query("estimated_by_node", """
SELECT node_id, CAST(sum(est) AS BIGINT) AS estimated FROM f_est GROUP BY node_id HAVING sum(est) > 0""")
def _(v):
    return P.estimated_by_node(v.tables, v.profile)


BRIEF_SQL = """
SELECT n.node_id, hub_name, az, host, CAST(port AS BIGINT) AS port, CAST(op AS BIGINT) AS op, is_alive,
  coalesce(primaries, 0) AS primaries, coalesce(secondaries, 0) AS secondaries, coalesce(learners, 0) AS learners,
  coalesce(total, 0) AS total, coalesce(estimated, 0) AS estimated, CAST(weight AS FLOAT) AS weight, score
FROM f_scored n LEFT JOIN (
  SELECT node_id, count(*) FILTER (WHERE role = 0) AS primaries, count(*) FILTER (WHERE role = 1) AS secondaries,
    count(*) FILTER (WHERE role = 2) AS learners, count(*) AS total FROM f_facts GROUP BY node_id) f ON n.node_id = f.node_id
LEFT JOIN (SELECT node_id, CAST(sum(est) AS BIGINT) AS estimated FROM f_est GROUP BY node_id) e ON n.node_id = e.node_id"""


@query("node_brief", BRIEF_SQL)
def node_brief_query(v):
    return P.node_brief(v.nodes, v.facts, v.tables, v.profile, ordered=True)


@query("node_brief_in_az", BRIEF_SQL + " WHERE az = (SELECT min(r_name) FROM region)")
def _(v):
    first = v.table("region").agg(F.min("r_name").alias("az"))
    return P.node_brief(v.nodes.join(first, "az", "left_semi"), v.facts, v.tables, v.profile)


@query("replicas_by_node", """
SELECT node_id, count(*) FILTER (WHERE role = 0) AS primaries, count(*) FILTER (WHERE role = 1) AS secondaries,
  count(*) FILTER (WHERE role = 2) AS learners, count(*) AS total,
  CAST(coalesce(sum(w) FILTER (WHERE role = 0), 0) AS BIGINT) AS weighted_primaries,
  CAST(coalesce(sum(w) FILTER (WHERE role = 1), 0) AS BIGINT) AS weighted_secondaries,
  CAST(coalesce(sum(w) FILTER (WHERE role = 2), 0) AS BIGINT) AS weighted_learners, CAST(sum(w) AS BIGINT) AS weighted_total
FROM (SELECT m.*, CASE WHEN m.split_version >= t.split_version THEN 1
                       WHEN partition_id < parts_count // 2 THEN 2 ELSE 0 END AS w
      FROM f_members m JOIN f_tables t ON m.table_id = t.table_id) GROUP BY node_id""")
def _(v):
    return P.replicas_by_node(P.partition_weight(v.members, v.tables), weight="part_weight")


@query("replicas_on_nodes", """
SELECT r.request_id, r.node_id, CASE WHEN r.node_id IS NULL THEN 'not found' ELSE 'ok' END AS status,
  count(*) FILTER (WHERE role = 0) AS primaries, count(*) FILTER (WHERE role = 1) AS secondaries,
  count(*) FILTER (WHERE role = 2) AS learners, count(f.node_id) AS total
FROM (SELECT c_custkey AS request_id, s_suppkey AS node_id FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 2) r
LEFT JOIN f_facts f ON r.node_id = f.node_id GROUP BY 1, 2, 3""")
def _(v):
    return P.replicas_on_nodes(v.facts, requests_of(v))


@query("replicas_on_nodes_full", """
SELECT r.request_id, r.node_id, CASE WHEN r.node_id IS NULL THEN 'not found' ELSE 'ok' END AS status,
  table_id, partition_id, CAST(role AS BIGINT) AS role, table_id * 4294967296 + partition_id AS packed_id
FROM (SELECT c_custkey AS request_id, s_suppkey AS node_id FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 2) r
LEFT JOIN f_facts f ON r.node_id = f.node_id""")
def _(v):
    return P.replicas_on_nodes(v.facts, requests_of(v), only_brief=False)


def requests_of(v):
    """Customers ask for nodes; odd ones ask for a node that does not exist."""
    c, s = v.table("customer"), v.table("supplier")
    return v.scoped(
        c.join(s, F.col("c_custkey") == F.col("s_suppkey") * 2, "left")
        .select(F.col("c_custkey").alias("request_id"), F.col("s_suppkey").alias("node_id"))
    )


@query("hub_sizes", """
SELECT az, hub_name, count(*) AS size FROM f_nodes WHERE op <> 2 GROUP BY az, hub_name
UNION ALL SELECT az, '*', count(*) FROM f_nodes WHERE op <> 2 GROUP BY az""")
def _(v):
    return N.hub_sizes(v.nodes)


@query("split_weight", """
SELECT m.table_id, partition_id, CASE WHEN max(m.split_version) >= max(t.split_version) THEN 1
   WHEN partition_id < max(parts_count) // 2 THEN 2 ELSE 0 END AS part_weight, count(*) AS peers
FROM f_members m JOIN f_tables t ON m.table_id = t.table_id GROUP BY m.table_id, partition_id""", ints="part_weight")
def _(v):
    weighed = P.partition_weight(v.members, v.tables)
    return weighed.groupBy(*P.PART_KEY).agg(F.max("part_weight").alias("part_weight"), F.count(F.lit(1)).alias("peers"))


PARTS_SQL = """
WITH parts AS (SELECT m.table_id, partition_id, max(membership_version) AS v, max(m.split_version) AS sv, count(*) AS peers,
    max(parts_count) AS parts_count, max(t.split_version) AS tsv
  FROM f_members m JOIN f_tables t ON m.table_id = t.table_id GROUP BY m.table_id, partition_id) """


@query("schedulable_partitions", PARTS_SQL + """
SELECT p.table_id, p.partition_id, CASE WHEN p.sv >= p.tsv THEN 1 WHEN p.partition_id < p.parts_count // 2 THEN 2 ELSE 0 END AS part_weight,
  CASE WHEN p.sv >= p.tsv THEN true WHEN p.partition_id >= p.parts_count // 2 THEN false ELSE c.partition_id IS NULL END AS schedulable
FROM parts p LEFT JOIN parts c ON p.table_id = c.table_id AND c.partition_id = p.partition_id + p.parts_count // 2
  AND p.partition_id < p.parts_count // 2 AND c.v > 0""", ints="part_weight")
def _(v):
    return P.schedulable_partitions(v.members, v.tables)


@query("split_pairs", PARTS_SQL + """
, p2 AS (SELECT *, parts_count // 2 AS half FROM parts WHERE partition_id < parts_count // 2 * 2),
  a AS (SELECT * FROM p2 WHERE partition_id < half), b AS (SELECT *, partition_id - half AS pid FROM p2 WHERE partition_id >= half)
SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a.partition_id, b.pid) AS parent_id,
  coalesce(a.partition_id, b.pid) + coalesce(a.half, b.half) AS child_id,
  CAST(coalesce(a.v, 0) AS BIGINT) AS parent_version, CAST(coalesce(b.v, 0) AS BIGINT) AS child_version,
  coalesce(a.sv, 0) AS parent_split_version, coalesce(b.sv, 0) AS child_split_version,
  coalesce(a.peers, 0) AS parent_peers, coalesce(b.peers, 0) AS child_peers
FROM a FULL OUTER JOIN b ON a.table_id = b.table_id AND a.partition_id = b.pid""")
def _(v):
    return P.split_pairs(v.members, v.tables)


@query("abnormal_partitions", """
SELECT t.table_id, parts_count - coalesce(healthy, 0) AS abnormal_count, CAST(coalesce(learners, 0) AS BIGINT) AS learner_count
FROM f_tables t LEFT JOIN (SELECT table_id, count(*) FILTER (WHERE l = 0 AND p = 1) AS healthy, sum(l) AS learners
  FROM (SELECT table_id, partition_id, count(*) FILTER (WHERE role = 2) AS l, count(*) FILTER (WHERE role = 0) AS p
        FROM f_members GROUP BY 1, 2) GROUP BY 1) x ON t.table_id = x.table_id""")
def _(v):
    return P.abnormal_partitions(v.members, v.tables)


OCC_SQL = """
WITH occ AS (SELECT table_id, partition_id, hub_name, count(*) AS replicas, count(*) FILTER (WHERE role IN (0, 1)) AS serving,
    count(*) FILTER (WHERE role IN (0, 1) AND is_alive) AS alive_serving, min(n.node_id) AS held_by
  FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id GROUP BY 1, 2, 3) """


@query("hub_constraint_audit", OCC_SQL + """
SELECT t.table_id, h.hub_name, parts_count - coalesce(ok, 0) - coalesce(red, 0) AS missing, coalesce(ok, 0) AS ok,
  coalesce(red, 0) AS redundant
FROM f_tables t CROSS JOIN f_hubs h LEFT JOIN (SELECT table_id, hub_name, count(*) FILTER (WHERE replicas = 1) AS ok,
  count(*) FILTER (WHERE replicas > 1) AS red FROM occ GROUP BY 1, 2) x ON x.table_id = t.table_id AND x.hub_name = h.hub_name""")
def _(v):
    return P.hub_constraint_audit(v.tables, v.hubs, v.members, v.nodes)


@query("missing_hub_cells", """
SELECT table_id, partition_id, count(*) AS missing_hubs, min(hub_name) AS first_missing FROM (
  SELECT t.table_id, p.partition_id, h.hub_name
  FROM f_tables t, unnest(range(t.parts_count)) p(partition_id), f_hubs h
  WHERE NOT EXISTS (SELECT 1 FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id
    WHERE m.table_id = t.table_id AND m.partition_id = p.partition_id AND n.hub_name = h.hub_name)) GROUP BY 1, 2""")
def _(v):
    cells = P.missing_hub_cells(v.tables, v.hubs, v.members, v.nodes)
    return cells.groupBy(*P.PART_KEY).agg(
        F.count(F.lit(1)).alias("missing_hubs"), F.min("hub_name").alias("first_missing"))


@query("out_of_hub_members", """
SELECT table_id, partition_id, m.node_id, CAST(role AS BIGINT) AS role
FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id WHERE no_primary""")
def _(v):
    # As if the hubs without primaries had been removed.
    return P.out_of_hub_members(v.members, v.nodes, v.hubs.filter("not no_primary"))


@query("serving_by_hub", OCC_SQL + """
SELECT table_id, partition_id, hub_name, serving FROM occ WHERE serving > 0
UNION ALL SELECT table_id, partition_id, '*', CAST(sum(serving) AS BIGINT) FROM occ GROUP BY 1, 2 HAVING sum(serving) > 0""")
def _(v):
    return P.serving_by_hub(v.members, v.nodes, v.hubs)


@query("learning_load", """
WITH parts AS (SELECT table_id, partition_id, min(CASE WHEN role = 0 THEN node_id END) AS pri,
    count(*) FILTER (WHERE role = 2) AS l FROM f_members GROUP BY 1, 2),
  per AS (SELECT table_id, node_id, CAST(sum(learns) AS BIGINT) AS learns, CAST(sum(feeds) AS BIGINT) AS feeds FROM (
    SELECT table_id, pri AS node_id, 0 AS learns, l AS feeds FROM parts WHERE pri IS NOT NULL AND l > 0
    UNION ALL SELECT table_id, node_id, 1, 0 FROM f_members WHERE role = 2) GROUP BY 1, 2)
SELECT p.table_id, p.node_id, learns, feeds, lp AS learning_parts, greatest(parts_count * 100 // 1000, 1) AS allowed_learning_parts,
  greatest(3 - greatest(feeds, learns), 0) AS node_room
FROM per p JOIN (SELECT table_id, count(*) FILTER (WHERE l > 0) AS lp FROM parts GROUP BY 1) x ON p.table_id = x.table_id
JOIN f_tables t ON t.table_id = p.table_id""", ints="allowed_learning_parts")
def _(v):
    return P.learning_load(v.members, v.tables, max_ratio=100, per_node_limit=3)


@query("hub_spread", """
SELECT az, count(*) AS hubs, arg_min(hub_name, (size, hub_name)) AS min_hub, min(size) AS min_size,
  arg_min(hub_name, (-size, hub_name)) AS max_hub, max(size) AS max_size, max(size) - min(size) > 1 AS imbalanced
FROM (SELECT h.az, h.hub_name, count(n.node_id) AS size FROM f_hubs h
      LEFT JOIN f_nodes n ON h.hub_name = n.hub_name AND n.op <> 2 GROUP BY 1, 2) GROUP BY az HAVING count(*) >= 2""")
def _(v):
    return P.hub_spread(v.nodes, v.hubs)


IMBALANCE_SQL = """
WITH rated AS (SELECT node_id, wscore, (is_alive AND op = 0 AND NOT no_primary) AS allowed FROM f_scored),
  tot AS (SELECT sum(wscore) AS s, min(wscore) AS least FROM rated WHERE allowed),
  pt AS (SELECT table_id, CAST(sum(primaries) AS BIGINT) AS p FROM f_load GROUP BY 1 HAVING sum(primaries) > 0),
  due AS (SELECT pt.table_id, r.node_id, CAST(wscore * p AS BIGINT) // CAST(s AS BIGINT) AS share, p
    FROM pt CROSS JOIN rated r CROSS JOIN tot WHERE allowed AND least > 0),
  state AS (SELECT d.table_id, max(p) - sum(share) AS remained, count(*) FILTER (WHERE coalesce(l.primaries, 0) < share) AS below
    FROM due d LEFT JOIN f_load l ON l.table_id = d.table_id AND l.node_id = d.node_id GROUP BY 1),
  imb AS (SELECT l.table_id, l.node_id, l.primaries, CAST(CASE WHEN d.node_id IS NULL THEN 0
      WHEN below = 0 AND remained > 0 THEN share + 1 ELSE share END AS BIGINT) AS target
    FROM f_load l JOIN state s ON l.table_id = s.table_id
    LEFT JOIN due d ON d.table_id = l.table_id AND d.node_id = l.node_id),
  edges AS (SELECT p.table_id, p.node_id AS primary_node, s.node_id AS secondary_node, count(*) AS partitions
    FROM f_members p JOIN f_members s ON p.table_id = s.table_id AND p.partition_id = s.partition_id
    WHERE p.role = 0 AND s.role = 1 GROUP BY 1, 2, 3) """


@query("primary_imbalance", IMBALANCE_SQL + """
SELECT table_id, node_id, primaries, target, primaries - target AS surplus FROM imb""")
def _(v):
    return P.primary_imbalance(v.members, v.nodes, v.hubs)


@query("primary_switch_edges", IMBALANCE_SQL + "SELECT * FROM edges")
def _(v):
    return P.primary_switch_edges(v.members)


@query("direct_switches", IMBALANCE_SQL + """
SELECT e.*, a.primaries - a.target AS surplus, b.target - b.primaries AS deficit FROM edges e
JOIN imb a ON a.table_id = e.table_id AND a.node_id = e.primary_node AND a.primaries > a.target
JOIN imb b ON b.table_id = e.table_id AND b.node_id = e.secondary_node AND b.primaries < b.target""")
def _(v):
    return P.direct_switches(P.primary_switch_edges(v.members), P.primary_imbalance(v.members, v.nodes, v.hubs))


GAPS_SQL = """
WITH weighed AS (SELECT m.table_id, partition_id, node_id, role, CASE WHEN m.split_version >= t.split_version THEN 1
    WHEN partition_id < parts_count // 2 THEN 2 ELSE 0 END AS w, m.split_version >= t.split_version AS normal,
    partition_id + parts_count // 2 AS child FROM f_members m JOIN f_tables t ON m.table_id = t.table_id),
  wload AS (SELECT table_id, node_id, sum(w) AS wt, coalesce(sum(w) FILTER (WHERE role = 0), 0) AS wp,
    coalesce(sum(w) FILTER (WHERE role = 2), 0) AS wl FROM weighed GROUP BY 1, 2),
  gaps AS (SELECT table_id, node_id, hub_name, CAST(coalesce(est, 0) - coalesce(wt, 0) AS BIGINT) AS gap,
      CAST(coalesce(wt, 0) AS BIGINT) AS wt, CAST(coalesce(wp, 0) AS BIGINT) AS wp, CAST(coalesce(wl, 0) AS BIGINT) AS wl
    FROM (SELECT coalesce(e.table_id, w.table_id) AS table_id, coalesce(e.node_id, w.node_id) AS node_id, est, wt, wp, wl
      FROM f_est e FULL OUTER JOIN wload w ON e.table_id = w.table_id AND e.node_id = w.node_id
      WHERE coalesce(est, 0) > 0 OR wt IS NOT NULL) JOIN (SELECT node_id, hub_name FROM f_nodes) USING (node_id)
    WHERE hub_name NOT IN (SELECT hub_name FROM f_scored WHERE op <> 2 AND wscore <= 0)) """


@query("balance_report", GAPS_SQL + """
SELECT table_id, hub_name, CAST(sum(abs(gap)) AS BIGINT) // 2 AS moves, max(gap) AS max_gap, min(gap) AS min_gap
FROM gaps GROUP BY 1, 2""")
def _(v):
    return P.balance_report(v.members, v.estimates, v.tables, v.nodes, v.hubs, v.profile)


@query("load_extremes", GAPS_SQL + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY table_id, hub_name ORDER BY gap DESC, wp, wl, node_id) AS a,
    row_number() OVER (PARTITION BY table_id, hub_name ORDER BY gap, wp DESC, wl DESC, node_id DESC) AS b FROM gaps),
  ends AS (SELECT x.table_id, x.hub_name, x.node_id AS light_node, x.gap AS light_gap, y.node_id AS heavy_node, y.gap AS heavy_gap,
      y.wp >= y.wt - y.wp - y.wl AS pf
    FROM ranked x JOIN ranked y ON x.table_id = y.table_id AND x.hub_name = y.hub_name
    WHERE x.a = 1 AND y.b = 1 AND x.gap > 0 AND y.gap < 0),
  parts AS (SELECT DISTINCT table_id, partition_id FROM f_members),
  picks AS (SELECT e.table_id, e.hub_name, w.partition_id, w.role, row_number() OVER (PARTITION BY e.table_id, e.hub_name
      ORDER BY CASE WHEN w.role = 2 THEN 0 WHEN (w.role = 0) = pf THEN 1 ELSE 2 END, w.partition_id) AS r
    FROM ends e JOIN weighed w ON w.table_id = e.table_id AND w.node_id = e.heavy_node
    LEFT JOIN parts c ON c.table_id = w.table_id AND c.partition_id = w.child
    WHERE w.w > 0 AND w.w <= -heavy_gap AND (w.normal OR c.table_id IS NULL))
SELECT e.table_id, e.hub_name, light_node, light_gap, heavy_node, heavy_gap, coalesce(p.partition_id, -1) AS move_partition,
  CAST(coalesce(p.role, -1) AS BIGINT) AS move_role
FROM ends e LEFT JOIN picks p ON p.table_id = e.table_id AND p.hub_name = e.hub_name AND p.r = 1""", once=True)
def _(v):
    return P.load_extremes(v.members, v.estimates, v.tables, v.nodes, v.hubs, v.profile)


@query("add_candidates", OCC_SQL + """
, need AS (SELECT t.table_id, h.hub_name, parts_count - coalesce(n, 0) AS missing FROM f_tables t CROSS JOIN f_hubs h
    LEFT JOIN (SELECT table_id, hub_name, count(*) AS n FROM occ GROUP BY 1, 2) x
      ON x.table_id = t.table_id AND x.hub_name = h.hub_name),
  cand AS (SELECT d.table_id, d.hub_name, missing, n.node_id, coalesce(est, 0) - coalesce(load, 0) AS gap, coalesce(learners, 0) AS learners
    FROM need d JOIN f_nodes n ON n.hub_name = d.hub_name AND n.op <> 2
    LEFT JOIN f_est e ON e.table_id = d.table_id AND e.node_id = n.node_id
    LEFT JOIN f_load l ON l.table_id = d.table_id AND l.node_id = n.node_id WHERE missing > 0)
SELECT table_id, hub_name, missing, node_id, gap, learners FROM cand
QUALIFY row_number() OVER (PARTITION BY table_id, hub_name ORDER BY gap DESC, learners, node_id) = 1""")
def _(v):
    return P.add_candidates(v.tables, v.hubs, v.members, v.nodes, v.estimates, v.profile)


@query("remove_candidates", """
WITH r AS (SELECT m.table_id, m.partition_id, n.hub_name, m.node_id, m.role, op, is_alive, coalesce(est, 0) - load AS gap,
    count(*) OVER w AS replicas, count(*) FILTER (WHERE is_alive AND m.role IN (0, 1)) OVER w AS alive_serving
  FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id JOIN f_load l ON l.table_id = m.table_id AND l.node_id = m.node_id
  LEFT JOIN f_est e ON e.table_id = m.table_id AND e.node_id = m.node_id
  WINDOW w AS (PARTITION BY m.table_id, m.partition_id, n.hub_name))
SELECT table_id, partition_id, hub_name, replicas, node_id, CAST(role AS BIGINT) AS role, gap,
  (alive_serving = 1 AND is_alive AND role IN (0, 1)) AS blocked FROM r WHERE replicas > 1
QUALIFY row_number() OVER (PARTITION BY table_id, partition_id, hub_name
  ORDER BY (role <> 2), gap, (op <> 2), is_alive, node_id) = 1""")
def _(v):
    return P.remove_candidates(v.members, v.nodes, v.hubs, P.held_load(v.members, v.tables, v.profile))


@query("primary_candidates", """
WITH s AS (SELECT m.table_id, m.partition_id, m.node_id, count(*) OVER w AS secondaries, is_alive AND op = 0 AS promotable,
    NOT no_primary AS role_allowed, row_number() OVER (PARTITION BY m.table_id, m.partition_id
      ORDER BY (NOT (is_alive AND op = 0)), no_primary, primaries, load - coalesce(est, 0), m.node_id) AS r
  FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id JOIN f_load l ON l.table_id = m.table_id AND l.node_id = m.node_id
  LEFT JOIN f_est e ON e.table_id = m.table_id AND e.node_id = m.node_id WHERE m.role = 1
  WINDOW w AS (PARTITION BY m.table_id, m.partition_id))
SELECT table_id, partition_id, secondaries, node_id, promotable, role_allowed FROM s WHERE r = 1
AND NOT EXISTS (SELECT 1 FROM f_members p WHERE p.table_id = s.table_id AND p.partition_id = s.partition_id AND p.role = 0)""")
def _(v):
    return P.primary_candidates(v.members, v.nodes, v.hubs, P.held_load(v.members, v.tables, v.profile))


@query("restart_impact", """
WITH t AS (SELECT m.table_id, m.partition_id, m.node_id, m.role, op = 1 AS restarting, no_primary, primaries
  FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id JOIN f_load l ON l.table_id = m.table_id AND l.node_id = m.node_id
  WHERE m.role IN (0, 1)),
 p AS (SELECT table_id, partition_id, min(node_id) FILTER (WHERE role = 0 AND restarting) AS pri,
   min(node_id) FILTER (WHERE role = 1 AND restarting) AS sec FROM t GROUP BY 1, 2),
 h AS (SELECT table_id, partition_id, node_id AS heir FROM t WHERE role = 1
   QUALIFY row_number() OVER (PARTITION BY table_id, partition_id ORDER BY no_primary, primaries, node_id) = 1)
SELECT p.table_id, p.partition_id, CASE WHEN pri IS NULL THEN 'demote_secondary' WHEN heir IS NULL THEN 'demote_primary'
  ELSE 'switch_primary' END AS action, coalesce(pri, sec) AS node_id, CASE WHEN pri IS NOT NULL THEN heir END AS successor
FROM p LEFT JOIN h ON p.table_id = h.table_id AND p.partition_id = h.partition_id WHERE pri IS NOT NULL OR sec IS NOT NULL""")
def _(v):
    return P.restart_impact(v.members, v.nodes, v.hubs)


SHADE_SQL = """
WITH pairs AS (SELECT table_id, base_table FROM f_tables WHERE base_table IS NOT NULL),
  b AS (SELECT pairs.table_id, partition_id, node_id, role FROM pairs JOIN f_members m ON m.table_id = base_table),
  s AS (SELECT pairs.table_id, partition_id, node_id, role FROM pairs JOIN f_members m ON m.table_id = pairs.table_id) """


@query("shade_placement_diff", SHADE_SQL + """
, cells AS (SELECT coalesce(b.table_id, s.table_id) AS table_id, coalesce(b.partition_id, s.partition_id) AS partition_id,
    coalesce(b.node_id, s.node_id) AS node_id, b.node_id IS NOT NULL AS ib, s.node_id IS NOT NULL AS ish,
    coalesce(s.role IN (0, 1), false) AS serves FROM b FULL OUTER JOIN s
    ON b.table_id = s.table_id AND b.partition_id = s.partition_id AND b.node_id = s.node_id),
  x AS (SELECT c.*, hub_name, count(*) FILTER (WHERE ib AND NOT ish) OVER hub AS adds, count(*) FILTER (WHERE ib AND serves) OVER hub AS safe,
      count(*) FILTER (WHERE NOT ib AND serves) OVER hub AS extra_serving,
      min(CASE WHEN NOT ib AND serves THEN c.node_id END) OVER hub AS first_serving
    FROM cells c JOIN f_nodes n ON n.node_id = c.node_id WINDOW hub AS (PARTITION BY table_id, partition_id, hub_name))
SELECT table_id, partition_id, hub_name, node_id, CASE WHEN NOT ish THEN 'add' WHEN adds > 0 THEN 'keep' WHEN safe > 0 THEN 'remove'
  WHEN extra_serving = 0 OR node_id = first_serving THEN 'keep' ELSE 'remove' END AS change FROM x WHERE ib <> ish""")
def _(v):
    base, shade = P.as_shades(v.members, v.tables)
    return P.shade_placement_diff(base, shade, v.nodes, v.hubs)


@query("shade_primary_diff", SHADE_SQL + """
SELECT s.table_id, s.partition_id, CASE WHEN max(bp) IS NULL THEN 'base has none'
  WHEN min(CASE WHEN s.node_id = bp THEN s.role END) = 0 THEN 'aligned'
  WHEN min(CASE WHEN s.node_id = bp THEN s.role END) = 1 AND count(*) FILTER (WHERE s.role = 0) = 0 THEN 'assign'
  WHEN min(CASE WHEN s.node_id = bp THEN s.role END) = 1 THEN 'switch' ELSE 'not possible' END AS verdict
FROM s LEFT JOIN (SELECT table_id, partition_id, min(node_id) AS bp FROM b WHERE role = 0 GROUP BY 1, 2) q
  ON q.table_id = s.table_id AND q.partition_id = s.partition_id GROUP BY 1, 2""")
def _(v):
    return P.shade_primary_diff(*P.as_shades(v.members, v.tables))


GROUPS_SQL = """
WITH g AS (SELECT table_id, parts_count, table_id % 6 + 1 AS gr FROM f_tables
    WHERE table_id % 4 = 1 AND parts_count % (table_id % 6 + 1) = 0 AND table_id % 6 + 1 <> parts_count),
  slices AS (SELECT e.table_id, hub_name, node_id, est, parts_count, gr, CAST(coalesce(sum(est) OVER (PARTITION BY e.table_id, hub_name
      ORDER BY idx, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT e.*, lpad(CAST(hub_no AS VARCHAR), 3, '0') || '.' || lpad(CAST(node_id * 7 % 1000 AS VARCHAR), 3, '0') AS idx
      FROM f_est e JOIN f_hubs h ON h.hub_name = e.hub_name) e JOIN g ON e.table_id = g.table_id
    WHERE est > 0 AND e.hub_name NOT IN (SELECT hub_name FROM f_scored WHERE op <> 2 AND (wscore <= 0 OR node_id % 31 = 7))),
  placed AS (SELECT table_id, partition_id, row_number() OVER (PARTITION BY table_id ORDER BY partition_id % gr, partition_id) - 1 AS pos
    FROM (SELECT table_id, gr, unnest(range(parts_count)) AS partition_id FROM g)),
  asg AS (SELECT s.table_id, hub_name, partition_id, node_id FROM slices s JOIN placed p ON p.table_id = s.table_id
    AND pos >= start AND pos < start + est) """


def assigned(v):
    """Slices by node index; every 31st node cannot be rated, so its hub is not ready."""
    slot = (F.col("node_id") * 7 % 1000).cast("string")
    index = padded_node_index(F.concat_ws(".", F.col("hub_no").cast("string"), slot))
    nodes = v.nodes.join(v.hubs.select("hub_name", "hub_no"), "hub_name").withColumn("node_index", index)
    nodes = nodes.withColumn("score", F.when(F.col("node_id") % 31 == 7, 0).otherwise(F.col("score")).cast("long"))
    return P.capacity_range_assign(v.estimates, groups_of(v), nodes, v.hubs)


@query("capacity_range_assign", GROUPS_SQL + "SELECT * FROM asg")
def _(v):
    return assigned(v)


@query("group_spread", GROUPS_SQL + """
SELECT m.table_id, m.node_id, hub_name, count(DISTINCT partition_id % gr) AS served_groups,
  (count(*) + max(parts_count // gr) - 1) // max(parts_count // gr) AS needed_groups,
  count(DISTINCT partition_id % gr) > (count(*) + max(parts_count // gr) - 1) // max(parts_count // gr) AS scattered
FROM f_members m JOIN g ON g.table_id = m.table_id JOIN f_nodes n ON n.node_id = m.node_id GROUP BY 1, 2, 3""")
def _(v):
    return P.group_spread(v.members, v.nodes, groups_of(v))


@query("group_moves", GROUPS_SQL + """
SELECT a.table_id, a.hub_name, count(o.node_id) AS in_place, count(*) - count(o.node_id) AS moves FROM asg a LEFT JOIN (
  SELECT table_id, partition_id, hub_name, min(m.node_id) AS node_id FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id
  GROUP BY 1, 2, 3 HAVING count(*) = 1 AND max(CASE WHEN role IN (0, 1) THEN 1 ELSE 0 END) = 1) o
  ON o.table_id = a.table_id AND o.partition_id = a.partition_id AND o.hub_name = a.hub_name AND o.node_id = a.node_id
GROUP BY 1, 2""")
def _(v):
    return P.group_moves(v.members, v.nodes, v.hubs, assigned(v))


HUB_COLUMNS = [f"NATION_{i}" for i in range(25)]
LETTER_SQL = "CASE role WHEN 0 THEN 'P' WHEN 1 THEN 'S' ELSE 'L' END"


def by_hub_sql(hubs):
    cells = [f"coalesce(string_agg(cell, ',' ORDER BY cell) FILTER (WHERE hub_name = '{h}'), '-') AS {h}" for h in hubs]
    names = ", ".join(f"'{h}'" for h in hubs)
    rest = f"coalesce(string_agg(hub_name || '/' || cell, ',' ORDER BY hub_name || '/' || cell) FILTER (WHERE hub_name NOT IN ({names})), '-') AS other"
    return f"""SELECT table_id, partition_id, {", ".join(cells)}, {rest}
FROM (SELECT table_id, partition_id, hub_name, {LETTER_SQL} || ':' || host || ':' || port AS cell
FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id) GROUP BY 1, 2"""


@query("placement_by_hub", by_hub_sql(HUB_COLUMNS))
def _(v):
    return P.placement_by_hub(v.members, v.nodes, HUB_COLUMNS)


@query("placement_by_named_hubs", by_hub_sql(HUB_COLUMNS[:3]))
def _(v):
    return P.placement_by_hub(v.members, v.nodes, HUB_COLUMNS[:3])


@query("placement_by_role", """
SELECT m.table_id, m.partition_id,
  coalesce(string_agg(a, ',' ORDER BY a) FILTER (WHERE m.role = 0), '') AS primary_at,
  coalesce(string_agg(a, ',' ORDER BY a) FILTER (WHERE m.role = 1), '') AS secondaries_at,
  coalesce(string_agg(al, ',' ORDER BY al) FILTER (WHERE m.role = 2), '') AS learners_at
FROM (SELECT m.*, host || ':' || port AS a, host || ':' || port || CASE WHEN coalesce(f.ready_to_promote, false) THEN '(ready)' ELSE '' END AS al
  FROM f_members m JOIN f_nodes n ON m.node_id = n.node_id LEFT JOIN f_facts f
    ON f.table_id = m.table_id AND f.partition_id = m.partition_id AND f.node_id = m.node_id) m GROUP BY 1, 2""")
def _(v):
    return P.placement_by_role(v.members, v.nodes, v.facts)
