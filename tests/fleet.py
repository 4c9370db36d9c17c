"""Small literal fleets and seeded random placements."""

import random

S, T = "svc", 1
NODE_FIELDS = ("service string, snapshot_ts bigint, node_id bigint, host string, port int, biz_port int, process_id bigint, "
               "hub_name string, az string, op int, is_alive boolean, weight float, score bigint")


def nodes(spark, rows, service=S, ts=T):
    """rows of (node_id, hub, score) or dicts with any field."""
    full = []
    for r in rows:
        r = r if isinstance(r, dict) else dict(zip(("node_id", "hub_name", "score"), r))
        d = dict(service=service, snapshot_ts=ts, host=f"h{r['node_id']}", port=1, biz_port=2, process_id=1, az="az", op=0,
                 is_alive=True, weight=1.0, score=100)
        d.update(r)
        full.append(tuple(d[f.split()[0]] for f in NODE_FIELDS.split(", ")))
    return spark.createDataFrame(full, NODE_FIELDS)


def hubs(spark, rows, service=S, ts=T):
    """rows of (hub, az, disallowed roles)."""
    return spark.createDataFrame(
        [(service, ts, *r) for r in rows], "service string, snapshot_ts bigint, hub_name string, az string, disallowed_roles array<int>")


def tables(spark, rows, service=S, ts=T):
    """rows of (table_id, parts_count, split_version, base_table)."""
    return spark.createDataFrame(
        [(service, ts, *r) for r in rows],
        "service string, snapshot_ts bigint, table_id bigint, parts_count bigint, split_version bigint, base_table bigint")


def members(spark, rows, service=S, ts=T):
    """rows of (table_id, partition_id, node_id, role[, version, split_version, restore_version])."""
    full = [(service, ts, *r, *(7, 0, 0)[len(r) - 4:]) for r in rows]
    return spark.createDataFrame(
        full, "service string, snapshot_ts bigint, table_id bigint, partition_id bigint, node_id bigint, role int, "
        "membership_version bigint, split_version bigint, restore_version bigint")


def facts(spark, rows, service=S, ts=T):
    """rows of (table_id, partition_id, node_id, role, version, ready, restore, cleanup, statistics)."""
    return spark.createDataFrame(
        [(service, ts, *r) for r in rows],
        "service string, snapshot_ts bigint, table_id bigint, partition_id bigint, node_id bigint, role int, membership_version bigint, "
        "ready_to_promote boolean, restore_version bigint, split_cleanup_version bigint, statistics map<string,string>")


def random_placement(seed, hub_count=5, parts=300):
    """Nodes, and members with one replica per hub and partition, hub 0 first as primary."""
    rng = random.Random(seed)
    node_rows, by_hub, nid = [], {}, 0
    for h in range(hub_count):
        by_hub[h] = []
        for _ in range(rng.randint(10, 40)):
            node_rows.append(dict(node_id=nid, hub_name=f"hub{h}", score=rng.randint(1, 200), op=2 if rng.random() < 0.05 else 0))
            by_hub[h].append(nid)
            nid += 1
    member_rows = [(1, p, rng.choice(by_hub[h]), 0 if h == 0 else 1) for p in range(parts) for h in range(hub_count)]
    return node_rows, member_rows
