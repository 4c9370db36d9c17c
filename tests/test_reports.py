import fleet
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shardlens.functions.ranking import id_bucket
from shardlens.operators import liveness as L
from shardlens.operators import progress as G
from shardlens.operators import reconcile as R
from shardlens.operators import routes as RT
from shardlens.operators import tasks as TK
from shardlens.operators import validate as V
from shardlens.schema import REPORTS_RAW
from shardlens.sources import kv, sinks
from shardlens.sources.pings import read_pings
from shardlens.sources.reports import accepted_facts, flatten_reports, read_memberships, read_reports


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def raw_report(spark):
    own = lambda role: Row(node_id="n1", host="h1", port=1, role=role, ready_to_promote=True, restore_version=2, split_cleanup_version=0, statistics={"seq": "5"})
    other = Row(node_id="n2", host="h2", port=1, role=0, ready_to_promote=False, restore_version=0, split_cleanup_version=0, statistics=None)
    info = lambda p, peers: Row(table_id=1, partition_id=p, membership_version=3, split_version=0, peers=peers)
    ok, bad = Row(code=0, message=""), Row(code=7, message="x")
    data = [("svc", 1, "n1", "h1", 1, {"cpu_percent": "100"}, [ok, bad, ok],
             [info(0, [other, own(1)]), info(1, [own(1)]), info(2, [other])])]
    return spark.createDataFrame(data, REPORTS_RAW)


def test_reports_keep_only_the_own_peer(spark, tmp_path):
    items, servers = flatten_reports(raw_report(spark))
    assert rows(items, "partition_id", "code", "has_own_peer") == [(0, 0, True), (1, 7, True), (2, 0, False)]
    assert rows(accepted_facts(items), "partition_id", "role", "restore_version") == [(0, 1, 2)]
    assert servers.count() == 1
    raw_report(spark).write.json(str(tmp_path / "r"))
    again, _ = read_reports(spark, str(tmp_path / "r"), "json")
    assert rows(again, "partition_id", "code", "has_own_peer") == rows(items, "partition_id", "code", "has_own_peer")


def test_memberships_default_their_restore_version(spark):
    stored = spark.createDataFrame(
        [("s", 1, 1, 0, '{"membership_version":4,"split_version":1,"peers":{"a":0,"b":2},"restore_version":{"b":9}}'), ("s", 1, 1, 1, "{nope")],
        "service string, snapshot_ts bigint, table_id bigint, partition_id bigint, value string")
    members, rejects = read_memberships(stored)
    assert rows(members, "node_id", "role", "restore_version") == [("a", 0, 0), ("b", 2, 9)]
    assert rows(rejects, "partition_id") == [(1,)]


def pings(spark, recs):
    return spark.createDataFrame(
        [("svc", r, f"grpc:{h}:9", 9, "x.zw", "", "DC1", p) for r, h, p in recs],
        "service string, round_no bigint, id string, port int, location string, paz string, dc string, payload string")


def payload(node, pid=1, biz=2, index=""):
    return f'{{"node_id":"{node}","process_id":{pid},"biz_port":{biz},"node_index":"{index}"}}'


def test_one_bad_record_voids_its_round(spark):
    raw = pings(spark, [
        (1, "a", payload("n1")), (1, "b", payload("n2")), (2, "a", payload("n1")), (2, "b", "junk"), (3, "a", payload("n1")), (3, "b", payload("n1")),
        (4, "a", payload("n1", pid=0))])
    hubs = fleet.hubs(spark, [("h", "ZW", [])], service="svc")
    none = spark.createDataFrame([], "service string, dc string")
    expected = spark.createDataFrame([("svc", r) for r in range(1, 6)], "service string, round_no bigint")
    out = read_pings(raw, hubs, none, expected=expected)
    assert rows(out.rounds, "round_no", "void") == [(1, False), (2, True), (3, True), (4, True), (5, True)]
    assert rows(out.pings, "round_no", "node_id", "host") == [(1, "n1", "a"), (1, "n2", "b")]
    assert rows(out.rejects, "round_no", "reason") == [(2, "no node_id"), (3, "duplicate node_id"), (3, "duplicate node_id"), (4, "no process_id")]


def test_index_conflicts_void_a_round_and_blacklists_pass_over(spark):
    raw = pings(spark, [(1, "a", payload("n1", index="0.1")), (1, "b", payload("n2", index="0.1")), (2, "a", payload("n1", index="0.1"))])
    hubs = fleet.hubs(spark, [("h", "ZW", [])], service="svc")
    none = spark.createDataFrame([], "service string, dc string")
    out = read_pings(raw, hubs, none, static_indexed=True)
    assert rows(out.rounds, "round_no", "void") == [(1, True), (2, False)]
    everywhere = spark.createDataFrame([("*", "DC1")], "service string, dc string")
    out = read_pings(raw, hubs, everywhere, static_indexed=True)
    assert out.pings.count() == 0 and rows(out.rounds, "void") == [(False,), (False,)]


def test_restart_takes_two_rounds(spark):
    seen = [(1, 10), (2, 10), (3, 11), (4, 12), (5, 12), (6, 13), (8, 13)]
    data = [("s", r, 1, pid, "h", 1, 1, "az") for r, pid in seen] + [("s", r, 2, 5, "h", 1, 1, "az") for r in range(1, 9)]
    p = spark.createDataFrame(data, "service string, round_no bigint, node_id bigint, process_id bigint, host string, port int, biz_port int, az string")
    out = [x for x in rows(L.liveness_changes(p, p), "node_id", "round_no", "change") if x[0] == 1]
    # Round 4 finds the node absent, so it is new whatever its process; 7 does not list it, but 6 had already killed it.
    assert out == [(1, 1, "new"), (1, 3, "restarted"), (1, 4, "new"), (1, 6, "restarted"), (1, 8, "new")]


def test_liveness_does_not_depend_on_buckets(spark):
    """Brute force round by round, on histories whose streaks of restarts cross the bounds of very small buckets."""
    rng, n = random.Random(12), 60
    data = []
    for node in range(12):
        pid, stay, gap = 1, rng.random(), rng.random() * 0.4
        for r in range(1, n + 1):
            pid += rng.random() > stay
            if rng.random() > gap:
                data.append(("s", r * 2, node, pid, f"h{rng.random() < 0.1}", 1, 1, f"az{rng.random() < 0.1}"))
    want, at = [], {(d[2], d[1] // 2): d for d in data}
    for node in range(12):
        active, before = False, None
        for r in range(1, n + 1):
            now, change = at.get((node, r)), None
            if now is None:
                change = "vanished" if active else None
                active = False
            elif not active:
                change, active = "new", True
            elif now[3] != before[3]:
                change, active = "restarted", False
            elif now[4:7] != before[4:7]:
                change = "changed"
            if change:
                moved = now is not None and before is not None and now[7] != before[7]
                want.append(("s", r * 2, node, change, moved, (now or before)[3]))
            before = now
    p = spark.createDataFrame(data, "service string, round_no bigint, node_id bigint, process_id bigint, host string, port int, biz_port int, az string")
    for width in (1, 2, 7, 4096):
        assert sorted(map(tuple, L.liveness_changes(p, p, width).collect())) == sorted(want)


def test_recovery_drops_unknown_and_demotes_dead(spark):
    nodes = fleet.nodes(spark, [dict(node_id=1, hub_name="a"), dict(node_id=2, hub_name="a", is_alive=False)])
    routes = spark.createDataFrame(
        [("svc", 1, 1, 0, 9, 0, 0), ("svc", 1, 1, 0, 9, 1, 1), ("svc", 1, 1, 0, 9, 2, 1), ("svc", 1, 1, 1, 7, 0, 0)],
        "service string, snapshot_ts bigint, table_id bigint, partition_id bigint, version bigint, server_index bigint, role int")
    servers = spark.createDataFrame([("svc", 1, i, f"h{i + 1}", 1) for i in range(3)], "service string, snapshot_ts bigint, server_index bigint, host string, port int")
    kept = fleet.members(spark, [(1, 1, 1, 0, 7)])
    out = RT.recover_membership(routes, servers, kept, nodes)
    assert rows(out, "partition_id", "node_id", "role", "membership_version") == [(0, 1, 0, 11), (0, 2, 2, 11)]


def test_restore_readiness(spark):
    tables = fleet.tables(spark, [(1, 2, 0, None), (2, 1, 0, None), (3, 1, 0, None)]).selectExpr("*", "cast(3 as bigint) restore_version")
    nodes = fleet.nodes(spark, [(1, "a", 1), (2, "b", 1), (9, "gone", 1)])
    hubs = fleet.hubs(spark, [("a", "az", []), ("b", "az", [])])
    members = fleet.members(spark, [
        (1, 0, 1, 1, 7, 0, 3), (1, 1, 1, 1, 7, 0, 3), (1, 0, 2, 1, 7, 0, 3), (1, 1, 2, 2, 7, 0, 3), (2, 0, 1, 0), (3, 0, 9, 1), (3, 0, 1, 1), (3, 0, 2, 1)])
    facts = fleet.facts(spark, [(1, p, n, 1, 7, True, 3, 0, {}) for p in (0, 1) for n in (1, 2)])
    out = G.restore_readiness(tables, members, facts, nodes, hubs)
    assert rows(out, "table_id", "state", "next_hub") == [(1, "ready", "b"), (2, "primary left", "a"), (3, "outside hubs", "a")]


@pytest.mark.parametrize("kind,role,ready,stats,want", [
    ("standard", 2, True, {}, 1), ("standard", 2, False, {}, None), ("standard", 2, True, {"unavailable": ""}, None),
    ("standard", 1, False, {"unavailable": ""}, 2), ("standard", 0, False, {"unavailable": ""}, 2),
    ("schema_versioned", 1, False, {"schema_changing": "true"}, 2), ("schema_versioned", 2, False, {"schema_changing": "false"}, 1),
    ("schema_versioned", 2, True, {}, 1), ("someday", 2, True, {}, 1),
])
def test_role_rules(spark, kind, role, ready, stats, want):
    nodes = fleet.nodes(spark, [(1, "a", 1)])
    out = R.passive_role_targets(
        fleet.members(spark, [(1, 0, 1, role)]), fleet.facts(spark, [(1, 0, 1, role, 7, ready, 0, 0, stats)]), nodes,
        fleet.tables(spark, [(1, 1, 0, None)]), kind)
    assert rows(out, "target") == ([] if want is None else [(want,)])


@pytest.mark.parametrize("seqs,restoring,want", [
    # (role, seq) of nodes 1..n; node 1 is the learner judged.
    ([(2, 100), (0, 1099)], False, [(1, 1)]), ([(2, 100), (0, 1100)], False, []), ([(2, None), (0, 5)], False, []),
    ([(2, 100), (1, 200), (1, 50)], False, [(1, 1)]), ([(2, 100), (1, 200), (1, 300)], False, []),
    ([(2, 100), (1, 200), (1, 300)], True, [(1, 1)]), ([(2, 100), (1, None)], False, []),
])
def test_log_based_learner(spark, seqs, restoring, want):
    nodes = fleet.nodes(spark, [(i + 1, "a", 1) for i in range(len(seqs))])
    members = fleet.members(spark, [(1, 0, i + 1, r) for i, (r, _) in enumerate(seqs)])
    facts = fleet.facts(spark, [(1, 0, i + 1, r, 7, True, 0, 0, {} if s is None else {"seq": str(s)}) for i, (r, s) in enumerate(seqs)])
    tables = fleet.tables(spark, [(1, 1, 0, None)])
    out = R.passive_role_targets(members, facts, nodes, tables, "log_based", tables if restoring else None)
    assert [x for x in rows(out, "node_id", "target") if x[0] == 1] == want


def test_switch_needs_no_guard_by_default(spark):
    facts = fleet.facts(spark, [(1, 0, 1, 0, 7, True, 0, 0, {}), (1, 0, 2, 1, 7, True, 0, 0, {})])
    assert rows(R.primary_switch_safe(facts, guarded=False), "safe") == [(True,)]
    assert rows(R.primary_switch_safe(facts), "safe") == [(False,)]


def test_restorable_needs_every_region(spark):
    tables = fleet.tables(spark, [(1, 2, 0, None), (2, 1, 0, None)])
    full = [("FILE", "done"), ("DIRECTORY", "part_0"), ("DIRECTORY", "part_1"), ("DIRECTORY", "part_x"), ("FILE", "part_7")]
    data = [("svc", 1, 1, "/p", r, *x) for r in ("R1", "R2") for x in full] + [("svc", 1, 2, "/q", "R1", "FILE", "done"), ("svc", 1, 2, "/q", "R1", "DIRECTORY", "part_0")]
    listing = spark.createDataFrame(data, "service string, snapshot_ts bigint, table_id bigint, path string, region string, type string, suffix string")
    regions = spark.createDataFrame([("svc", "R1"), ("svc", "R2")], "service string, region string")
    assert rows(TK.restorable_checkpoints(listing, tables, regions), "table_id", "missing_parts", "restorable") == [(1, 0, True), (2, 0, False)]


def test_retention_drops_cancelled_ones_that_are_old(spark):
    runs = spark.createDataFrame(
        [("s", 1, 1, i, i * 10, i * 10 + 1, st) for i, st in enumerate([1, 0, 1, 0, 0, None])],
        "service string, snapshot_ts bigint, task_id bigint, session_id bigint, start_sec bigint, finish_sec bigint, finish_status int")
    task = lambda keep: spark.createDataFrame([("s", 1, 1, keep)], "service string, snapshot_ts bigint, task_id bigint, keep_nums bigint")
    dropped = lambda keep: [x[0] for x in rows(TK.retention(runs, task(keep)), "session_id")]
    assert (dropped(2), dropped(1), dropped(3), dropped(0), dropped(-1)) == ([0, 1], [0, 1, 2, 3], [], [0, 1, 2, 3, 4], [])


def test_retention_of_a_dense_history(spark):
    """A hot task with 6,000 runs inside a few minutes, several a second, beside sparse ones: the cut as by sorting."""
    data = [("s", 1, 1, i, 10**9 + i * 7919 % 6000 // 25, i % 3 // 2) for i in range(6000)]
    data += [("s", 1, t, i, i * 10**7, 0) for t in (2, 3) for i in range(4)]
    runs = spark.createDataFrame(data, "service string, snapshot_ts bigint, task_id bigint, session_id bigint, start_sec bigint, finish_status int")
    keeps = {1: 1500, 2: 1, 3: 9}
    tasks = spark.createDataFrame([("s", 1, t, k) for t, k in keeps.items()], "service string, snapshot_ts bigint, task_id bigint, keep_nums bigint")
    want = set()
    for task, keep in keeps.items():
        mine = [(start, session, status) for *_, t, session, start, status in data if t == task]
        done = sorted(x[:2] for x in mine if x[2] == 0)
        if len(done) > keep:
            cut = done[len(done) - keep - 1]
            want |= {(task, session) for start, session, _ in mine if (start, session) <= cut}
    got = [tuple(r) for r in TK.retention(runs, tasks).select("task_id", "session_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    bucketed = runs.withColumn("b", id_bucket(runs, "start_sec", "session_id", named_by=TK.TASK_KEY))
    assert bucketed.groupBy("task_id", "b").count().agg({"count": "max"}).first()[0] < 200


def test_order_of_shades(spark):
    tables = fleet.tables(spark, [(1, 1, 0, None), (2, 1, 0, 1), (3, 1, 0, 2), (4, 1, 0, 5), (5, 1, 0, 4), (6, 1, 0, 5), (7, 1, 0, 99), (8, 1, 0, 7)])
    out = V.topological_table_order(tables)
    assert rows(out, "table_id", "depth") == [(1, 0), (2, 1), (3, 2), (4, -1), (5, -1), (6, -1), (7, -1), (8, -1)]


def test_kv_dump_survives_a_round_trip(spark, tmp_path):
    data = spark.createDataFrame([("/a", bytearray(b"x y")), ("/a/b", bytearray(b"")), ("/a/b/c", bytearray(b"\x00\xff"))], "path string, value binary")
    kv.write_kv_dump(data, str(tmp_path / "kv"), "/a")
    back = kv.reroot(kv.read_kv_dump(spark, str(tmp_path / "kv")), "/z/w")
    assert sorted((r.path, bytes(r.value)) for r in back.collect()) == [("/z/w", b"x y"), ("/z/w/b", b""), ("/z/w/b/c", b"\x00\xff")]


def test_kv_dump_knows_its_root(spark, tmp_path):
    data = spark.createDataFrame([(p, bytearray(b"1")) for p in ("/a", "/a/b", "/ab", "/c", "/c/d e")], "path string, value binary")
    for root in ("/a", "/c", "/"):
        kv.write_kv_dump(data, str(tmp_path / "two" / (root.strip("/") or "top")), root)
    both = [str(tmp_path / "two" / name) for name in ("a", "c")]
    paths = lambda df: sorted(r.path for r in df.collect())
    assert [paths(kv.reroot(kv.read_kv_dump(spark, p), "/z")) for p in both] == [["/z", "/z/b"], ["/z", "/z/d e"]]
    with pytest.raises(ValueError, match="top: dump without its root /"):
        kv.read_kv_dump(spark, str(tmp_path / "two" / "top"))
    # Files from elsewhere: the first line is the root, each file has its own.
    for name, lines in (("one", ["/x/y 01", "/x/y/z 02"]), ("two", ["/x 03", "/x/q 04"])):
        (tmp_path / "foreign").mkdir(exist_ok=True)
        (tmp_path / "foreign" / name).write_text("\n".join(lines) + "\n")
    assert paths(kv.reroot(kv.read_kv_dump(spark, str(tmp_path / "foreign")), "/n")) == ["/n", "/n", "/n/q", "/n/z"]
    assert paths(kv.reroot(kv.read_kv_dump(spark, str(tmp_path / "foreign" / "two"), "/x"), "/n")) == ["/n", "/n/q"]
    with pytest.raises(ValueError, match="two: dump without its root /nowhere"):
        kv.read_kv_dump(spark, str(tmp_path / "foreign" / "two"), "/nowhere")
    (tmp_path / "headless").write_text("/x/a 01\n/x/b 02\n")
    with pytest.raises(Exception, match="headless: dump without its root"):
        kv.read_kv_dump(spark, str(tmp_path / "headless")).collect()


def test_routes_reach_every_target_that_works(spark, tmp_path):
    tables, members = fleet.tables(spark, [(1, 3, 0, None)]), fleet.members(spark, [(1, 0, 1, 0), (1, 0, 2, 1), (1, 2, 3, 0)])
    nodes, hubs = fleet.nodes(spark, [(1, "a", 1), (2, "b", 1), (3, "nohub", 1)]), fleet.hubs(spark, [("a", "az", []), ("b", "az", [])])
    servers = RT.route_servers(nodes, hubs)
    assert rows(servers, "node_id", "server_index", "hub_id") == [(1, 0, 0), (2, 1, 1)]
    routes = RT.build_routes(tables, members, RT.route_replicas(members, servers, fleet.facts(spark, [(1, 0, 1, 0, 7, True, 0, 0, {})])))
    assert [(r.partition_id, [tuple(x) for x in r.replicas]) for r in routes.orderBy("partition_id").collect()] == [(0, [(0, 0), (1, 1)]), (1, []), (2, [])]
    good, old = str(tmp_path / "good"), str(tmp_path / "old")
    sinks.write_routes(routes, [old], 0)
    blocked = tmp_path / "file"
    blocked.write_text("in the way")
    result = sinks.write_routes(routes, [f"{blocked}/x", good], 1, previous=[old])
    assert result.written == [good] and result.removed == [old] and result.error and str(blocked) in result.error
    assert sinks.read_routes(spark, good).count() == 3 and not (tmp_path / "old").exists()


def test_checkpoint_list_and_listing(spark, tmp_path):
    lines = spark.createDataFrame([(t, s * 10, s, f"{s} /p/{s}") for t in (1, 2) for s in range(5)], "table_id bigint, start_sec bigint, session_id bigint, line string")
    sinks.write_checkpoint_list(lines, str(tmp_path / "lists"))
    got = [line for f in sorted((tmp_path / "lists" / "table_id=1").glob("part-*")) for line in f.read_text().split("\n") if line]
    assert got == [f"{s} /p/{s}" for s in range(5)]
    base = tmp_path / "ck" / "table_5" / "1_2"
    (base / "part_0").mkdir(parents=True)
    (base / "part_0" / "data").write_text("x")
    (base / "done").write_text("")
    found = spark.createDataFrame([("s", 1, 5, str(base))], "service string, snapshot_ts bigint, table_id bigint, path string")
    listing = sinks.list_checkpoints(found, "R")
    assert rows(listing, "table_id", "type", "suffix") == [(5, "DIRECTORY", "part_0"), (5, "FILE", "done")]


def test_own_rules_may_ask_for_removal(spark):
    from shardlens.schema import INVALID_ROLE

    nodes = fleet.nodes(spark, [(1, "a", 100), (2, "a", 100)])
    members = fleet.members(spark, [(1, 0, 1, 0), (1, 0, 2, 1)])
    facts = fleet.facts(spark, [(1, 0, 1, 0, 7, True, 0, 0, {}), (1, 0, 2, 1, 7, True, 0, 0, {"retired": "true"})])
    tables = fleet.tables(spark, [(1, 1, 0, None)])
    retired = lambda: F.when(F.element_at("statistics", F.lit("retired")) == "true", INVALID_ROLE).otherwise(F.col("role"))
    out = R.passive_role_targets(members, facts, nodes, tables, "retiring", rules={"retiring": retired}).collect()
    assert [(r.node_id, r.target, r.action) for r in out] == [(2, INVALID_ROLE, "remove")]
