import random
from collections import defaultdict

import fleet
import pytest
from pyspark.sql import functions as F

from shardlens.operators import nodes as N
from shardlens.operators import placement as P
from shardlens.schema import OFFLINE


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 7])
def test_estimates_keep_their_invariants(spark, seed):
    node_rows, _ = fleet.random_placement(seed)
    tables = [(t, parts, 0, None) for t, parts in ((1, 256), (2, 7), (3, 1279), (13, 256))] + [(20, 7, 0, 2)]
    est = P.estimate_replicas(fleet.nodes(spark, node_rows), fleet.tables(spark, tables)).collect()
    live = [n for n in node_rows if n["op"] != OFFLINE]
    score, hub = {n["node_id"]: n["score"] for n in live}, {n["node_id"]: n["hub_name"] for n in live}
    total = defaultdict(int)
    for n in live:
        total[n["hub_name"]] += n["score"]
    got = {(r.table_id, r.node_id): r.est for r in est}
    assert len(got) == len(est)
    for t, parts, *_ in tables:
        for h in total:
            assert sum(e for (tt, n), e in got.items() if tt == t and hub[n] == h) == parts
        for n in score:
            floor = score[n] * parts // total[hub[n]]
            assert got.get((t, n), 0) in (floor, floor + 1)
    # A shade is shared out like its base.
    assert {n: e for (t, n), e in got.items() if t == 20} == {n: e for (t, n), e in got.items() if t == 2}


def test_looked_up_estimates_equal_listed_ones(spark):
    node_rows, member_rows = fleet.random_placement(3)
    nodes, tables = fleet.nodes(spark, node_rows), fleet.tables(spark, [(1, 300, 0, None)])
    listed = {r.node_id: r.est for r in P.estimate_replicas(nodes, tables).collect()}
    held = P.held_load(fleet.members(spark, member_rows), tables, P.node_profile(nodes)).collect()
    assert held and all(r.est == listed.get(r.node_id, 0) for r in held)


def test_hub_without_scores_voids_its_scope(spark):
    nodes = fleet.nodes(spark, [(1, "a", 0), (2, "b", 5)]).unionByName(fleet.nodes(spark, [(3, "c", 5)], service="other"))
    tables = fleet.tables(spark, [(1, 4, 0, None)]).unionByName(fleet.tables(spark, [(1, 4, 0, None)], service="other"))
    assert rows(P.estimate_replicas(nodes, tables), "service", "node_id", "est") == [("other", 3, 4)]


def test_primaries_are_shared_by_score(spark):
    # Scores 2:1:1 and four primaries, all on the last node: it has two too many for its share of one... of three others.
    nodes = fleet.nodes(spark, [(1, "a", 200), (2, "b", 100), (3, "b", 100)])
    hubs = fleet.hubs(spark, [("a", "az", []), ("b", "az", [])])
    members = fleet.members(spark, [(1, p, 3, 0) for p in range(4)] + [(1, p, 1, 1) for p in range(4)] + [(1, p, 2, 1) for p in range(4)])
    out = P.primary_imbalance(members, nodes, hubs)
    assert rows(out, "node_id", "primaries", "target", "surplus") == [(1, 0, 2, -2), (2, 0, 1, -1), (3, 4, 1, 3)]
    switches = P.direct_switches(P.primary_switch_edges(members), out)
    assert rows(switches, "primary_node", "secondary_node", "partitions") == [(3, 1, 4), (3, 2, 4)]


def test_remainder_raises_every_share(spark):
    nodes = fleet.nodes(spark, [(1, "a", 100), (2, "a", 100)])
    hubs = fleet.hubs(spark, [("a", "az", [])])
    members = fleet.members(spark, [(1, 0, 1, 0), (1, 1, 2, 0), (1, 2, 1, 0)])
    assert rows(P.primary_imbalance(members, nodes, hubs), "node_id", "target") == [(1, 2), (2, 2)]


def test_forbidden_hub_has_no_share(spark):
    nodes = fleet.nodes(spark, [(1, "a", 100), (2, "b", 100)])
    hubs = fleet.hubs(spark, [("a", "az", []), ("b", "az", [0])])
    members = fleet.members(spark, [(1, 0, 2, 0), (1, 0, 1, 1)])
    assert rows(P.primary_imbalance(members, nodes, hubs), "node_id", "surplus") == [(1, -1), (2, 1)]


def test_partitions_nobody_holds_are_abnormal(spark):
    out = P.abnormal_partitions(fleet.members(spark, [(1, 0, 1, 0), (1, 1, 1, 2)]), fleet.tables(spark, [(1, 5, 0, None), (2, 3, 0, None)]))
    assert rows(out, "table_id", "abnormal_count", "learner_count") == [(1, 4, 1), (2, 3, 0)]


def test_nodes_without_replicas_appear_in_the_brief(spark):
    nodes = fleet.nodes(spark, [(1, "a", 100), (2, "a", 100)])
    facts = fleet.facts(spark, [(1, 0, 1, 0, 7, True, 0, 0, {})])
    out = P.node_brief(nodes, facts, fleet.tables(spark, [(1, 2, 0, None)]), ordered=True)
    assert rows(out, "node_id", "primaries", "total", "estimated") == [(1, 1, 1, 1), (2, 0, 0, 1)]


def brute_shrink(node_rows, new_size):
    """The loop itself: from the largest hub, dead first, restarting next, whole hosts."""
    by_hub = defaultdict(list)
    for n in node_rows:
        if n["op"] != OFFLINE:
            by_hub[n["hub_name"]].append(n)
    gone, count = set(), sum(map(len, by_hub.values()))
    while count > new_size:
        hub = min(by_hub, key=lambda h: (-len(by_hub[h]), h))
        first = min(by_hub[hub], key=lambda n: (n["is_alive"], n["op"] != 1, n["node_id"]))
        out = [n for n in by_hub[hub] if n["host"] == first["host"]]
        by_hub[hub] = [n for n in by_hub[hub] if n["host"] != first["host"]]
        gone |= {n["node_id"] for n in out}
        count -= len(out)
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_shrink_equals_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    node_rows = [
        dict(node_id=i, hub_name=f"h{rng.randint(0, 2)}", op=rng.choice([0, 0, 0, 1, 2]), is_alive=rng.random() < 0.8) for i in range(40)]
    for n in node_rows:
        n["host"] = f"{n['hub_name']}-{rng.randint(0, 7)}"
    hubs = fleet.hubs(spark, [(f"h{i}", "az", []) for i in range(3)])
    target = spark.createDataFrame([(fleet.S, fleet.T, "az", 13)], "service string, snapshot_ts bigint, az string, new_size bigint")
    got = {r.node_id for r in N.shrink_by_load(fleet.nodes(spark, node_rows), hubs, target).collect()}
    assert got == brute_shrink(node_rows, 13)


def test_idle_node_is_found_by_position(spark):
    # Node 1 is overloaded, nodes 2 and 3 hold nothing of the table and have no estimate for it (its share is one slot).
    nodes = fleet.nodes(spark, [(1, "a", 9000), (2, "a", 1), (3, "a", 1), (4, "b", 1)])
    hubs = fleet.hubs(spark, [("a", "az", []), ("b", "az", [])])
    tables = fleet.tables(spark, [(3, 2, 0, None)])
    members = fleet.members(spark, [(3, 0, 1, 0), (3, 0, 2, 1), (3, 0, 3, 1)])
    est = P.estimate_replicas(nodes, tables)
    out = P.add_candidates(tables, hubs, members, nodes, est)
    by_hub = {r.hub_name: (r.missing, r.node_id, r.gap) for r in out.collect()}
    assert by_hub["b"] == (2, 4, 2)
    want = {r.node_id: r.est for r in est.collect()}
    gaps = sorted(((-(want.get(n, 0) - 1)), n) for n in (1, 2, 3))
    assert by_hub["a"] == (1, gaps[0][1], -gaps[0][0])


def test_slots_cover_every_partition_once(spark):
    node_rows, _ = fleet.random_placement(5)
    nodes, tables = fleet.nodes(spark, node_rows), fleet.tables(spark, [(1, 120, 0, None)])
    groups = spark.createDataFrame([(fleet.S, fleet.T, 1, 120, 6)], "service string, snapshot_ts bigint, table_id bigint, parts_count bigint, part_groups bigint")
    out = P.capacity_range_assign(P.estimate_replicas(nodes, tables), groups).collect()
    seen = defaultdict(list)
    for r in out:
        seen[r.hub_name].append(r.partition_id)
    assert len(seen) == 5 and all(sorted(p) == list(range(120)) for p in seen.values())


def test_scopes_do_not_mix(spark):
    """Two services and two snapshots at once give what each gives alone."""
    parts = []
    for i, (svc, ts) in enumerate([("a", 1), ("b", 2)]):
        node_rows, member_rows = fleet.random_placement(10 + i, hub_count=3, parts=60)
        parts.append((
            fleet.nodes(spark, node_rows, svc, ts), fleet.hubs(spark, [(f"hub{h}", "az", [0] if h == 2 else []) for h in range(3)], svc, ts),
            fleet.tables(spark, [(1, 60, 0, None)], svc, ts), fleet.members(spark, member_rows, svc, ts)))

    def union(k):
        out = parts[0][k]
        for p in parts[1:]:
            out = out.unionByName(p[k])
        return out

    def results(nodes, hubs, tables, members):
        profile = P.node_profile(nodes).persist()
        est = P.estimate_replicas(nodes, tables, profile).persist()
        load = P.held_load(members, tables, profile).persist()
        yield est
        yield P.primary_imbalance(members, nodes, hubs)
        yield P.load_extremes(members, est, tables, nodes, hubs)
        yield P.add_candidates(tables, hubs, members, nodes, est)
        yield P.remove_candidates(members, nodes, hubs, load)
        yield P.missing_hub_cells(tables, hubs, members, nodes)
        yield N.node_order(nodes)

    together = [sorted(map(str, df.collect())) for df in results(*(union(k) for k in range(4)))]
    alone = [[] for _ in together]
    for p in parts:
        for i, df in enumerate(results(*p)):
            alone[i] += map(str, df.collect())
    assert together == [sorted(a) for a in alone]


def test_range_assignment_follows_the_index_and_skips_unready_hubs(spark):
    nodes = fleet.nodes(spark, [(1, "a", 100), (2, "a", 100), (3, "b", 100), (4, "b", 0)])
    nodes = nodes.withColumn("node_index", F.when(F.col("node_id") == 2, "0").otherwise("1"))
    hubs = fleet.hubs(spark, [("a", "az", []), ("b", "az", [])])
    groups = fleet.tables(spark, [(1, 4, 0, None)]).withColumn("part_groups", F.lit(2).cast("long"))
    est = P.estimate_replicas(nodes, groups)
    out = rows(P.capacity_range_assign(est, groups, nodes, hubs), "hub_name", "partition_id", "node_id")
    assert out == [("a", 0, 2), ("a", 1, 1), ("a", 2, 2), ("a", 3, 1)]


def test_removals_of_a_shade_leave_a_serving_replica(spark):
    rng = random.Random(8)
    nodes = fleet.nodes(spark, [(n, f"hub{n % 2}", 100) for n in range(8)])
    hubs = fleet.hubs(spark, [("hub0", "az", []), ("hub1", "az", [])])
    side = lambda: [(1, p, n, rng.choice([0, 1, 1, 2])) for p in range(60) for n in range(8) if rng.random() < 0.4]
    base, shade = side(), side()
    got = P.shade_placement_diff(fleet.members(spark, base), fleet.members(spark, shade), nodes, hubs).collect()
    gone = {(r.partition_id, r.node_id) for r in got if r.change == "remove"}
    waits = {(r.partition_id, r.hub_name) for r in got if r.change == "add"}
    assert gone and not any((p, f"hub{n % 2}") in waits for p, n in gone)
    serving = lambda drop: {(p, n % 2) for _, p, n, role in shade if role < 2 and (p, n) not in drop}
    assert serving(gone) == serving(set())


def test_receivers_of_equal_nodes_are_spread(spark):
    from shardlens.operators import tasks as TK

    nodes = fleet.nodes(spark, [(n, "hub", 100) for n in range(4)])
    hubs = fleet.hubs(spark, [("hub", "az", [])])
    members = fleet.members(spark, [(1, p, n, 1) for p in range(80) for n in range(4)])
    tables = fleet.tables(spark, [(1, 80, 0, None)])
    known = nodes.withColumn("az", F.lit(first_az(spark)))
    out = TK.task_receivers(members, known, hubs.withColumn("az", F.lit(first_az(spark))), tables, "every_region")
    counts = [r["count"] for r in out.groupBy("node_id").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1


def first_az(spark):
    from shardlens.schema import az_dimension

    return az_dimension(spark).agg(F.min("az")).first()[0]


def test_finished_receivers_leave_and_running_ones_keep_their_slot(spark):
    from shardlens.operators import tasks as TK

    rows_in = [("svc", 1, 1, p, n, f"hub{n}", 100 if n == 0 else 10, n == 3) for p in range(3) for n in range(4)]
    schema = "service string, snapshot_ts bigint, table_id bigint, partition_id bigint, node_id bigint, hub_name string, progress bigint, running boolean"
    out = TK.concurrency_slice(spark.createDataFrame(rows_in, schema), max_hubs=2, max_nodes=2, max_per_node=1)
    assert rows(out, "node_id", "partition_id") == [(1, 0), (3, 0)]


def test_the_callers_session_settings_stay(spark):
    from shardlens.session import tune

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tune(spark)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo" and spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hub_columns_lose_no_replica(spark):
    nodes = fleet.nodes(spark, [(1, "a", 100), (2, "b", 100)])
    out = P.placement_by_hub(fleet.members(spark, [(1, 0, 1, 0), (1, 0, 2, 1)]), nodes, ["a"]).collect()
    assert [(r.a, r.other) for r in out] == [("P:h1:1", "b/S:h2:1")]


def test_estimates_per_node_equal_the_list(spark):
    node_rows, _ = fleet.random_placement(11)
    nodes = fleet.nodes(spark, node_rows)
    rng = random.Random(12)
    tables = fleet.tables(spark, [(t, rng.choice([1, 3, 7, 64, 500]), 0, t - 1 if t % 5 == 4 else None) for t in range(60)])
    want = P.estimate_replicas(nodes, tables).groupBy("node_id").agg(F.sum("est").alias("e"))
    assert rows(P.estimated_by_node(tables, P.node_profile(nodes)), "node_id", "estimated") == rows(want, "node_id", "e")


def test_text_ids_with_a_common_prefix_are_numbered_in_small_buckets(spark):
    from shardlens.functions.ranking import id_bucket, numbered, part_grid

    ids = [f"node_{n}" for n in range(20_000)]
    df = spark.createDataFrame([("s", i) for i in ids], "service string, node_id string")
    bucketed = df.withColumn("_b", id_bucket(df))
    assert bucketed.groupBy("_b").count().agg(F.max("count")).first()[0] <= 1000
    got = [r.node_id for r in numbered(bucketed, ["service"], ["_b"], ["node_id"]).orderBy("rn").collect()]
    assert got == sorted(ids)
    grid = part_grid(spark.createDataFrame([(1, 10_000), (2, 0), (3, 1)], "t int, parts_count long"), "pid")
    assert rows(grid.groupBy("t").agg(F.count("*").alias("n"), F.max("pid").alias("m")), "t", "n", "m") == [(1, 10_000, 9_999), (3, 1, 0)]


@pytest.mark.parametrize(
    "name, ids",
    [
        ("one odd id", [f"node_{n:06d}" for n in range(20_000)] + ["x1"]),
        ("sparse numbers", [n * n * 1_000_003 for n in range(20_000)]),
        ("all begin alike, then by length", ["a" * (n % 500) + str(n) for n in range(20_000)]),
    ],
)
def test_buckets_of_ids_are_even_whatever_the_ids_look_like(spark, name, ids):
    """No window group holds more than a few times its share, neither the buckets nor the list of their totals."""
    from shardlens.functions.ranking import BUCKETS, id_bucket, numbered

    kind = "long" if isinstance(ids[0], int) else "string"
    shuffled = random.Random(4).sample(ids, len(ids))
    df = spark.createDataFrame([("s", i) for i in shuffled], f"service string, node_id {kind}").repartition(8)
    bucketed = df.withColumn("_b", id_bucket(df))
    largest, buckets = bucketed.groupBy("_b").count().agg(F.max("count"), F.count("*")).first()
    assert largest <= 4 * len(ids) / BUCKETS and buckets <= BUCKETS
    got = [r.node_id for r in numbered(bucketed, ["service"], ["_b"], ["node_id"]).orderBy("rn").collect()]
    assert got == sorted(ids)


def test_profile_numbers_unique_and_missing_indexes_exactly(spark):
    """Indexes of their own, ties and nulls (first) within a hub, in buckets of (index, id)."""
    rng = random.Random(9)
    node_rows, _ = fleet.random_placement(9)
    live = [n for n in node_rows if n["op"] != OFFLINE]
    index = {n["node_id"]: rng.choice([None, 3, rng.randrange(10**9)]) for n in node_rows}
    known = spark.createDataFrame(list(index.items()), f"node_id {fleet.nodes(spark, node_rows).schema['node_id'].dataType.simpleString()}, node_index long")
    base = fleet.nodes(spark, node_rows)
    nodes = base.drop("node_index").join(known, "node_id")
    got = {r.node_id: r.rn for r in P.node_profile(nodes).collect()}
    want = {}
    for hub in {n["hub_name"] for n in live}:
        mine = [n["node_id"] for n in live if n["hub_name"] == hub]
        mine.sort(key=lambda i: (index[i] is not None, index[i] or 0, i))
        want |= {i: k for k, i in enumerate(mine, 1)}
    assert got == want


def test_an_empty_list_of_ids_has_no_buckets(spark):
    from shardlens.functions.ranking import id_bucket, numbered

    df = spark.createDataFrame([], "service string, node_id string")
    assert numbered(df.withColumn("_b", id_bucket(df)), ["service"], ["_b"], ["node_id"]).count() == 0
