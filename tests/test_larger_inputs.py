"""What larger tables broke: the whole job of a filter, many small files, state read and written once a row."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_filter_leaves_out_nodes_that_hold_excluded_members(spark, tmp_path):
    def put(name, data, ddl):
        spark.createDataFrame(data, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("region", [(0, "R")], "r_regionkey int, r_name string")
    put("nation", [(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("supplier", [(k, f"s{k}", 1, 10.0) for k in (1, 2, 4)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    put("part", [(1, "p", 50)], "p_partkey bigint, p_name string, p_size int")
    # Every node holds a primary; node 2 also a learner of quantity 1, node 4 one of quantity 2.
    held = [(1, 1, "A", 9.0), (2, 2, "A", 9.0), (3, 4, "A", 9.0), (4, 2, "R", 1.0), (5, 4, "R", 2.0)]
    put("lineitem", [(o, 1, n, 1, q, f) for o, n, f, q in held],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string")
    assert sorted(r.node_id for r in entry.queries()["filter_nodes"](spark, str(tmp_path)).collect()) == [1, 4]


def test_many_short_lists_are_written_by_several_tasks(spark, tmp_path):
    from shardlens.sources.sinks import read_checkpoint_list, write_checkpoint_list

    data = [(t, s, s, f"{s} /p {t}/{s}") for t in range(200) for s in (1, 2)] + [(None, 1, 1, "1 /none"), (7, 3, 3, "odd")]
    lines = spark.createDataFrame(data, "table_id bigint, start_sec bigint, session_id bigint, line string")
    for _ in range(2):  # the second time over what is there
        write_checkpoint_list(lines, str(tmp_path / "lists"))
    got = read_checkpoint_list(spark, str(tmp_path / "lists")).collect()
    key = lambda row: (row[0] is None, row)
    want = [(t, s, f"/p {t}/{s}") for t in range(200) for s in (1, 2)] + [(None, 1, "/none")]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({f.name for f in (tmp_path / "lists").glob("table_id=*/part-*")}) > 1


class _Kept:
    """A bucket's state and timers without a stream; counts how often the state is read and written."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock:
    def __init__(self, watermark, rung=None):
        self.watermark, self.rung = watermark, rung

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.rung


def test_a_bucket_of_keys_is_read_and_written_once_a_micro_batch():
    import random

    from pyspark.sql import Row
    from test_streams import brute_feed

    from shardlens.streaming import ordered
    from shardlens.streaming.stateful import _Feed

    rng, steps, end = random.Random(3), _Feed(5, 600), 3000
    steps.fields = ("version",)
    rows = [Row(t=t, at_sec=at, version=v) for t in range(20) for v, at in enumerate(rng.sample(range(1000, end), 30))]
    rows += [Row(t=t, at_sec=end, version=99) for t in range(20)] + [Row(t=1, at_sec=None, version=1), Row(t=None, at_sec=9999, version=1)]
    kept, got = _Kept(), []
    bucket = ordered._InOrder(steps, ["t"], "at_sec", ["t", "at", "version", "reason"])
    bucket.init(kept)
    for low, high in ((0, 1900), (1900, 10000)):
        before = kept.calls
        batch = [r for r in rows if r.at_sec is None or low <= r.at_sec < high]
        got += bucket.handleInputRows((0,), iter(batch), _Clock((low + ordered.AHEAD) * 1000))
        assert kept.calls - before <= 2 and len(kept.timers) == 1
    rung = kept.timers.pop()
    got += bucket.handleExpiredTimer((0,), _Clock((end + ordered.AHEAD) * 1000), _Clock(0, rung))
    want = [(t, *x) for t in range(20) for x in brute_feed(sorted((r.at_sec, r.version) for r in rows if r.t == t and r.at_sec))]
    assert sorted(map(tuple, got)) == sorted(want) and len(kept.timers) == 1


def test_large_tables_get_more_and_smaller_partitions(spark, tmp_path):
    from shardlens import session

    keys = (session.FIRST_PARTITIONS, session.MERGED_SIZE)
    state = lambda: [spark.conf.get(key, None) for key in keys]
    for name, size in (("small", 100), ("large", 40 * session.BYTES_A_PARTITION)):
        (tmp_path / name).mkdir()
        with (tmp_path / name / "t.parquet").open("wb") as f:
            f.truncate(size)
    before = state()
    session.widen(spark, str(tmp_path / "small"))
    assert state() == before
    session.widen(spark, str(tmp_path / "large"))
    assert state() == ["40", session.MERGED]
    session.widen(spark, str(tmp_path / "small"))
    assert state() == before
    spark.conf.set(keys[0], "17")  # somebody's own choice
    session.widen(spark, str(tmp_path / "large"))
    chosen = state()
    spark.conf.unset(keys[0])
    session.widen(spark, str(tmp_path / "small"))
    assert chosen[0] == "17" and state() == before


def test_a_grid_of_parts_is_never_broadcast(spark):
    from pyspark.sql import functions as F

    from shardlens.functions.ranking import part_grid

    tables = spark.range(10).select(F.col("id").alias("t"), F.lit(5000).cast("long").alias("parts_count"))
    held = spark.range(10**6).select((F.col("id") % 20).alias("t"), F.col("id").alias("pid"), (F.col("id") % 7).alias("node_id"))
    joined = part_grid(tables, "pid").drop("parts_count").join(held, ["t", "pid"], "left").filter("node_id is not null")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 250 * 10


def test_batches_run_in_the_callers_session(spark, tmp_path):
    from shardlens.session import FIRST_PARTITIONS, first_partitions
    from shardlens.streaming.runner import PARTITIONS, STORE_SETTING, _state_store, drain_batches, read_stream

    rows = spark.range(10)
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = read_stream(spark, str(tmp_path / "in"), rows.schema)
    drain_batches(stream, "session", lambda batch, i, out: seen.append((batch.sparkSession.conf.get("spark.sql.adaptive.enabled"), batch.count())), wide=True)
    assert seen == [("true", 10)]
    before = spark.conf.get(PARTITIONS), spark.conf.get(FIRST_PARTITIONS, None)
    spark.conf.set(FIRST_PARTITIONS, "37")
    try:
        assert first_partitions(spark) == 37
        with _state_store(spark, False, wide=True):
            assert spark.conf.get(PARTITIONS) == "37" and "RocksDB" in spark.conf.get(STORE_SETTING)
    finally:
        spark.conf.unset(FIRST_PARTITIONS) if before[1] is None else spark.conf.set(FIRST_PARTITIONS, before[1])
    assert spark.conf.get(PARTITIONS) == before[0] and "RocksDB" not in spark.conf.get(STORE_SETTING)


def test_nodes_alike_give_the_results_of_the_whole_list(spark):
    import random

    import fleet
    from shardlens.operators import placement as P

    rng = random.Random(8)
    # Hub a is longer than a stretch and its tables wrap around; some nodes of b have floors; node 5001 comes twice.
    node_rows = [dict(node_id=n, hub_name="a", score=rng.randint(1, 9), op=2 if n % 50 == 7 else 0) for n in range(600)]
    node_rows += [dict(node_id=5000 + n, hub_name="b", score=1 + 30 * (n % 2)) for n in range(9)] + [dict(node_id=5001, hub_name="b", score=3)]
    shapes = {t: rng.choice([1, 4, 40, 300]) for t in range(30)}
    ids = [n["node_id"] for n in node_rows]
    held = sorted({(t, rng.randrange(shapes[t]), rng.choice(ids)) for t in shapes for _ in range(40)})
    nodes = fleet.nodes(spark, node_rows).persist()
    hubs = fleet.hubs(spark, [("a", "z", []), ("b", "z", [])])
    tables = fleet.tables(spark, [(t, n, 0, None) for t, n in shapes.items()])
    members = fleet.members(spark, [(t, p, n, rng.randrange(3)) for t, p, n in held]).persist()
    profile = P.node_profile(nodes).persist()
    estimates = P.estimate_replicas(nodes, tables, profile).persist()
    got = lambda df: sorted(map(tuple, df.collect()))

    assert {(r.hub_name, r.table_id): r.n for r in estimates.selectExpr("*").groupBy("hub_name", "table_id").agg({"est": "sum"})
            .withColumnRenamed("sum(est)", "n").collect()} == {(h, t): n for h in "ab" for t, n in shapes.items()}
    whole, short = P.node_gaps(members, estimates, tables, nodes), P.node_gaps(members, None, tables, nodes, profile)
    assert short.count() * 2 < whole.count() == short.selectExpr("sum(alike)").first()[0]
    assert got(P.balance_report(members, None, tables, nodes, hubs, profile)) == got(P.balance_report(members, estimates, tables, nodes, hubs))
    assert got(P.load_extremes(members, None, tables, nodes, hubs, profile)) == got(P.load_extremes(members, estimates, tables, nodes, hubs))
    picks, need = P.add_candidates(tables, hubs, members, nodes, None, profile), got(P.add_candidates(tables, hubs, members, nodes, estimates))
    assert got(picks) == need and need


def test_restore_readiness_reads_members_once_and_counts_repeated_rows(spark, tmp_path):
    import random

    from shardlens.operators import progress as G

    rng = random.Random(5)
    some = lambda *of: rng.choice(of)
    tables = [(t, some(1, 2, 2, 0, None), some(0, 1, 2)) for t in range(40)] + [(3, 5, 1), (4, 1, 2), (None, 1, 1)]
    nodes = [(n, some("a", "b", "gone", None)) for n in range(8)] + [(1, "a"), (None, "b")]
    hubs = [("a",), ("b",), ("c",)]
    members = [(some(*range(45), None), some(0, 0, 1, 2, 1024, None), some(*range(9), None), some(0, 1, 1, 1, 2, None), some(0, 1, 2, None))
               for _ in range(120)]
    members += [(t, p, n, 1, 1) for t in (7, 8) for p in (0, 1) for n in range(8)] + [(9, 0, 0, 1, 1)] * 2
    facts = [(*m[:3], some(0, 1, 2, None)) for m in members for _ in range(some(0, 1, 1, 2))]
    frame = lambda data, ddl: spark.createDataFrame([("s", 1, *row) for row in data], "service string, snapshot_ts bigint, " + ddl)
    key = "table_id bigint, partition_id bigint, node_id bigint, "
    frame(members, key + "role int, restore_version bigint").write.parquet(str(tmp_path / "members"))
    out = G.restore_readiness(
        frame(tables, "table_id bigint, parts_count bigint, restore_version bigint"), spark.read.parquet(str(tmp_path / "members")),
        frame(facts, key + "restore_version bigint"), frame(nodes, "node_id bigint, hub_name string"), frame(hubs, "hub_name string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1

    def pairs(left, right, *at):  # an outer join in which null meets nothing
        return [r for r in right if None not in left and tuple(r[i] for i in at) == left] or [None]

    def expected(table):
        t, parts, _ = table
        cells, twins = {}, [x for x in tables if x[0] == t]
        for twin in twins:
            for m in (m for m in members if m[0] == t):
                for node in pairs(m[2:3], nodes, 0):
                    for fact in pairs(m[:3], facts, 0, 1, 2):
                        have, seen = m[4] or 0, fact and fact[3]
                        done = have >= twin[2] and seen is not None and seen >= have and m[3] == 1
                        cells.setdefault((node and node[1], m[1]), []).append((m[3] == 0, done))
        known = {c: r for c, r in cells.items() if (c[0],) in hubs}
        finished = {h: sum(d for c, r in known.items() if c[0] == h for _, d in r) for (h,) in hubs}
        open_hubs = [h for (h,) in hubs for x in twins if x[1] is not None and finished[h] < x[1]]
        if any(p for r in cells.values() for p, _ in r):
            state = "primary left"
        elif len(known) < len(cells):
            state = "outside hubs"
        else:
            single = sum(len(r) == 1 for r in known.values())
            state = "hub not single" if parts is not None and single < parts * len(hubs) else "ready"
        return t, state, min(open_hubs, default=None)

    want = [expected(t) for t in tables if t[0] is not None]
    assert len({s for _, s, _ in want}) == 4
    text = lambda rows: sorted(map(str, rows))
    assert text(map(tuple, out.select("table_id", "state", "next_hub").collect())) == text(want)


def test_newest_facts_read_no_column_that_is_not_asked_for(spark, tmp_path):
    import random

    import fleet
    from shardlens.operators.reconcile import latest
    from shardlens.schema import REPLICA_KEY
    from shardlens.streaming import facts as SF

    rng = random.Random(3)
    some = lambda *of: rng.choice(of)
    data = [(some(1, 2, None), some(0, 1), some(1, 2, 3), some(0, 1, 2), some(5, 6, 7, None), True, some(0, 1, None), 0, {"seq": "1"})
            for _ in range(200)]
    data += data[:20]
    fleet.facts(spark, data).write.parquet(str(tmp_path / "facts"))
    newest = latest(spark.read.parquet(str(tmp_path / "facts")), REPLICA_KEY, ["membership_version"])
    assert newest.columns == [*REPLICA_KEY, "role", "membership_version", "ready_to_promote", "restore_version", "split_cleanup_version", "statistics"]
    asked = newest.select(*REPLICA_KEY, "role", "membership_version", "restore_version")
    assert "statistics" not in asked._jdf.queryExecution().executedPlan().toString()
    want = {}
    low = lambda r: tuple((x is not None, x or 0) for x in (r[4], r[3], r[6]))
    for row in data:
        want[row[:3]] = max(want.get(row[:3], row), row, key=low)
    got = [(r.table_id, r.partition_id, r.node_id, r.membership_version, r.role, r.restore_version, r.statistics) for r in newest.collect()]
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(((*k, r[4], r[3], r[6], r[8]) for k, r in want.items()), key=key)
    # A compacted set is read as it is; with a batch after it the newest are picked again.
    out = str(tmp_path / "out")
    batch = spark.read.parquet(str(tmp_path / "facts")).withColumn("report_sec", F.lit(1).cast("long"))
    for i in range(3):
        SF._log_batch(batch.withColumn("report_sec", F.lit(i).cast("long")), i, out, SF.NEWEST, 2)
        shuffled = "Exchange" in SF._logged(spark, out, SF.NEWEST)._jdf.queryExecution().executedPlan().toString()
        assert shuffled == (i != 1) and {r.report_sec for r in SF._logged(spark, out, SF.NEWEST).collect()} == {i}
        assert SF._logged(spark, out, SF.NEWEST).count() == len(want)


def test_reports_are_built_from_facts_read_once(spark):
    from shardlens.plans.queries_streams import FIRST, SECOND, reported
    from shardlens.plans.views import FleetViews
    from shardlens.streaming.runner import WIDE_STATE, _state_store

    v = FleetViews(spark, "/root/testdata/sf0.001")
    rows = reported(v)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Window [row_number") == 1
    facts = v.facts.withColumn("report_sec", F.lit(FIRST).cast("long"))
    again = facts.filter("seq div 100 % 4 = 0")
    newer = facts.filter("seq div 100 % 4 = 1").withColumns({"membership_version": F.lit(7).cast("long"), "report_sec": F.lit(SECOND).cast("long")})
    want = facts.unionByName(again).unionByName(newer).withColumn("reported_at", F.timestamp_seconds("report_sec"))
    assert rows.columns == want.columns
    text = lambda df: sorted(map(str, df.collect()))
    assert text(rows) == text(want)
    with _state_store(spark, False, wide=True):
        assert {key: spark.conf.get(key) for key in WIDE_STATE} == WIDE_STATE
    assert all(spark.conf.get(key, None) is None for key in WIDE_STATE)
