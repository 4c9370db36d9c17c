import random

import pytest
from pyspark.sql import functions as F

from shardlens.streaming import stateful as ST
from shardlens.streaming.runner import STORE_SETTING, close_input, drain, drain_batches, read_stream


def stream_of(spark, tmp_path, data, schema, files=1, closing=None):
    """One parquet file per chunk, so that the stream takes several micro-batches."""
    step = (len(data) + files - 1) // files
    for i in range(files):
        spark.createDataFrame(data[i * step:(i + 1) * step], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    if closing:
        close_input(spark.createDataFrame(data, schema), str(tmp_path / "in/closing"), *closing)
    return read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)


def brute_feed(times, min_gap=5, max_gap=600):
    out, last, waiting, version = [], None, False, 0
    for at in range(times[0][0], times[-1][0] + 1):
        if last is not None and waiting and at >= last + min_gap:
            out.append((at, version, "change"))
            last, waiting = at, False
        if last is not None and not waiting and at >= last + max_gap:
            out.append((at, version, "refresh"))
            last = at
        for t, v in times:
            if t == at:
                version = max(version, v)
                if last is None or at >= last + min_gap:
                    out.append((at, version, "change"))
                    last = at
                else:
                    waiting = True
    return out


def jittered(data, at, delay, rng):
    """Rows in an order in which none is more than ``delay`` behind another that came before."""
    return sorted(data, key=lambda row: row[at] + rng.randrange(delay))


def test_route_feed_spaces_publishes_however_changes_come(spark, tmp_path):
    rng = random.Random(4)
    at, data = 1000, []
    for v in range(60):
        at += rng.choice([1, 1, 2, 3, 7, 700])
        data.append(("s", 1, at, v))
    data.append(("s", 1, data[7][2], 99))  # two versions in one second
    want = brute_feed(sorted((d[2], d[3]) for d in data))
    schema = "service string, table_id bigint, at_sec bigint, version bigint"
    for files, delay in ((1, 5), (4, 40)):
        rows = data if files == 1 else jittered(data, 2, delay, rng)
        stream = stream_of(spark, tmp_path / str(files), rows, schema, files, ("at_sec", F.max("at_sec") + delay))
        out = drain(ST.route_feed(stream, f"{delay} seconds"), "feed", timers=True)
        assert sorted((r.publish_sec, r.version, r.reason) for r in out.collect()) == want
    assert all(5 <= b[0] - a[0] <= 600 for a, b in zip(want, want[1:]))
    assert "RocksDB" not in spark.conf.get(STORE_SETTING)


def test_alert_clock_runs_on_while_nothing_is_dead(spark, tmp_path):
    data = [("s", t, d) for t, d in [(0, 0), (100, 2), (400, 2), (5000, 0), (5010, 1), (5020, 1), (5400, 3)]]
    schema = "service string, at_sec bigint, dead bigint"
    for k, rows in enumerate((data, [data[i] for i in (2, 0, 1, 4, 3, 6, 5)])):
        stream = stream_of(spark, tmp_path / str(k), rows, schema, 1 + k * 3, ("at_sec", F.max("at_sec") + 500))
        out = drain(ST.dead_node_alert(stream, delay="500 seconds"), "alert", timers=True)
        assert sorted((r.at_sec, r.alert) for r in out.collect()) == [(0, 0), (100, 0), (400, 2), (5000, 0), (5010, 0), (5020, 0), (5400, 3)]


def test_liveness_stream_over_several_batches(spark, tmp_path):
    rng = random.Random(2)
    seen = [(1, 10), (2, 10), (3, 11), (4, 12), (5, 12), (6, 13), (8, 13)]
    data = sorted([("s", 1, r, pid, "h", 1, 1) for r, pid in seen] + [("s", 2, r, 5, "h", 1, 1) for r in range(1, 12)], key=lambda x: x[2])
    schema = "service string, node_id bigint, seq bigint, process_id bigint, host string, port bigint, biz_port bigint"
    for files in (1, 4, 6):
        rows = data if files < 6 else jittered(data, 2, 4, rng)
        stream = stream_of(spark, tmp_path / str(files), rows, schema, files, ("seq", F.max("seq") + 5))
        out = drain(ST.stream_liveness(stream, 5, "20 seconds"), "live", timers=True)
        got = sorted((r.seq, r.change) for r in out.filter(F.col("node_id") == 1).collect())
        assert got == [(1, "new"), (3, "restarted"), (4, "new"), (6, "restarted"), (8, "new"), (9, "vanished")]
        assert [tuple(r) for r in out.filter("node_id = 2").collect()] == [("s", 2, 1, "new", 5)]


def brute_cleanups(events, end, retry, longest):
    """Second by second: events of a second after an alarm of the same second."""
    due, tries, out = None, 0, []
    for at in range(min(e[0] for e in events), end + 1):
        if due == at:
            tries += 1
            out.append((at, tries))
            due = at + min(longest, retry * 2 ** (tries - 1))
        now = [e for e in events if e[0] == at]
        if any(kind in (ST.CLEANED, ST.REUSED) for _, kind, _ in now):
            due = None
        elif any(kind == ST.FAILED for _, kind, _ in now) and due is not None and tries:
            due = at + min(longest, retry * 2 ** (tries - 1))
        dropped = [until for _, kind, until in now if kind == ST.DROPPED]
        if dropped:
            due, tries = max(at + 1, max(dropped)), 0
    return out


def test_cleanups_come_again_after_failures_and_pass_over_ids_in_use(spark, tmp_path):
    rng, schema = random.Random(9), "service string, table_id bigint, at_sec bigint, kind string, due_sec bigint"
    data, want = [], []
    for t in range(12):
        at, events = 100, []
        for _ in range(rng.randrange(1, 7)):
            at += rng.randrange(1, 80)
            kind = rng.choice([ST.DROPPED, ST.FAILED, ST.FAILED, ST.CLEANED, ST.REUSED]) if events else ST.DROPPED
            events.append((at, kind, at + rng.randrange(1, 50) if kind == ST.DROPPED else None))
        data += [("s", t, *e) for e in events]
        want.append(events)
    end = max(d[2] for d in data) + 200
    want = sorted((t, *row) for t, events in enumerate(want) for row in brute_cleanups(events, end, 10, 40))
    used = [("s", 3, 0, None), ("s", 4, 0, 250)]
    for files in (1, 5):
        rows = jittered(data, 2, 30, rng)
        stream = stream_of(spark, tmp_path / str(files), rows, schema, files, ("at_sec", F.max("at_sec") + 230))
        plain = drain(ST.cleanup_attempts(stream, "30 seconds", 10, 40), "tries", timers=True)
        assert sorted((r.table_id, r.at_sec, r.attempt) for r in plain.collect()) == want
        batches = []

        def in_use():
            batches.append(1)  # read anew for each micro-batch: the second id is known from the second read on
            return spark.createDataFrame(used[: len(batches)], "service string, table_id bigint, from_sec bigint, to_sec bigint")

        out = ST.stream_due_cleanups(stream, in_use, delay="30 seconds", retry=10, longest_retry=40)
        got = sorted((r.table_id, r.at_sec, r.attempt) for r in spark.read.schema(ST.CLEANUP_OUT).option("recursiveFileLookup", "true").parquet(out).collect())
        assert len(batches) >= files + 1 and [g for g in got if g[0] not in (3, 4)] == [w for w in want if w[0] not in (3, 4)]
        assert not any(g[0] == 3 for g in got) and {g for g in got if g[0] == 4} <= {w for w in want if w[0] == 4}
        assert {g for g in got if g[0] == 4 and g[1] > 250} == {w for w in want if w[0] == 4 and w[1] > 250}


def test_rows_behind_the_delay_are_left_out(spark, tmp_path):
    data = [("s", 1000, 1), ("s", 5000, 1), ("s", 4960, 2), ("s", 2000, 7), ("s", 4970, 2)]
    stream = stream_of(spark, tmp_path, data, "service string, at_sec bigint, dead bigint", 5, ("at_sec", F.max("at_sec") + 100))
    got = sorted(r.at_sec for r in drain(ST.dead_node_alert(stream, delay="100 seconds"), "late", timers=True).collect())
    assert got == [1000, 4960, 4970, 5000]


def test_route_sets_are_whole_and_published_once(spark, tmp_path):
    from shardlens.sources.sinks import read_routes, route_publisher, write_routes

    schema = "service string, snapshot_ts bigint, table_id bigint, version bigint"
    sets = [[("s", 1, t, v) for t in range(v + 2)] for v in range(4)]
    target, other, rows = str(tmp_path / "routes"), str(tmp_path / "other"), lambda df: sorted(map(tuple, df.collect()))
    for k, routes in enumerate(sets[:3]):
        assert write_routes(spark.createDataFrame(routes, schema), [target], k).written == [target]
        assert rows(read_routes(spark, target)) == routes
    again = write_routes(spark.createDataFrame(sets[3], schema), [target, other], 2, previous=[str(tmp_path / "gone")])
    assert (again.written, again.repeated, again.error) == ([other], [target], None)
    assert rows(read_routes(spark, target)) == sets[2] and rows(read_routes(spark, target, 1)) == sets[1]
    # A set that was begun and lost is not read, and a set that has left is named.
    (tmp_path / "routes/sets/9-lost").mkdir()
    assert rows(read_routes(spark, target)) == sets[2]
    with pytest.raises(ValueError, match="no route set 0"):
        read_routes(spark, target, 0)
    assert not (tmp_path / "routes/sets").joinpath("0").exists() and len(list((tmp_path / "routes/sets").iterdir())) == 3
    empty = str(tmp_path / "empty")
    write_routes(spark.createDataFrame([], schema), [empty], 0)
    assert rows(read_routes(spark, empty)) == [] and read_routes(spark, empty).schema == spark.createDataFrame([], schema).schema

    stream = stream_of(spark, tmp_path, [r for s in sets for r in s], schema, files=3)
    drain_batches(stream, "publish", route_publisher(lambda batch: batch, [str(tmp_path / "fed")]))
    assert rows(read_routes(spark, str(tmp_path / "fed"))) == [r for s in sets for r in s][-4:]
    bad = write_routes(spark.createDataFrame(sets[0], schema), ["nowhere://x", target], 5)
    assert bad.written == [target] and "nowhere" in bad.error


def test_checkpoint_lists_and_listings_go_round(spark, tmp_path):
    from shardlens.sources.sinks import list_checkpoints, read_checkpoint_list, write_checkpoint_list

    there = tmp_path / "c k/table_1/5_7"
    (there / "part_0").mkdir(parents=True)
    (there / "part_1").mkdir()
    (there / "part_1/file").write_text("x")
    (there / "done").touch()
    lines = [("s", 1, 1, 7, 5, f"5 {there}"), ("s", 1, 2, 9, 6, f"6 {tmp_path}/missing"), ("s", 1, 2, 9, 7, "no session")]
    write_checkpoint_list(spark.createDataFrame(lines, "service string, snapshot_ts bigint, table_id bigint, start_sec bigint, session_id bigint, line string"), str(tmp_path / "lists"))
    known = read_checkpoint_list(spark, str(tmp_path / "lists"))
    assert sorted(map(tuple, known.collect())) == [(1, 5, str(there)), (2, 6, f"{tmp_path}/missing")]
    scoped = known.select(F.lit("s").alias("service"), F.lit(1).cast("long").alias("snapshot_ts"), "table_id", "path")
    got = sorted((r.table_id, r.region, r.type, r.suffix) for r in list_checkpoints(scoped, "HB1").collect())
    assert got == [(1, "HB1", "DIRECTORY", "part_0"), (1, "HB1", "DIRECTORY", "part_1"), (1, "HB1", "FILE", "done")]
    url = scoped.filter("table_id = 1").withColumn("path", F.concat(F.lit("file://"), F.replace("path", F.lit(" "), F.lit("%20"))))
    assert list_checkpoints(url, "HB1").count() == 3


def test_lag_and_facts_do_not_depend_on_batches(spark, tmp_path):
    from shardlens.operators.reconcile import replication_lag
    from shardlens.streaming import facts as SF

    rng = random.Random(6)
    schema = "service string, snapshot_ts bigint, table_id bigint, partition_id bigint, node_id bigint, role int, membership_version bigint, report_sec bigint, restore_version bigint, statistics map<string,string>"
    data = [
        ("s", 1, t, p, n, 0 if n == p % 4 else 1, v, 100 + v, 0, {"seq": str(rng.randrange(5000))})
        for v in (1, 2) for t in range(3) for p in range(4) for n in range(4)
    ]
    rng.shuffle(data)
    newest = {}
    for d in data:
        if d[6] >= newest.get(d[2:5], d)[6]:
            newest[d[2:5]] = d
    want = sorted(map(tuple, replication_lag(spark.createDataFrame(list(newest.values()), schema)).collect()))
    intent = spark.createDataFrame([d[:5] + (0,) for d in newest.values()], "service string, snapshot_ts bigint, table_id bigint, partition_id bigint, node_id bigint, restore_version bigint")
    for files in (1, 5):
        out = SF.follow_lag(stream_of(spark, tmp_path / str(files), data, schema, files), compact_every=2)
        assert sorted(map(tuple, SF.current_lag(spark, out).select("service", "snapshot_ts", "table_id", "partition_id", "node_id", "role", "lag", "too_far").collect())) == want
        log = SF.collect_facts(stream_of(spark, tmp_path / f"f{files}", data, schema, files), compact_every=2)
        got = {(r.table_id, r.partition_id, r.node_id): r.membership_version for r in SF.current_facts(spark, log, intent).collect()}
        assert got == {k: d[6] for k, d in newest.items()}
