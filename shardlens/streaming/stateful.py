"""Streams that need their own state: liveness, alerts, overdue items, route publishing, clean-ups.

Each keeps a few fields per key and wakes by event time.  Keys are nodes, services, runs or tables, so state grows with
the fleet and not with the history.  ``delay`` is how far behind the newest row a row may come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlens.streaming.ordered import Memo, Out, Steps, in_order
from shardlens.streaming.runner import drain_batches

# --- liveness -----------------------------------------------------------------------------------------------------

LIVENESS_OUT = "service string, node_id bigint, seq bigint, change string, process_id bigint"


class _Liveness(Steps):
    memo_ddl = "seq bigint, active boolean, process_id bigint, host string, port bigint, biz_port bigint"
    fields = ("process_id", "host", "port", "biz_port")

    def __init__(self, round_seconds: int):
        self.round = round_seconds

    def step(self, memo: Memo, at: int, row: tuple) -> tuple[Memo, Out]:
        seq, process = at // self.round, row[0]
        follows = memo is not None and memo[1]  # a node that missed a round has been forgotten
        if not follows:
            return (seq, True, *row), [(seq, "new", process)]
        if memo[2] != process:
            return (seq, False, *row), [(seq, "restarted", process)]
        return (seq, True, *row), [(seq, "changed", process)] if memo[2:] != row else []

    def alarm(self, memo: tuple) -> int:
        return (memo[0] + 1) * self.round + 1  # just after the next round

    def ring(self, memo: tuple, at: int) -> tuple[Memo, Out]:
        return None, [(memo[0] + 1, "vanished", memo[2])] if memo[1] else []


def stream_liveness(pings: DataFrame, round_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Liveness changes from a stream of pings (service, node_id, seq, process_id, host, port, biz_port).

    ``seq`` numbers the valid rounds, one every ``round_seconds``; event time is its position.  Rounds may come in any
    order within ``delay``.  A node that is not listed once the watermark has passed the next round has vanished.  Of a
    node listed twice in a round, the greater process counts.
    """
    ordered = pings.select("service", "node_id", (F.col("seq") * round_seconds).alias("at_sec"), *_Liveness.fields)
    return in_order(ordered, ["service", "node_id"], "at_sec", _Liveness(round_seconds), LIVENESS_OUT, delay)


# --- alerts -------------------------------------------------------------------------------------------------------

ALERT_OUT = "service string, at_sec bigint, dead bigint, alert bigint"


class _Alert(Steps):
    memo_ddl = "since bigint"
    fields = ("dead",)

    def __init__(self, grace: int, recovery: int):
        self.grace, self.recovery = grace, recovery

    def step(self, memo: Memo, at: int, row: tuple) -> tuple[Memo, Out]:
        since, (dead,), value = memo[0] if memo else at, row, 0
        if dead > 0 and at - since > self.recovery:
            since = at
        elif dead > 0 and at - since > self.grace:
            value = dead
        return (since,), [(at, dead, value)]


def dead_node_alert(counts: DataFrame, recovery_minutes: int = 60, delay: str = "0 seconds") -> DataFrame:
    """Alert value per observation (service, at_sec, dead), one row per service and collection.

    0 within min(300 s, 30 s per recovery minute) of the last reset, then the number of dead nodes; after the
    recovery time it resets to 0 once.  The clock runs on while nothing is dead, so a first failure long after the
    start resets at once.  Observations may come in any order within ``delay``.
    """
    steps = _Alert(min(300, recovery_minutes * 30), recovery_minutes * 60)
    return in_order(counts.select("service", "at_sec", "dead"), ["service"], "at_sec", steps, ALERT_OUT, delay)


# --- overdue items ------------------------------------------------------------------------------------------------


def overdue_items(opened: DataFrame, closed: DataFrame, longest: str, delay: str = "0 seconds") -> DataFrame:
    """Items whose due time passes without a closing row.

    ``opened``: (service, item_id, due_sec); ``closed``: (service, item_id, at_sec).  A task run opens with due = start
    + period and closes when it finishes; a recycled table id opens with its deadline and closes when it is used again
    or cleaned.  ``longest`` is the longest time from opening to due.

    This is an outer join of two streams.  Due time is the event time of the open side, so the engine itself drops
    an item and emits it unmatched once closings have moved past its due time; no Python runs per item.
    """
    o = opened.select(
        "service", "item_id", "due_sec", F.timestamp_seconds("due_sec").alias("due_at")
    ).withWatermark("due_at", delay).alias("o")
    c = closed.select(
        "service", "item_id", F.timestamp_seconds("at_sec").alias("closed_at")
    ).withWatermark("closed_at", delay).alias("c")
    in_time = F.expr(f"c.closed_at <= o.due_at and c.closed_at >= o.due_at - interval {longest}")
    same = (F.col("o.service") == F.col("c.service")) & (F.col("o.item_id") == F.col("c.item_id"))
    return o.join(c, same & in_time, "left_outer").filter("c.item_id is null").select("o.service", "o.item_id", "o.due_sec")


# --- route feed ---------------------------------------------------------------------------------------------------

FEED_OUT = "service string, table_id bigint, publish_sec bigint, version bigint, reason string"
MIN_GAP, MAX_GAP = 5, 600


class _Feed(Steps):
    memo_ddl = "last bigint, version bigint, waiting boolean"
    fields = ("version",)

    def __init__(self, min_gap: int, max_gap: int):
        self.min_gap, self.max_gap = min_gap, max_gap

    def step(self, memo: Memo, at: int, row: tuple) -> tuple[Memo, Out]:
        last, known, _ = memo or (None, row[0], False)
        version = max(known, row[0])
        if last is None or at >= last + self.min_gap:
            return (at, version, False), [(at, version, "change")]
        return (last, version, True), []

    def alarm(self, memo: tuple) -> int:
        return memo[0] + (self.min_gap if memo[2] else self.max_gap)

    def ring(self, memo: tuple, at: int) -> tuple[Memo, Out]:
        return (at, memo[1], False), [(at, memo[1], "change" if memo[2] else "refresh")]


def route_feed(changes: DataFrame, delay: str = "0 seconds", min_gap: int = MIN_GAP, max_gap: int = MAX_GAP) -> DataFrame:
    """When to publish each table's routes.  ``changes``: (service, table_id, at_sec, version).

    Changes within ``min_gap`` of the last publish wait and go out together; a table without changes is published
    again after ``max_gap``.  Changes may come in any order within ``delay``.
    """
    rows = changes.select("service", "table_id", "at_sec", "version")
    return in_order(rows, ["service", "table_id"], "at_sec", _Feed(min_gap, max_gap), FEED_OUT, delay)


# --- clean-ups ----------------------------------------------------------------------------------------------------

CLEANUP_OUT = "service string, table_id bigint, at_sec bigint, attempt bigint"
DROPPED, FAILED, CLEANED, REUSED = "dropped", "failed", "cleaned", "reused"


class _Cleanup(Steps):
    memo_ddl = "next bigint, tries bigint"
    fields = ("due_sec", "failed", "over")

    def __init__(self, retry: int, longest_retry: int):
        self.retry, self.longest = retry, longest_retry

    def joined(self, one: tuple, two: tuple) -> tuple:
        due = [row[0] for row in (one, two) if row[0] is not None]
        return max(due, default=None), one[1] or two[1], one[2] or two[2]

    def _pause(self, tries: int) -> int:
        return min(self.longest, self.retry << min(tries - 1, 40))

    def step(self, memo: Memo, at: int, row: tuple) -> tuple[Memo, Out]:
        due, failed, over = row
        if over:
            memo = None
        elif failed and memo is not None and memo[1]:
            memo = (at + self._pause(memo[1]), memo[1])
        if due is not None:
            memo = (max(at, due), 0)
        return memo, []

    def alarm(self, memo: tuple) -> int:
        return memo[0]

    def ring(self, memo: tuple, at: int) -> tuple[Memo, Out]:
        tries = memo[1] + 1
        return (at + self._pause(tries), tries), [(at, tries)]


def cleanup_attempts(events: DataFrame, delay: str = "0 seconds", retry: int = 60, longest_retry: int = 3600) -> DataFrame:
    """When to try to clean up each dropped item.  ``events``: (service, table_id, at_sec, kind, due_sec).

    ``dropped`` opens an item, which is tried when ``due_sec`` comes; ``cleaned`` and ``reused`` end it.  An attempt
    that ``failed`` is made again ``retry`` seconds after the failure, twice that after the next and so on up to
    ``longest_retry``; an attempt of which nothing is heard counts as failed when it was made.
    """
    rows = events.select(
        "service", "table_id", "at_sec", F.when(F.col("kind") == DROPPED, F.col("due_sec")).alias("due_sec"),
        (F.col("kind") == FAILED).alias("failed"), F.col("kind").isin(CLEANED, REUSED).alias("over"),
    )
    return in_order(rows, ["service", "table_id"], "at_sec", _Cleanup(retry, longest_retry), CLEANUP_OUT, delay)


def stream_due_cleanups(
    events: DataFrame, in_use: Callable[[], DataFrame], label: str = "cleanups", delay: str = "0 seconds", **retry: int
) -> str:
    """Attempts of ``cleanup_attempts`` on items that nobody uses when they are due; gives the folder of the batches.

    ``in_use()`` is read anew for every micro-batch: (service, table_id, from_sec, to_sec; a null end is open).  An item
    in use is passed over; nothing is heard of that attempt, so that it comes again.
    """

    def each(batch: DataFrame, batch_id: int, out: str) -> None:
        used = in_use().select(
            F.col("service").alias("_s"), F.col("table_id").alias("_t"), F.col("from_sec").alias("_from"), F.col("to_sec").alias("_to"))
        same = (F.col("service") == F.col("_s")) & (F.col("table_id") == F.col("_t"))
        held = (F.col("at_sec") >= F.col("_from")) & (F.col("at_sec") <= F.coalesce("_to", F.col("at_sec")))
        batch.join(used, same & held, "left_anti").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return drain_batches(cleanup_attempts(events, delay, **retry), label, each, timers=True)
