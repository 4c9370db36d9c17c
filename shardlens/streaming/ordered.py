"""Keyed streams whose rows are worked in event-time order, however they come, with alarms in between.

Rows wait in the state of their key until the watermark has passed them, and come back in order.  What a key remembers,
and when it wants to be woken without a row, is told by a ``Steps`` object.  Keys are dealt into buckets: the state of a
bucket is read and written once a micro-batch, not once a row or key, and one timer, for the first thing that can happen to
any of its keys, wakes it when no row comes.  Memory holds one bucket: what its keys remember and their rows that wait,
one for each second of the delay and of a micro-batch, however many rows a second has.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

# The engine's clock starts at 0 and takes a row of that time for late; so its time is one second ahead of ours.
AHEAD = 1

# Buckets of keys, and what is kept of one: its keys with memo and waiting rows, and the time of its timer.
KEY_BUCKETS = 2048
KEPT = T.StructType([T.StructField("keys", T.BinaryType()), T.StructField("timer", T.LongType())])

Memo = tuple | None
Out = list[tuple]


class Steps:
    """What one key does.  ``memo`` is what it remembers (None: nothing); outputs lack the key columns."""

    memo_ddl: str
    fields: tuple[str, ...]

    def joined(self, one: tuple, two: tuple) -> tuple:
        """Two rows of a key that bear the same time, as one.  Must not depend on their order."""
        return max(one, two)

    def step(self, memo: Memo, at: int, row: tuple) -> tuple[Memo, Out]:
        raise NotImplementedError

    def alarm(self, memo: tuple) -> int | None:
        """When to wake the key if nothing comes before; it is woken before a row of the same time."""
        return None

    def ring(self, memo: tuple, at: int) -> tuple[Memo, Out]:
        raise NotImplementedError


class _InOrder(StatefulProcessor):
    """One state value a bucket of keys: for each key what it remembers and the rows that wait, and one timer for all."""

    def __init__(self, steps: Steps, keys: list[str], at: str, out: list[str]):
        self.steps, self.keys, self.at, self.out = steps, keys, at, Row(*out)

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    def _load(self) -> tuple[dict[tuple, tuple[Memo, dict[int, tuple]]], int | None]:
        kept = self.kept.get()
        return ({}, None) if kept is None else (pickle.loads(kept[0]), kept[1])

    def _save(self, state: dict, timer: int | None, rung: bool = False) -> None:
        """Keep the state with a timer for the first thing that can happen to a key; ``rung``: the old timer is gone."""
        first = None
        for memo, waiting in state.values():
            times = [*waiting] if memo is None or (bell := self.steps.alarm(memo)) is None else [*waiting, bell]
            first = min(times if first is None else [*times, first], default=None)
        if first != timer or rung:
            if timer is not None and not rung:
                self.handle.deleteTimer((timer + AHEAD) * 1000)
            if first is not None:
                self.handle.registerTimer((first + AHEAD) * 1000)
        if state:
            self.kept.update((pickle.dumps(state), first))
        elif timer is not None:
            self.kept.clear()

    def _due(self, state: dict, passed: int) -> Out:
        """Work all that the watermark has passed, key by key in the order of time; keys that are through leave."""
        made, steps = [], self.steps
        for key, (memo, waiting) in list(state.items()):
            for at in [*sorted(at for at in waiting if at <= passed), None]:
                upto = passed if at is None else at
                while memo is not None and (when := steps.alarm(memo)) is not None and when <= upto:
                    memo, out = steps.ring(memo, when)
                    made += [(*key, *values) for values in out]
                if at is not None:
                    memo, out = steps.step(memo, at, waiting.pop(at))
                    made += [(*key, *values) for values in out]
            if memo is None and not waiting:
                del state[key]
            else:
                state[key] = memo, waiting
        return made

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, timer = self._load()
        for row in rows:
            own, at = tuple(row[name] for name in self.keys), row[self.at]
            if at is None or None in own:
                continue  # a row without a time, or a closing record
            new = tuple(row[name] for name in self.steps.fields)
            waiting = state.setdefault(own, (None, {}))[1]
            waiting[at] = self.steps.joined(waiting[at], new) if at in waiting else new
        made = self._due(state, self._passed(timerValues))
        self._save(state, timer)
        return (self.out(*values) for values in made)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, timer = self._load()
        made = self._due(state, self._passed(timerValues))
        self._save(state, timer, rung=True)
        return (self.out(*values) for values in made)

    def _passed(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() // 1000 - AHEAD


def in_order(stream: DataFrame, keys: list[str], at: str, steps: Steps, out: str, delay: str) -> DataFrame:
    """``steps`` over the rows of each key in the order of ``at`` (seconds); ``out``: DDL of the key and output columns.

    A row counts wherever it comes, as long as it is at most ``delay`` behind the newest; a later one is dropped unless its
    turn has not passed.  Rows without a time are left out.  Rows with a null key move the watermark and do nothing else
    (``runner.close_input``).  Needs the RocksDB state store (``runner.drain``).
    """
    steps.fields = tuple(name for name in stream.columns if name in steps.fields)
    out_type = T.StructType.fromDDL(out)
    timed = stream.withColumn("_at", F.timestamp_seconds(F.col(at) + AHEAD)).withWatermark("_at", delay)
    dealt = timed.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)))
    processor = _InOrder(steps, keys, at, out_type.fieldNames())
    return dealt.groupBy("_bucket").transformWithState(processor, out_type, "append", "eventTime")
