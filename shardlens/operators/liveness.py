"""Node liveness from discovery rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlens.functions.exprs import count_where, int_div
from shardlens.functions.ranking import BUCKET_WIDTH, id_bucket, numbered

NODE = ["service", "node_id"]
STEP = [*NODE, "seq"]
ATTRIBUTES = ["process_id", "host", "port", "biz_port", "az"]


def round_sequence(rounds: DataFrame) -> DataFrame:
    """Valid rounds of every service with their 1-based position; void rounds are simply not among them."""
    distinct = rounds.select("service", "round_no").distinct()
    bucketed = distinct.withColumn("_b", id_bucket(distinct, "round_no"))
    return numbered(bucketed, ["service"], ["_b"], ["round_no"], out="seq").select("service", "round_no", "seq")


def liveness_changes(pings: DataFrame, rounds: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """What changed between consecutive valid rounds.

    'new' and 'vanished' need no word; a node whose process id changed is 'restarted', which counts as dead for that
    round and as 'new' in the next one it is listed in; another address or business port gives 'changed'.  A process id
    that changes in every round alternates between the two, so the parity within a streak of changes decides.

    A node's history is scanned in buckets of ``width`` rounds, so that a long one is never one group.  The last round of
    a bucket stands in the next one too, where the row after it finds it; where the last streak began is carried from
    bucket to bucket by one small row each.
    """
    order = round_sequence(rounds)
    bucket = int_div("seq", F.lit(width).cast("long"))
    at_edge = F.col("seq") % width == width - 1
    places = F.when(at_edge, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    laid = (
        pings.join(order, ["service", "round_no"])
        .select(*STEP, *ATTRIBUTES, F.explode(places).alias("_b"))
        .withColumn("_guest", F.col("_b") != bucket)
    )
    inside = Window.partitionBy(*NODE, "_b").orderBy("seq")
    upto, ahead = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    seen = laid.withColumn("old", F.lag(F.struct("seq", *ATTRIBUTES)).over(inside)).withColumn("_next", F.lead("seq").over(inside))
    follows = F.coalesce(F.col("old.seq") == F.col("seq") - 1, F.lit(False))
    other_process = F.coalesce(F.col("process_id") != F.col("old.process_id"), F.lit(False))
    seen = seen.withColumn("_follows", follows).withColumn("_swapped", follows & other_process & ~F.col("_guest"))
    # A row without a swap ends the streak before it; the next swap begins one.
    ends = F.when(~F.col("_swapped") & ~F.col("_guest"), F.col("seq"))
    seen = seen.withColumn("_end", F.max(ends).over(upto)).withColumn("_old_end", F.max(ends).over(ahead))
    earlier = Window.partitionBy(*NODE).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.groupBy(*NODE, "_b").agg(F.max("_end").alias("_last")).select(*NODE, "_b", F.max("_last").over(earlier).alias("_carried"))
    known = seen.join(carried, [*NODE, "_b"])

    def restarted(seq, end):
        """Every other swap of a streak; a row that ended the streak itself is none."""
        return F.coalesce((seq != end) & ((seq - end) % 2 == 1), F.lit(False))

    here = restarted(F.col("seq"), F.coalesce("_end", "_carried"))
    was_dead = restarted(F.col("old.seq"), F.coalesce("_old_end", "_carried"))
    moved = F.lit(False)
    for name in ("host", "port", "biz_port"):
        moved = moved | F.coalesce(F.col(name) != F.col(f"old.{name}"), F.lit(False))
    change = (
        F.when(F.col("_swapped") & here, "restarted").when(~F.col("_follows") | was_dead, "new").when(moved, "changed")
    )
    # Whether the round after the last of a bucket lists the node is seen in the next bucket.
    gone = ~here & F.coalesce(F.col("_next") != F.col("seq") + 1, F.lit(True)) & (~at_edge | F.col("_guest"))
    event = lambda seq, what, moved_az: F.struct(seq.alias("seq"), what.alias("change"), moved_az.alias("az_moved"))
    az_moved = F.col("_follows") & F.coalesce(F.col("az") != F.col("old.az"), F.lit(False))
    events = F.filter(
        F.array(
            F.when(~F.col("_guest") & change.isNotNull(), event(F.col("seq"), change, az_moved)),
            F.when(gone, event(F.col("seq") + 1, F.lit("vanished"), F.lit(False))),
        ),
        lambda e: e.isNotNull(),
    )
    return (
        known.select(*NODE, "process_id", F.explode(events).alias("e"))
        .select("service", "node_id", "e.*", "process_id")
        # The step after the last round is no round: what was listed last has not vanished.
        .join(order, ["service", "seq"])
        .select("service", "round_no", "node_id", "change", "az_moved", "process_id")
    )


def fleet_counters(changes: DataFrame) -> DataFrame:
    """Changes of each kind per service and round."""
    return changes.groupBy("service", "round_no").agg(
        *[count_where(F.col("change") == c).alias(c) for c in ("new", "restarted", "vanished", "changed")])
