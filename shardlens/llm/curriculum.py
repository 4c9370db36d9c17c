"""Mixing sources to target weights by a curriculum: each source's weight changes over the training time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlens.llm.common import BLANK_CLASS, staged

# Knots (time, weight) of a piecewise linear weight over the training time 0 to 1.
Schedule = Sequence[tuple[float, float]]


@dataclass(frozen=True)
class MixParams:
    """``schedules`` go to the sources in turn; ``share`` of all words are asked for, no document more than ``repeats`` times."""

    schedules: tuple[Schedule, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))
    share: float = 1.5
    repeats: int = 2

    def __post_init__(self):
        if any(integral(schedule) <= 0 for schedule in self.schedules):
            raise ValueError("every schedule needs a weight above 0")


def segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """``(time, weight, slope, integral before)`` per linear piece."""
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((float(t0), float(w0), (w1 - w0) / (t1 - t0), total))
        total += (w0 + w1) / 2 * (t1 - t0)
    return out


def integral(schedule: Schedule) -> float:
    """The weight of a source over the whole training time."""
    return float(sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])))


def _time_of(part: Column, schedule: Schedule) -> Column:
    """The time at which ``part`` (0 to 1) of the source's demand has been met: the inverse of the integrated weight."""
    asked = part * integral(schedule)
    pieces = segments(schedule)

    def inside(piece):
        t0, w0, slope, before = piece
        d = asked - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * d))
        return F.when(d <= 0, F.lit(t0)).otherwise(F.lit(t0) + F.try_divide(F.lit(2.0) * d, F.lit(w0) + root))

    time = inside(pieces[-1])
    for piece, later in reversed(list(zip(pieces, pieces[1:]))):
        time = F.when(asked < later[3], inside(piece)).otherwise(time)
    return F.least(F.lit(1.0), time)


def _laid(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``df`` dealt by range of ``order`` and written with the number of the partition.

    Written before anything is summed: the range bounds come from a sample and may differ in a second evaluation.
    """
    return staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)


def _offsets(laid: DataFrame, sums: dict[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """``_at_part`` (and ``_at_<group>``): the sums over the partitions before.  A row per partition and group inside it."""
    totals = laid.groupBy("_part", *within).agg(*[F.sum(col).alias(name) for name, col in sums.items()])
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        F.col("_part").alias("_at_part"),
        *[F.col(name).alias(f"_at_{name}") for name in within],
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before{name}") for name in sums],
    )


def _running(laid: DataFrame, offsets: DataFrame, order: Sequence[Column], sums: dict[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """Adds to each row the sums over all rows before it in ``order`` (in its group), and what else ``offsets`` carries."""
    same = F.col("_part") == F.col("_at_part")
    for name in within:
        same = same & F.col(name).eqNullSafe(F.col(f"_at_{name}"))
    rows = laid.join(offsets, same).drop("_at_part", *[f"_at_{name}" for name in within])
    ahead = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for name, col in sums.items():
        rows = rows.withColumn(name, F.coalesce(F.sum(col).over(ahead), F.lit(0)) + F.col(f"_before{name}"))
    return rows.drop("_part", *[f"_before{name}" for name in sums])


def _prefix(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str) -> DataFrame:
    laid = _laid(df, order, label)
    return _running(laid, _offsets(laid, sums), order, sums)


def source_targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """``source, source_size`` -> also ``slot`` (which schedule), ``weight`` and ``target``.

    ``share`` of all words is dealt by weight; where that is above ``repeats`` times the source's size it stops there,
    and the excess is dealt again among the others.  The end of that is one level for all: with the sources in order of
    size per weight, those below the level are full and the others get the level times their weight.
    """
    weights = [integral(s) for s in params.schedules]
    by_name = [F.col("source").asc_nulls_last()]
    ranked = _prefix(sizes, by_name, {"_rank": F.lit(1)}, "mix-sources").withColumn("slot", (F.col("_rank") % len(weights)).cast("int"))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("slot") + 1)).withColumn(
        "_full", F.col("source_size") * params.repeats
    )
    weighed = staged(weighed.withColumn("_ratio", F.col("_full") / F.col("weight")), "mix-weights")
    asked = weighed.agg(F.sum("source_size") * F.lit(float(params.share))).scalar()
    weight = weighed.agg(F.sum("weight")).scalar()
    filled = _prefix(weighed, [F.col("_ratio"), F.col("_rank")], {"_full_before": F.col("_full"), "_weight_before": F.col("weight")}, "mix-levels")
    levels = filled.withColumn("_level", (asked - F.col("_full_before")) / (weight - F.col("_weight_before")))
    level = levels.where(F.col("_ratio") > F.col("_level")).agg(F.max("_level")).scalar()
    # No level (all sources full): least() leaves the null out.
    target = F.least(F.col("_full").cast("double"), level * F.col("weight"))
    return weighed.select("source", "source_size", "slot", "weight", target.alias("target"))


def curriculum(
    docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken, copies``, in training order.

    ``size`` counts the words of the text (null: none).  A source's documents follow each other in an order drawn from
    their ids, as often as the target asks for: the last copy ends where the target is met, so that the words taken of
    a source are its target (to the nearest whole word).  ``copies`` holds ``(copy, words, position)`` of each copy that
    is taken: the demand for a source up to a time is its target times the share of its integrated weight, and a copy
    stands where that demand reaches the copy's middle.  Rows are range-sorted by their first position, those of which
    nothing is taken last.

    Sources stand in code point order, null last (it is a source of its own), and take the schedules in turn.  Rows with
    equal ids are rows of their own; equal ones may swap their places.  An empty table gives an empty result; a source
    without words has target 0.  Columns besides the three are ignored.  Running sums are made inside range partitions
    and shifted by the totals of the partitions before, so that one source may hold most of the rows.
    """
    ident = F.col(id_col)
    slim = docs.select(
        ident.alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[^{BLANK_CLASS[1:]}+")).cast("long").alias("size"),
        F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 16).alias("_key"),
    )
    slim = staged(slim, "mix-sizes")  # texts are read once; what follows moves ids and sizes
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), params)

    order = [F.col(c) for c in ("source", "_key", "doc_id", "size")]
    start = {"_start": F.col("size")}
    laid = _laid(slim, order, "mix-order")
    offsets = _offsets(laid, start, ["source"])
    # The targets travel with the shifts, so that documents meet one small table by partition and source.
    carried = offsets.join(targets, F.col("_at_source").eqNullSafe(F.col("source"))).drop("source")
    placed = _running(laid, carried, order, start, ["source"])

    asked = F.floor(F.col("target") + 0.5)
    copies = []
    for k in range(params.repeats):
        before = F.lit(k) * F.col("source_size") + F.col("_start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), asked - before)).cast("long")
        part = F.try_divide(before + words / F.lit(2.0), F.col("target"))
        time = _time_of(part, params.schedules[-1])
        for slot, schedule in reversed(list(enumerate(params.schedules[:-1]))):
            time = F.when(F.col("slot") == slot, _time_of(part, schedule)).otherwise(time)
        copies.append(F.struct(F.lit(k).alias("copy"), words.alias("words"), time.alias("position")))
    mixed = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0)).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"]).alias("taken"),
        "copies",
    )
    return mixed.orderBy(F.get("copies", F.lit(0))["position"].asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, range-sorted by its place in the training: ``position, doc_id, source, copy, words``."""
    each = mixed.select("doc_id", "source", F.explode("copies").alias("c"))
    return each.select(F.col("c.position").alias("position"), "doc_id", "source", "c.copy", "c.words").orderBy("position", "doc_id", "copy")


def mix_report(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``curriculum`` with the position of the first and the second copy in place of the list."""
    place = lambda k: F.get("copies", F.lit(k))["position"]
    return curriculum(docs, params).select(
        "doc_id", "size", "source_size", "target", "taken", place(0).alias("first_position"), place(1).alias("second_position")
    )
