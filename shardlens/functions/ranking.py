"""Positions over long ordered groups without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of one bucket of consecutive numbers, buckets of a list of ids, and the ids their bounds are taken from.
BUCKET_WIDTH, BUCKETS, SAMPLED = 4096, 128, 8192


def id_bucket(df: DataFrame, *cols: str, named_by: Sequence[str] = ()) -> Column:
    """A bucket that grows with ``cols`` (the node id by default), so that bucket order is their order, nulls first.

    The bounds are quantiles of the ``SAMPLED`` distinct ids of least hash: an even draw whatever the ids look like, the
    same in every run.  They only level the buckets; positions are exact with any bounds.  They are a scalar subquery
    of the plan, so nothing runs while the plan is being built, and every row meets the same ones.

    Where ``named_by`` and ``cols`` name a row, rows are drawn instead: no shuffle looks for distinct ids then.
    """
    key = F.struct(*(cols or ("node_id",)))
    ids = df.select(*named_by, key.alias("key")) if named_by else df.select(key.alias("key")).distinct()
    drawn = ids.orderBy(F.xxhash64(*named_by, "key"), "key").limit(SAMPLED)
    place = lambda k: (k * F.size("ids") / BUCKETS).cast("int")
    bounds = drawn.agg(F.sort_array(F.collect_list("key")).alias("ids")).select(
        F.transform(F.sequence(F.lit(1), F.lit(BUCKETS - 1)), lambda k: F.get("ids", place(k))).alias("bounds")
    )
    # The bucket is where the row's key stands among the bounds.
    return F.array_position(F.sort_array(F.array_append(bounds.scalar(), key)), key)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    weight: str | None = None,
) -> DataFrame:
    """Position (or running total of ``weight``) of each row within ``keys``, in ``coarse`` then ``order`` order.

    A plain window would sort each ``keys`` group in one task.  Here rows are numbered inside the small
    ``keys + coarse`` groups and shifted by the totals of the groups before, so only the per-bucket totals
    (one row per bucket) meet in one task.  ``out`` is 1-based without ``weight``; with it, ``out`` is the
    total of the rows *before* this one.
    """
    group = [*keys, *coarse]
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    before = Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        df.groupBy(*group)
        .agg(size.cast("long").alias("_size"))
        .select(*group, F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("long").alias("_shift"))
    )
    inside = Window.partitionBy(*group).orderBy(*order)
    if weight is None:
        here = F.row_number().over(inside).cast("long")
    else:
        running = inside.rowsBetween(Window.unboundedPreceding, -1)
        here = F.coalesce(F.sum(weight).over(running), F.lit(0)).cast("long")
    return df.join(shift, group).withColumn(out, here + F.col("_shift")).drop("_shift")


def part_grid(rows: DataFrame, out: str, count: str = "parts_count") -> DataFrame:
    """``rows`` once for each id from 0 to ``count`` - 1, as column ``out``.

    A short list in one file would emit the whole grid in one task.  Blocks of ids are made first, dealt over the
    cluster, and opened there.  Spark takes the grid for as small as ``rows``; the hint keeps joins from sending it whole
    through the driver.
    """
    width = F.lit(BUCKET_WIDTH).cast("long")
    last = F.call_function("div", F.col(count) - 1, width)
    blocks = rows.filter(F.col(count) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("_block") * width
    ids = F.sequence(start, F.least(start + width, F.col(count)) - 1)
    dealt = blocks.repartition(*[F.col(c) for c in blocks.columns if c != count])
    return dealt.select(*rows.columns, F.explode(ids).alias(out)).hint("merge")
