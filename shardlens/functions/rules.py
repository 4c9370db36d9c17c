"""Role rules: which role a reported replica should have next.

A rule is a name -> Column registry entry over one row per replica with these columns: ``role``, ``ready_to_promote``,
``statistics``, ``seq`` (-1 unknown), ``has_primary`` and ``primary_seq`` (another replica of the partition, or of the
parent's for a split child), ``larger`` / ``not_larger`` / ``unknown`` (other replicas' sequences against this
one's), ``restoring``, ``is_child``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardlens.functions.exprs import has_stat, stat_long
from shardlens.schema import LEARNER, SECONDARY

MAX_LAG = 1000


def near(seq: Column, primary_seq: Column) -> Column:
    """Close enough to the primary to serve; strict, so exactly ``MAX_LAG`` behind is too far."""
    return seq + MAX_LAG > primary_seq


def standard() -> Column:
    role, out_of_service = F.col("role"), has_stat("statistics", "unavailable")
    learner = F.when(~out_of_service & F.col("ready_to_promote"), SECONDARY).otherwise(LEARNER)
    return F.when(role == LEARNER, learner).when(out_of_service, LEARNER).otherwise(role)


def log_based() -> Column:
    role, seq, other = F.col("role"), F.col("seq"), F.col("primary_seq")
    fit = (standard() == SECONDARY) & (seq != -1)
    caught_up = (other != -1) & near(seq, other)
    by_majority = (F.col("unknown") == 0) & (F.col("larger") <= F.col("not_larger"))
    alone = F.coalesce(F.col("restoring"), F.lit(False)) | by_majority
    promote = fit & F.when(F.col("has_primary"), caught_up).otherwise(alone & ~F.col("is_child"))
    learner = F.when(promote, SECONDARY).otherwise(LEARNER)
    far_behind = F.col("has_primary") & (seq != -1) & (other != -1) & ~near(seq, other)
    secondary = F.when(far_behind, LEARNER).otherwise(SECONDARY)
    return F.when(role == LEARNER, learner).when(role == SECONDARY, secondary).otherwise(role)


def schema_versioned() -> Column:
    role, changing = F.col("role"), F.element_at(F.col("statistics"), F.lit("schema_changing"))
    return (
        F.when(changing.isNull(), standard())
        .when((changing == "true") & (role != LEARNER), LEARNER)
        .when((changing == "false") & (role == LEARNER), SECONDARY)
        .otherwise(role)
    )


ROLE_RULES: dict[str, Callable[[], Column]] = {
    "standard": standard,
    "log_based": log_based,
    "schema_versioned": schema_versioned,
}


def target_role(service_type: str, rules: dict[str, Callable[[], Column]] | None = None) -> Column:
    """Next role under the rule of ``service_type``; types without their own rule use the standard one.

    ``rules`` adds to the registry or replaces entries of it.
    """
    return (ROLE_RULES | (rules or {})).get(service_type, standard)().cast("int")


def primary_may_switch(from_stats: Column, to_stats: Column, guarded: bool) -> Column:
    """May the primary move?  Guarded services first pause the old one and need the new one's offset level."""
    if not guarded:
        return F.lit(True)
    paused = F.coalesce(F.element_at(from_stats, F.lit("stream_load_paused")) == "true", F.lit(False))
    a, b = (stat_long(s, "stream_load_offset", missing=None) for s in (from_stats, to_stats))
    return paused & F.coalesce(a <= b, F.lit(False))


