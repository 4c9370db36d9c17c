"""Node scores and weights.  Estimators are a plain name -> Column registry, open to new entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardlens.functions.exprs import col, int_div
from shardlens.schema import GIB

INVALID_SCORE, MIN_SCORE, MAX_SCORE = 0, 1, 10000
MIN_WEIGHT, DEFAULT_WEIGHT, MAX_WEIGHT = 0.1, 1.0, 10.0


def _unit(resource: Column, key: str) -> Column:
    return F.coalesce(F.element_at(resource, F.lit(key)), F.lit(0)).cast("long")


def _bounded(value: Column, scaled: Column) -> Column:
    bound = F.least(F.greatest(scaled, F.lit(MIN_SCORE).cast("long")), F.lit(MAX_SCORE).cast("long"))
    return F.when(value == 0, F.lit(INVALID_SCORE).cast("long")).otherwise(bound)


def _by_cpu(resource: Column) -> Column:
    cpu = _unit(resource, "CPU")
    return _bounded(cpu, int_div(cpu, F.lit(10).cast("long")))


def _by_ksat_cpu(resource: Column) -> Column:
    cpu = _unit(resource, "KSAT_CPU")
    return _bounded(cpu, int_div(cpu + 5, F.lit(10).cast("long")))


def _by_disk(resource: Column) -> Column:
    disk = _unit(resource, "DISK_CAP")
    step = F.lit(10 * GIB).cast("long")
    return _bounded(disk, int_div(disk + F.lit(5 * GIB), step))


ESTIMATORS: dict[str, Callable[[Column], Column]] = {
    "default": lambda resource: F.lit(100).cast("long"),
    "cpu_core": _by_cpu,
    "ksat_core": _by_ksat_cpu,
    "disk_cap": _by_disk,
}


def node_score(resource: Column | str, estimator: str) -> Column:
    """Score 1..10000 of a resource map; 0 says the estimator cannot judge the node."""
    if estimator not in ESTIMATORS:
        raise KeyError(f"unknown estimator {estimator!r}, known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](col(resource))


def effective_weight(weight: Column | str = "weight") -> Column:
    w = col(weight).cast("float")
    low, high = F.lit(MIN_WEIGHT).cast("float"), F.lit(MAX_WEIGHT).cast("float")
    return F.when(w < low, F.lit(DEFAULT_WEIGHT).cast("float")).when(w > high, high).otherwise(w)


def weighted_score(score: Column | str = "score", weight: Column | str = "weight") -> Column:
    """Score times weight in single precision, rounded half up, at least 1 for a valid score."""
    s = col(score)
    product = s.cast("float") * effective_weight(weight) + F.lit(0.5).cast("float")
    return F.when(s == INVALID_SCORE, F.lit(0).cast("long")).otherwise(
        F.greatest(F.floor(product).cast("long"), F.lit(1).cast("long"))
    )
