"""The query registry: each entry pairs a Spark plan with the SQL that must give equal rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.plans.views import FleetViews, with_views
from shardlens.schema import SCOPE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Result form: no scope columns (the views hold one scope), whole numbers as BIGINT."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *[
            F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
            for f in df.schema.fields
            if f.name not in SCOPE
        ]
    )


def query(name: str, sql: str | None = None, ints: str = "", once: bool = False):
    """Register ``build(views) -> DataFrame`` under ``name`` with its checking SQL.

    ``ints`` names result columns that the SQL types narrower than BIGINT; ``once`` has the SQL work out each of its
    views a single time.
    """

    def register(build: Callable[[FleetViews], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: flat(build(FleetViews(spark, sf_dir)))
        if sql is not None:
            full = with_views(sql)
            if once:
                full = re.sub(r"^((?:WITH |, ?|  )?\w+) AS \(", r"\1 AS MATERIALIZED (", full, flags=re.M)
            if ints:
                casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ints.split())
                full = f"SELECT * REPLACE ({casts}) FROM (\n{full}\n)"
            ORACLES[name] = full
        return build

    return register
