"""Discovery records to node pings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlens.functions.exprs import discovery_host, node_index_parts
from shardlens.operators.nodes import detectable, drop_blacklisted_dc
from shardlens.operators.validate import normalize_az
from shardlens.schema import PING_PAYLOAD

ROUND = ["service", "round_no"]


@dataclass
class PingRounds:
    """``pings`` of valid rounds, ``rejects`` with reasons, and every round with its ``void`` flag."""

    pings: DataFrame
    rejects: DataFrame
    rounds: DataFrame


def read_pings(
    raw: DataFrame, hubs: DataFrame, blacklist: DataFrame, use_paz: bool = False, static_indexed: bool = False,
    allow_index_conflict: bool = False, expected: DataFrame | None = None,
) -> PingRounds:
    """Parse discovery records: (service, round_no, id, port, location, paz, dc, payload).

    Records in zones without hub or in blacklisted centres are passed over.  Among the others one bad payload, bad
    or doubly used index, or doubly used node id voids its whole round, and so does a round of ``expected`` in
    which a service with zones lists nothing.  Uses are counted by aggregation, so an id listed a million times is
    not a group in one task.
    """
    mine = drop_blacklisted_dc(detectable(normalize_az(raw, use_paz), hubs), blacklist)
    p = F.from_json("payload", PING_PAYLOAD)
    rows = mine.withColumn("p", p).select(
        *ROUND, "id", "port", "az", discovery_host("id").alias("host"), F.col("p.node_id").alias("node_id"),
        F.col("p.process_id").alias("process_id"), F.col("p.biz_port").alias("biz_port"),
        (F.col("p.node_index") if static_indexed else F.lit("")).alias("node_index"),
    )
    index = node_index_parts("node_index")
    bad = (
        F.when(F.coalesce("node_id", F.lit("")) == "", "no node_id")
        .when(F.coalesce("process_id", F.lit(0)) == 0, "no process_id").when(F.coalesce("biz_port", F.lit(0)) == 0, "no biz_port")
    )
    if static_indexed:
        bad = F.coalesce(bad, F.when(index.isNull(), "bad index"))
    judged = rows.withColumn("reason", bad)
    by_id = judged.filter("reason is null").groupBy(*ROUND, "node_id").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    judged = judged.join(by_id, [*ROUND, "node_id"], "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("uses") > 1, "duplicate node_id"))).drop("uses")
    if static_indexed and not allow_index_conflict:
        slot = [*ROUND, "az", "node_index"]
        by_slot = rows.groupBy(*slot).agg(F.count(F.lit(1)).alias("claims")).filter("claims > 1")
        judged = judged.join(by_slot, slot, "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.col("claims") > 1, "index conflict"))).drop("claims")
    flags = judged.groupBy(*ROUND).agg(F.bool_or(F.col("reason").isNotNull()).alias("bad"))
    # A round in which only other zones were listed is valid, and empty.
    listed = raw.select(*ROUND).distinct().withColumn("listed", F.lit(True))
    every = listed if expected is None else expected.select(*ROUND).distinct().join(listed, ROUND, "left")
    zoned = hubs.select("service").distinct().withColumn("has_az", F.lit(True))
    empty = F.col("listed").isNull() & F.coalesce("has_az", F.lit(False))
    rounds = every.join(flags, ROUND, "left").join(zoned, "service", "left").select(
        *ROUND, (F.coalesce("bad", F.lit(False)) | empty).alias("void"))
    pings = judged.filter("reason is null").join(rounds.filter("not void"), ROUND, "left_semi").drop("reason", "id")
    return PingRounds(pings, judged.filter("reason is not null"), rounds)
