"""Hardware resources: what servers offer, what partitions use, and whether every hub covers the need.

Resource maps travel as MAP<STRING,BIGINT>; sums run over exploded (key, value) rows, which combine before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlens.functions.exprs import ceil_div, is_serving, stat_long
from shardlens.schema import GIB, HUB_KEY, NODE_KEY, OFFLINE, PART_KEY, SCOPE, TABLE_KEY

# Statistics key -> resource name, per service type.
SERVER_KEYS: dict[str, dict[str, str]] = {
    "standard": {
        "cpu_percent": "KSAT_CPU",
        "memcap_bytes": "MEM_CAP",
        "diskcap_bytes": "DISK_CAP",
        "diskband_bytes": "DISK_BAND",
        "netband_bytes": "NET_BAND",
    },
    "log_based": {"dbcap_bytes": "DISK_CAP", "dbcpu_cores": "CPU", "cpu_percent": "KSAT_CPU"},
    "embedding": {"instance_storage_limit_bytes": "MEM_CAP"},
}
REPLICA_KEYS: dict[str, dict[str, str]] = {"embedding": {"db_storage_limit_bytes": "MEM_CAP"}}
# Types for which a server without any usable key is an error, not just silent.
STRICT_TYPES = {"log_based", "embedding"}


def _picked(stats: Column | str, keys: dict[str, str]) -> Column:
    pairs = [F.struct(F.lit(name).alias("k"), stat_long(stats, key, missing=None).alias("v")) for key, name in keys.items()]
    made = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    return F.when(F.size(made) > 0, made)


def server_resource(servers: DataFrame, service_type: str) -> DataFrame:
    """Servers with the ``resource`` map their statistics give, and an ``error`` where the type demands one."""
    resource = _picked("statistics", SERVER_KEYS.get(service_type, SERVER_KEYS["standard"]))
    missing = F.lit(service_type in STRICT_TYPES)
    out = servers.withColumn("resource", resource)
    return out.withColumn("error", F.when(missing & F.col("resource").isNull(), "no statistics key"))


def replica_resource(facts: DataFrame, service_type: str) -> DataFrame:
    """Facts with the ``resource`` of each replica; null where the type reports none or the value does not parse."""
    keys = REPLICA_KEYS.get(service_type)
    none = F.lit(None).cast("map<string,bigint>")
    return facts.withColumn("resource", _picked("statistics", keys) if keys else none)


def table_resource(tables: DataFrame, service_type: str) -> DataFrame:
    """Tables with the ``resource`` their arguments ask for; the GiB field wins over the byte field."""
    if service_type != "embedding":
        return tables.withColumn("resource", F.lit(None).cast("map<string,bigint>"))
    field = lambda k: F.coalesce(F.get_json_object("json_args", f"$.{k}").try_cast("bigint"), F.lit(0))
    gib = field("table_size_gibibytes")
    size = F.when(gib > 0, gib * F.lit(GIB).cast("long")).otherwise(field("table_size_bytes"))
    return tables.withColumn("resource", F.create_map(F.lit("MEM_CAP"), size))


def hub_resources(nodes: DataFrame, dedupe: bool = False) -> DataFrame:
    """Resource sums per (hub, key) over non-offline nodes.  ``dedupe`` counts one node (the lowest id) per address."""
    live = nodes.filter(F.col("op") != OFFLINE)
    if dedupe:
        live = live.groupBy(*SCOPE, "host", "port").agg(
            F.min_by(F.struct("hub_name", "resource"), "node_id").alias("one")
        ).select(*SCOPE, "one.hub_name", "one.resource")
    units = live.select(*HUB_KEY, F.explode("resource").alias("key", "value"))
    return units.groupBy(*HUB_KEY, "key").agg(F.sum("value").alias("value"))


def as_map(units: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value) rows back as one map per ``keys``."""
    return units.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("resource"))


def partition_resource(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Use per (partition, key): ceil(sum / sampled) over serving reports at the intended version.

    ``facts`` carry ``resource``.  Every sampled replica counts in the divisor, whether or not it has the key.
    """
    versions = members.groupBy(*PART_KEY).agg(F.max("membership_version").alias("kept_version"))
    sampled = (
        facts.filter(is_serving() & F.col("resource").isNotNull())
        .join(versions, PART_KEY)
        .filter("membership_version = kept_version")
    )
    # One row per replica for the count, one per key for the sums: the null key marks the former.
    units = sampled.select(
        *PART_KEY,
        F.explode(F.concat(
            F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(1).cast("long").alias("value"))),
            F.map_entries("resource"),
        )).alias("u"),
    ).select(*PART_KEY, "u.key", "u.value")
    # Laid out by partition once: the sums per key and what is gathered of them (a handful of keys) share the exchange.
    sums = units.repartition(*[F.col(c) for c in PART_KEY]).groupBy(*PART_KEY, "key").agg(F.sum("value").alias("value"))
    gathered = sums.groupBy(*PART_KEY).agg(
        F.max(F.when(F.col("key").isNull(), F.col("value"))).alias("sampled"),
        F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))).alias("units"),
    )
    return gathered.select(*PART_KEY, "sampled", F.explode("units").alias("u")).select(
        *PART_KEY, "u.key", ceil_div("u.value", "sampled").alias("value"), "sampled"
    )


def table_resource_usage(part_units: DataFrame, tables: DataFrame) -> DataFrame:
    """Use per (table, key): every partition counts at least ceil(table need / parts); unsampled ones count that.

    ``tables`` carry ``resource``.  Unsampled partitions are added by difference, so no partition grid is built.
    """
    shape = tables.select(*TABLE_KEY, "parts_count")
    need = tables.select(*TABLE_KEY, "parts_count", F.explode("resource").alias("key", "need")).select(
        *TABLE_KEY, "key", ceil_div("need", "parts_count").alias("average")
    )
    in_shape = part_units.join(shape, TABLE_KEY).filter("partition_id < parts_count")
    sampled = in_shape.select(*PART_KEY).distinct().groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("sampled_parts"))
    floored = in_shape.join(need, [*TABLE_KEY, "key"], "left").groupBy(*TABLE_KEY, "key").agg(
        F.sum(F.greatest("value", F.coalesce("average", F.lit(0)))).alias("used"), F.count(F.lit(1)).alias("with_key")
    )
    return (
        floored.join(need, [*TABLE_KEY, "key"], "full_outer")
        .join(shape, TABLE_KEY)
        .join(sampled, TABLE_KEY, "left")
        .select(
            *TABLE_KEY, "key",
            (F.coalesce("used", F.lit(0))
             # Sampled partitions that lack the key rise to the average, and so do unsampled ones.
             + (F.col("parts_count") - F.coalesce("with_key", F.lit(0))) * F.coalesce("average", F.lit(0))).alias("used"),
            F.coalesce("sampled_parts", F.lit(0)).cast("long").alias("sampled_parts"),
        )
    )


def service_resource_usage(table_units: DataFrame) -> DataFrame:
    return table_units.groupBy(*SCOPE, "key").agg(F.sum("used").alias("used"))


def capacity_audit(hub_units: DataFrame, required: DataFrame) -> DataFrame:
    """Every (hub, key) that falls short of what each hub must hold.  ``required``: (scope, key, need)."""
    hubs = hub_units.select(*HUB_KEY).distinct()
    return (
        hubs.join(required.select(*SCOPE, "key", "need"), SCOPE)
        .join(hub_units, [*HUB_KEY, "key"], "left")
        .select(*HUB_KEY, "key", F.coalesce("value", F.lit(0)).cast("long").alias("has"), "need")
        .filter("has < need")
    )


def capacity_without(nodes: DataFrame, leaving: DataFrame, required: DataFrame) -> DataFrame:
    """The audit as it would be once the ``leaving`` nodes (NODE_KEY) are offline; one node counts per address."""
    staying = nodes.join(leaving.select(*NODE_KEY), NODE_KEY, "left_anti")
    return capacity_audit(hub_resources(staying, dedupe=True), required)


def capacity_with_table(nodes: DataFrame, used: DataFrame, new_table: DataFrame) -> DataFrame:
    """The audit as it would be with one more table.  ``used``: (scope, key, used); ``new_table``: (scope, resource)."""
    extra = new_table.select(*SCOPE, F.explode("resource").alias("key", "need"))
    required = used.select(*SCOPE, "key", F.col("used").alias("need")).unionByName(extra).groupBy(*SCOPE, "key").agg(
        F.sum("need").alias("need"))
    return capacity_audit(hub_resources(nodes, dedupe=True), required)
