"""Checks of tables and hubs, registry and order of tables; each gives verdict rows instead of side effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlens.session import shared_folder
from shardlens.schema import MAX_PARTS, SCOPE, TABLE_KEY, az_dimension

VALID_NAME = r"\A[a-zA-Z0-9.\-_]+\z"


# --- zones --------------------------------------------------------------------------------------------------------


def az_of_location(location: Column) -> Column:
    """Zone of a discovery location: its last dot token in upper case, with the one renamed zone."""
    token = F.upper(F.element_at(F.split(location, "[.]"), -1))
    return F.when(token == "SGP", "TXSGP1").otherwise(token)


def hub_az(az: Column) -> Column:
    """Zone name of a hub in standard form: upper case without the leading underscore."""
    return F.upper(F.regexp_replace(az, "^_", ""))


def normalize_az(pings: DataFrame, use_paz: bool = False) -> DataFrame:
    return pings.withColumn("az", F.col("paz") if use_paz else az_of_location(F.col("location")))


def region_of_az(df: DataFrame) -> DataFrame:
    """Add region, is_physical and virtual_az by zone; unknown zones keep nulls.  The dimension has 17 rows."""
    return df.join(F.broadcast(az_dimension(df.sparkSession)), "az", "left")


def regions_of_service(hubs: DataFrame) -> DataFrame:
    """Distinct regions of every service, sorted."""
    return region_of_az(hubs).filter("region is not null").groupBy(*SCOPE).agg(
        F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


def validate_hubs(hubs: DataFrame, use_paz: bool) -> DataFrame:
    """Verdict per hub: its zone must be known and physical exactly when the service uses physical zones."""
    rows = region_of_az(hubs.withColumn("az", hub_az(F.col("az"))))
    fits = F.col("is_physical") if use_paz else ~F.col("is_physical")
    ok = (F.col("az") == "STAGING") | F.coalesce(fits, F.lit(False))
    return rows.select(*SCOPE, "hub_name", "az", F.when(ok, "ok").otherwise("bad az").alias("verdict"))


# --- tables -------------------------------------------------------------------------------------------------------


def is_json_object(doc: Column) -> Column:
    return F.json_object_keys(doc).isNotNull()


def queue_shards(doc: Column) -> Column:
    """``msg_queue_shards`` of a JSON object as a whole number; null when absent or of another type."""
    return F.when(is_json_object(doc), F.get_json_object(doc, "$.msg_queue_shards").try_cast("bigint"))


def pick_scheduler(tables: DataFrame) -> DataFrame:
    """'hash_group' when the queue shards divide the partitions and are fewer, else 'adaptive'.

    Unreadable or absent arguments mean adaptive with 0 groups.
    """
    shards, parts = queue_shards(F.col("json_args")), F.col("parts_count")
    hashed = (shards > 0) & (parts % F.greatest(shards, F.lit(1).cast("long")) == 0) & (shards != parts)
    return tables.select(
        *TABLE_KEY,
        F.when(F.coalesce(hashed, F.lit(False)), "hash_group").otherwise("adaptive").alias("scheduler"),
        F.coalesce(shards, F.lit(0)).cast("long").alias("part_groups"),
    )


def validate_tables(tables: DataFrame) -> DataFrame:
    """One row per broken rule.  ``tables``: TABLE_KEY, table_name, parts_count, base_name, service_type, json_args."""
    base = tables.select(
        *SCOPE, F.col("table_name").alias("base_name"), F.col("parts_count").alias("base_parts"), F.lit(True).alias("_base"))
    doc, parts, kind = F.col("json_args"), F.col("parts_count"), F.col("service_type")
    get = lambda k: F.get_json_object(doc, f"$.{k}")
    number = lambda k: F.coalesce(get(k).try_cast("bigint"), F.lit(0))
    wants_base = F.coalesce(F.col("base_name"), F.lit("")) != ""
    has_base = F.coalesce("_base", F.lit(False))
    shards, raw_shards, readable = queue_shards(doc), get("msg_queue_shards"), is_json_object(doc)
    embedding, logged = kind == "embedding", kind == "log_based"
    uneven = (shards <= 0) | (parts % F.greatest(shards, F.lit(1).cast("long")) != 0)
    rules = {
        "bad name": ~F.col("table_name").rlike(VALID_NAME),
        "bad parts count": (parts <= 0) | (parts > MAX_PARTS),
        "base missing": wants_base & ~has_base,
        "base parts differ": wants_base & has_base & (F.col("base_parts") != parts),
        "bad json": ~readable | (~logged & raw_shards.isNotNull() & shards.isNull()),
        "bad queue shards": ~logged & readable & uneven,
        "no prefix": embedding & readable & (F.coalesce(get("btq_prefix"), F.lit("")) == ""),
        "no keys": embedding & readable & (number("table_num_keys") <= 0),
        "no size": embedding & readable & (number("table_size_bytes") <= 0) & (number("table_size_gibibytes") <= 0),
        "bad inflation": embedding & readable & (F.coalesce(get("table_inflation_ratio").try_cast("double"), F.lit(0.0)) < 1.0),
        "prefix not dummy": logged & readable & (F.coalesce(get("btq_prefix"), F.lit("")) != "dummy"),
    }
    broken = F.filter(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]),
        lambda x: x.isNotNull(),
    )
    return tables.join(base, [*SCOPE, "base_name"], "left").select(*TABLE_KEY, F.explode(broken).alias("violation"))


def registry(entries: DataFrame) -> DataFrame:
    """Tables under the service that owns them: the last of a one- or two-item comma list.

    ``entries``: (table_id, table_name, belongs_to, base_name).
    """
    items = F.split("belongs_to", ",")
    owner = F.element_at(items, -1)
    verdict = F.when((F.size(items) > 2), "list too long").when(owner == "", "no service").otherwise("ok")
    return entries.select(owner.alias("owner"), "table_id", "table_name", "base_name", verdict.alias("verdict"))


def tables_per_service(registered: DataFrame) -> DataFrame:
    return registered.filter("verdict = 'ok'").groupBy("owner").agg(
        F.count(F.lit(1)).alias("tables"), F.count(F.when(F.coalesce("base_name", F.lit("")) != "", 1)).alias("shades"),
        F.min("table_id").alias("first_id"), F.max("table_id").alias("last_id"),
    )


def topological_table_order(tables: DataFrame) -> DataFrame:
    """Depth of every table below its outermost base; bases come before their shades in (depth, table_id) order.

    Tables on a cycle, below one, or below a missing base get depth -1 and ``unordered``.  Pointers jump twice as far
    each round, so a chain of n shades takes log2(n) joins; each round is checkpointed to cut its lineage.
    """
    spark = tables.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    known = tables.select(*SCOPE, F.col("table_id").alias("base_table"), F.lit(True).alias("_there"))
    # ``jump`` is the table 2^k levels up (null once past the root), ``depth`` the levels climbed so far.
    state = tables.join(known, [*SCOPE, "base_table"], "left").select(
        *TABLE_KEY, F.when(F.col("base_table").isNull() | F.col("_there"), F.col("base_table")).alias("jump"),
        F.when(F.col("base_table").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        (F.col("base_table").isNotNull() & F.col("_there").isNull()).alias("lost"),
    ).checkpoint()
    rounds_left = max(1, state.count()).bit_length() + 1
    while rounds_left > 0 and state.filter("jump is not null").limit(1).count() > 0:
        up = state.select(
            *SCOPE, F.col("table_id").alias("jump"), F.col("jump").alias("up_jump"), F.col("depth").alias("up_depth"),
            F.col("lost").alias("up_lost"))
        state = state.join(up, [*SCOPE, "jump"], "left").select(
            *TABLE_KEY, F.col("up_jump").alias("jump"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"),
            (F.col("lost") | F.coalesce("up_lost", F.lit(False))).alias("lost"),
        ).checkpoint()
        rounds_left -= 1
    unordered = F.col("lost") | F.col("jump").isNotNull()
    return state.select(*TABLE_KEY, F.when(unordered, -1).otherwise(F.col("depth")).cast("long").alias("depth"), unordered.alias("unordered"))
