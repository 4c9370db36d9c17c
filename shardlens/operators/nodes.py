"""Node fleets: filters, lookups, hub sizes, address and index audits, shrink and hub choices, admin checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlens.functions.exprs import count_where, host_port, int_div, node_index_parts
from shardlens.functions.ranking import id_bucket, numbered
from shardlens.functions.scoring import MAX_WEIGHT, MIN_WEIGHT, node_score
from shardlens.schema import HUB_KEY, NODE_KEY, NOOP, OFFLINE, PART_KEY, RESTART, SCOPE, TABLE_KEY

ADDRESS_KEY = [*SCOPE, "host", "port"]


# --- filters ------------------------------------------------------------------------------------------------------


def node_filter(
    alive: bool | None = None,
    hub: str | None = None,
    op: int | None = None,
    not_op: int | None = None,
    negate: bool = False,
) -> Column:
    """AND of the given node conditions, optionally negated as a whole."""
    parts = []
    if alive is not None:
        parts.append(F.col("is_alive") == alive)
    if hub is not None:
        parts.append(F.col("hub_name") == hub)
    if op is not None:
        parts.append(F.col("op") == op)
    if not_op is not None:
        parts.append(F.col("op") != not_op)
    cond = reduce(lambda a, b: a & b, parts, F.lit(True))
    return ~cond if negate else cond


def filter_nodes(
    nodes: DataFrame,
    cond: Column | None = None,
    exclude_members: DataFrame | None = None,
    with_role: tuple[DataFrame, int] | None = None,
    without_role: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Nodes that meet ``cond`` and are (not) among the given member rows.

    ``with_role`` keeps members of that role; ``without_role`` keeps members of any other role.
    """
    out = nodes if cond is None else nodes.filter(cond)
    if exclude_members is not None:
        out = out.join(exclude_members.select(*NODE_KEY), NODE_KEY, "left_anti")
    if with_role is not None:
        members, role = with_role
        out = out.join(members.filter(F.col("role") == role).select(*NODE_KEY), NODE_KEY, "left_semi")
    if without_role is not None:
        members, role = without_role
        out = out.join(members.filter(F.col("role") != role).select(*NODE_KEY), NODE_KEY, "left_semi")
    return out


def detectable(pings: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pings whose zone has a hub in their service."""
    return pings.join(hubs.select("service", "az"), ["service", "az"], "left_semi")


def drop_blacklisted_dc(pings: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Drop pings from data centres listed for their service or for every service (``*``).

    ``blacklist`` holds (service, dc).  Two equi anti joins instead of one with OR, so neither becomes nested loops.
    """
    everywhere = blacklist.filter(F.col("service") == "*").select("dc")
    return pings.join(blacklist, ["service", "dc"], "left_anti").join(everywhere, "dc", "left_anti")


# --- hubs ---------------------------------------------------------------------------------------------------------


def hub_sizes(nodes: DataFrame) -> DataFrame:
    """Non-offline nodes per hub, and per zone in the rows with hub ``*``."""
    by_hub = nodes.filter(F.col("op") != OFFLINE).groupBy(*SCOPE, "az", "hub_name").agg(F.count(F.lit(1)).alias("size"))
    by_az = by_hub.groupBy(*SCOPE, "az").agg(F.sum("size").alias("size")).withColumn("hub_name", F.lit("*"))
    return by_hub.unionByName(by_az)


def node_order(nodes: DataFrame) -> DataFrame:
    """0-based position of every node in (hub, id) order and the number of nodes of its scope."""
    count = nodes.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("node_count"))
    rows = nodes.select(*NODE_KEY, "hub_name").withColumn("_b", id_bucket(nodes))
    placed = numbered(rows, SCOPE, ["hub_name", "_b"], ["node_id"], out="position")
    return placed.select(*NODE_KEY, (F.col("position") - 1).alias("position")).join(count, SCOPE)


def takes_part(pairs: DataFrame, nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """Whether the node of each (table, node) pair is inside its table's grayscale percentage.

    ``tables`` holds (table key, grayscale); 100 and more lets every node in, 0 and less none.
    """
    share = (F.col("position") + 1).cast("float") / F.col("node_count").cast("float")
    limit = F.col("grayscale").cast("float") / F.lit(100).cast("float")
    inside = F.when(F.col("grayscale") >= 100, True).when(F.col("grayscale") <= 0, False).otherwise(
        share.cast("float") <= limit.cast("float")
    )
    return (
        pairs.select(*TABLE_KEY, "node_id")
        .join(tables.select(*TABLE_KEY, "grayscale"), TABLE_KEY)
        .join(node_order(nodes), NODE_KEY)
        .select(*TABLE_KEY, "node_id", "position", "grayscale", inside.alias("takes_part"))
    )


# --- audits -------------------------------------------------------------------------------------------------------


def index_conflicts(nodes: DataFrame) -> DataFrame:
    """(zone, index) pairs that several non-offline nodes claim; ``conflicts`` counts the surplus ones."""
    return (
        nodes.filter(F.col("op") != OFFLINE)
        .groupBy(*SCOPE, "az", "node_index")
        .agg(F.count(F.lit(1)).alias("claimants"), F.min("node_id").alias("first_node"))
        .filter("claimants > 1")
        .withColumn("conflicts", F.col("claimants") - 1)
    )


def missing_indexes(nodes: DataFrame) -> DataFrame:
    """Unused node indexes of every hub, from 0 up to the largest one in use."""
    used = (
        nodes.filter(F.col("op") != OFFLINE)
        .select(*HUB_KEY, node_index_parts("node_index")["sub_no"].cast("long").alias("sub_no"))
        .filter("sub_no >= 0")
        .distinct()
    )
    top = used.groupBy(*HUB_KEY).agg(F.max("sub_no").alias("top"))
    every = top.select(*HUB_KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("sub_no"))
    return every.join(used, [*HUB_KEY, "sub_no"], "left_anti")


def address_conflicts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """What to do with nodes that share an address or have left for good.  Replica counts come from membership.

    Alone: offline, dead and without replicas -> removable.  Shared: with several alive nodes all stay; a dead one
    goes offline when exactly one is alive, is ambiguous when none is, and an offline dead one is removable once
    it holds nothing.
    """
    load = members.groupBy(*NODE_KEY).agg(F.count(F.lit(1)).alias("replicas"))
    shared = nodes.groupBy(*ADDRESS_KEY).agg(
        F.count(F.lit(1)).alias("at_address"), count_where(F.col("is_alive")).alias("alive_there")
    )
    offline, dead, empty = F.col("op") == OFFLINE, ~F.col("is_alive"), F.col("replicas") == 0
    several = F.col("at_address") > 1
    verdict = (
        F.when(several & (F.col("alive_there") > 1), "keep")
        .when(offline & dead & empty, "removable")
        .when(~several | ~dead | offline, "keep")
        .when(F.col("alive_there") == 1, "mark offline")
        .otherwise("ambiguous")
    )
    return (
        nodes.join(shared, ADDRESS_KEY)
        .join(load, NODE_KEY, "left")
        .withColumn("replicas", F.coalesce("replicas", F.lit(0)).cast("long"))
        .select(*NODE_KEY, "host", "port", "at_address", "alive_there", "replicas", verdict.alias("verdict"))
    )


# --- scores -------------------------------------------------------------------------------------------------------


def refresh_scores(nodes: DataFrame, estimator: str, force: bool = False) -> DataFrame:
    """Next score of every node and why; ``blocks`` marks nodes that keep their scope from scheduling."""
    fresh, old = node_score("resource", estimator), F.col("score")
    valid, offline = fresh != 0, F.col("op") == OFFLINE
    stale = F.lit(force) | (old == 0)
    verdict = (
        F.when(valid & (fresh != old), "updated").when(valid, "unchanged")
        .when(offline & (old != 0), "reset").when(offline, "unchanged")
        .when(stale, "blocks").otherwise("kept old")
    )
    new = F.when(valid, fresh).when(offline, F.lit(0)).otherwise(old).cast("long")
    return nodes.select(
        *NODE_KEY, old.alias("old_score"), new.alias("new_score"), verdict.alias("verdict"),
        (~valid & ~offline & stale).alias("blocks"),
    )


def scores_ready(refreshed: DataFrame) -> DataFrame:
    """One row per scope: may it be scheduled?"""
    return refreshed.groupBy(*SCOPE).agg(
        (~F.bool_or("blocks")).alias("ready"), count_where(F.col("blocks")).alias("blocking_nodes")
    )


# --- lookups and admin checks -------------------------------------------------------------------------------------


def lookup_nodes(nodes: DataFrame, addrs: DataFrame, match_port: bool) -> DataFrame:
    """Resolve (scope, request_id, host, port) to a node.

    A unique host:port wins.  When it is shared or unknown, ``match_port`` finds nothing; without it the lowest
    node id at the address, else on the host, is taken.
    """
    exact = nodes.groupBy(*ADDRESS_KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("node_id").alias("_exact"))
    found = addrs.join(exact, ADDRESS_KEY, "left")
    if match_port:
        return found.withColumn("node_id", F.when(F.col("_n") == 1, F.col("_exact"))).drop("_n", "_exact")
    on_host = nodes.groupBy(*SCOPE, "host").agg(F.min("node_id").alias("_host"))
    return (
        found.join(on_host, [*SCOPE, "host"], "left")
        .withColumn("node_id", F.coalesce("_exact", "_host"))
        .drop("_n", "_exact", "_host")
    )


def _resolved(nodes: DataFrame, requests: DataFrame, match_port: bool, *fields: str) -> DataFrame:
    state = nodes.select(*NODE_KEY, *[F.col(f).alias(f"now_{f}") for f in fields])
    return lookup_nodes(nodes, requests, match_port).join(state, NODE_KEY, "left")


def node_admin_check(nodes: DataFrame, requests: DataFrame, match_port: bool = True) -> DataFrame:
    """Verdict on requests to set a node's ``op``; an offline node cannot be set to restart."""
    illegal = (F.col("now_op") == OFFLINE) & (F.col("op") == RESTART)
    verdict = (
        F.when(F.col("node_id").isNull(), "not found").when(F.col("now_op") == F.col("op"), "duplicate")
        .when(illegal, "illegal").otherwise("ok")
    )
    return _resolved(nodes, requests, match_port, "op").select(*SCOPE, "request_id", "node_id", verdict.alias("verdict"))


def weight_update_check(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict on requests to set a node's ``weight``: an equal one is fine as it is, others need 0.1 to 10."""
    w = F.col("weight").cast("float")
    out_of_range = (w < F.lit(MIN_WEIGHT).cast("float")) | (w > F.lit(MAX_WEIGHT).cast("float"))
    verdict = (
        F.when(F.col("node_id").isNull(), "not found").when(F.col("now_weight").cast("float") == w, "unchanged")
        .when(out_of_range, "out of range").otherwise("ok")
    )
    return _resolved(nodes, requests, True, "weight").select(*SCOPE, "request_id", "node_id", verdict.alias("verdict"))


def assign_hub_check(nodes: DataFrame, hubs: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict on requests to move a node to ``hub_name``."""
    target = hubs.select(*HUB_KEY, F.col("az").alias("hub_az"))
    verdict = (
        F.when(F.col("hub_az").isNull(), "unknown hub").when(F.col("node_id").isNull(), "not found")
        .when(F.col("now_hub_name") == F.col("hub_name"), "duplicate").when(F.col("now_az") != F.col("hub_az"), "other az")
        .otherwise("ok")
    )
    return (
        _resolved(nodes, requests, True, "hub_name", "az").join(target, HUB_KEY, "left")
        .select(*SCOPE, "request_id", "node_id", verdict.alias("verdict"))
    )


def remove_replicas_check(members: DataFrame, tables: DataFrame, nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict on requests to drop a replica.  The node is named by ``unique_id`` or, without one, by host:port."""
    by_id = nodes.select(*SCOPE, F.col("node_id").alias("unique_id"), F.lit(True).alias("known"))
    looked_up = lookup_nodes(nodes, requests, match_port=True).join(by_id, [*SCOPE, "unique_id"], "left")
    node = F.when(F.col("unique_id").isNotNull(), F.when(F.col("known"), F.col("unique_id"))).otherwise(F.col("node_id"))
    held = members.select(*PART_KEY, "node_id", F.lit(True).alias("held"))
    in_range = (F.col("partition_id") >= 0) & (F.col("partition_id") < F.col("parts_count"))
    verdict = (
        F.when(F.col("node_id").isNull(), "unknown node").when(~in_range, "bad partition")
        .when(F.col("held").isNull(), "not a member").otherwise("ok")
    )
    return (
        looked_up.withColumn("node_id", node)
        .join(tables.select(*TABLE_KEY, "parts_count"), TABLE_KEY)
        .join(held, [*PART_KEY, "node_id"], "left")
        .select(*SCOPE, "request_id", "node_id", verdict.alias("verdict"))
    )


def hint_conflicts(nodes: DataFrame, hubs: DataFrame, hints: DataFrame) -> DataFrame:
    """Which hub hint applies to each node.  ``hints`` holds (scope, address, hinted_hub), the address being
    host:port or host; host:port wins.  A hint counts only when its hub exists in the node's zone."""
    by_addr = hints.select(*SCOPE, F.col("address").alias("addr"), F.col("hinted_hub").alias("hub_by_addr"))
    by_host = hints.select(*SCOPE, F.col("address").alias("host"), F.col("hinted_hub").alias("hub_by_host"))
    target = hubs.select(*SCOPE, F.col("hub_name").alias("hinted_hub"), F.col("az").alias("hint_az"))
    verdict = (
        F.when(F.col("hinted_hub").isNull(), "no hint").when(F.col("hint_az").isNull(), "unknown hub")
        .when(F.col("hint_az") != F.col("az"), "other az").otherwise("used")
    )
    return (
        nodes.withColumn("addr", host_port())
        .join(by_addr, [*SCOPE, "addr"], "left")
        .join(by_host, [*SCOPE, "host"], "left")
        .withColumn("hinted_hub", F.coalesce("hub_by_addr", "hub_by_host"))
        .join(target, [*SCOPE, "hinted_hub"], "left")
        .select(*NODE_KEY, "hinted_hub", verdict.alias("verdict"))
    )


# --- fleet changes ------------------------------------------------------------------------------------------------


def replacement_status(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """State of node replacements.  ``pairs`` holds (scope, request_id, pair_id, src_host, src_port, dst_host,
    dst_port).  A request waits until all its new nodes are seen; then old ones still in use are to go offline."""
    end = lambda side: lookup_nodes(
        nodes,
        pairs.select(*SCOPE, "request_id", "pair_id", F.col(f"{side}_host").alias("host"), F.col(f"{side}_port").alias("port")),
        match_port=True,
    ).select(*SCOPE, "request_id", "pair_id", F.col("node_id").alias(f"{side}_node"))
    op = nodes.select(*SCOPE, F.col("node_id").alias("src_node"), F.col("op").alias("src_op"))
    both = end("src").join(end("dst"), [*SCOPE, "request_id", "pair_id"]).join(op, [*SCOPE, "src_node"], "left")
    pending = F.col("src_node").isNotNull() & (F.col("src_op") != OFFLINE)
    whole = both.groupBy(*SCOPE, "request_id").agg(
        F.bool_or(F.col("dst_node").isNull()).alias("waiting"), F.bool_or(pending).alias("unfinished")
    )
    action = (
        F.when(F.col("waiting"), "wait").when(pending, "offline source").otherwise("none")
    )
    return both.join(whole, [*SCOPE, "request_id"]).select(
        *SCOPE, "request_id", "pair_id", "src_node", "dst_node", action.alias("action"),
        (~F.col("waiting") & ~F.col("unfinished")).alias("satisfied"),
    )


def az_expansion_status(nodes: DataFrame, hubs: DataFrame, targets: DataFrame) -> DataFrame:
    """State of zone growth requests (scope, request_id, az, new_size): current size, whether it is reached, and
    whether the request makes sense.  Zones without a hub are ignored, which counts as reached."""
    sizes = (
        hubs.select(*HUB_KEY, "az").join(
            nodes.filter(F.col("op") != OFFLINE).groupBy(*HUB_KEY).agg(F.count(F.lit(1)).alias("size")), HUB_KEY, "left")
        .groupBy(*SCOPE, "az").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("current_size"))
    )
    size = F.coalesce("current_size", F.lit(-1)).cast("long")
    return targets.join(sizes, [*SCOPE, "az"], "left").select(
        *SCOPE, "request_id", "az", "new_size", size.alias("current_size"),
        (F.col("current_size").isNull() | (F.col("current_size") >= F.col("new_size"))).alias("reached"),
        F.when(F.col("current_size").isNull(), "no hub")
        .when(F.col("new_size") <= F.col("current_size"), "not larger").otherwise("ok").alias("request"),
    )


def shrink_by_index(nodes: DataFrame, hubs: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes to take offline when zones with indexed nodes shrink to ``new_size``: every index past the last one
    kept per hub.  Sizes that do not divide by the zone's hubs select nothing (see ``shrink_request_check``)."""
    per_az = hubs.groupBy(*SCOPE, "az").agg(F.count(F.lit(1)).alias("hub_count"))
    kept = targets.join(per_az, [*SCOPE, "az"]).filter("new_size > 0 and new_size % hub_count = 0")
    last = int_div(F.col("new_size").cast("long"), F.col("hub_count")) - 1
    sub = node_index_parts("node_index")["sub_no"]
    return (
        nodes.select(*NODE_KEY, "az", "hub_name", sub.alias("sub_no"))
        .join(kept.select(*SCOPE, "az", last.alias("last_kept")), [*SCOPE, "az"])
        .filter("sub_no > last_kept")
        .select(*NODE_KEY, "az", "hub_name", "sub_no")
    )


def shrink_request_check(hubs: DataFrame, targets: DataFrame, indexed: bool) -> DataFrame:
    per_az = hubs.groupBy(*SCOPE, "az").agg(F.count(F.lit(1)).alias("hub_count"))
    uneven = F.lit(indexed) & (F.col("new_size") % F.col("hub_count") != 0)
    verdict = (
        F.when(F.col("hub_count").isNull(), "no hub").when(F.col("new_size") <= 0, "bad size")
        .when(uneven, "not divisible").otherwise("ok")
    )
    return targets.join(per_az, [*SCOPE, "az"], "left").select(*SCOPE, "az", "new_size", verdict.alias("verdict"))


def shrink_by_load(nodes: DataFrame, hubs: DataFrame, targets: DataFrame, domain: str = "host") -> DataFrame:
    """Nodes to take offline when zones shrink to ``new_size``: always from the currently largest hub (lowest name
    on ties), dead nodes first, restarting next, a whole failure domain ('host' or 'process') at a time.

    A hub gives up its domains in an order of its own, and its size before each step falls strictly.  So the greedy
    loop over hubs is the merge of those sequences by size, and the cut is a running total.
    """
    live = (
        nodes.filter(F.col("op") != OFFLINE)
        .join(hubs.select(*HUB_KEY), HUB_KEY, "left_semi")
        .join(targets.select(*SCOPE, "az", "new_size"), [*SCOPE, "az"])
    )
    where = F.col("host") if domain == "host" else host_port()
    keyed = live.select(
        *NODE_KEY, "az", "hub_name", "new_size", where.alias("domain"), F.col("is_alive").cast("int").alias("alive"),
        F.when(F.col("op") == RESTART, 0).otherwise(1).alias("calm"),
    )
    first = F.min(F.struct("alive", "calm", "node_id"))
    domains = (
        keyed.groupBy(*SCOPE, "az", "hub_name", "domain", "new_size")
        .agg(F.count(F.lit(1)).alias("size"), first.alias("f"))
        .select(*SCOPE, "az", "hub_name", "domain", "new_size", "size", "f.alive", "f.calm", "f.node_id")
    )
    hub_total = domains.groupBy(*SCOPE, "az", "hub_name").agg(F.sum("size").alias("hub_total"))
    az_total = domains.groupBy(*SCOPE, "az").agg(F.sum("size").alias("az_total"))
    steps = numbered(
        domains.withColumn("_b", id_bucket(domains)), [*SCOPE, "az", "hub_name"], ["alive", "calm", "_b"], ["node_id"],
        out="given_up", weight="size",
    ).join(hub_total, [*SCOPE, "az", "hub_name"]).withColumn("level", F.col("given_up") - F.col("hub_total"))
    merged = numbered(
        steps.withColumn("_lb", F.floor(F.col("level") / 1024)), [*SCOPE, "az"], ["_lb"], ["level", "hub_name"],
        out="removed_before", weight="size",
    ).join(az_total, [*SCOPE, "az"])
    taken = merged.filter("az_total - removed_before > new_size").select(*SCOPE, "az", "hub_name", "domain")
    return keyed.join(taken, [*SCOPE, "az", "hub_name", "domain"], "left_semi").select(*NODE_KEY, "az", "hub_name")


def hub_recommendation(
    new_nodes: DataFrame, nodes: DataFrame, hubs: DataFrame, hints: DataFrame, domain: str = "host"
) -> DataFrame:
    """Hub for each new node: the one its index names; else the only hub of its zone, a valid hint, the hub that
    already holds its failure domain, or the hub with the fewest addresses (lowest name on ties)."""
    live = nodes.filter(F.col("op") != OFFLINE).join(hubs.select(*HUB_KEY), HUB_KEY, "left_semi")
    used = live.groupBy(*HUB_KEY).agg(F.count_distinct("host", "port").alias("addresses"))
    sized = hubs.select(*HUB_KEY, "az").join(used, HUB_KEY, "left").withColumn(
        "addresses", F.coalesce("addresses", F.lit(0)).cast("long"))
    per_az = sized.groupBy(*SCOPE, "az").agg(
        F.count(F.lit(1)).alias("hub_count"), F.min(F.struct("addresses", "hub_name"))["hub_name"].alias("emptiest"),
        F.min("hub_name").alias("first_hub"),
    )
    place = ["host"] if domain == "host" else ["host", "port"]
    same = live.groupBy(*SCOPE, "az", *place).agg(F.min("hub_name").alias("domain_hub"))
    hinted = hint_conflicts(new_nodes, hubs, hints).filter("verdict = 'used'").select(*NODE_KEY, "hinted_hub")
    index = node_index_parts("node_index")
    by_index = F.concat_ws("_", "az", index["hub_no"].cast("string"))
    found = (
        new_nodes.join(per_az, [*SCOPE, "az"], "left").join(same, [*SCOPE, "az", *place], "left").join(hinted, NODE_KEY, "left")
    )
    indexed = F.coalesce(F.col("node_index"), F.lit("")) != ""
    reason = (
        F.when(indexed, "index").when(F.col("hub_count").isNull(), "no hub").when(F.col("hub_count") == 1, "only hub")
        .when(F.col("hinted_hub").isNotNull(), "hint").when(F.col("domain_hub").isNotNull(), "failure domain")
        .otherwise("fewest addresses")
    )
    hub = (
        F.when(indexed, by_index).when(F.col("hub_count") == 1, F.col("first_hub"))
        .otherwise(F.coalesce("hinted_hub", "domain_hub", "emptiest"))
    )
    return found.select(*NODE_KEY, hub.alias("hub_name"), reason.alias("reason"))


def node_state_transitions(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Next state of every changed node.  ``changes`` holds (node key, alive, new_process_id), one row per node.

    A pending restart clears when the process id changed; unknown nodes start with op 0, weight 1, score 0.
    """
    now = nodes.select(*NODE_KEY, "op", "weight", "score", "process_id", F.lit(True).alias("known"))
    known = F.coalesce("known", F.lit(False))
    restarted = F.col("alive") & (F.col("op") == RESTART) & (F.col("process_id") != F.col("new_process_id"))
    op = F.when(~known | restarted, NOOP).otherwise(F.col("op")).cast("long")
    kind = (
        F.when(~known & ~F.col("alive"), "unknown dead").when(~known, "new").when(~F.col("alive"), "dead")
        .when(restarted, "restarted").otherwise("refreshed")
    )
    return changes.join(now, NODE_KEY, "left").select(
        *NODE_KEY, kind.alias("kind"), op.alias("op"), F.col("alive").alias("is_alive"),
        F.when(known, F.col("weight")).otherwise(F.lit(1.0)).cast("float").alias("weight"),
        F.when(known, F.col("score")).otherwise(F.lit(0)).cast("long").alias("score"),
        F.when(F.col("alive") | ~known, F.col("new_process_id")).otherwise(F.col("process_id")).alias("process_id"),
    )
