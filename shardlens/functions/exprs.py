"""Column expressions shared by the operators: addresses, paths, ids, maps, times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardlens.schema import NOOP, OFFLINE, PRIMARY, RESTART, ROLE_NAMES, SECONDARY


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- roles and node state -----------------------------------------------------------------------------------------


def is_serving(role: Column | str = "role") -> Column:
    return col(role).isin(PRIMARY, SECONDARY)


def is_normal(alive: Column | str = "is_alive", op: Column | str = "op") -> Column:
    return col(alive) & (col(op) == NOOP)


def is_servable(alive: Column | str = "is_alive", op: Column | str = "op") -> Column:
    return (col(op) != OFFLINE) & (col(alive) | (col(op) == RESTART))


def role_name(role: Column | str = "role") -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, col(role).cast("int")), F.lit("invalid"))


def count_where(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


# --- checkpoint paths ---------------------------------------------------------------------------------------------

# <prefix>/table_<id>/<session>_<ts>; the greedy prefix makes the last "/table_" win.
CHECKPOINT_PATH = r"^(.*)/table_([+-]?[0-9]+)/([+-]?[0-9]+)_([+-]?[0-9]+)$"


def checkpoint_parts(path: Column | str) -> Column:
    """Struct (prefix, table_id, session_id, start_sec), null when the path has another form."""
    p = col(path)
    field = lambda i: F.regexp_extract(p, CHECKPOINT_PATH, i)
    last = F.element_at(F.split(p, "/table_"), -1)
    well_formed = p.rlike(CHECKPOINT_PATH) & last.rlike(r"^[+-]?[0-9]+/[+-]?[0-9]+_[+-]?[0-9]+$")
    parsed = F.struct(
        field(1).alias("prefix"),
        field(2).try_cast("bigint").alias("table_id"),
        field(3).try_cast("bigint").alias("session_id"),
        field(4).try_cast("bigint").alias("start_sec"),
    )
    return F.when(well_formed, parsed)


def checkpoint_path(prefix: Column | str, table_id: Column | str, session: Column | str, ts: Column | str) -> Column:
    return F.concat(
        F.regexp_replace(col(prefix), "/$", ""),
        F.lit("/table_"),
        col(table_id).cast("string"),
        F.lit("/"),
        col(session).cast("string"),
        F.lit("_"),
        col(ts).cast("string"),
    )


# --- addresses and ids --------------------------------------------------------------------------------------------


def host_port(host: Column | str = "host", port: Column | str = "port") -> Column:
    return F.concat_ws(":", col(host), col(port).cast("string"))


def split_host_port(addr: Column | str) -> Column:
    """Struct (host, port); null unless the text is ``host:port`` with a numeric port."""
    parts = F.split(col(addr), ":")
    return F.when(
        (F.size(parts) == 2) & parts[1].try_cast("int").isNotNull(),
        F.struct(parts[0].alias("host"), parts[1].try_cast("int").alias("port")),
    )


def discovery_host(discovery_id: Column | str) -> Column:
    """Host of a ``protocol:host:port`` id, empty text when it has another number of parts."""
    parts = F.split(col(discovery_id), ":")
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).otherwise(F.lit(""))


NODE_INDEX = r"^\s*([+-]?[0-9]+)\.([+-]?[0-9]+)"


def node_index_parts(index: Column | str) -> Column:
    """Struct (hub_no, sub_no) of ``a.b``; null when it does not start that way."""
    c = col(index)
    return F.when(
        c.rlike(NODE_INDEX),
        F.struct(
            F.regexp_extract(c, NODE_INDEX, 1).try_cast("int").alias("hub_no"),
            F.regexp_extract(c, NODE_INDEX, 2).try_cast("int").alias("sub_no"),
        ),
    )


def padded_node_index(index: Column | str, width: int = 3) -> Column:
    parts = node_index_parts(index)
    pad = lambda c: F.lpad(c.cast("string"), width, "0")
    return F.concat_ws(".", pad(parts["hub_no"]), pad(parts["sub_no"]))


def pack_part(table_id: Column | str, partition_id: Column | str) -> Column:
    return F.shiftleft(col(table_id).cast("long"), 32) + col(partition_id).cast("long")


def unpack_table(packed: Column | str) -> Column:
    return F.shiftright(col(packed), 32)


def unpack_partition(packed: Column | str) -> Column:
    return col(packed).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def list_key(items: Column | str) -> Column:
    """Order-free key of a string list."""
    return F.array_join(F.array_sort(col(items)), ",")


# --- statistics maps ----------------------------------------------------------------------------------------------


def stat_long(stats: Column | str, key: str, missing: int | None = -1) -> Column:
    value = F.element_at(col(stats), F.lit(key)).try_cast("bigint")
    return value if missing is None else F.coalesce(value, F.lit(missing).cast("long"))


def has_stat(stats: Column | str, key: str) -> Column:
    return F.coalesce(F.map_contains_key(col(stats), key), F.lit(False))


def _zip(a: Column, b: Column, merge: Callable[[Column, Column, Column], Column]) -> Column:
    return F.map_zip_with(a, b, merge)


def map_add(a: Column | str, b: Column | str) -> Column:
    zero = F.lit(0).cast("long")
    return _zip(col(a), col(b), lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def map_upper(a: Column | str, b: Column | str) -> Column:
    """Keywise maximum; a missing key counts as 0, and a key only in ``b`` needs a positive value to enter."""
    zero = F.lit(0).cast("long")
    keys_a = col(a)
    merged = _zip(keys_a, col(b), lambda k, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, x, zero)))
    return F.map_filter(merged, lambda k, v: F.map_contains_key(keys_a, k) | (v > 0))


def map_sub(a: Column | str, b: Column | str) -> Column:
    """Keywise difference; keys of ``b`` that would fall to 0 or below leave the map."""
    left, right = col(a), col(b)
    merged = _zip(
        left,
        right,
        lambda k, x, y: F.when(y.isNull(), x).when(F.coalesce(x, F.lit(0).cast("long")) > y, x - y),
    )
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def map_ceil_div(a: Column | str, parts: Column) -> Column:
    return F.transform_values(col(a), lambda k, v: ceil_div(v, parts))


def ceil_div(value: Column | str, parts: Column | str) -> Column:
    return int_div(col(value) + col(parts) - F.lit(1), parts)


def int_div(a: Column | str, b: Column | str) -> Column:
    """Truncating division of longs (never through double)."""
    return F.call_function("div", col(a), col(b))


# --- times --------------------------------------------------------------------------------------------------------


def sec_to_ts(sec: Column | str) -> Column:
    return F.timestamp_seconds(col(sec))


def ts_to_sec(ts: Column | str) -> Column:
    return F.unix_timestamp(col(ts).cast("timestamp"))


def run_duration_text(start: Column | str, finish: Column | str) -> Column:
    """Seconds between start and finish, ``-`` while the run is going on (finish 0 or null)."""
    f = F.coalesce(col(finish), F.lit(0).cast("long"))
    return F.when(f == 0, F.lit("-")).otherwise((f - col(start)).cast("string"))


# --- node status names of the older route format ------------------------------------------------------------------

# The five status names.
STATUS_ENABLE = "NODE_ENABLE"
STATUS_ERROR = "NODE_ERROR"
STATUS_TEMPDOWN = "NODE_TEMPDOWN"
STATUS_PREDISABLE = "NODE_PREDISABLE"
STATUS_DISABLE = "NODE_DISABLE"


def status_of_node(op: Column | str = "op", alive: Column | str = "is_alive") -> Column:
    return (
        F.when(col(op) == RESTART, STATUS_TEMPDOWN)
        .when(col(op) == OFFLINE, STATUS_PREDISABLE)
        .when(col(alive), STATUS_ENABLE)
        .otherwise(STATUS_ERROR)
    )


def node_of_status(status: Column | str) -> Column:
    """Struct (op, is_alive) for a status name, null for an unknown one."""
    s = col(status)
    op = (
        F.when(s.isin(STATUS_ERROR, STATUS_ENABLE), NOOP)
        .when(s == STATUS_TEMPDOWN, RESTART)
        .when(s.isin(STATUS_PREDISABLE, STATUS_DISABLE), OFFLINE)
    )
    return F.when(op.isNotNull(), F.struct(op.alias("op"), (s != STATUS_ERROR).alias("is_alive")))


# --- JSON documents -----------------------------------------------------------------------------------------------


def edit_json(doc: Column | str, schema: str, path: list[str], edit: Callable[[Column], Column]) -> Column:
    """Rewrite the value at ``path`` of a JSON column; null when the path is absent.

    ``schema`` declares the document, so the whole edit is one from_json/withField/to_json chain.
    """
    parsed = F.from_json(col(doc), schema)
    dotted = ".".join(path)
    target = parsed
    for name in path:
        target = target.getField(name)
    edited = F.to_json(parsed.withField(dotted, edit(target)))
    return F.when(F.get_json_object(col(doc), "$." + dotted).isNotNull(), edited)

