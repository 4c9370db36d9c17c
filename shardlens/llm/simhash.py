"""SimHash near-duplicates: a self-join of binary tries within an error budget of bits, and its components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm.common import TO_LOWER, WORD, map_batches, staged, unused
from shardlens.llm.components import star_components

BITS = 64


@dataclass(frozen=True)
class SimHashParams:
    """Shingles of ``words`` words; ``errors`` differing bits link.  A bucket of more than ``bucket`` fingerprints is
    parted by further bits.  Tries of about ``rows`` fingerprints are joined at once."""

    words: int = 4
    errors: int = 4
    seed: int = 42
    bucket: int = 1024
    rows: int = 100_000


def fingerprint(text: str | None, params: SimHashParams = SimHashParams()) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; without words the fingerprint is 0."""
    words = WORD.findall((text or "").translate(TO_LOWER))
    if not words:
        return 0
    k, seed, digest = params.words, params.seed, xxhash.xxh64_intdigest
    shingles = map(" ".join, zip(*(words[i:] for i in range(k)))) if len(words) > k else [" ".join(words)]
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64)
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), params) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return map_batches(docs.select("doc_id", "text"), run, schema)


class Forest:
    """Binary tries, one for each run of sorted values; a node is a range of positions at a depth.

    ``ends`` holds the position behind each trie's last value.
    """

    def __init__(self, values: np.ndarray, ends: np.ndarray):
        self.values, self.ends = values, ends
        self.starts = np.append(0, ends[:-1]).astype(np.int64)

    def halves(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the nodes' ranges go over from bit 0 to bit 1 at ``depth``: a binary search in all ranges at once."""
        low, high, shift = lo.copy(), hi.copy(), np.uint64(BITS - 1 - depth)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            one = (self.values[middle] >> shift & np.uint64(1)).astype(bool)
            high[open_] = np.where(one, middle, high[open_])
            low[open_] = np.where(one, low[open_], middle + 1)
        return low


def near_pairs(forest: Forest, errors: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within ``errors`` bits, by descending node pairs (a, b) together from each (root, root).

    Each step goes one bit down in both nodes; unlike children cost one error, and a pair beyond the budget is dropped with
    everything below it.  Pairs of single fingerprints are settled at once.  At most about ``most`` node pairs are
    opened at a time, deepest first.
    """
    spent = np.zeros(len(forest.starts), dtype=np.int64)
    stack = [(0, forest.starts, forest.ends, forest.starts, forest.ends, spent)]
    while stack:
        depth, *nodes = stack.pop()
        a, a_end, b, b_end, spent = nodes
        single = (a_end - a == 1) & (b_end - b == 1)
        if single.any():
            x, y = a[single], b[single]
            near = (np.bitwise_count(forest.values[x] ^ forest.values[y]) <= errors) & (x != y)
            if near.any():
                yield x[near], y[near]
            nodes = a, a_end, b, b_end, spent = tuple(v[~single] for v in nodes)
        if not len(a) or depth == BITS:
            continue
        if len(a) > most:
            half = len(a) // 2
            stack += [(depth, *(v[:half] for v in nodes)), (depth, *(v[half:] for v in nodes))]
            continue
        am, bm, same = forest.halves(a, a_end, depth), forest.halves(b, b_end, depth), a == b
        children = (
            (a, am, b, bm, spent, True),
            (am, a_end, bm, b_end, spent, True),
            (a, am, bm, b_end, spent + 1, True),
            (am, a_end, b, bm, spent + 1, ~same),
        )
        grown = []
        for ca, ce, cb, cf, cost, wanted in children:
            keep = (ce > ca) & (cf > cb) & (cost <= errors) & wanted
            grown.append(tuple(v[keep] for v in (ca, ce, cb, cf, cost)))
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*grown))))


def local_links(bucket: np.ndarray, values: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint with a near one in some ``bucket``: itself and the least one it is connected to here."""
    order = np.lexsort((values, bucket))
    bucket, values = bucket[order], values[order]
    fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (values[1:] != values[:-1]))[: len(values)]
    bucket, values = bucket[fresh], values[fresh]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(values)).astype(np.int64)
    names, at = np.unique(values, return_inverse=True)
    parent = np.arange(len(names))

    def root(x: np.ndarray) -> np.ndarray:
        x = parent[x]
        while not np.array_equal(x, above := parent[x]):
            x = above
        return x

    for x, y in near_pairs(Forest(values, ends), errors) if len(values) else ():
        x, y = root(at[x]), root(at[y])
        while (apart := x != y).any():
            x, y = x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            x, y = root(x), root(y)
    top = root(np.arange(len(parent)))
    moved = top != np.arange(len(parent))
    return names[moved].view(np.int64), names[top[moved]].view(np.int64)


def _join_tries(errors: int, rows: int):
    """Buckets arrive one after the other; those of about ``rows`` fingerprints are joined at once, each in itself."""

    def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, values = (np.concatenate(c) for c in zip(*parts))
        u, v = local_links(bucket, values.view(np.uint64), errors)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            bucket, values = batch["bucket"].to_numpy(), batch["fp"].to_numpy()
            if held + len(bucket) > rows and held:
                # All but the last bucket, which may go on in this batch.
                last = parts[-1][0][-1]
                whole, rest = zip(*(((b[b != last], v[b != last]), (b[b == last], v[b == last])) for b, v in parts))
                if sum(len(b) for b, _ in whole):
                    yield out(list(whole))
                    parts = list(rest)
                    held = sum(len(b) for b, _ in parts)
            parts.append((bucket, values))
            held += len(bucket)
        if held:
            yield out(parts)

    return run


def partitions_of_bits(errors: int) -> list[list[int]]:
    """Ways to part the 64 bits into ``errors + 1`` masks each (signed longs): by lines of a grid, one direction a way.

    Two fingerprints within ``errors`` bits agree on some mask of every way.  Lines of two directions meet in few bits, so
    that each further way fixes new ones.
    """
    q = errors + 1
    ways = [(1, 0), (0, 1), *((1, k) for k in range(1, q))]
    masks = [[sum(1 << p for p in range(BITS) if (x * (p % q) + y * (p // q)) % q == j) for j in range(q)] for x, y in ways]
    return [[m - (1 << BITS) if m >> (BITS - 1) else m for m in way] for way in masks]


def near_buckets(fps: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``(fp, bucket)``: any two distinct ``fp`` values within ``errors`` bits meet in some bucket.

    A bucket holds what agrees on a mask.  Those above the limit are parted again by the next way, which fixes more bits,
    until none is left: only crowded values are copied further, and no pair of chunks is sent.  What is still crowded
    when all ways are used agrees on most of its bits; it is dealt in pairs of chunks.
    """
    rows, parts = fps.select("fp", F.lit(0).cast("long").alias("mask")), []
    for way in partitions_of_bits(params.errors):
        masks = F.array(*[F.col("mask").bitwiseOR(F.lit(m).cast("long")) for m in way])
        keyed = rows.select("fp", F.explode(masks).alias("mask"))
        # Two buckets of one name would be joined as one: more is compared then, and still only near ones are linked.
        keyed = keyed.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        # Most fingerprints share no bucket with another: they need no task.
        sizes = staged(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
        parts.append(keyed.join(sizes.where(F.col("n") <= params.bucket), "bucket").select("fp", "bucket"))
        crowded = sizes.where(F.col("n") > params.bucket)
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        left = keyed.join(crowded, "bucket")
        rows = staged(left.select("fp", "mask").distinct(), "simhash-crowded")
    chunks = F.expr(f"CAST((n + {params.bucket - 1}) DIV {params.bucket} AS int)")
    dealt = (
        left.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("fp", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"))
    )
    return reduce(DataFrame.unionByName, [*parts, dealt])


def near_links(fps: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the distinct ``fp`` values within ``errors`` bits: at most one per value and task.

    The trie join runs on each bucket of ``near_buckets`` alone: these are the node pairs of the tries, rotated to the
    bits that a bucket agrees on, which spent no error yet.
    """
    dealt = near_buckets(fps, params).repartition("bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, _join_tries(params.errors, params.rows), "u long, v long")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id`` (the smallest ``doc_id`` reachable over links).

    Null and wordless texts have fingerprint zero and link like any other.  A null ``doc_id`` takes part in links but
    names no component unless all are null; repeated rows share a component; other columns are ignored; an empty table
    gives no rows.  Texts are read once, and only distinct fingerprints, with their smallest ``doc_id``, are joined.
    """
    rows = staged(fingerprints(docs, params), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    roots = star_components(staged(near_links(distinct.select("fp"), params), "simhash-links"))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = staged(placed, "simhash-roots")
    named = staged(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    members = staged(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "simhash-members")
    return rows.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """One row of each component: the one with the smallest ``doc_id`` (null last; repeated rows: one of them)."""
    row = unused(docs, "_row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    rank = F.struct(F.col("doc_id").isNull().alias("gone"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    rows = numbered.select(rank.alias("doc_id"), "text")
    kept = near_duplicates(rows, params).select(F.col("component_id.row").alias(row)).distinct()
    return numbered.join(staged(kept, "simhash-kept"), row).select(*docs.columns)


def near_duplicate_report(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 hex digits."""
    return near_duplicates(docs, params).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id"
    )
