"""Centroid clustering on bit planes: exact integer distances from AND and popcount."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm.common import staged, unused

DIMENSIONS = 64  # one bit plane fills one 64-bit word
MOST = 2**62  # larger components are cut to this
LONGEST = 2**63 - 1  # larger distances and sums are reported as this
WIDTHS = (8, 12, 16, 20, 24, 32, 48, 64)  # planes kept for a vector: the first width that holds its components
SUM = T.DecimalType(38, 0)


@dataclass(frozen=True)
class ClusterParams:
    clusters: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"


def _weights(width: int) -> np.ndarray:
    """What a bit of each plane counts: two's complement, the highest plane counts negative."""
    worth = [1 << k for k in range(width - 1)] + [-(1 << (width - 1))]
    return np.array(worth, object if width > 40 else np.int64)


def _width(largest: np.ndarray) -> np.ndarray:
    """The planes for vectors whose components need as many bits as ``largest`` (an unsigned value)."""
    steps = np.array([2 ** (w - 1) for w in WIDTHS], np.uint64)
    return np.array(WIDTHS)[np.searchsorted(steps, largest, side="right")]


def pack(numbers: np.ndarray, width: int) -> np.ndarray:
    """Bit planes of int64 vectors: word ``k`` of a row holds bit ``k`` of its 64 components."""
    planes = np.empty((len(numbers), width), np.uint64)
    for k in range(width):
        bits = ((numbers >> min(k, 63)) & 1).astype(np.uint8)
        planes[:, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def unpack(planes: np.ndarray) -> np.ndarray:
    """The int64 vectors of bit planes."""
    numbers = np.zeros((len(planes), DIMENSIONS), np.int64)
    for k, worth in enumerate(_weights(planes.shape[1])):
        word = np.ascontiguousarray(planes[:, k]).view(np.uint8).reshape(-1, 8)
        numbers += np.unpackbits(word, axis=1, bitorder="little").astype(np.int64) * np.int64(worth)
    return numbers


def dots(planes: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact dot products of packed vectors with one packed centroid.

    The product of bit i and bit j of two components counts ``weight i * weight j``; how many components have both bits
    is the popcount of the two planes' AND.
    """
    w, c = planes.shape[1], len(centroid)
    both = np.bitwise_count(planes[:, :, None] & centroid[None, None, :]).reshape(len(planes), w * c)
    worth = np.multiply.outer(_weights(w), _weights(c)).reshape(-1)
    if w + c + 6 <= 52:  # 64 products of that size are exact in floating point
        return (both.astype(np.float64) @ worth.astype(np.float64)).astype(np.int64)
    return both.astype(object) @ worth.astype(object)


def distances(planes: np.ndarray, centroids: list[np.ndarray]) -> np.ndarray:
    """Squared distances, a column per centroid."""
    own = np.array([dots(row[None, :], row)[0] for row in planes], object) if planes.shape[1] > 20 else _norms(planes)
    columns = [own - 2 * dots(planes, c) + dots(c[None, :], c)[0] for c in centroids]
    return np.stack(columns, axis=1)


def _norms(planes: np.ndarray) -> np.ndarray:
    w = planes.shape[1]
    both = np.bitwise_count(planes[:, :, None] & planes[:, None, :]).reshape(len(planes), w * w)
    return (both.astype(np.float64) @ np.multiply.outer(_weights(w), _weights(w)).reshape(-1).astype(np.float64)).astype(np.int64)


def packed_centroid(numbers: list[int]) -> np.ndarray:
    row = np.array([numbers], np.int64)
    return pack(row, int(_width(_span(row))[0]))[0]


def _span(numbers: np.ndarray) -> np.ndarray:
    """Per vector the largest of ``x`` and ``-x - 1``, which decides how many planes it needs."""
    return np.maximum(numbers, -(numbers + 1)).max(axis=1).astype(np.uint64)


def _numbers(values: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(values.astype(np.float64) * scale)
    return np.clip(whole, -float(MOST), float(MOST)).astype(np.int64)


def bit_planes(vectors: DataFrame, params: ClusterParams, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, planes`` of the vectors with exactly 64 components, none of them null or not finite."""
    scale = params.scale
    values = F.col(vector_col).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where((F.size(vector_col) == DIMENSIONS) & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = _numbers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS), scale)
            widths = _width(_span(numbers))
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                flat = pack(numbers[rows], width).reshape(-1).view(np.int64)
                planes = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), planes], names=["vec_id", "planes"])

    return kept.mapInArrow(run, "vec_id long, planes array<long>")


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of a batch's vectors, one group for each number of planes."""
    lists = batch.column("planes")
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    widths = np.asarray(lists.value_lengths())
    starts = np.cumsum(widths) - widths
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def _nearest(planes: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    far = distances(planes, centroids)
    best = far.argmin(axis=1)  # the first of equals
    return best, far[np.arange(len(far)), best]


def cluster_sums(planes: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """``cluster, n, s0 .. s63``: how many vectors are nearest to each centroid, and their componentwise sums.

    A task adds up its own vectors and sends one row per cluster, so what is shuffled does not depend on how many vectors
    a cluster has.
    """
    names = [f"s{d}" for d in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(centroids), [[0] * DIMENSIONS for _ in centroids]
        for batch in batches:
            for _, group in _groups(batch):
                best, _ = _nearest(group, centroids)
                numbers = unpack(group)
                if group.shape[1] > 40:
                    numbers = numbers.astype(object)
                for k in np.unique(best).tolist():
                    mine = numbers[best == k]
                    count[k] += len(mine)
                    total[k] = [a + int(b) for a, b in zip(total[k], mine.sum(axis=0))]
        used = [k for k in range(len(centroids)) if count[k]]
        if used:
            sums = [pa.array([Decimal(total[k][d]) for k in used], pa.decimal128(38, 0)) for d in range(DIMENSIONS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([count[k] for k in used], pa.int64()), *sums], names=["cluster", "n", *names]
            )

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, SUM) for c in names]]
    parts = planes.mapInArrow(run, T.StructType(fields))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).cast(SUM).alias(c) for c in names])


def assign(planes: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """``vec_id, cluster, distance``: the nearest centroid (of equals the first) and the squared distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, group in _groups(batch):
                best, far = _nearest(group, centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(best.astype(np.int32)),
                        pa.array([min(int(x), LONGEST) for x in far] if far.dtype == object else far, pa.int64()),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )

    return planes.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(planes: DataFrame, params: ClusterParams) -> list[list[int]]:
    """The ``clusters`` vectors whose ids have the least hashes (equal ids: by their planes)."""
    key = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = planes.select("planes", key.alias("key")).orderBy("key", "planes").limit(params.clusters).collect()
    return [unpack(np.array([row["planes"]], np.int64).view(np.uint64))[0].tolist() for row in chosen]


def fit(planes: DataFrame, params: ClusterParams) -> list[list[int]]:
    """The centroids after all rounds.  The driver holds only them: ``clusters`` x 64 numbers."""
    centroids = first_centroids(planes, params)
    for _ in range(params.rounds if centroids else 0):
        for row in cluster_sums(planes, [packed_centroid(c) for c in centroids]).collect():
            centroids[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(DIMENSIONS)]
    return centroids


def cluster(vectors: DataFrame, params: ClusterParams = ClusterParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors of exactly 64 components, none null or not finite; a component counts as ``floor(scale * x)``.  The
    vectors are packed once into bit planes and written; every round reads the planes, assigns each vector to its
    nearest centroid and takes the floor of the mean, all in exact integers.  Rows with equal ids are vectors of their
    own, a null id hashes as an empty one, fewer vectors than clusters give as many clusters as vectors, and an empty table gives
    an empty result.  Components beyond 2^62 count as 2^62; distances and sums beyond a long are reported as its largest.
    Columns besides the two are ignored.
    """
    spark = vectors.sparkSession
    planes = staged(bit_planes(vectors, params, id_col, vector_col), "bit-planes")
    centroids = fit(planes, params)
    placed = assign(planes, [packed_centroid(c) for c in centroids])
    if not centroids:
        return placed.selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    placed = staged(placed, "clusters")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast(SUM)).alias("_sum"))
    # A row per cluster: the whole is summed from them, and both sides of the join below are of that size.
    known = {row["cluster"]: int(row["_sum"]) for row in sums.collect()}
    whole = min(sum(known.values()), LONGEST)
    about = spark.createDataFrame([(k, min(v, LONGEST), whole) for k, v in known.items()], "cluster int, cluster_inertia long, inertia long")
    return placed.join(F.broadcast(about.join(named, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
