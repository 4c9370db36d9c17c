"""Buckets of fingerprints: all near pairs meet, crowded buckets are parted by further bits."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardlens.llm import simhash
from shardlens.llm.components import star_components

FULL = (1 << 64) - 1


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _values(rng):
    """Random values, balls around some centres, and a crowd that agrees on its low 30 bits."""
    out = {0, FULL, *(rng.getrandbits(64) for _ in range(200))}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            value = centre
            for bit in rng.sample(range(64), rng.randrange(1, 9)):
                value ^= 1 << bit
            out.add(value)
    return sorted(out | {rng.getrandbits(34) << 30 | 12345 for _ in range(300)})


def _components(pairs, values):
    top = {v: v for v in values}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {v: root(v) for v in values}


@pytest.mark.parametrize("errors", [0, 1, 3, 4, 5, 12])
def test_each_way_parts_all_bits(errors):
    for way in simhash.partitions_of_bits(errors):
        masks = [m & FULL for m in way]
        assert len(masks) == errors + 1 and sum(masks) == FULL


@pytest.mark.parametrize(("bucket", "errors"), [(1024, 4), (32, 4), (2, 4), (8, 2), (8, 0)])
def test_all_near_pairs_meet(spark, bucket, errors):
    values = _values(random.Random(bucket + errors))
    fps = spark.createDataFrame([(_signed(v),) for v in values], "fp long")
    params = simhash.SimHashParams(bucket=bucket, errors=errors)
    held = {}
    for r in simhash.near_buckets(fps, params).collect():
        held.setdefault(r.fp & FULL, set()).add(r.bucket)
    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= errors]
    assert all(held[a] & held[b] for a, b in near)
    roots = {r.node: r.root for r in star_components(simhash.near_links(fps, params)).collect()}
    got = Counter(Counter(roots.get(_signed(v), _signed(v)) for v in values).values())
    assert got == Counter(Counter(_components(near, values).values()).values())


def test_a_crowd_is_parted_by_further_bits(spark):
    """20,000 values that agree on 16 bits: pairs of chunks of 64 would copy each over 300 times."""
    rng = random.Random(3)
    values = {rng.getrandbits(48) << 16 | 77 for _ in range(20_000)}
    fps = spark.createDataFrame([(_signed(v),) for v in values], "fp long")
    sizes = simhash.near_buckets(fps, simhash.SimHashParams(bucket=64)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    assert most <= 64 and total <= 40 * len(values)


def test_no_fingerprints(spark):
    assert simhash.near_links(spark.createDataFrame([], "fp long")).count() == 0
