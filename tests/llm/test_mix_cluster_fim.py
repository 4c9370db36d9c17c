"""Source mixing, centroid clustering and fill-in-middle against brute force and on awkward rows."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from llm_tables import WORDS, docs_frame

from shardlens.llm import bitplanes, curriculum, fill_in_middle, sql
from test_llm_edges import clashing

# ---------------------------------------------------------------------------------------------- fill-in-middle


def fim_texts():
    rng = random.Random(3)
    alphabet = ["a", "é", "€", "😀", " ", "\n", "\x00", "ſ", "<", "P"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    return [None, "", "x", "€", "<P>", "a<S>b", "tail <M>", "<", "<<P", *texts, "ü" * 300_000, "x" * 99_999 + "<M>", "😀" * 50_000]


def fim_row(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    if plain:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fim_equals_brute_force_and_gives_the_text_back(spark):
    rows = [*enumerate(fim_texts()), (None, "without an id"), (None, None), (7, "twice"), (7, "twice")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted(map(repr, (tuple(r) for r in fill_in_middle.fill_in_middle(docs).collect())))
    assert got == sorted(repr((d, *fim_row(d, t))) for d, t in rows)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sums = sorted((r["doc_id"] or -1, r["output_sha256"], r["restored_sha256"]) for r in fill_in_middle.fim_digests(docs).collect())
    assert sums == sorted((d or -1, digest(fim_row(d, t)[4]), digest(t or "")) for d, t in rows)
    assert fill_in_middle.fim_digests(docs.limit(0)).count() == 0


def test_code_points_by_words():
    text = "aé€😀" * 50 + "z"
    data = text.encode()
    points = fill_in_middle.CodePoints(np.frombuffer(data, np.uint8))
    places = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert points.rank(places).tolist() == list(range(len(text) + 1))
    assert points.select(np.arange(1, len(text) + 1)).tolist() == places[1:].tolist()


# ---------------------------------------------------------------------------------------------------- mixing


def targets_by_sharing_again(sizes, params):
    """The excess over each source's limit is dealt again by weight until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: Fraction(curriculum.integral(params.schedules[k % len(params.schedules)])) for k, s in enumerate(names)}
    limit = {s: params.repeats * sizes[s] for s in names}
    full, left = set(), Fraction(params.share) * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > limit[s]]
        if not above:
            return {**{s: Fraction(limit[s]) for s in full}, **share}
        full.update(above)
        left -= sum(limit[s] for s in above)


def time_by_bisection(part, schedule):
    def upto(t):
        return sum(
            (min(t, t1) - t0) * (w0 + w0 + (w1 - w0) * (min(t, t1) - t0) / (t1 - t0)) / 2
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])
            if t > t0
        )

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid) < part * upto(1.0) else (low, mid)
    return low


def mix_rows(seed=1, sources=7, n=300, hot=True):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        source = 0 if hot and rng.random() < 0.4 else rng.randrange(sources)
        words = 0 if rng.random() < 0.1 else rng.choice([1, 5, 40, 400])
        rows.append((d, None if source == 3 else f"s{source}é", " \t".join(["w"] * words)))
    return [*rows, (None, "s1é", "a b c"), (5, None, None), (5, "s1é", "x y"), (5, "s1é", "x y"), (9, "", "lone words here"), (10, "zz", "")]


@pytest.mark.parametrize(
    "params",
    [
        curriculum.MixParams(),
        curriculum.MixParams(schedules=(((0, 0.0), (0.25, 4.0), (1, 1.0)), ((0, 2.0), (0.5, 2.0), (0.75, 0.0), (1, 3.0))), share=2.2, repeats=3),
        curriculum.MixParams(share=9.0),
    ],
)
def test_mix_meets_targets_and_stands_in_order(spark, params):
    rows = mix_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5))
    got = curriculum.curriculum(docs, params).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(WORDS.findall(text or ""))
    full = params.share >= params.repeats
    want = {s: Fraction(params.repeats * v) for s, v in sizes.items()} if full else targets_by_sharing_again(sizes, params)
    taken, names = {}, sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    for row in got:
        assert row["source_size"] == sizes[row["source"]] and math.isclose(row["target"], float(want[row["source"]]), rel_tol=1e-12)
        assert 0 <= row["taken"] <= params.repeats * row["size"] and row["taken"] == sum(c["words"] for c in row["copies"])
        taken[row["source"]] = taken.get(row["source"], 0) + row["taken"]
    assert taken == {s: math.floor(row + Fraction(1, 2)) for s, row in want.items()}

    placed = [(c["position"], c["words"], row) for row in got for c in row["copies"]]
    assert all(0 <= p <= 1 for p, _, _ in placed)
    for source in sizes:
        schedule, met = params.schedules[names.index(source) % len(params.schedules)], 0
        for position, words, _ in sorted((p for p in placed if p[2]["source"] == source), key=lambda p: (p[0], p[1])):
            middle = (met + words / 2) / float(want[source])
            met += words
            # Copies of one size in a row may swap; the demand up to a copy is the integral of its source's weight.
            assert abs(position - time_by_bisection(middle, schedule)) < 1e-6
    firsts = [row["copies"][0]["position"] if row["copies"] else 2.0 for row in got]
    assert firsts == sorted(firsts)
    order = curriculum.training_order(curriculum.curriculum(docs, params)).collect()
    assert [r["position"] for r in order] == sorted(p for p, _, _ in placed)


def test_mix_sql_reruns_and_empty(spark):
    rows = mix_rows(seed=2)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    key = lambda r: tuple((x is None, x) for x in r)
    one, two = (sorted(map(tuple, curriculum.mix_report(docs.repartition(k)).collect()), key=key) for k in (1, 6))
    assert one == two
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert one == sorted(con.sql(sql.OP11_SQL).fetchall(), key=key)
    assert curriculum.mix_report(docs.limit(0)).count() == 0
    wordless = curriculum.mix_report(docs.where("size(split(text, 'w')) = 1 AND doc_id = 10")).collect()
    assert [(r["taken"], r["target"], r["first_position"]) for r in wordless] == [(0, 0.0, None)]
    assert curriculum.mix_report(docs_frame(spark)).count() == docs_frame(spark).count()


# ------------------------------------------------------------------------------------------------- clustering


def vectors(n=400, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (12, 64))
    rows = [(int(k), [float(np.float32(x)) for x in centres[k % 12] + rng.normal(0, 0.1, 64)]) for k in range(n)]
    first = rows[0][1]
    odd = [(None, first), (3, first), (3, first), (5, None), (6, []), (7, first[:63]), (8, first + [0.0])]
    odd += [(9, [None, *first[1:]]), (10, [math.nan, *first[1:]]), (11, [-math.inf, *first[1:]])]
    return rows + odd


def cluster_by_hand(rows, k=8, rounds=10, most=2**62):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [max(-most, min(most, math.floor(1024 * x))) for x in v]) for i, v in kept]
    named = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in whole)
    centroids = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in whole:
            mine[near(v)[1]].append(v)
        centroids = [[sum(xs) // len(m) for xs in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in whole]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    top = 2**63 - 1
    return [(i, j, min(d, top), min(inertia[j], top), min(sum(inertia.values()), top), digest[j]) for i, j, d in out]


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_clusters_equal_brute_force_and_sql(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = bitplanes.cluster(clashing(table)).collect()
    same(got, cluster_by_hand(rows))
    con = duckdb.connect()
    con.register("embeddings", table.toArrow())
    same(got, con.sql(sql.OP12_SQL).fetchall())
    assert bitplanes.cluster(table.limit(0)).count() == 0
    few = [rows[0], rows[0], rows[20]]
    same(bitplanes.cluster(spark.createDataFrame(few, table.schema)).collect(), cluster_by_hand(few))


def test_clusters_of_wide_components(spark):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.random.default_rng(1).normal(0, 1, (60, 64)))]
    for k, size in enumerate((1e2, 1e4, 1e6, 1e9, 1e15, 1e300)):
        rows[k] = (k, [(-size if d % 3 else size) for d in range(64)])
        rows[10 + k] = (10 + k, [size, *rows[10 + k][1][1:]])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(bitplanes.cluster(table, bitplanes.ClusterParams(rounds=3)).collect(), cluster_by_hand(rows, rounds=3))


def test_bit_planes_give_the_numbers_back():
    rng = np.random.default_rng(0)
    for width in bitplanes.WIDTHS:
        top = 2 ** (min(width, 63) - 1)
        numbers = rng.integers(-top, top, (5, 64))
        planes = bitplanes.pack(numbers, width)
        assert (bitplanes.unpack(planes) == numbers).all()
        other = bitplanes.pack(numbers[::-1].copy(), width)
        exact = [[sum(a * b for a, b in zip(x, y)) for y in numbers[::-1].tolist()] for x in numbers.tolist()]
        assert [[int(bitplanes.dots(planes[i : i + 1], other[j])[0]) for j in range(5)] for i in range(5)] == exact
