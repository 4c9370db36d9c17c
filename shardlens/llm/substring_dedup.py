"""Passages that recur anywhere in the corpus: found by anchors, confirmed and located by sharded automata."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlens.llm.common import WORD, map_batches, staged


@dataclass(frozen=True)
class PassageParams:
    """A passage is ``window`` words; its anchor is the phrase of ``phrase`` words with the least hash in it.  An anchor at
    more than ``crowd`` places is routed passage by passage.  ``shard`` segments are put in one automaton."""

    window: int = 35
    phrase: int = 12
    crowd: int = 200
    shard: int = 20_000


INDEX_BITS = np.uint64(28)
INDEX_MASK = np.uint64((1 << 28) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when it has grown large."""

    most = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


WORD_HASHES = WordHashes()


def phrase_hashes(words: list[str], length: int) -> np.ndarray:
    """A hash for each run of ``length`` words, put together from runs of 1, 2, 4, ... words."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    run = np.fromiter(map(WORD_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    out, have, width, factor = None, 0, 1, MIX
    while True:
        if length & width:
            # What is there already stands before the next ``width`` words.
            out = run if out is None else out[: len(run) - have] * factor + run[have:]
            have += width
        if have == length:
            break
        run = run[:-width] * factor + run[width:]
        width, factor = 2 * width, factor * factor
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(words: list[str], params: PassageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of each anchor: equal windows have equal anchors at equal offsets.

    A window's anchor is its phrase with the least hash, the leftmost if there are several; windows that follow each
    other mostly share it.
    """
    hashes, width = phrase_hashes(words, params.phrase), params.window - params.phrase + 1
    if len(hashes) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, hashes[:0], none, none
    packed = ((hashes >> INDEX_BITS) << INDEX_BITS) | np.arange(len(hashes), dtype=np.uint64)
    of_window = (_sliding_min(packed, width) & INDEX_MASK).astype(np.int64)
    first = np.flatnonzero(np.diff(of_window, prepend=-1))
    last = np.append(first[1:], len(of_window)) - 1
    at = of_window[first]
    return at, hashes[at], first, last


def _digest(words: list[str], gone: np.ndarray | None = None) -> str:
    kept = words if gone is None else [w for w, g in zip(words, gone) if not g]
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def _survey(params: PassageParams):
    """A row per document: its words, the digest of all of them, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, places, hashes = [], [], [], []
            for text in batch["_text"]:
                words = WORD.findall(text.as_py())
                at, h, _, _ = anchors(words, params)
                counts.append(len(words))
                digests.append(_digest(words))
                places.append(at.astype(np.int32))
                hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["_k1"], batch["_k2"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                names=["_id", "_k1", "_k2", "n_words", "_whole", "_at", "_h"],
            )

    return run


def _segments(words: list[str], hits: dict[int, bool], params: PassageParams) -> Iterator[tuple[int, int, str]]:
    """(route, first word, text) of the stretches in which passages can recur: all windows of a recurring anchor, routed by
    the anchor's hash; windows of a crowded anchor one by one, routed by their own."""
    n = params.window
    for at, h, first, last in zip(*(x.tolist() for x in anchors(words, params))):
        if at not in hits:
            continue
        if not hits[at]:
            yield h, first, " ".join(words[first : last + n])
            continue
        for s in range(first, last + 1):
            text = " ".join(words[s : s + n])
            yield xxhash.xxh64_intdigest(text), s, text


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _halves(text: str) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(text)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


PART = 20_000
STRETCHES = ("_route", "_segment", "_times", "_k1", "_k2", "_first", "_s1", "_s2")
STRETCH_SCHEMA = ", ".join(f"{c} {'string' if c == '_segment' else 'long'}" for c in STRETCHES)


def _emit_stretches(params: PassageParams):
    """Two kinds of rows: segments with how often they were seen, equal ones among neighbours as one (route, text, times);
    and where each segment stands (text key, first word, segment hash)."""

    def out(found: Counter, places: list[tuple]) -> pa.RecordBatch:
        none = [None] * len(places)
        columns = [*zip(*places)] if places else [()] * 5
        gap = [None] * len(found)
        data = [
            pa.array([*(r for r, _ in found), *none], pa.int64()),
            pa.array([*(t for _, t in found), *none], pa.string()),
            pa.array([*found.values(), *none], pa.int64()),
            *(pa.array([*gap, *c], pa.int64()) for c in columns),
        ]
        return pa.RecordBatch.from_arrays(data, names=list(STRETCHES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, str]] = Counter()
        places: list[tuple] = []
        for batch in batches:
            one, two, copies = (batch[c].to_pylist() for c in ("_k1", "_k2", "_copies"))
            for i, text, at, crowded in zip(range(len(copies)), batch["_text"], batch["_hit"], batch["_crowded"]):
                hits = dict(zip(at.as_py(), crowded.as_py()))
                for route, first, segment in _segments(WORD.findall(text.as_py()), hits, params):
                    found[_signed(route), segment] += copies[i]
                    places.append((one[i], two[i], first, *_halves(segment)))
                if len(places) >= PART:
                    yield out(found, places)
                    found, places = Counter(), []
        yield out(found, places)

    return run


def recurring_windows(segments: dict[str, int], window: int) -> dict[str, int]:
    """For each segment (text -> times seen) a mask of the windows in it that occur more than once in all segments.

    Words become characters, so that the automaton works on words and matches them exactly.  The passages confirmed
    by count are its patterns; each segment is then streamed through it, and every match ends a recurring window.
    """
    codes: dict[str, str] = {}

    def code(word: str) -> str:
        got = codes.get(word)
        if got is None:
            n = len(codes) + 1
            got = codes[word] = chr(n if n < 0xD800 else n + 0x800)
        return got

    coded = {text: "".join(map(code, text.split(" "))) for text in segments}
    seen: Counter[str] = Counter()
    for text, line in coded.items():
        times = segments[text]
        for s in range(len(line) - window + 1):
            seen[line[s : s + window]] += times
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for passage, times in seen.items():
        if times > 1:
            automaton.add_word(passage, 1)
    masks: dict[str, int] = {}
    if len(automaton):
        automaton.make_automaton()
        for text, line in coded.items():
            mask = 0
            for end, _ in automaton.iter(line):
                mask |= 1 << (end - window + 1)
            if mask:
                masks[text] = mask
    return masks


def _locate(params: PassageParams):
    """Shards of segments, sorted by route: a route's segments are always judged together.

    A route with one segment has nothing to compare: seen more than once, all its windows recur, else none does.  The
    others are gathered to shards, each with its automaton.
    """

    def out(masks: dict[str, int]) -> pa.RecordBatch:
        keys = [_halves(t) for t in masks]
        columns = [[a for a, _ in keys], [b for _, b in keys], list(masks.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_s1", "_s2", "_mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        whole: dict[str, int] = {}
        group: dict[str, int] = {}
        route = None

        def close() -> None:
            if len(group) > 1:
                held.update(group)
            else:
                for text, times in group.items():
                    if times > 1:
                        whole[text] = (1 << (text.count(" ") + 2 - params.window)) - 1
            group.clear()

        for batch in batches:
            for r, text, times in zip(*(batch[c].to_pylist() for c in ("_route", "_segment", "_times"))):
                if r != route:
                    close()
                    route = r
                    if len(held) >= params.shard:
                        yield out(recurring_windows(held, params.window))
                        held.clear()
                    if len(whole) >= params.shard:
                        yield out(whole)
                        whole.clear()
                group[text] = group.get(text, 0) + times
        close()
        yield out(recurring_windows(held, params.window))
        yield out(whole)

    return run


def _cut(params: PassageParams):
    """What is left of each distinct text once the windows named by its masks are out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for text, first, masks in zip(batch["_text"], batch["_first"], batch["_mask"]):
                words = WORD.findall(text.as_py())
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for at, mask in set(zip(first.as_py(), masks.as_py())):
                    while mask:
                        s = at + (mask & -mask).bit_length() - 1
                        edge[s] += 1
                        edge[s + params.window] -= 1
                        mask &= mask - 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                digests.append(_digest(words, gone))
            yield pa.RecordBatch.from_arrays(
                [batch["_k1"], batch["_k2"], pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["_k1", "_k2", "_gone", "_rest"],
            )

    return run


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def remove_recurring(docs: DataFrame, params: PassageParams = PassageParams(), id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` after every recurring passage is out.

    A null text has no words; texts shorter than a window lose nothing; repeated rows and copies lose all their words
    if they have a window; other columns are ignored; an empty table gives no rows.  Texts are read whole.

    1. Each document's anchors are listed once, with its counts, and written.  An anchor at one place only rules out
       all windows that have it: equal windows have equal anchors.
    2. Texts with recurring anchors are reduced to distinct texts with the number of their copies, and written.
    3. The stretches around recurring anchors go to the shard of their anchor, where passages are confirmed on their words,
       an automaton of them is compiled, and the stretches are streamed through it.
    4. The windows found go back to the places of their stretches, and each distinct text is cut once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = _keys(text)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("_id"), k1.alias("_k1"), k2.alias("_k2"), text.alias("_text"))
    survey = staged(
        map_batches(keyed, _survey(params), f"_id {kind}, _k1 long, _k2 long, n_words long, _whole string, _at array<int>, _h array<long>"),
        "passage-anchors",
    )
    placed = survey.select("_k1", "_k2", F.explode(F.arrays_zip("_at", "_h")).alias("_a")).select("_k1", "_k2", "_a._at", "_a._h")
    place = F.xxhash64("_k1", "_k2", "_at")
    recurring = (
        placed.select("_h", place.alias("_p"))
        .groupBy("_h")
        .agg(F.min("_p").alias("_least"), F.max("_p").alias("_most"), F.count(F.lit(1)).alias("_n"))
        .where("_least != _most")
        .select("_h", (F.col("_n") > params.crowd).alias("_crowded"))
    )
    hits = staged(
        placed.join(staged(recurring, "passage-recurring"), "_h")
        .groupBy("_k1", "_k2")
        .agg(F.collect_set(F.struct("_at", "_crowded")).alias("_hits"))
        .select("_k1", "_k2", F.col("_hits._at").alias("_hit"), F.col("_hits._crowded").alias("_crowded")),
        "passage-hits",
    )
    texts = keyed.groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    suspects = staged(texts.join(hits, ["_k1", "_k2"]), "passage-texts")
    stretches = staged(map_batches(suspects, _emit_stretches(params), STRETCH_SCHEMA), "passage-stretches")
    segments = stretches.where("_segment IS NOT NULL").select("_route", "_segment", "_times")
    sharded = segments.repartition("_route").sortWithinPartitions("_route")
    masks = staged(map_batches(sharded, _locate(params), "_s1 long, _s2 long, _mask long"), "passage-masks")
    marks = staged(
        stretches.where("_first IS NOT NULL").select("_k1", "_k2", "_first", "_s1", "_s2")
        .join(masks, ["_s1", "_s2"])
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("_first", "_mask")).alias("_m"))
        .select("_k1", "_k2", F.col("_m._first").alias("_first"), F.col("_m._mask").alias("_mask")),
        "passage-marks",
    )
    marked = suspects.select("_k1", "_k2", "_text").join(marks, ["_k1", "_k2"])
    cut = map_batches(marked, _cut(params), "_k1 long, _k2 long, _gone long, _rest string")
    # Copies: every window of a text that occurs twice starts somewhere else.
    copied = survey.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"), F.max("n_words").alias("_w"))
    copied = copied.where((F.col("_n") > 1) & (F.col("_w") >= params.window)).select(
        "_k1", "_k2", F.col("_w").alias("_gone"), F.sha2(F.lit("").cast("binary"), 256).alias("_rest")
    )
    copied = staged(copied, "passage-copies")
    changed = staged(cut.join(copied.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").unionByName(copied), "passage-cut")
    return survey.select(F.col("_id").alias(id_col), "_k1", "_k2", "n_words", "_whole").join(changed, ["_k1", "_k2"], "left").select(
        id_col,
        "n_words",
        F.coalesce("_gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_rest", "_whole").alias("kept_sha256"),
    )
