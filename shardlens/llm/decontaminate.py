"""Benchmark decontamination: stretches that keep enough runs of an item, each settled by exact edit distance."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm.common import map_batches, staged, unused, without_listed

TOKEN = re.compile(r"\w+")
# Text of benchmark items that one pass over the documents takes along; more items take more passes.
BLOCK_BYTES = 16 << 20
# Hits of a text that are weighed at a time, beside those in what an item can cover.
HITS = 1 << 20


@dataclass(frozen=True)
class LeakParams:
    """``similarity``: 1 - edits / item words, at least."""

    similarity: float = 0.8

    def edits(self, words: int) -> int:
        return math.floor((1 - self.similarity) * words + 1e-9)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def infix_edits(item: list[int], window: list[int]) -> tuple[int, int]:
    """Least edits between ``item`` and any stretch of ``window``, and where that stretch ends (bit-parallel)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, word in enumerate(window, 1):
        eq = places.get(word, 0)
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        xv = eq | mv
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j
    return best, end


class ItemIndex:
    """Items of one block by their runs of words.  Built once per task from the broadcast items.

    An item changed by e edits keeps one of e + 1 pieces, and each edit spoils at most ``run`` of its runs of that many
    words: of ``words - run + 1`` runs, ``run * e`` or fewer are lost.  Those kept stand at starts which differ by e at
    most.  Stretches of a text with that many runs of an item near one start are compared with it; no other can hold it.
    """

    def __init__(self, items: list[tuple[int, str]], params: LeakParams):
        self.params, self.ids, self.vocabulary = params, [], {}
        self.items: list[list[int]] = []
        for item, text in items:
            if words := tokens(text):
                self.ids.append(item)
                self.items.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        sizes = [len(w) for w in self.items]
        edits = [params.edits(n) for n in sizes]
        runs = [max(1, (n - e) // (e + 1)) for n, e in zip(sizes, edits)]
        self.edits = np.array(edits, dtype=np.int64)
        self.needed = np.array([max(1, n - r + 1 - r * e) for n, e, r in zip(sizes, edits, runs)], dtype=np.int64)
        # For each run length: the codes of the items' runs, sorted, with their item and place.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.spans: dict[int, int] = {}
        for run in sorted(set(runs)):
            mine = [n for n, r in enumerate(runs) if r == run]
            self.spans[run] = max(sizes[n] + edits[n] for n in mine)
            codes = [self.code(np.array(self.items[n], dtype=np.uint64), run) for n in mine]
            item = np.repeat(np.array(mine, dtype=np.int64), [len(c) for c in codes])
            place = np.concatenate([np.arange(len(c)) for c in codes])
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            self.seeds[run] = code[order], item[order], place[order]

    @staticmethod
    def code(ids: np.ndarray, run: int) -> np.ndarray:
        """A number for each stretch of ``run`` words; those that meet by chance are sorted out by the exact check."""
        out = np.zeros(len(ids) - run + 1, dtype=np.uint64)
        for j in range(run):
            out = (out ^ ids[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, first start, last start) of the stretches that can be within the edits allowed."""
        for run, (codes, items, places) in self.seeds.items():
            if len(ids) < run:
                continue
            code = self.code(ids, run)
            low, count = np.searchsorted(codes, code), np.searchsorted(codes, code, side="right")
            count -= low
            # A run that recurs in a text and in many items makes many hits: they are weighed in pieces of the text, which
            # overlap by what an item can cover.
            total, span, begin = np.append(0, np.cumsum(count)), self.spans[run], 0
            while begin < len(code):
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + HITS, side="right")) - 1)
                stop = min(end + span, len(code))
                if total[stop] > total[begin]:
                    yield from self._near(items, places, low[begin:stop], count[begin:stop], begin)
                begin = len(code) if stop == len(code) else end

    def _near(self, items: np.ndarray, places: np.ndarray, low: np.ndarray, count: np.ndarray, offset: int) -> Iterator[tuple[int, int, int]]:
        """Stretches by the hits of one piece of a text, which begins at ``offset``: ``count`` hits a place, from ``low`` on."""
        at = np.repeat(np.arange(offset, offset + len(count)), count)
        hit = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        item, start = items[hit], at - places[hit]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        # From each hit to the last one that is needed: of one item, and near enough.
        end = np.arange(len(item)) + self.needed[item] - 1
        within = end < len(item)
        begin, end = np.flatnonzero(within), end[within]
        near = (item[begin] == item[end]) & (start[end] - start[begin] <= self.edits[item[begin]])
        begin, end = begin[near], end[near]
        if not len(begin):
            return
        # Stretches of one item that touch are one.
        who, first, last = item[begin], start[begin], start[end]
        fresh = np.append(True, (who[1:] != who[:-1]) | (first[1:] > last[:-1]))
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(who)) - 1
        yield from zip(who[heads].tolist(), first[heads].tolist(), last[tails].tolist())

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text number, item number, edits, end word) of the best place of every item that a text holds."""
        if not self.items:
            return []
        known, found = self.vocabulary, []
        for n, text in enumerate(texts):
            ids = [known.get(w, 0) for w in tokens(text)]
            best: dict[int, tuple[int, int]] = {}
            for item, first, last in self.stretches(np.array(ids, dtype=np.uint64)):
                words, allowed = self.items[item], int(self.edits[item])
                left = max(0, first - allowed)
                edits, end = infix_edits(words, ids[left : last + len(words) + allowed])
                if edits <= allowed and (edits, left + end) < best.get(item, (edits + 1, 0)):
                    best[item] = (edits, left + end)
            found += [(n, item, edits, end) for item, (edits, end) in sorted(best.items())]
        return found


def _search_block(items: list[tuple[int, str]], params: LeakParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, params)
        for batch in batches:
            hits = index.search(batch["text"].to_pylist())
            rows = [n for n, *_ in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(rows, pa.int64())),
                    pa.array([index.ids[i] for _, i, _, _ in hits], pa.int64()),
                    pa.array([len(index.items[i]) for _, i, _, _ in hits], pa.int64()),
                    pa.array([e for _, _, e, _ in hits], pa.int64()),
                    pa.array([w for *_, w in hits], pa.int64()),
                ],
                names=["doc_id", "item_id", "item_words", "edits", "end_word"],
            )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """One row per document row and benchmark item it holds: ``doc_id, item_id, item_words, edits, end_word``.

    Texts are compared as lower-case words.  An item is held if some stretch of the document differs from it by at
    most ``1 - similarity`` of its words in edits (insert, delete, replace); every such pair is found.  Null and wordless texts hold nothing and
    are held by nothing; repeated rows and repeated items are reported each; other columns are ignored.

    The items are the stated query set: they go along with the documents in blocks of at most about ``BLOCK_BYTES``, each
    block one pass in which documents stay where they are read.
    """
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    # Rows are dealt by place as well as by text, so that repeated items do not pile up in one block.
    dealt = staged(asked.withColumn("_block", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(blocks))), "benchmark")
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("item_id", "item_words", "edits", "end_word")]
    )
    slim, found = docs.select("doc_id", "text"), None
    for block in range(blocks):
        items = [(r.item_id, r.text) for r in dealt.where(F.col("_block") == block).orderBy("item_id", "text").toLocalIterator()]
        part = map_batches(slim, _search_block(items, params), schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns: leaky texts are named by 128-bit hashes."""
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.concat_ws(":", F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text"))))
    leaks = find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, params)
    leaky = staged(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaky")
    return without_listed(keyed, leaky, key).select(*docs.columns)
