"""Sum-of-squares online packing of token streams into windows of fixed length."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlens.llm.common import map_batches, staged

WINDOW = 1024
PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_window", "offset", "_part"]
PIECE_SCHEMA = ", ".join(f"{c} {'int' if c == '_part' else 'long'}" for c in PIECE_COLUMNS)


# Runs of blanks from here on go to the merge form: matching them recurses in the rank form's library, which then dies.
LONG_BLANKS = re.compile(r"\s{1000}")


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None) -> Callable[[str], list[int]]:
    """Text -> token ids of the byte-level vocabulary in its merge form (a ``tokenizers`` file), without special tokens
    around it.

    Ordinary text is encoded by the rank form that lies beside the file under the same name, which gives the same ids
    several times faster (tested).  Texts that hold an added token's string, which is one id, or a very long run of
    blanks, and all texts where there is no rank form, take the merge form.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    merges = Tokenizer.from_file(path)
    by_merges = lambda text: merges.encode(text, add_special_tokens=False).ids
    ranked = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranked):
        return by_merges
    import tiktoken

    with open(ranked, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    known = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(path, encoding="utf-8") as f:
        added = re.compile("|".join(re.escape(t["content"]) for t in json.load(f)["added_tokens"]) or r"(?!)")

    def encode(text: str) -> list[int]:
        if added.search(text) or LONG_BLANKS.search(text):
            return by_merges(text)
        return known.encode_ordinary(text)

    return encode


class LevelPacker:
    """Windows by fill level; ``place`` puts an item where the sum of squared counts of open windows stays least.

    ``open[h]`` holds the open windows filled to ``h``, ``count[h]`` their number (the level array).
    """

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]

    def place(self, piece: tuple, length: int) -> list | None:
        """Add a piece of ``length``; returns the pieces of the window it fills, if it fills one."""
        count, size = self.count, self.size
        # From level h to h + length: the sum changes by 2 * (count[h + length] - count[h]) + 2 within, less 1 at the ends.
        levels = size - length + 1
        gain = 2 * count[length:].copy() + 1
        gain[levels - 1] = 0
        gain[1:] -= 2 * count[1:levels] - 1
        gain[1:][count[1:levels] == 0] = np.iinfo(np.int64).max
        best = levels - 1 - int(np.argmin(gain[::-1]))
        window = self.open[best].pop() if best else []
        if best:
            count[best] -= 1
        window.append(piece)
        if best + length == size:
            return window
        self.open[best + length].append(window)
        count[best + length] += 1
        return None

    def close(self) -> Iterator[list]:
        """The rest, with pieces cut so that all windows but the last are full."""
        left = [w for level in reversed(self.open) for w in level]
        i, j, current, filled = 0, len(left), None, 0
        stock: list[tuple] = []
        while i < j or stock:
            if current is None:
                if i >= j:
                    current, filled = [], 0
                else:
                    current, filled = left[i], sum(len(p[2]) for p in left[i])
                    i += 1
            while filled < self.size:
                if not stock:
                    if i >= j:
                        break
                    j -= 1
                    stock = list(left[j])
                doc, start, ids, total = stock.pop()
                room = self.size - filled
                current.append((doc, start, ids[:room], total))
                filled += min(room, len(ids))
                if len(ids) > room:
                    stock.append((doc, start + room, ids[room:], total))
            yield current
            current = None


def _pieces(window: list, number: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window:
        yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset
        offset += len(ids)


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
    return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32())], names=PIECE_COLUMNS)


def pack_partition(batches: Iterator[pa.RecordBatch], vocabulary: str | None, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Packs one partition's documents in their order.  Only open windows are held: a few for each level."""
    from pyspark import TaskContext

    part, encode, packer, number, rows = TaskContext.get().partitionId(), encoder(vocabulary), LevelPacker(size), 0, []
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = text.as_py()
            ids = np.array([*encode(text or ""), end_id], dtype="<u4")
            whole = len(ids) - len(ids) % size
            full = [[(doc, at, ids[at : at + size], len(ids))] for at in range(0, whole, size)]
            if whole < len(ids):
                done = packer.place((doc, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)
                full += [done] if done else []
            for window in full:
                rows += _pieces(window, number)
                number += 1
            if len(rows) >= 20_000:
                yield _batch(rows, part)
                rows = []
    for window in packer.close():
        rows += _pieces(window, number)
        number += 1
    yield _batch(rows, part)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, size: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its text (null: empty) and ``end_id``.  What exceeds whole windows is one item, placed
    online by the sum-of-squares rule (ties: the fullest window).  When a partition ends, its open windows are filled
    from one another by cutting, so that one window per partition at most is padded.  Repeated rows are packed each; a
    ``doc_id`` that is no number is an error under ANSI rules, else null; an empty table gives no rows; other columns are ignored.

    Partitions are packed apart and the pieces written, so that a lost executor repeats single partitions; sequence
    numbers are then made gapless with the window counts of the partitions before (one small row per partition).
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = map_batches(slim, lambda batches: pack_partition(batches, vocabulary, size, end_id), PIECE_SCHEMA)
    pieces = staged(packed, "packed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        pieces.groupBy("_part")
        .agg((F.max("_window") + 1).alias("_windows"))
        .select("_part", F.coalesce(F.sum("_windows").over(before), F.lit(0)).alias("_first"))
    )
    return pieces.join(F.broadcast(firsts), "_part").select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_window") + F.col("_first")).cast("long").alias("sequence_id"),
        "offset",
    )
