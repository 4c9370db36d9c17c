"""Fill-in-middle transformation: cuts between code points, found on UTF-8 bytes eight at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlens.llm.common import map_batches

ONES, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FimParams:
    """``plain_percent`` of the documents stay as they are, ``spm_percent`` of the others put the suffix first."""

    seed: str = "1"
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class CodePoints:
    """Ranks and places of the code points of UTF-8 bytes.

    The bytes are read as 64-bit words.  In ``ends`` the low bit of a byte is set where a code point ends, which is where
    the byte after it is no continuation byte (``10......``); ``before`` counts the ends in all words before a word.
    """

    def __init__(self, data: np.ndarray):
        padded = np.full(len(data) // 8 * 8 + 8, 0x80, np.uint8)
        padded[: len(data)] = data
        padded[len(data)] = 0  # ends the last code point; the continuation bytes behind it end none
        word = padded.view("<u8")
        starts = ~((word >> np.uint64(7)) & ~(word >> np.uint64(6))) & ONES
        self.ends = starts >> np.uint64(8)
        self.ends[:-1] |= starts[1:] << np.uint64(56)
        self.before = np.zeros(len(word) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Code points that end before each byte offset."""
        word = place >> 3
        below = (np.uint64(1) << (place & 7).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, count: np.ndarray) -> np.ndarray:
        """The byte offset after the first ``count`` code points, for counts from 1 to their number."""
        word = np.searchsorted(self.before[1:], count)
        left = (count - self.before[word]).astype(np.uint64)
        upto = self.ends[word] * ONES  # byte j: how many of the bytes 0 to j end a code point
        reached = ((upto | HIGH) - left * ONES) & HIGH
        return word * 8 + 9 - np.bitwise_count(reached)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each text starts and ends (null: nothing)."""
    array = texts.cast(pa.large_binary())
    _, places, data = array.buffers()
    if not len(array) or data is None:
        nothing = np.zeros(len(array), np.int64)
        return np.zeros(0, np.uint8), nothing, nothing
    bounds = np.frombuffer(places, np.int64)[array.offset : array.offset + len(array) + 1]
    start, end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    valid = np.asarray(array.is_valid())
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], start, np.where(valid, end, start)


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, params: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    The text has ``n`` code points (null text: empty).  Four numbers are drawn from a hash of the seed and the id, so
    that any run gives the same cuts: the two cuts, whether the text stays plain, and the order of the parts.  Empty
    texts and texts that contain one of the three marks stay plain; their part lengths are null.  ``restored`` gives
    the text back.  Rows with equal ids are cut at the same draws, a null id draws as an empty one, an empty table gives
    an empty result, and columns besides id and text are ignored.  No shuffle; memory holds one batch of texts.
    """
    key = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.sha2(key, 256).alias("digest")
    ).select(
        "doc_id", "text", *[F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    )
    prefix, suffix, middle = (mark.encode() for mark in (params.prefix, params.suffix, params.middle))
    marks, plain_from, spm_below = (prefix, suffix, middle), 100 - params.plain_percent, params.spm_percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, end = _bytes_of(batch.column("text"))
            points, view = CodePoints(data), memoryview(data)
            first = points.rank(start)
            n = points.rank(end) - first
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
            one, two = h1 % (n + 1), h2 % (n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            cuts = [np.where(k > 0, points.select(np.maximum(first + k, 1)), start) if len(data) else start for k in (low, high)]
            forms, outputs = [], []
            for i, (a, b, c, d) in enumerate(zip(start.tolist(), *(cut.tolist() for cut in cuts), end.tolist())):
                text = bytes(view[a:d])
                if not text or h3[i] % 100 >= plain_from or any(mark in text for mark in marks):
                    forms.append(PLAIN)
                    outputs.append(text)
                    continue
                head, body, tail = view[a:b], view[b:c], view[c:d]
                spm = h4[i] % 100 < spm_below
                forms.append(SPM if spm else PSM)
                parts = (suffix, tail, prefix, head, middle, body) if spm else (prefix, head, suffix, tail, middle, body)
                outputs.append(b"".join(parts))
            plain = np.array([form == PLAIN for form in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(low, pa.int64(), mask=plain),
                    pa.array(high - low, pa.int64(), mask=plain),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return map_batches(drawn, run, OUT)


def restored(output: Column, form: Column, params: FimParams = FimParams()) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of.

    A text that was cut contains no mark, and no mark can begin inside another, so each mark stands once in the output.
    """

    def around(text: Column, mark: str) -> tuple[Column, Column]:
        return F.split_part(text, F.lit(mark), F.lit(1)), F.split_part(text, F.lit(mark), F.lit(2))

    front, body = around(output, params.middle)
    psm_head, psm_tail = around(F.substring(front, len(params.prefix) + 1, 2**31 - 1), params.suffix)
    spm_tail, spm_head = around(F.substring(front, len(params.suffix) + 1, 2**31 - 1), params.prefix)
    return (
        F.when(form == PSM, F.concat(psm_head, body, psm_tail))
        .when(form == SPM, F.concat(spm_head, body, spm_tail))
        .otherwise(output)
    )


def fim_digests(docs: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """``fill_in_middle`` with checksums in place of the texts: of the output and of the text restored from it."""
    return fill_in_middle(docs, params).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), params), 256).alias("restored_sha256"),
    )
