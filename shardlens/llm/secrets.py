"""Secret scan: fixed patterns, and strings near sensitive words that a primed compressor cannot shorten."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm.common import map_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 24 or more: the longest runs of these characters are what a shorter pattern would find and drop.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]

SENSITIVE = re.compile(
    r"passw(?:or)?d|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|signature|AKIA",
    re.I | re.A,
)
HINTS = ("passw", "passphrase", "passcode", "secret", "token", "api", "key", "credential", "bearer", "authoriz", "signature", "akia")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
REACH, AROUND = 64, 400
# Share of what a random string of the same letters and length costs, at which a candidate counts as incompressible: in
# bytes of the compressor, and in bits by pairs of letters (a compressor stores a short word as it is).
NOVELTY, UNSPOKEN = 0.9, 0.85

# What code and configuration are full of; primes the compressor beside the surrounding text.
IDENTIFIERS = (
    "access account address admin api_key append application args array assert async auth authorization await base64 "
    "bearer bool boolean break bucket buffer bytes cache callback certificate class client client_id client_secret "
    "column config connection const constructor content context continue cookie count create credential data database "
    "date debug decode def default delete description dict digest echo email encode encoding endpoint environment "
    "error example exception export extends false field file filter final float format from function global group "
    "handler hash header host http https id implements import index information init input insert instance int "
    "integer interface join json key label lambda language length library limit list localhost login long map "
    "message method model module name namespace new none null number object option output package parameter params "
    "parse password path pattern payload placeholder port prefix print private process project protected provider "
    "public query range read receive region register release request require response result return role salt schema "
    "script secret security select self send server service session set setting sha256 signature size source "
    "static status string struct super switch table target template test this throw timeout timestamp token true "
    "try type undefined update url user username utf-8 value variable version void while window word write yield "
    "your_api_key_here changeme example_password ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 "
)

# What prose is full of; primes the pairs of letters beside the identifiers and the surrounding text.
PROSE = (
    "the of and that with which this from have they their would there about other people through between government "
    "because different important development organisation responsibility understanding information international "
    "der die und nicht eine werden sich auch nach dass zwischen entwicklung gesellschaft verwaltung beschreibung "
    "wissenschaft schliesslich verantwortung que les des une pour dans est pas avec sont cette comme entre developpement "
    "gouvernement aujourd questions notamment traitement los las para como pero sobre tambien desde informacion "
    "desarrollo administracion universidad conocimiento caracteristicas "
)

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str, low: str) -> list[tuple[int, str, int]]:
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


@lru_cache(maxsize=4096)
def _random_like(alphabet: str, length: int) -> bytes:
    return "".join(random.Random(length).choices(alphabet, k=length)).encode()


def _alphabet(candidate: str) -> str:
    """The letters that the candidate seems to be drawn from: hexadecimal digits, or each kind of letter it has."""
    held = set(candidate)
    for hexadecimal in ("0123456789abcdef", "0123456789ABCDEF"):
        if held <= set(hexadecimal):
            return hexadecimal
    kinds = (string.ascii_lowercase, string.ascii_uppercase, string.digits)
    known = "".join(kind for kind in kinds if held & set(kind))
    return known + "".join(sorted(held - set(known)))


def novelty(candidate: str, around: str) -> float:
    """Bytes that the candidate adds to an archive which already knows its surroundings and common identifiers, by those
    that a random string of its alphabet and length adds."""
    known = zstandard.ZstdCompressionDict((IDENTIFIERS + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    engine = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False)
    empty = len(engine.compress(b""))
    drawn = _random_like(_alphabet(candidate), len(candidate))
    return (len(engine.compress(candidate.encode())) - empty) / (len(engine.compress(drawn)) - empty)


def _pairs(text: str) -> np.ndarray:
    """How often each letter (without case) follows each."""
    codes = np.frombuffer(text.lower().encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - ord("a")
    a, b = codes[:-1], codes[1:]
    both = (a >= 0) & (a < 26) & (b >= 0) & (b < 26)
    return np.bincount(a[both] * 26 + b[both], minlength=676).reshape(26, 26)


SPOKEN = _pairs(IDENTIFIERS + PROSE)


def unspoken(candidate: str, around: str) -> float:
    """Bits of the candidate's letters by the pairs that words and the surroundings have, by those of random letters."""
    known = SPOKEN + _pairs(around) + 0.5
    bits = -np.log2(known / known.sum(axis=1, keepdims=True))
    own = _pairs(candidate)
    return float((own * bits).sum() / max(own.sum(), 1) / bits.mean())


def _novel(text: str, start: int, end: int) -> bool:
    """What has no letters is none; what has no digits must also be unlike words.  Copies of the candidate do not count
    as surroundings."""
    candidate, wide = text[start:end], AROUND + end - start
    if not any(c.isalpha() for c in candidate):
        return False
    before = text[max(0, start - wide) : start].replace(candidate, " ")[-AROUND:]
    around = before + text[end : end + wide].replace(candidate, " ")[:AROUND]
    if not any(c.isdigit() for c in candidate) and unspoken(candidate, around) < UNSPOKEN:
        return False
    return novelty(candidate, around) >= NOVELTY


def novel_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
    """Candidates within ``REACH`` characters after a sensitive word that the primed compressor cannot shorten."""
    found, last = [], 0
    # Candidates come in order, and so do the spans they are held against: what begins before a candidate's end reaches
    # no further than ``taken_to``.
    taken, ahead, taken_to = sorted(taken), 0, 0
    for word in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, max(word.end(), last), word.end() + REACH):
            # The reach may cut a long string: it is judged and reported whole.
            whole = CANDIDATE.match(text, m.start())
            last = max(last, whole.end())
            while ahead < len(taken) and taken[ahead][0] < whole.end():
                taken_to = max(taken_to, taken[ahead][1])
                ahead += 1
            if taken_to > whole.start():
                continue
            if _novel(text, whole.start(), whole.end()):
                found.append((whole.start(), "novel", whole.end()))
    return found


def spans_of(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind; null is empty."""
    text = text or ""
    low = text.lower()
    found = base_spans(text, low)
    if any(h in low for h in HINTS):
        found += novel_spans(text, [(s, e) for s, _, e in found])
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for s, k, e in spans_of(t.as_py())] for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, ARROW_SPANS)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans`` (array of kind, start, end; code points, end exclusive).

    Null and empty texts have no spans; texts are scanned whole; repeated rows are scanned each; other columns are
    ignored.  Rows stay where they are read: no shuffle, a batch of texts at a time.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(SPAN))])
    return map_batches(docs.select("doc_id", "text"), _scan, schema)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in spans_of(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted again where there was one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(t.as_py()) for t in batch["text"]], pa.string())
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch[n] for n in names], names=names)

    clean = map_batches(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return clean.select(*docs.columns)


def secret_report(docs: DataFrame) -> DataFrame:
    """``find_secrets`` as counts and digests: the form in which results are compared."""
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    based = F.filter("spans", lambda x: x["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(based, label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )
