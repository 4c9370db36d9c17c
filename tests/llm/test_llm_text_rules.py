"""Secret scan, quality rules, packing and sharding against brute force."""

import hashlib
import re
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_tables import DOCS, SF_DIR, WORDS, docs_frame
from pyspark.sql import functions as F

from shardlens.llm import packing, quality_rules, secrets, sharding


def spans_by_hand(text):
    text, found = text or "", []
    for kind, pattern, least in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None),
        ("access", r"AKIA[A-Z0-9]+", 20),
        ("hex", r"[0-9a-f]+", 24),
    ):
        for m in re.finditer(pattern, text):
            if (len(m[2]) >= 6) if least is None else (len(m[0]) >= least):
                found.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_secrets_by_hand(spark):
    rows = secrets.secret_report(docs_frame(spark)).collect()
    assert len(rows) == len(DOCS)
    texts = {d: t for d, t in DOCS}
    for r in rows:
        want = spans_by_hand(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert sum(r.n_assign for r in rows) and sum(r.n_hex for r in rows) and sum(r.n_novel for r in rows)


def test_novel_strings_are_reported_and_prose_is_not():
    told = "use the bearer ghp4Zq9Xw27LmT0RkV8sYd3Nc here"
    assert [(k, told[s:e]) for s, k, e in secrets.spans_of(told)] == [("novel", "ghp4Zq9Xw27LmT0RkV8sYd3Nc")]
    assert secrets.spans_of("the secret timestamp information environment of the organisation") == []
    assert secrets.spans_of("the credential " + "xyz123" * 5 + " " + "xyz123" * 5) == []
    assert secrets.redacted("a password=abcdef1 b") == "a [SECRET] b"


def quality_by_hand(text):
    text = text or ""
    words = WORDS.findall(text)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_base_counts_by_hand(spark):
    rows = quality_rules.quality_verdicts(docs_frame(spark)).collect()
    texts = dict(DOCS)
    assert len(rows) == len(DOCS)
    for r in rows:
        want = quality_by_hand(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert any(r.n_repeat_words for r in rows) and any(r.kept for r in rows)


def test_common_lines_are_cut_and_copies_are_not_boilerplate(spark):
    own = lambda d, n: " ".join(f"w{d}x{i}" for i in range(n))
    banner = " ".join(f"banner{i}" for i in range(60))
    rows = [(d, f"{own(d, 40)}\n{banner.upper() if d % 2 else banner}", "s") for d in range(30)]
    rows += [(100 + d, own(7000, 80), "s") for d in range(30)]
    rows += [(200, f"{own(200, 70)}\n{banner}", "s"), (201, f"{own(201, 40)}\n{banner}", None)]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[d].kept for d in range(30)) and got[3].n_left == 40
    assert all(got[100 + d].kept for d in range(30))
    assert got[200].kept and got[200].n_left == 70
    assert got[201].kept and got[201].n_left == 100


def test_shards_are_contiguous_balanced_and_whole(spark):
    rows = sharding.shard_by_bytes(docs_frame(spark), 5).orderBy("doc_id").collect()
    texts = {d: (t or "").encode() for d, t in DOCS}
    assert [r.doc_id for r in rows] == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    most = max(r["size"] for r in rows)
    assert all(abs(sizes[k] - sum(sizes.values()) / 5) <= most for k in range(5))


def test_shards_of_real_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = sharding.shard_by_bytes(docs, 24).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(rows) == 24 and all(r.m == r.n - 1 for r in rows) and sum(r.n for r in rows) == docs.count()


def test_packing_ids_are_the_merge_forms():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok, encode, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(None), random.Random(8)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  \n", "it's", "ſ", "é", "12345", "日本", "\u00a0", "x" * 30, "\x1c", "\u0085"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)]
    texts += [" " * n for n in (999, 1000, 1001)] + ["\t" * 5000 + "end", "z" * 100_000]
    assert [encode(t) for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode("a<|endoftext|>b")[1] == 50256


def test_packing_round_trip(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").unionByName(docs_frame(spark).select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(20_000_000, "a <|endoftext|> b"), (20_000_001, " ".join(["token"] * 5000)), (20_000_002, "<|endoftext|><|endoftext|>x<|endoftext |>"), (20_000_003, "a" + " " * 1_000_000 + "b"), (20_000_004, "\n\u3000" * 3000)], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    rows = packing.pack_documents(docs).collect()
    at, fill = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(np.array(piece, dtype="<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        at.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, pieces in at.items():
        end = 0
        for start, length in sorted(pieces):
            assert start == end and length > 0
            end += length
        assert end == len(ids[d])
    assert set(at) == set(ids) and sorted(fill) == list(range(len(fill)))
    total = 0
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
        total += 1024 - end
    assert total <= 1024 * docs.rdd.getNumPartitions()


def test_level_packer_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.LevelPacker(16)
    for _ in range(300):
        length = int(rng.integers(1, 17))
        before = packer.count.copy()
        options = {}
        for h in range(0, 17 - length):
            if h and not before[h]:
                continue
            after = before.copy()
            if h:
                after[h] -= 1
            if h + length < 16:
                after[h + length] += 1
            options[h] = int((after**2).sum())
        packer.place((1, 0, np.zeros(length, "<u4"), length), length)
        assert int((packer.count**2).sum()) == min(options.values())
        assert [len(w) for w in packer.open] == packer.count[:16].tolist()
    full = [sum(len(p[2]) for p in w) for w in packer.close()]
    assert all(f == 16 for f in full[:-1])
