"""Quality rules: repetition inside a document, and lines that too many documents of a host share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlens.llm.common import BLANK_CLASS, BLANKS, staged, unused, without_listed, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class LineRules:
    """A line is removed if more than ``line_docs`` documents of its host, and more than ``line_percent`` in a hundred
    of them, have it; a document is rejected if fewer than ``left_words`` words or ``left_percent`` in a hundred stay.

    Both limits count: boilerplate is what a host puts on a share of its documents.  Near copies of one clean document
    also have its lines in common; a number alone would reject all of a group of eleven in a host of any size, and leave
    the near-duplicate stage none to keep.  ``line_docs`` is for hosts so small that a share says little."""

    line_docs: int = 10
    line_percent: int = 1
    left_words: int = 50
    left_percent: int = 50


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> Column:
    """Names a row by what it is judged on, as 128 bits in text form; equal rows share it and have one verdict."""
    parts = [docs[id_col], F.coalesce(docs[host_col], F.lit("")), F.coalesce(docs[text_col], F.lit(""))]
    return F.concat_ws(":", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))


def _repeat_words(n: Column) -> Column:
    """Words in windows of three that occur twice or more: each such start covers three words, less the overlap."""
    near = F.transform(
        F.sequence(F.lit(1), F.size("_starts") - 1),
        lambda i: F.least(F.lit(WINDOW), F.get("_starts", i) - F.get("_starts", i - 1)),
    )
    summed = F.aggregate(near, F.lit(WINDOW), lambda a, x: a + x)
    return F.when(F.size("_starts") == 0, 0).when(F.size("_starts") == 1, WINDOW).otherwise(summed)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base counts per row, with its distinct lines as ``_lines`` (hash, words, and times seen) and ``_self``.

    ``_self`` stands for the document when lines are counted: the hash of all its lines, in lower case with single
    blanks.  Exact copies share it, so that a text which was copied often does not turn its own lines into boilerplate;
    texts that differ in a word are documents of their own, however much of their text they share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("doc_id"),
        row_key(docs, id_col, text_col, host_col).alias("_key"),
        F.coalesce(F.col(host_col), F.lit("")).alias("_host"),
        text.alias("_t"),
        words_of(text).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_all"),
    )
    counted = base.select(
        "_row",
        "_key",
        "doc_id",
        "_host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_all") - F.size(F.array_distinct("_all"))).cast("long").alias("n_dup_lines"),
        F.transform("_all", lambda x: F.lower(F.btrim(F.regexp_replace(x, f"{BLANK_CLASS}+", " ")))).alias("_norm"),
        F.when(
            F.size("_w") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - WINDOW),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_tri"),
    )
    # Repeated windows: neighbours in the sorted hashes.  They are looked up in 64 short lists, not in one long list.
    sorted_tri = counted.withColumn("_sorted", F.sort_array("_tri"))
    twice = sorted_tri.withColumn(
        "_twice",
        F.when(F.size(F.array_distinct("_tri")) == F.size("_tri"), F.array().cast("array<bigint>")).otherwise(
            F.array_distinct(
                F.transform(
                    F.filter(F.sequence(F.lit(1), F.size("_sorted") - 1), lambda i: F.get("_sorted", i) == F.get("_sorted", i - 1)),
                    lambda i: F.get("_sorted", i),
                )
            )
        ),
    )
    lists = twice.withColumn(
        "_lists",
        F.when(F.size("_twice") > 0, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.filter("_twice", lambda x: x.bitwiseAND(63) == b))),
    )
    # The lists are named twice on purpose: a column named once would be worked out anew for every word.
    starts = lists.withColumn(
        "_starts",
        F.when(
            F.col("_lists").isNotNull(),
            F.filter(
                F.sequence(F.lit(0), F.size("_tri") - 1),
                lambda i: F.array_contains(
                    F.get("_lists", F.get("_tri", i).bitwiseAND(63).cast("int")), F.get("_tri", i)
                ),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    line = F.transform("_norm", lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).cast("long").alias("w")))
    return starts.select(
        "_row",
        "_key",
        "doc_id",
        "_host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeat_words(F.col("n_words")).cast("long").alias("n_repeat_words"),
        F.xxhash64("_norm").alias("_self"),
        line.alias("_lines"),
    )


def quality_verdicts(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs`` with the base counts, ``base_failed``, ``kept`` and ``n_left`` (words left).

    Lines are compared in lower case with single blanks.  Null and empty texts have no words and fail; a null host is a
    host of its own; repeated rows and exact copies (but for case and blanks) are judged one by one and count as one document; an empty table gives no rows; other
    columns of ``docs`` are ignored.

    The texts are read once.  What later steps need is one small record per line, written to the shared folder.  The
    count per (host, line) combines before its shuffle.  Only lines above the limit are kept of it, written, and joined
    to the lines again, where Spark splits a hot line or broadcasts a short list by its known size.
    """
    features = staged(document_features(docs, id_col, text_col, host_col), "quality-lines")
    lines = features.select("_row", "_host", "_self", F.explode("_lines").alias("_line")).select(
        "_row", "_host", "_self", F.col("_line.h").alias("_h"), F.col("_line.w").alias("_lw")
    )
    per_host = features.groupBy("_host", "_self").agg(F.lit(1).alias("_one")).groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    counts = lines.groupBy("_host", "_h", "_self").agg(F.lit(1).alias("_one")).groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_n"))
    common = (
        counts.where(F.col("_n") > rules.line_docs)
        .join(per_host, "_host")
        .where(F.col("_n") * 100 > F.col("_docs") * rules.line_percent)
        .select("_host", "_h")
    )
    lost = (
        lines.select("_row", "_host", "_h", "_lw")
        .join(staged(common, "quality-common-lines"), ["_host", "_h"])
        .groupBy("_row")
        .agg(F.sum("_lw").alias("_lost"))
    )
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (left < rules.left_words) | (left * 100 < F.col("n_words") * rules.left_percent)
    return features.drop("_lines").join(lost, "_row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        left.cast("long").alias("n_left"),
        "_key",
    )


def keep_quality(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    judged = quality_verdicts(docs, rules)
    key = unused(docs, "_key")
    rejected = staged(judged.where(~F.col("kept")).select(F.col("_key").alias(key)).distinct(), "quality-rejected")
    return without_listed(docs.withColumn(key, row_key(docs)), rejected, key).select(*docs.columns)
