"""Every operator and stage on empty tables, nulls in any column, repeated rows and clashing extra columns."""

import importlib

import pytest
from llm_tables import DOCS, SF_DIR, docs_frame
from pyspark.sql import functions as F

from shardlens.llm import decontaminate, html_extract, packing, quality_rules, queries, secrets, sharding, simhash, substring_dedup, url_filter, warc

CLASHING = ["_row", "_key", "_k1", "_text", "fp", "shard", "size", "kept", "_id", "_part", "least", "h", "u", "v", "_h", "_t", "_w", "spans", "length", "path_"]


def clashing(df):
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING if c not in df.columns})


def pages(spark, rows=None):
    rows = rows if rows is not None else [(1, "http://a.com/x/1", "<article><p>Text here.</p></article>"), (None, None, None), (1, "http://a.com/x/1", "<article><p>Text here.</p></article>"), (2, "", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, DOCS[8][1][:300]), (None, None), (2, "")], "item_id long, text string")


MODEL = html_extract.train([])
OVER_DOCS = {
    "secrets": secrets.secret_report,
    "redact": secrets.redact_secrets,
    "shards": lambda d: sharding.shard_by_bytes(d, 4),
    "simhash": simhash.near_duplicate_report,
    "representatives": simhash.keep_representatives,
    "quality": quality_rules.quality_verdicts,
    "keep quality": quality_rules.keep_quality,
    "packing": packing.pack_documents,
    "passages": substring_dedup.remove_recurring,
    "leaks": lambda d: decontaminate.find_leaks(d, bench(d.sparkSession)),
    "drop leaks": lambda d: decontaminate.drop_leaks(d, bench(d.sparkSession)),
}
OVER_PAGES = {
    "html": lambda p: html_extract.extract_main_text(p, MODEL),
    "fit and html": lambda p: html_extract.extract_main_text(p, html_extract.fit(p)),
    "urls": lambda p: url_filter.judge_urls(p, labels(p.sparkSession)),
    "warc": lambda p: warc.read_warc(warc.write_warc(p)),
}
ROW_FOR_ROW = {"secrets", "redact", "shards", "simhash", "quality", "passages", "html", "fit and html", "urls", "warc"}


def odd_docs(spark):
    """The fixture, a row of nulls twice, and repeated rows."""
    docs = docs_frame(spark)
    nulls = spark.createDataFrame([(None,) * 5] * 2, docs.schema)
    return clashing(docs.unionByName(nulls).unionByName(docs.where("doc_id IN (4, 8, 8, 15)")))


@pytest.mark.parametrize("name", OVER_DOCS)
def test_documents(spark, name):
    docs = odd_docs(spark)
    got = OVER_DOCS[name](docs)
    rows = got.collect()
    if name in ROW_FOR_ROW:
        assert len(rows) == docs.count()
    if name in ("redact", "representatives", "keep quality", "drop leaks"):
        assert got.columns == docs.columns
    empty = OVER_DOCS[name](docs.limit(0))
    assert empty.collect() == [] and empty.columns == got.columns


@pytest.mark.parametrize("name", OVER_PAGES)
def test_pages(spark, name):
    table = clashing(pages(spark))
    got = OVER_PAGES[name](table)
    assert len(got.collect()) == table.count()
    empty = OVER_PAGES[name](table.limit(0))
    assert empty.collect() == [] and empty.columns == got.columns


def test_representatives_by_hand(spark):
    docs = odd_docs(spark)
    keep = simhash.keep_representatives(docs).select("doc_id", "text").collect()
    components = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(keep) == len(components) and {r.doc_id for r in keep} == components


def test_stages_one_by_one(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(docs_frame(spark).withColumn("doc_id", F.col("doc_id") + 10**6))
    columns, before = docs.columns, docs
    counts = []
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF_DIR)
        assert after.columns == columns and after.schema == before.schema, name
        after.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        counts.append(before.count())
    judged = quality_rules.quality_verdicts(docs).where("kept")
    assert counts[0] == judged.count() > counts[1] > counts[2] == counts[3] > 0
    assert all(not secrets.spans_of(r.text) for r in before.select("text").collect())
    packed = pipeline.STAGES[-1][1](spark, before, SF_DIR)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_pipeline_is_registered(spark):
    assert list(queries.QUERIES)[-1] == "pipeline" and len(queries.QUERIES) == 14
    assert queries.QUERIES["pipeline"](spark, SF_DIR).count() > 0


def test_pipeline_on_empty_and_null_documents(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    for docs in (docs_frame(spark).limit(0), odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, SF_DIR).count() >= 0
