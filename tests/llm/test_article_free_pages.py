"""Collections that mark no article: what the shipped pages teach must do."""

import re

import pytest
from llm_tables import SF_DIR
from pyspark.sql import functions as F

from shardlens.llm import html_extract


@pytest.mark.parametrize("shell", ["<div class='content'>", "<div>", "<div id='q7'>"])
def test_main_text_without_article_elements(spark, shell):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").where("html IS NOT NULL")
    want = {
        r.page_id: "\n".join(b.text for b in html_extract.blocks(r.html) if html_extract._own_label(b)) for r in pages.select("page_id", "html").collect()
    }
    bare = F.regexp_replace(F.regexp_replace("html", r"(?i)<(article|main)(\s[^>]*)?>", shell), r"(?i)</(article|main)>", "</div>")
    bare = pages.withColumn("html", bare)
    assert bare.where(F.col("html").rlike("(?i)<(article|main)")).count() == 0
    got = {r.page_id: r.text for r in html_extract.extract_main_text(bare, html_extract.fit(bare)).collect()}
    assert sum(got[p] == text for p, text in want.items()) >= 0.9 * len(want) and all(got.values())


def test_shipped_pages_are_labelled_as_they_read():
    for page in html_extract.OWN_PAGES:
        found = html_extract.blocks(page)
        own = [b.text for b in found if html_extract._own_label(b)]
        assert own == [t for t in (html_extract.blocks(x)[0].text for x in re.findall(r"<(?:h1|p)>.*?</(?:h1|p)>", page))]


def test_a_tag_that_ends_in_a_new_line_marks_an_article(spark):
    page = html_extract.OWN_PAGES[0].replace("<article>", "<article\n class='x'>")
    pages = spark.createDataFrame([(k, "", page) for k in range(3)], "page_id long, url string, html string")
    model = html_extract.fit(pages, html_extract.CrfParams(rounds=5))
    assert model.emit.any() and model.main_text(page).startswith("Ferry returns")
