"""Near duplicates, leaks, recurring passages, archives, urls and page text against brute force."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
import xxhash
import zstandard
from llm_tables import DOCS, SF_DIR, WORDS, docs_frame

from shardlens.llm import decontaminate, html_extract, simhash, substring_dedup, url_filter, warc


def fingerprint_by_hand(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps):
    ids, parent = sorted(fps), {d: d for d in fps}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("bucket,rows", [(1024, 100_000), (7, 50)])
def test_simhash_by_hand(spark, bucket, rows):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs_frame(spark).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: fingerprint_by_hand(t) for d, t in texts.items()}
    rows = simhash.near_duplicate_report(docs, simhash.SimHashParams(bucket=bucket, rows=rows)).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == components_by_hand(fps)


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = [base]
    for flips in (1, 3, 4, 5):
        noise = np.zeros(40, dtype=np.uint64)
        for _ in range(flips):
            noise ^= np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
        values.append(base ^ noise)
    values = np.unique(np.concatenate(values))
    cut = len(values) // 3
    forest = simhash.Forest(np.concatenate([values, values[:cut]]), np.array([len(values), len(values) + cut]))
    near = lambda n, off: {(i + off, j + off) for i in range(n) for j in range(i + 1, n) if int(values[i] ^ values[j]).bit_count() <= 4}
    want = near(len(values), 0) | near(cut, len(values))
    for most in (1 << 18, 16):
        got = {(min(a, b), max(a, b)) for x, y in simhash.near_pairs(forest, 4, most) for a, b in zip(x.tolist(), y.tolist())}
        assert got == want and want


def test_chain_of_links_is_one_component(spark):
    from shardlens.llm.components import star_components

    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 205), (205, 200)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in star_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 201: 200, 205: 200}


def edits_by_hand(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(words, 1):
            row.append(min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_infix_edits_by_hand():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))]
        words = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 30))]
        assert decontaminate.infix_edits(item, words)[0] == edits_by_hand(item, words)


def test_leaks_against_brute_force(spark):
    """Recall against exact edit distances over planted passages with edits, and no clean document."""
    rng = random.Random(4)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 4000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(60)] + [(60, None), (61, ""), (5, "again a b c d e f g h i j k l m n")]
    docs = []
    for d in range(240):
        words = [word() for _ in range(150)]
        if d < 180:
            leak = items[rng.randrange(60)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, len(leak) // 8, len(leak) // 6])):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], [word()], [leak[at], word()]])
            words[75:75] = leak
        docs.append((d, " ".join(words).title()))
    docs += [(900, None), (901, "")]
    params = decontaminate.LeakParams()
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), params
    ).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found if r.item_words != 16 or r.item_id != 5}
    want = {}
    for d, text in docs:
        words = decontaminate.tokens(text)
        for i, t in items[:60]:
            item = decontaminate.tokens(t)
            if (e := edits_by_hand(item, words)) <= params.edits(len(item)):
                want[d, i] = e
    assert got.keys() <= want.keys()
    assert len(got) >= 0.97 * len(want) and len(want) > 150
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= got.keys() and all(got[k] == 0 for k in exact)


def test_leaks_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert one and sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == one
    left = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {r[0] for r in one}


def passages_by_hand(texts, n=35):
    words = {d: WORDS.findall(t or "") for d, t in texts.items()}
    seen = {}
    for w in words.values():
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            seen[key] = seen.get(key, 0) + 1
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


@pytest.mark.parametrize("crowd,shard", [(200, 20_000), (1, 3)])
def test_recurring_passages_by_hand(spark, crowd, shard):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs_frame(spark).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = substring_dedup.remove_recurring(docs, substring_dedup.PassageParams(crowd=crowd, shard=shard)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == passages_by_hand(texts)
    assert any(r.n_removed for r in rows)


def pages_frame(spark):
    same = "<p>équal</p>" * 50
    rows = [
        (5, "http://a.example.com/x", same, 1), (3, "http://b.example.com/y", same, 1), (9, "http://c.example.com/z\r\nX: y", same, 2),
        (1, None, None, 0), (2, "http://d", "", 0), (None, "http://e", "", 0), (None, "f", "<p>own</p>", 3), (7, "g", "y" * 3_000_000, 4),
        (8, "http://a.example.com/x", "<p>a</p>", 1), (8, "http://a.example.com/x", "<p>a</p>", 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, path long").repartition(2)


def test_warc_round_trip(spark):
    rows = warc.read_warc(warc.write_warc(pages_frame(spark)), with_payload=True).collect()
    assert len(rows) == 10
    for r in rows:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert got == [
        (False, 1, 0, "response", None), (False, 2, 0, "revisit", 1), (False, 3, 650, "response", None), (False, 5, 650, "revisit", 3),
        (False, 7, 3_000_000, "response", None), (False, 8, 8, "response", None), (False, 8, 8, "revisit", 8), (False, 9, 650, "revisit", 3),
        (True, 0, 0, "revisit", 1), (True, 0, 10, "response", None),
    ]
    assert sum(bytes(r.payload) == b"y" * 3_000_000 for r in rows) == 1


def test_broken_archives_are_named(tmp_path):
    words = warc.train_dictionary([b"some page"])
    engine = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    good = warc.record(1, "http://a", b"abc", warc.payload_digest(b"abc"), None, False)
    head = struct.pack("<II", warc.DICT_FRAME, len(words)) + words
    assert warc.parse_record(good, "x")["payload"] == b"abc"
    whole = head + engine.compress(good)
    for data, said in (
        (whole[:-3], "cut off"),
        (engine.compress(good), "no dictionary"),
        (head + engine.compress(good[:-1]), "end mark"),
        (head + engine.compress(good.replace(b"abc", b"abd")), "digest"),
        (head + engine.compress(good.replace(b"WARC/1.1", b"WARC/0.9")), "version"),
        (head[:-2], "cut off"),
    ):
        path = tmp_path / "a.warc.zst"
        path.write_bytes(data)
        with pytest.raises(warc.BadArchive, match=said):
            for frame in warc._frames(str(path)):
                warc.parse_record(frame, "x")


def test_url_rules_and_templates(spark):
    urls = [
        ("https://A.Example.NET/en/1?x", "example.net/en/", "allow"), ("http://example.net/english", "net/", "block"), ("http://net/", "net/", "block"),
        ("http://x.example.com/de/3", "example.com/de/", "block"), ("http://x.org/fr/", "org/fr/", "allow"), ("http://fakenet/", None, "allow"),
        ("http://example.net", None, "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("x://y://z/a#b", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)], "page_id long, url string")
    bad = [(1000 + i, f"http://h.com/spam/{i}") for i in range(60)] + [(2000 + i, f"http://h.com/news/{i}/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i}") for i in range(60)]
    bad += [(3000 + i, f"http://h.com/wide/{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(60)]
    pages = pages.unionByName(spark.createDataFrame(bad, "page_id long, url string")).repartition(3)
    labels = spark.createDataFrame(
        [(1000 + i, 0, 0) for i in range(50)] + [(2000 + i, 1, 0) for i in range(50)] + [(3000 + i, 1, 0) for i in range(50)] + [(None, 0, 1), (1000, None, None), (2001, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels).collect()}
    for i, (url, rule, verdict) in enumerate(urls):
        assert (got[i].rule, got[i].verdict) == (rule, verdict), url
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/1") and (got[7].host, got[7].path, got[9].host) == ("", "", "y:")
    assert all(got[1000 + i].verdict == "block" for i in range(60)) and all(got[2000 + i].verdict == "allow" for i in range(60))
    assert got[1000].template == "/spam/*" and got[3000].template == "/wide/*" and len(got) == len(urls) + 180


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p></div><article><h1>A &amp; B</h1><p>First   long sentence of the text,
with more words in it. And one &#233;tude.</p><script>var x = "</p>";</script><p>Second one, <a href="/z">linked</a> here and there. It goes on.<aside class="sidebar"><p>Trending now</p></aside>
<p>Third paragraph ends the article, as it should. Right here.</p><section class="comments"><div class="comment"><p>Nice post, thanks.</p></div></section></article>
<form><label>Email</label><input><button>Go</button></form><footer><p>&copy; somebody</p></footer></body></html>"""


def test_blocks_of_a_page():
    texts = [b.text for b in html_extract.blocks(PAGE)]
    assert texts[:3] == ["Home", "About us", "We use cookies on this site."] and "A & B" in texts
    assert html_extract.blocks(None) == html_extract.blocks("") == html_extract.blocks("<p> \n </p><!-- x -->") == []
    assert [b.text for b in html_extract.blocks("<p>a<br>b &lt;i&gt; <b>c</b>d<p>e</div>f<!-- g")] == ["a b <i> cd", "ef"]
    assert [b.text for b in html_extract.blocks('<p title="a>b">x</p <p>y < z')][:1] == ["x"]


def test_main_text_of_held_out_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    model = html_extract.fit(pages)
    assert model.main_text(PAGE) == (
        "A & B\nFirst long sentence of the text, with more words in it. And one étude.\nSecond one, linked here and there. It goes on.\n"
        "Third paragraph ends the article, as it should. Right here."
    )
    held_out = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id >= 100").collect()
    for r in held_out:
        found = html_extract.blocks(r.html)
        want = "\n".join(b.text for b in found if any(tag == "article" for tag, _ in b.path))
        assert model.main_text(r.html) == want
    rng = np.random.default_rng(99)
    stock = [b.text for r in held_out for b in html_extract.blocks(r.html)]
    right = whole = 0
    for r in held_out:
        found = html_extract.blocks(r.html)
        made, ys = html_extract._laid_out(found, [html_extract._own_label(b) for b in found], stock, rng)
        right += sum(int(a == b) for a, b in zip(model.decode(made), ys))
        whole += len(ys)
    assert right / whole > 0.97


def test_viterbi_and_likelihood_on_a_toy():
    block = lambda text, tag: html_extract.Block(text, (("div", ()), (tag, ())), 0.0)
    pages = [([block("a", "nav"), block("b b", "p"), block("c", "footer")], [0, 1, 0])] * 20
    model = html_extract.train(pages, html_extract.CrfParams(dims=512, rounds=40))
    assert model.decode(pages[0][0]) == [0, 1, 0] and model.decode([]) == []


def test_texts_of_odd_pages(spark):
    model = html_extract.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"))
    got = html_extract.extract_main_text(pages_frame(spark), model).collect()
    assert len(got) == 10 and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if r.page_id in (1, 2))


def test_documents_are_what_the_fixture_says():
    assert len(DOCS) == len({d for d, _ in DOCS})
