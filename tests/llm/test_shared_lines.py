"""Lines of a host that different documents share, where they are most of the text."""

import random

import duckdb
import pandas as pd
import pytest

from shardlens.llm import quality_rules
from shardlens.llm.sql import OP8_SQL

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left"]


@pytest.mark.parametrize("docs,own,shared", [(60, 20, 200), (40, 10, 90), (200, 10, 300)])
def test_documents_made_mostly_of_shared_lines_are_rejected(spark, docs, own, shared):
    rng = random.Random(own)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for host in range(12):
        lines = "\n".join(say(10) for _ in range(shared // 10))
        rows += [(1000 * host + d, f"{say(own)}\n{lines}", f"h{host}") for d in range(docs)]
    # Copies of one text, and of it in other case and with other blanks, are one document.
    copied = "\n".join(say(12) for _ in range(10))
    rows += [(10**6 + d, (copied, copied.upper(), copied.replace(" ", "  "))[d % 3], "copies") for d in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(table).collect()}
    assert not any(got[1000 * h + d].kept for h in range(12) for d in range(docs))
    assert all(got[1000 * h + d].n_left == own for h in range(12) for d in range(docs))
    assert all(got[10**6 + d].kept for d in range(30))


def test_a_hot_host_and_its_sql(spark):
    """2,000 documents: a footer in 30 goes, a passage in 15 (above ten, below one percent) stays; all counts as in SQL."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    footer, passage, small = say(70), say(70), say(70)
    rows = [(d, say(60), "hot") for d in range(1955)]
    rows += [(5000 + d, f"{say(51)}\n{footer if d % 2 else footer.upper()}", "hot") for d in range(30)]
    rows += [(6000 + d, f"{say(51)}\n{passage}", "hot") for d in range(15)]
    rows += [(7000 + d, f"{say(20)}\n{small}\n \n{small}", None if d % 2 else "") for d in range(11)]
    rows += [(8000, None, None), (8001, "", "hot"), (8002, "a b c a b c\n$ a b\n$ a b", "hot"), (8002, "a b c a b c\n$ a b\n$ a b", "hot")]
    rows += [(None, say(60), "hot"), (8003, "x y " * 40, "hot")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = [tuple(r) for r in quality_rules.quality_verdicts(table).select(*COLUMNS).collect()]
    left = {r[0]: r[-1] for r in got}
    assert all(left[5000 + d] == 51 for d in range(30)) and all(left[6000 + d] == 121 for d in range(15))
    assert all(left[7000 + d] == 20 for d in range(11))
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con.register("documents", frame)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP8_SQL})").fetchall(), key=key)
