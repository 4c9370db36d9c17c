"""Leaks at exactly the edits allowed, by length and kind of edit."""

import random

import pytest

from shardlens.llm import decontaminate


def edited(rng, item, kind, edits):
    words, fresh = list(item), iter(range(10**6))
    if kind == "delete":
        keep = set(rng.sample(range(len(words)), len(words) - edits))
        return [w for i, w in enumerate(words) if i in keep]
    for n, at in enumerate(sorted(rng.sample(range(len(words)), edits), reverse=True)):
        how = kind if kind != "mixed" else ("delete", "insert", "replace")[n % 3]
        words[at : at + 1] = {"delete": [], "insert": [words[at], f"new{next(fresh)}"], "replace": [f"new{next(fresh)}"]}[how]
    return words


@pytest.mark.parametrize("kind", ["replace", "insert", "delete", "mixed"])
@pytest.mark.parametrize("size", [5, 10, 20, 38, 59, 80])
def test_items_at_the_limit_are_all_found(kind, size):
    rng, params = random.Random(size), decontaminate.LeakParams()
    items = [[f"w{rng.randrange(3000)}" for _ in range(size)] for _ in range(40)]
    index = decontaminate.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)], params)
    texts = []
    for item in items:
        around = [f"w{rng.randrange(3000)}" for _ in range(300)]
        around[150:150] = edited(rng, item, kind, params.edits(size))
        texts.append(" ".join(around))
    found = {(n, item): edits for n, item, edits, _ in index.search(texts)}
    assert all(found.get((n, n), 99) <= params.edits(size) for n in range(40))
    assert all(decontaminate.infix_edits(index.items[i], [index.vocabulary.get(w, 0) for w in texts[n].split()])[0] == e for (n, i), e in found.items())


def test_small_vocabulary_against_all_pairs():
    """Few different words, so that runs recur: the same pairs, edits and ends as comparing every item with every text."""
    rng, params = random.Random(8), decontaminate.LeakParams()
    for vocabulary in (3, 8, 30):
        items = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 30))) for _ in range(60)]
        texts = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 90))) for _ in range(60)] + [None, ""]
        index = decontaminate.ItemIndex(list(enumerate(items)), params)
        want = []
        for n, text in enumerate(texts):
            words = [index.vocabulary.get(w, 0) for w in decontaminate.tokens(text)]
            for i, item in enumerate(index.items):
                edits, end = decontaminate.infix_edits(item, words)
                want += [(n, i, edits, end)] if edits <= params.edits(len(item)) else []
        assert index.search(texts) == want


def test_pieces_of_a_text_give_the_same(monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 5)
    test_small_vocabulary_against_all_pairs()


def test_one_very_long_item_takes_little_memory():
    import tracemalloc

    rng = random.Random(9)
    long = [f"w{i}" for i in range(10_000)]
    items = [(0, " ".join(long))] + [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(30))) for i in range(1, 50)]
    text = " ".join(["before"] * 50 + edited(rng, long, "mixed", 1500) + ["then", *items[7][1].split()])
    tracemalloc.start()
    index = decontaminate.ItemIndex(items, decontaminate.LeakParams())
    found = index.search([text, None, items[3][1]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(n, i) for n, i, _, _ in found] == [(0, 0), (0, 7), (2, 3)] and found[0][2] <= 1500
    assert peak < 200 << 20
