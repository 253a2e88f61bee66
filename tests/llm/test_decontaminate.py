import random

import numpy as np
import pytest
from conftest import frame, words

from tessera.llm import decontaminate as D


def tiling(item, doc, k):
    """Greedy string tiling by looking at all pairs of places again and again: words of the item marked."""
    a, b, marked = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return marked
        a[i : i + n] = b[j : j + n] = [True] * n
        marked += n


def expected(docs, items, k=D.MIN_MATCH, coverage=D.COVERAGE):
    import re

    cut = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    out = []
    for d, text in docs:
        for q, item in items:
            w = cut(item)
            if w:
                marked = tiling(w, cut(text), min(k, len(w)))
                if marked >= coverage * len(w) - 1e-9:
                    out.append((d, q, marked, len(w)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.randrange(1, 40), 60)) for i in range(25)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 40), 60)
        item = rng.choice(items[:25])[1].split()
        kind = rng.randrange(5)
        if kind == 1:
            text += " " + " ".join(item).upper() + ", " + text
        elif kind == 2:  # passages in another order
            c = rng.randrange(len(item))
            text = " ".join(item[c:]) + ". " + text + "; " + " ".join(item[:c])
        elif kind == 3:  # a part only
            text += " " + " ".join(item[: len(item) * rng.randrange(60, 100) // 100])
        elif kind == 4:
            text = " ".join(item * 3)
        docs.append((i, text))
    return docs, items


def table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("seed", range(3))
def test_against_all_places(spark, seed):
    docs, items = corpus(seed)
    got = D.matches(frame(spark, docs), table(spark, items))
    assert sorted(((r.doc_id, r.item_id, r.matched_words, r.item_words) for r in got.collect()), key=str) == expected(docs, items)


def test_reordered_passages_are_caught_and_clean_documents_stay(spark):
    rng = random.Random(8)
    item = words(rng, 30, 10**6).split()
    docs = [(1, " ".join(item[15:]) + " something else " + " ".join(item[:15])), (2, " ".join(item[:20])), (3, words(rng, 50))]
    (r,) = D.matches(frame(spark, docs), table(spark, [(7, " ".join(item))])).collect()
    assert (r.doc_id, r.item_id, r.coverage, r.n_tiles) == (1, 7, 1.0, 2)
    assert [r.doc_id for r in D.clean(frame(spark, docs), table(spark, [(7, " ".join(item))])).collect()] == [2, 3]


def test_a_large_benchmark_goes_in_blocks(spark):
    docs, items = corpus(4)
    both = [sorted(map(tuple, D.matches(frame(spark, docs), table(spark, items), block_bytes=n).collect()), key=str) for n in (D.BLOCK_BYTES, 300)]
    assert both[0] == both[1] != []
    left = [sorted(r.doc_id for r in D.clean(frame(spark, docs), table(spark, items), block_bytes=n).collect()) for n in (D.BLOCK_BYTES, 300)]
    assert left[0] == left[1] == [i for i, _ in docs if i not in {r[0] for r in both[0]}]


def test_odd_rows_and_empty_tables(spark, odd, clashing, empty, odd_rows):
    bench = table(spark, [(1, "same id other text"), (2, None), (None, "one")])
    want = expected(odd_rows, [(1, "same id other text"), (None, "one")])
    for docs in (odd, clashing):
        assert sorted(((r.doc_id, r.item_id, r.matched_words, r.item_words) for r in D.matches(docs, bench).collect()), key=str) == want
        assert D.clean(docs, bench).columns == docs.columns
    assert D.matches(empty, bench).collect() == [] and D.matches(odd, table(spark, [])).collect() == []
    assert D.clean(odd, table(spark, [])).count() == len(odd_rows)


def test_tiles_take_the_longest_first():
    item, doc = np.arange(12), np.array([0, 1, 2, 3, 4, 99, 2, 3, 4, 5, 6, 7, 8, 9])
    assert D.tiles(item, doc, 5) == [(2, 6, 8)]


def test_tiles_against_all_places():
    rng = random.Random(3)
    for _ in range(150):
        item, doc = ([rng.randrange(rng.choice([2, 4, 9])) for _ in range(rng.randrange(1, 50))] for _ in range(2))
        k = rng.randrange(1, 6)
        found = D.tiles(np.array(item), np.array(doc), k)
        assert sum(x[2] for x in found) == tiling(item, doc, k)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in found)


def test_tiles_do_not_rest_on_hashes(monkeypatch):
    monkeypatch.setattr(D, "_power_sums", lambda x, s, at: np.zeros(len(at), D.W.U))
    assert D.tiles(np.arange(12), np.array([0, 1, 2, 3, 4, 99, 2, 3, 4, 5, 6, 7, 8, 9]), 5) == [(2, 6, 8)]


def test_patterns_that_collide_in_polynomials_are_no_match(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    assert [r.doc_id for r in D.matches(frame(spark, [(1, word), (2, other)]), table(spark, [(5, word)])).collect()] == [1]


def test_a_seed_that_many_items_share(spark):
    """Items that share a passage with a long document, but not enough of it, are passed over before any place is looked up."""
    rng = random.Random(4)
    shared = "one two three four five"
    items = [(i, f"{shared} {words(rng, 30, 10**6)}") for i in range(300)]
    bench = D.Benchmark(items, D.MIN_MATCH, D.COVERAGE)
    raw = np.frombuffer((f"{shared} x " * 3000 + items[7][1]).encode(), np.uint8)
    assert [(x[0], x[1]) for x in bench.find(raw, np.array([0, len(raw)]))] == [(0, 7)]
