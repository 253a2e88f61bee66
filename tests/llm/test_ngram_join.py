import random
import re

import pytest
from conftest import edited, frame, words

from tessera.llm import ngram_join as J


def shingles(text, k):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def expected(rows, k=J.SHINGLE, percent=J.PERCENT):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if doc is not None:
            ids.append(doc)
    return sorted(((doc, len(sets[i]), min(least[find(i)], default=None)) for i, (doc, _) in enumerate(rows)), key=str)


def run(docs, **options):
    return sorted(map(tuple, J.clusters(docs, **options).collect()), key=str)


def corpus(seed):
    """Groups around the threshold, of sizes from one shingle on, with a passage that many share."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    out = []
    for size in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 15, 20, 30, 50, 80, 120, 300):
        base = words(rng, size)
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05):
            out.append(edited(rng, base, share))
        out += [base + " w1", base + " w1 w2 w3", base + " " + passage, words(rng, size) + " " + passage, base.upper()]
    hot = words(rng, 150)
    out += [edited(rng, hot, 0.012) for _ in range(60)]
    out += [passage + " " + words(rng, rng.randrange(1, 40)) for _ in range(40)]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {}), (3, {"k": 5, "percent": 80}), (4, {"k": 2, "percent": 60})])
def test_components_against_all_pairs(spark, seed, options):
    rows = corpus(seed)
    assert run(frame(spark, rows).repartition(6), **options) == expected(rows, **options)


def test_small_cells_and_full_filters(spark, monkeypatch):
    """Long lists are cut into cells, and a filter that lets everything pass changes nothing."""
    monkeypatch.setattr(J, "CELL", 7)
    monkeypatch.setattr(J, "passes", lambda table, keys: keys == keys)
    rows = corpus(7)
    assert run(frame(spark, rows)) == expected(rows)


@pytest.mark.parametrize(("chunk", "cell"), [(3, 2048), (3, 7), (20, 4)])
def test_long_lists_are_dealt_in_chunks(spark, monkeypatch, chunk, cell):
    """Near copies and a shared passage, whose lists fall in chunks and whose lists of two chunks fall in cells."""
    monkeypatch.setattr(J, "CHUNK_ENTRIES", chunk)
    monkeypatch.setattr(J, "CELL", cell)
    most, chunks = [], J._chunks
    monkeypatch.setattr(J, "_chunks", lambda load: most.append(chunks(load).max()) or chunks(load))
    rows = corpus(13)
    assert run(frame(spark, rows).repartition(4)) == expected(rows)
    assert most[0] > 2


def test_two_sets_of_a_list_meet_in_one_list():
    import numpy as np

    rng = np.random.default_rng(5)
    h = rng.integers(1, 1 << 63, 40, dtype=np.uint64)
    key = np.where(np.arange(40) < 30, np.uint64(77), np.uint64(78))
    chunks = np.where(key == 77, 5, 1)
    met, buckets = {}, {}
    for at, bucket, named, side in J._dealt(key, h, chunks, 10):
        for i, b, k, s in zip(at.tolist(), bucket.tolist(), named.tolist(), side.tolist(), strict=True):
            met.setdefault(k, []).append((i, s))
            buckets.setdefault(k, set()).add(b)
    pairs = [(i, j) for m in met.values() for i, s in m for j, t in m if i < j and (s != t or s == 2)]
    assert sorted(pairs) == [(i, j) for i in range(40) for j in range(i + 1, 40) if key[i] == key[j]]
    assert len(met) == 16 and all(len(b) == 1 for b in buckets.values())
    assert max(max(b) for k, b in buckets.items() if k == 78) < 10 <= min(min(b) for k, b in buckets.items() if k != 78)
    assert all(k >> 58 == 0 for k in met)


@pytest.mark.parametrize("heavy_from", [2, 10, 40, 1000])
def test_any_boundary_gives_the_same(spark, monkeypatch, heavy_from):
    monkeypatch.setattr(J, "boundary", lambda *a: heavy_from)
    rows = [(i, t) for i, t in corpus(5) if len(t.split()) < 60]
    assert run(frame(spark, rows)) == expected(rows)


def test_odd_rows_clashing_columns_and_empty_table(spark, odd, clashing, empty, odd_rows):
    assert run(odd) == expected(odd_rows) == run(clashing)
    assert run(empty) == []


def kept(rows, k=J.SHINGLE, percent=J.PERCENT):
    """Rows that stay: of each group the least by id (null last) and text's hash, whichever repeats; all rows without words."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = [r for r, s in zip(rows, sets) if not s]
    groups = {}
    for i, r in enumerate(rows):
        if sets[i]:
            groups.setdefault(find(i), []).append(r)
    return out, list(groups.values())


@pytest.mark.parametrize("case", ["odd", "seven", "corpus"])
def test_distinct_keeps_one_row_of_each_group(spark, clashing, odd_rows, case):
    a = "some words that stand here more than once in a row"
    seven = [(1, a), (7, a), (7, "unrelated text under the same id"), (None, a), (None, "another text without an id"), (9, "x"), (9, "y z")]
    rows = {"odd": odd_rows, "seven": seven, "corpus": [(i % 50, t) for i, t in corpus(11)]}[case]
    docs = clashing if case == "odd" else frame(spark, rows).repartition(3)
    got = J.distinct(docs)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    alone, groups = kept(rows)
    for r in alone:
        left.remove(r)
    for g in groups:
        least = min((i is None, i or 0) for i, _ in g)
        mine = [r for r in left if r in g]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least
        left.remove(mine[0])
    assert left == []
    if case == "seven":
        assert {(r.doc_id, r.text) for r in got.collect()} == {seven[0], seven[2], seven[4], seven[5], seven[6]}


def test_unlike_words_of_a_pattern_stay_apart(spark):
    """A pattern and its complement, which polynomial hashes take for one word."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    assert run(frame(spark, [(1, word), (2, other), (3, word)])) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_shingles_of_bytes():
    for t in ("", " \x0b\t", "One", "a B\x0cc\x85d É e f", "x\x1cy z\x00 w v u"):
        assert J.shingles(t.encode(), 4) == {b" ".join(s) for s in shingles(t, 4)}


def test_boundary_follows_the_cost():
    import numpy as np

    few, many = np.full(1 << J.SKETCH, 1), np.full(1 << J.SKETCH, 1)
    many[:64] = 10**6
    sizes = {n: 100 for n in range(1, 200)}
    assert J.boundary(sizes, few, 85) < J.boundary(sizes, many, 85)
