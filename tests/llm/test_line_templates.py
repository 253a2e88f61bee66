import collections
import random
import re

import pytest
from conftest import frame, words

from tessera.llm import line_templates as L

TOKEN = re.compile(rb"[^\x20\x09-\x0d]+")


def expected(rows, min_docs, similarity=L.SIMILARITY, depth=L.DEPTH):
    """Per row (id, text, lines, dropped) of documents with distinct ids, by whole-corpus dictionaries."""
    lines = []
    for i, t in rows:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            tokens = tuple("<*>" if re.search(rb"[0-9]", x) else x for x in TOKEN.findall(line))
            if tokens:
                lines.append((i, k, tokens))
    leaves = collections.defaultdict(list)
    for x in lines:
        leaves[len(x[2]), x[2][:depth]].append(x)
    template = {}
    for leaf, members in leaves.items():
        docs = collections.defaultdict(set)
        for i, _, t in members:
            docs[t].add(i)
        if len({x[0] for x in members}) < min_docs:
            continue
        general = set()
        if len(docs) > 1:
            constant = {}
            total = sum(map(len, docs.values()))
            for p in range(depth, leaf[0]):
                votes = collections.Counter()
                for t, d in docs.items():
                    votes[t[p]] += len(d)
                token, n = votes.most_common(1)[0]
                if 2 * n > total:
                    constant[p] = token
            general = {t for t in docs if sum(t[p] == c for p, c in constant.items()) >= similarity * (leaf[0] - depth)} if leaf[0] > depth else set()
        for i, k, t in members:
            template[i, k] = ("leaf", leaf) if t in general else ("line", t)
    places = collections.defaultdict(list)
    for place, t in template.items():
        places[t].append(place)
    drop = set()
    for found in places.values():
        if len({i for i, _ in found}) >= min_docs:
            drop |= set(found) - {min(found)}
    return sorted((i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in drop), (t or "").count("\n") + 1 if t else 0, sum((i, k) in drop for k in range((t or "").count("\n") + 1))) for i, t in rows)


def corpus(seed):
    rng = random.Random(seed)
    boiler = [words(rng, n) for n in (1, 3, 6, 20)]
    out = []
    for i in range(60):
        lines = [words(rng, rng.randrange(1, 12), 30) for _ in range(rng.randrange(0, 8))]
        lines += rng.sample(boiler, rng.randrange(0, 3))
        lines += [f"page {rng.randrange(99)} of {rng.randrange(99)} of this long report", f"user logged in from host {rng.choice('abcdefgh')}{rng.choice('xyz')} by the console", ""]
        rng.shuffle(lines)
        out.append((i, "\n".join(lines) + rng.choice(["", "\n"])))
    return out


def run(docs, **options):
    return sorted(map(tuple, L.deduplicated(docs, **options).collect()), key=str)


@pytest.mark.parametrize(("seed", "min_docs"), [(1, 2), (2, 5), (3, 10)])
def test_against_dictionaries(spark, seed, min_docs):
    rows = corpus(seed)
    got = run(frame(spark, rows).repartition(7), min_docs=min_docs)
    assert got == sorted(expected(rows, min_docs), key=str)
    assert any(r[3] for r in got)


@pytest.mark.parametrize("sizes", [(300, 200), (60, 60, 60, 60)])
def test_several_templates_in_a_leaf(spark, sizes):
    """One template after the other where one has the majority, and by a split where none has."""
    letters = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    ends = ["finished without any errors", "crashed after missing heartbeat", "waited for some disk", "restarted by its owner"]
    hot = [(10**6 + k, "the job on node master was never seen again") for k in range(700)]
    for more in ([], hot):
        rows = [(1000 * t + k, f"the job on node {letters(1000 * t + k)} {ends[t]}") for t, n in enumerate(sizes) for k in range(n)]
        got = run(frame(spark, rows + more).repartition(5))
        assert sum(r[3] for r in got) == sum(n - 1 for n in sizes) + max(0, len(more) - 1)
        assert {r[0] for r in got if not r[3]} == {1000 * t for t in range(len(sizes))} | {i for i, _ in more[:1]}


def test_leading_tokens_do_not_make_lines_alike(spark):
    """Lines that share little behind the leading tokens are no template, however few tokens follow."""
    verbs = "sang swam left slept wept lied won lost knew grew flew ran".split()
    assert not any(r[3] for r in run(frame(spark, [(i, f"He said that he {v}") for i, v in enumerate(verbs)])))


def test_patterns_that_collide_in_polynomials_stay_apart(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    got = run(frame(spark, [(i, word if i % 2 else other) for i in range(18)]))
    assert not any(r[3] for r in got)  # nine documents each


@pytest.mark.parametrize("tokens", [0, 300])
def test_votes_of_large_parts_and_salted_joins_change_nothing(spark, monkeypatch, tokens):
    rows = corpus(4)[:30]
    before = run(frame(spark, rows), min_docs=3)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "LOCAL_TOKENS", tokens)
    assert run(frame(spark, rows), min_docs=3) == before


def test_odd_rows(odd, clashing, odd_rows):
    got = run(odd, min_docs=2)
    assert got == run(clashing, min_docs=2) and len(got) == len(odd_rows)
    by = collections.Counter((r[0], r[1]) for r in got)
    assert by[6, "same row twice here"] == 2  # one document that stands there twice
    assert by[9, odd_rows[12][1]] == 1 and by[10, ""] == 1  # of two documents with one line, the first keeps it


def test_empty_table(empty):
    assert run(empty) == [] and L.cleaned(empty).collect() == []


def test_cleaned_keeps_columns_and_drops_emptied_documents(clashing):
    got = L.cleaned(clashing, min_docs=2)
    assert got.columns == clashing.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert 10 not in ids and 9 in ids and ids.count(6) == 2 and ids.count(None) == 2
