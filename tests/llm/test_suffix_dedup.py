import hashlib
import random

import numpy as np
import pytest
from conftest import frame, words

from tessera.llm import suffix_dedup as S
from tessera.llm import words as W


def expected(docs):
    """(bytes, removed, spans, hash) of texts in order, by a set of all windows."""
    seen, out = set(), []
    for text in docs:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if window in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(window)
        mask = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        out.append((len(raw), int(mask.sum()), int((mask & ~np.concatenate(([False], mask[:-1]))[: len(mask)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage, long = words(rng, 60), words(rng, 400)
    out = []
    for _ in range(60):
        kind = rng.randrange(7)
        own = words(rng, rng.randrange(5, 80))
        out.append([own, own + " " + passage, passage[: rng.randrange(90, 200)] + own, long, long[rng.randrange(50) :] + own, "ab" * rng.randrange(30, 300), own[:50] + "é" * rng.randrange(40, 120) + passage[7:]][kind])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 3000)
    docs = corpus(seed)
    got = sorted(map(tuple, S.digests(frame(spark, list(enumerate(docs))).repartition(5)).collect()))
    assert got == [(i, *x) for i, x in enumerate(expected(docs))]


def test_hot_tokens_are_dealt_by_content(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 500)
    rng = random.Random(9)
    passage = words(rng, 30)
    docs = [words(rng, 12) + " " + passage + " " + words(rng, 12) for _ in range(80)] + ["-" * 500] * 4
    got = sorted(map(tuple, S.digests(frame(spark, list(enumerate(docs))).repartition(3)).collect()))
    assert got == [(i, *x) for i, x in enumerate(expected(docs))]


def test_odd_rows(odd, clashing, odd_rows):
    """Rows that repeat id and text are one document; others go by id, then by their text's hash; null ids last."""
    got = S.digests(odd).collect()
    assert sorted(map(str, got)) == sorted(map(str, S.digests(clashing).collect()))
    assert len(got) == len(odd_rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    size = len(odd_rows[12][1])
    assert by[9, size].n_removed == 0 and by[10, size].n_removed == size and by[10, size].n_spans == 1
    assert by[11, 5000].n_removed == 4999 and by[1, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.n_removed for r in got if r.doc_id == 6] == [0, 0]


def test_empty_table_and_kept_bytes(spark, empty):
    assert S.digests(empty).collect() == []
    text = "".join(chr(0x400 + i) for i in range(60))
    got = {r.doc_id: bytes(r.kept) for r in S.kept(frame(spark, [(1, text), (2, "x" + text + "y")])).collect()}
    assert got == {1: text.encode(), 2: b"xy"}  # all windows of the first are the second's too


def test_multikey_quicksort_depths():
    strings = [b"aaaaaaaabbbbbbbbcccccccc", b"aaaaaaaabbbbbbbbdddddddd", b"aaaaaaaaxxxxxxxxcccccccc", b"zzzzzzzzbbbbbbbbcccccccc", b"aaaaaaaabbbbbbbbcccccccc"]
    table = np.array([np.frombuffer(s, ">u8") for s in strings]).astype(W.U)
    assert S.multikey(lambda d, live: table[live, d], 5, 3).tolist() == [3, 2, 1, 0, 3]


def test_plan_follows_the_size():
    """Splitters and sample grow with the text up to their bound, buckets never, and the share of sampled rows is never zero."""
    for n, size in ((0, 0), (10, 10**4), (10**6, 5 * 10**8), (5 * 10**9, 10**14), (10**12, 10**16)):
        ranges, per_range, wanted, below = S.plan(n, size)
        assert ranges * per_range * S.BUCKET_BYTES >= size and ranges <= S.MOST_SPLITTERS + 1
        assert wanted >= ranges and (below + 2**63) / 2**64 * max(n, 1) >= min(wanted, n) * 0.99
    assert S.plan(5 * 10**9, 10**14)[0] == S.MOST_SPLITTERS + 1


def test_several_buckets_a_range(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 300)
    monkeypatch.setattr(S, "MOST_SPLITTERS", 3)
    docs = corpus(5)
    got = sorted(map(tuple, S.digests(frame(spark, list(enumerate(docs))).repartition(3)).collect()))
    assert got == [(i, *x) for i, x in enumerate(expected(docs))]


@pytest.mark.parametrize("runs", [False, True])
def test_unlike_spans_of_one_hash_are_told_apart(runs):
    data = np.frombuffer(b"abcabdabcabcabd", np.uint8)
    start = np.arange(0, 13) if runs else np.arange(0, 15, 3)
    size = np.full(len(start), 3)
    want = [next(j for j in range(i + 1) if data[start[j] : start[j] + 3].tobytes() == data[start[i] : start[i] + 3].tobytes()) for i in range(len(start))]
    for key in (np.zeros(len(start), W.U), W.rolled(data, start, start + 3), W.hashes(data, start, start + 3)):
        assert S.first_of(data, start, size, key, runs).tolist() == want
