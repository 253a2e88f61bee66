import random

import numpy as np
import pytest
import sentencepiece
from conftest import frame, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import piece_dropout as P
from tessera.llm import words as W
from tessera.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
with open(MODEL, "rb") as f:
    PIECES, LIBRARY = P.Pieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encode(texts, **options):
    ids, counts = P.encode(PIECES, texts, W.mix(np.arange(len(texts), dtype=W.U)), **options)
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def decode(rows):
    ids, counts = np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows], np.int64)
    raw, sizes = P.decode(PIECES, ids, counts)
    ends = np.cumsum(sizes)
    return [raw[e - n : e].tobytes().decode() for e, n in zip(ends, sizes, strict=True)]


TEXTS = ["", " ", "  a  b\n\tc ", "\U0001F600 hi é ñ 漢字", "x" * 300, "hello world " * 30, "tokenization, isn't it? 12345", "\x00\x01", "<s> </s> <0x41>"]


def test_no_dropout_is_the_library():
    rng = random.Random(1)
    texts = TEXTS + [words(rng, 50) for _ in range(5)] + ["".join(rng.choice("aeéß tnr\n.,▂") for _ in range(200)) for _ in range(20)]
    assert encode(texts, dropout=0.0) == [LIBRARY.encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_round_trip(texts, dropout):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert decode(encode(texts, dropout=dropout)) == texts


def test_the_space_mark_itself_survives():
    assert decode(encode(["x▁y ▁▁ z"], dropout=0.1)) == ["x▁y ▁▁ z"]


def test_seeded_and_varied():
    text = "The quick brown fox jumps over the lazy dog. " * 20
    a, b, c = encode([text], dropout=0.3, seed=1), encode([text], dropout=0.3, seed=1), encode([text], dropout=0.3, seed=2)
    assert a == b != c and len(a[0]) > len(LIBRARY.encode(text))
    assert len({tuple(x) for x in encode([text] * 4, dropout=0.3)}) == 4  # by document
    assert encode([text], dropout=1.0) == [[i for ch in " " + text for i in [PIECES.char_id[ord("▁" if ch == " " else ch)]]]]


def test_every_occurrence_draws_its_own_skips(monkeypatch):
    """A word of several merges is varied at the rate, and an occurrence's result is its own agenda's."""
    word = " internationalization"
    cut = {tuple(r) for r in encode([word] * 3000, dropout=0.1)}
    assert len(cut) > 20
    plain = encode(["a"], dropout=0.0)[0]  # one merge, of the space and the letter
    assert len(plain) == 1 and abs(np.mean([r != plain for r in encode(["a"] * 20_000, dropout=0.1)]) - 0.1) < 0.01
    texts = [word * 3, " the cat sat", "a" * 100] * 20
    before = encode(texts, dropout=0.1)
    monkeypatch.setattr(P, "_any_skipped", lambda which, *_: np.ones(len(which), bool))  # all agendas run
    assert encode(texts, dropout=0.1) == before


@pytest.mark.parametrize("dropout", [0.0, 0.2, 0.7])
def test_lockstep_and_heap_agree(dropout, monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, 40), "a" * 30 + "thethethe" * 4, "internationalization " * 5]
    before = encode(texts, dropout=dropout)

    def alone(p, sym, key, limit):
        out = sym.copy()
        for i in range(len(sym)):
            n = int((sym[i] != -2).sum())
            out[i, :n] = P._heap(p, sym[i, :n], key[i], limit)
        return out

    monkeypatch.setattr(P, "_lockstep", alone)
    assert encode(texts, dropout=dropout) == before


def agenda(text, key, dropout, seed=P.SEED):
    """The same by the definition: strings, and at each step a look at all candidates."""
    names = {LIBRARY.id_to_piece(i): i for i in range(LIBRARY.get_piece_size()) if not (LIBRARY.is_control(i) or LIBRARY.is_unknown(i) or LIBRARY.is_byte(i))}
    score = {p: LIBRARY.get_score(i) for p, i in names.items()}
    chars = "\u2581" + text.replace(" ", "\u2581")
    cuts = [0, *(i for i in range(1, len(chars)) if not PIECES.beside[PIECES._pair(np.array([ord(chars[i - 1])]), np.array([ord(chars[i])]))[0]]), len(chars)]
    limit, out = int(dropout * 2.0**64), []
    for a, b in zip(cuts, cuts[1:]):
        code = np.array([ord(c) for c in chars[a:b]], np.int64)
        own = W.symbol_hashes(code, np.array([0]), np.array([b - a]))
        mine = W.mix(own ^ W.mix(W.mix(np.array([key]) ^ W.U(seed)) + W.U(a)))
        parts, skipped = [(i, c) for i, c in enumerate(chars[a:b])], set()
        while True:
            some = [(-score[x + y], i, x + y, n) for n, ((i, x), (_, y)) in enumerate(zip(parts, parts[1:])) if x + y in names and (i, x, y) not in skipped]
            if not some:
                break
            _, i, piece, n = min(some)
            skip = W.mix(mine ^ W.mix(np.array([i * 0x10001 + (names[piece] << 20)], W.U)))[0]
            if int(skip) < limit:
                skipped.add((i, parts[n][1], parts[n + 1][1]))
            else:
                parts[n : n + 2] = [(i, piece)]
        for _, c in parts:
            out += [names[c]] if c in names else [int(PIECES.byte_id[x]) for x in c.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.9])
def test_against_a_plain_agenda(dropout):
    rng = random.Random(6)
    texts = [words(rng, 15), "the internationalization of tokenization, isn't it? 12345", "aaaa" * 20, "\u00e9\u00df\U0001F600 hi  there\n" * 3, "thethethethe and then"]
    keys = W.mix(np.arange(len(texts), dtype=W.U))
    assert encode(texts, dropout=dropout) == [agenda(t, k, dropout) for t, k in zip(texts, keys)]


def test_frames(spark, odd, clashing, empty, odd_rows):
    got = P.encoded(odd, MODEL)
    rows = got.collect()
    assert all(r.lossless and len(r.ids) == r.n_tokens for r in rows) and len(rows) == len(odd_rows)
    assert sorted(map(str, rows)) == sorted(map(str, P.encoded(clashing, MODEL).collect()))
    back = sorted(((r.doc_id, r.text) for r in P.decoded(got, MODEL).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in odd_rows), key=str)
    assert P.encoded(empty, MODEL).collect() == []
    assert [r.text for r in P.decoded(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), MODEL).collect()] == [""]
    assert P.encoded(frame(spark, [(1, "a b")]), MODEL, dropout=0.0).first().ids == LIBRARY.encode("a b")
