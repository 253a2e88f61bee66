"""SentencePiece BPE encoding with seeded merge-dropout, and its exact decoding.

Encoding keeps an agenda of candidate merges, best score first, then leftmost. A candidate that
comes up is skipped if a keyed hash of the seed, the document id, the segment and its place in the
text, the place in the segment and the piece falls below the dropout rate; it comes up again only if a neighbour changes. A rate of 0
gives the segmentation of the SentencePiece library. The segments of a slice run their
agendas in lockstep, as rows of arrays.

A text is cut into segments between characters that stand side by side in no piece, which no
merge can join, so that segments are independent. Each occurrence of a segment draws its own
skips. Each distinct segment is worked out without skips once a slice, with its merges noted; that
is the result of every occurrence that skips none of them, and only the others run their agendas.

Spaces become U+2581 after one is put in front of a text; characters without a piece, among them
U+2581 itself, are written as byte pieces. So decoding gives back every text exactly.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows
(same id and text) get the same ids; a null id is hashed as -1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

DROPOUT = 0.1
SEED = 20_240_601
SLICE_BYTES = 4 << 20
#: Longest segment that runs in lockstep; longer ones take a heap each.
LOCKSTEP = 48
#: Rows that run in lockstep at a time; bounds the working arrays.
ROWS = 1 << 16
_SPACE, _LITERAL = 0x2581, 0x110000  # U+2581, and the code that stands for it where the text itself has it
_NONE = np.int32(2**31 - 1)


class Pieces:
    """The tables of a SentencePiece BPE model with byte fallback, built once in each worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids = {names[i]: i for i in normal}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.char_id = np.full(_LITERAL + 1, -1, np.int32)
        # characters that occur in pieces without being one get numbers after the pieces'
        inner = sorted({c for p in ids for c in p if c not in ids})
        extra = {c: n + k for k, c in enumerate(inner)}
        for c, i in [*((c, i) for c, i in ids.items() if len(c) == 1), *extra.items()]:
            self.char_id[ord(c)] = i
        self.n = n
        self.extra = np.array([ord(c) for c in inner], np.int64)
        ranked = sorted({sp.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(ranked)}
        number = ids | extra
        joins = {}
        beside = set()
        for p, i in ids.items():
            beside.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    joins[number[p[:k]], number[p[k:]]] = (place[sp.get_score(i)], i)
        # an open-addressing table of (left, right) -> rank, merged piece
        self.bits = max(12, int(np.ceil(np.log2(max(len(joins), 1)))) + 3)
        size = 1 << self.bits
        self.key, self.rank, self.join = np.full(size, -1, np.int64), np.full(size, _NONE), np.full(size, -1, np.int32)
        key = np.array([(a << 24) | b for a, b in joins] or [0], np.int64)[: len(joins)]
        todo, slot = np.arange(len(key)), self._slot(key)
        values = np.array(list(joins.values()) or [(0, 0)], np.int32)[: len(joins)]
        self.probes = 1
        while len(todo):
            free = self.key[slot[todo]] < 0
            put, first = np.unique(slot[todo][free], return_index=True)
            won = todo[free][first]
            self.key[put], self.rank[put], self.join[put] = key[won], values[won, 0], values[won, 1]
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += bool(len(todo))
        # pairs of characters that some piece has side by side, as a table of hashes (a false hit only joins segments)
        self.beside = np.zeros(1 << 20, bool)
        if beside:
            a, b = (np.array([ord(x[k]) for x in beside], np.int64) for k in (0, 1))
            self.beside[self._pair(a, b)] = True
        known = set(normal)
        spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() if i in known else b"" for i, p in enumerate(names)]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(W.U) * W.U(0x9E3779B97F4A7C15)) >> W.U(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3B + b * 0x85EB5) & 0xFFFFF

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of symbols; _NONE where nothing joins them."""
        key = (left.astype(np.int64) << 24) | right
        key = np.where((left < 0) | (right < 0), -2, key)
        slot = self._slot(key)
        rank, join = self.rank[slot], self.join[slot]
        odd = np.flatnonzero(self.key[slot] != key)
        rank[odd] = _NONE
        for _ in range(self.probes):
            odd = odd[(self.key[slot[odd]] >= 0) & (key[odd] >= 0)]
            if not len(odd):
                break
            slot[odd] = (slot[odd] + 1) & (len(self.key) - 1)
            hit = self.key[slot[odd]] == key[odd]
            rank[odd[hit]], join[odd[hit]] = self.rank[slot[odd[hit]]], self.join[slot[odd[hit]]]
            odd = odd[~hit]
        return rank, join


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, limit: W.U) -> np.ndarray:
    return W.mix(key ^ W.mix(place.astype(W.U) * W.U(0x10001) + (piece.astype(W.U) << W.U(20)))) < limit


def _lockstep(p: Pieces, sym: np.ndarray, key: np.ndarray, limit: W.U) -> np.ndarray:
    """Runs the agendas of the rows of ``sym`` (padded with -2); returns symbols, -2 where one is merged away."""
    return _agendas(p, sym, key, limit, [])


def _agendas(p: Pieces, sym: np.ndarray, key: np.ndarray, limit: W.U, merges: list) -> np.ndarray:
    """The agendas in lockstep; (row, place, piece) of the merges go to ``merges``."""
    n, width = sym.shape
    if width < 2 or not n:
        return sym
    rank, join = np.full((n, width), _NONE), np.full((n, width), -1, np.int32)
    r, j = p.look(sym[:, :-1].ravel(), sym[:, 1:].ravel())
    rank[:, :-1], join[:, :-1] = r.reshape(n, -1), j.reshape(n, -1)
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    before = after - 2
    rows = np.arange(n)
    while len(rows):
        best = np.argmin(rank[rows], axis=1)
        some = rank[rows, best] < _NONE
        rows, best = rows[some], best[some]
        piece = join[rows, best]
        drop = _skipped(key[rows], best, piece, limit)
        rank[rows[drop], best[drop]] = _NONE
        row, i, piece = rows[~drop], best[~drop], piece[~drop]
        if not len(row):
            continue
        merges.append((row, i, piece))
        right = after[row, i]
        then = after[row, right]
        sym[row, i], sym[row, right] = piece, -2
        rank[row, right] = rank[row, i] = _NONE
        after[row, i] = then
        has = then < width
        before[row[has], then[has]] = i[has]
        a, b = row[has], i[has]
        rank[a, b], join[a, b] = p.look(piece[has], sym[a, then[has]])
        back = before[row, i]
        has = back >= 0
        a, b = row[has], back[has]
        rank[a, b], join[a, b] = p.look(sym[a, b], piece[has])
    return sym


def _heap(p: Pieces, sym: np.ndarray, key: W.U, limit: W.U) -> np.ndarray:
    """The same agenda for one long segment."""
    sym = sym.copy()
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank, join = p.look(sym[:-1], sym[1:])
    agenda = [(int(rank[i]), int(i), int(join[i]), int(sym[i]), int(sym[i + 1])) for i in np.flatnonzero(rank < _NONE)]
    heapq.heapify(agenda)
    one = np.array([key])
    while agenda:
        _, i, piece, left, right = heapq.heappop(agenda)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right or _skipped(one, np.array([i]), np.array([piece]), limit)[0]:
            continue
        sym[i], sym[j] = piece, -2
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                rank, join = p.look(sym[a : a + 1], sym[b : b + 1])
                if rank[0] < _NONE:
                    heapq.heappush(agenda, (int(rank[0]), int(a), int(join[0]), int(sym[a]), int(sym[b])))
    return sym


def _utf8(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points (n x 4) and how many of them count."""
    code = np.where(code == _LITERAL, _SPACE, code)
    n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    out = np.zeros((len(code), 4), np.uint8)
    for k in range(1, 5):
        at = np.flatnonzero(n == k)
        c = code[at]
        for i in range(k):
            tail = (c >> (6 * (k - 1 - i))) & (0x3F if i or k > 1 else 0x7F)
            lead = {1: 0, 2: 0xC0, 3: 0xE0, 4: 0xF0}[k]
            out[at, i] = (tail | 0x80) if i else (lead | ((c >> (6 * (k - 1))) & (0x7F >> (k - (k == 1)))))
    return out, n


def _ids(p: Pieces, sym: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols that are left (``code``: their first characters), and how many ids each symbol has."""
    bare = (sym < 0) | (sym >= p.n)
    many = np.ones(len(sym), np.int64)
    if not bare.any():
        return sym.astype(np.int32), many
    spelled, size = _utf8(code[bare].astype(np.int64))
    many[bare] = size
    out = np.empty(int(many.sum()), np.int32)
    first = np.cumsum(many) - many
    out[first[~bare]] = sym[~bare]
    out[W.ragged(first[bare], size)] = p.byte_id[spelled[np.arange(4) < size[:, None]]]
    return out, many


def encode(p: Pieces, texts: list[str], keys: np.ndarray, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in one array, and the number of ids of each text."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    code = np.frombuffer("".join([f" {t}" for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    code[code == _SPACE] = _LITERAL
    code[code == 32] = _SPACE
    edge = np.ones(len(code), bool)
    edge[1:] = ~p.beside[p._pair(code[:-1], code[1:])]
    begin = np.cumsum(sizes) - sizes
    edge[begin[sizes > 0]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(code))
    text = np.searchsorted(begin + sizes, start, "right")
    limit = W.U(min(int(dropout * 2.0**64), 2**64 - 1))
    own = W.symbol_hashes(code, start, end)
    key = W.mix(own ^ W.mix(W.mix(keys[text] ^ W.U(seed)) + (start - begin[text]).astype(W.U)))
    _, first, which = np.unique(own, return_index=True, return_inverse=True)
    pool, size, merges = _cut_segments(p, code, start[first], (end - start)[first], own[first], W.U(0))
    where = np.cumsum(size) - size
    if limit:
        again = np.flatnonzero(_any_skipped(which, key, len(first), (end - start)[first], merges, limit))
        more, n, _ = _cut_segments(p, code, start[again], (end - start)[again], key[again], limit)
        which[again] = len(first) + np.arange(len(again))
        where = np.concatenate((where, len(pool) + np.cumsum(n) - n))
        pool, size = np.concatenate((pool, more)), np.concatenate((size, n))
    n = size[which]
    return pool[W.ragged(where[which], n)], np.bincount(text, n, len(texts)).astype(np.int64)


def _any_skipped(which: np.ndarray, key: np.ndarray, kinds: int, length: np.ndarray, merges: list, limit: W.U) -> np.ndarray:
    """Whether an occurrence skips a merge of its segment's result without skips; long segments count as such."""
    kind, place, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*merges, strict=True)) or ((), (), ())))
    order = np.argsort(kind, kind="stable")
    place, piece = place[order], piece[order]
    count = np.bincount(kind, minlength=kinds)
    begin = np.cumsum(count) - count
    out = (length > LOCKSTEP)[which]
    for k in range(int(count.max(initial=0))):
        at = np.flatnonzero((count[which] > k) & ~out)
        m = begin[which[at]] + k
        out[at] = _skipped(key[at], place[m], piece[m], limit)
    return out


def _cut_segments(p: Pieces, code: np.ndarray, a: np.ndarray, length: np.ndarray, key: np.ndarray, limit: W.U) -> tuple[np.ndarray, np.ndarray, list]:
    """Ids and number of ids of segments; without skips also (segment, place, piece) of the merges up to LOCKSTEP characters."""
    parts, counts, owners, merges = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    edges = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, LOCKSTEP]
    group = np.searchsorted(edges, length)
    for g, width in enumerate(edges):
        every = np.flatnonzero(group == g)
        for mine in np.split(every, range(ROWS, len(every), ROWS)) if len(every) else ():
            at = a[mine][:, None] + np.arange(width)
            real = np.arange(width) < length[mine][:, None]
            chars = code[np.minimum(at, len(code) - 1)]
            sym = np.where(real, p.char_id[chars], np.int32(-2))
            if limit:
                sym = _lockstep(p, sym, key[mine], limit)
            else:
                met: list = []
                sym = _agendas(p, sym, key[mine], limit, met)
                merges += [(mine[row], place, piece) for row, place, piece in met]
            left = real & (sym != -2)
            got, many = _ids(p, sym[left], chars[left])
            row = np.nonzero(left)[0]
            parts.append(got)
            counts.append(np.bincount(row, many, len(mine)).astype(np.int64))
            owners.append(mine)
    for k in np.flatnonzero(group == len(edges)):
        chars = code[a[k] : a[k] + length[k]]
        sym = _heap(p, p.char_id[chars], key[k], limit)
        got, many = _ids(p, sym[sym != -2], chars[sym != -2])
        parts.append(got)
        counts.append(np.array([len(got)]))
        owners.append(np.array([k]))
    pool, count, owner = (np.concatenate(x) for x in (parts, counts, owners))
    size, where = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
    size[owner], where[owner] = count, np.cumsum(count) - count
    return pool[W.ragged(where, size)], size, merges


def decode(p: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, without the space put in front, and their sizes."""
    size = p.size[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    ends = np.cumsum(counts)
    raw = p.blob[W.ragged(p.start[ids], size)]
    sizes = total[ends] - total[ends - counts]
    if len(raw):
        raw = np.delete(raw, total[(ends - counts)[counts > 0]])
    return raw, np.maximum(sizes - 1, 0)


_built: dict[int, Pieces] = {}


def _pieces(held) -> Pieces:
    key = hash(held.value)
    if key not in _built:
        _built.clear()
        _built[key] = Pieces(held.value)
    return _built[key]


def _cut(batches: Iterator[pa.RecordBatch], column: str, bytes_each: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) * bytes_each
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _as_list(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(ids, pa.int32()))


def _model(docs: DataFrame, path: str):
    """The model file (half a MB, fixed) is read on the driver and broadcast."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of every document; ``lossless`` says that decoding the ids gives the text back."""
    from .common import buffers, slices, texts

    held = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(held)
        for batch in slices(batches, "text", SLICE_BYTES):
            keys = batch.column("id").fill_null(-1).to_numpy().astype(np.int64).view(W.U)
            ids, counts = encode(p, [t or "" for t in batch.column("text").to_pylist()], W.mix(keys), dropout, seed)
            raw, offsets = buffers(batch.column("text"))
            back, sizes = decode(p, ids, counts)
            same = sizes == np.diff(offsets)
            if same.all() and not np.array_equal(back, raw):
                same = np.array([np.array_equal(back[x:y], raw[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), _as_list(ids, counts), pa.array(counts), pa.array(same)], ["doc_id", "ids", "n_tokens", "lossless"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, lossless boolean")


def decoded(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids decode to the empty text."""
    held = _model(rows, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(held)
        for batch in _cut(batches, "ids", 4, SLICE_BYTES):
            column = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, sizes = decode(p, column.flatten().to_numpy(zero_copy_only=False), counts)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes()))], ["doc_id", "text"])

    return rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
