"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and of non-ASCII bytes, with A-Z as a-z. Seeds are
hashes of ``min_match`` successive words (all the words of a shorter item). A document and an
item whose shared seeds could cover enough of the item are a candidate pair; occurrences are only
looked up for these. Their words are numbered by their bytes, so that nothing below rests on a
hash of words.

The tiling runs Karp-Rabin again and again, with shorter and shorter strings: all runs of s
unmarked words of both are hashed by sums of powers, equal ones are joined to matches as long as
they go, compared word by word, and marked longest first; what overlaps a marked place is cut and
waits its turn. Then s is halved, down to ``min_match``. Ties go to the earlier place in the item,
then in the document. The share of the item's words that is marked is its coverage, whatever the
order in which its passages stand in the document.

Defined results: a null or empty text matches nothing; an item that is null or has no words is
never found; repeated rows are judged each by itself; null ids are carried as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import buffers, slices, texts

MIN_MATCH = 5
COVERAGE = 0.8
#: Bytes of benchmark text that one pass over the documents holds; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 4 << 20
MATCHES = "doc_id bigint, item_id bigint, coverage double, matched_words int, item_words int, n_tiles int"


def _power_sums(x: np.ndarray, s: int, at: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of the runs of s numbers that begin at the places."""
    power, inverse = W.powers(len(x) + 1)
    total = np.concatenate((np.zeros(1, W.U), np.cumsum(W.mix(x.astype(W.U) + W.U(1)) * power[: len(x)])))
    return (total[at + s] - total[at]) * inverse[at]


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    """Places from which s numbers are unmarked."""
    if len(marked) < s:
        return np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[s:] == total[:-s])


def _same_runs(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least:
            yield a, b - a


def tiles(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two rows of numbers: (place in item, place in document, length)."""
    in_item, in_doc, found = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    s = k
    while 2 * s <= min(len(item), len(doc)):
        s *= 2
    while s >= k:
        p, t = _free(in_item, s), _free(in_doc, s)
        if len(p) and len(t):
            own, other = _power_sums(item, s, p), _power_sums(doc, s, t)
            order = np.argsort(own, kind="stable")
            low, high = (np.searchsorted(own[order], other, side) for side in ("left", "right"))
            p, t = p[order[W.ragged(low, high - low)]], np.repeat(t, high - low)
            order = np.lexsort((p, t - p))
            p, t = p[order], t[order]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(t) != 1)))) if len(p) else p
            n = np.diff(np.append(first, len(p))) + s - 1
            agenda = []
            for i, j, size in zip(p[first].tolist(), t[first].tolist(), n.tolist(), strict=True):
                agenda += [(-m, i + a, j + a) for a, m in _same_runs(item[i : i + size] == doc[j : j + size], s)]
            heapq.heapify(agenda)
            while agenda:
                n, i, j = heapq.heappop(agenda)
                free = ~(in_item[i : i - n] | in_doc[j : j - n])
                if free.all():
                    in_item[i : i - n] = in_doc[j : j - n] = True
                    found.append((i, j, -n))
                else:
                    for a, m in _same_runs(free, s):
                        heapq.heappush(agenda, (-m, i + a, j + a))
        s = s // 2 if s > k else 0
    return found


def _cut(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    low = W.lower_table()[raw].tobytes()
    return [low[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Benchmark:
    """A block of benchmark items with its seed index; its size is bounded by BLOCK_BYTES."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int, coverage: float):
        self.coverage, self.ids, self.words, seeds = coverage, [], [], {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            start, end, of = W.spans(raw, np.array([0, len(raw)]), W.not_alphanumeric())
            if not len(start):
                continue
            k = min(min_match, len(start))
            got, at = W.grams(W.hashes(raw, start, end), of, k)
            seeds.setdefault(k, []).append((got, np.full(len(got), len(self.ids)), at))
            self.ids.append(item_id)
            self.words.append(_cut(raw, start, end))
        self.seeds = {}
        for k, parts in seeds.items():
            got, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(got, kind="stable")
            self.seeds[k] = got[order], item[order].astype(np.int32), at[order].astype(np.int32)

    def _candidates(self, text: np.ndarray, gram: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """Texts and items whose shared seeds could cover enough of the item; each seed of a text counts once."""
        got, item, at = self.seeds[k]
        low = np.searchsorted(got, gram, "left")
        hit = np.flatnonzero(got[np.minimum(low, len(got) - 1)] == gram)
        order = hit[np.lexsort((gram[hit], text[hit]))]
        first = np.ones(len(order), bool)
        first[1:] = (text[order[1:]] != text[order[:-1]]) | (gram[order[1:]] != gram[order[:-1]])
        hit = order[first]
        border = np.flatnonzero(np.concatenate(([True], np.diff(text[hit]) != 0, [True]))) if len(hit) else []
        for x, y in zip(border[:-1], border[1:], strict=True):
            mine = hit[x:y]
            n = np.searchsorted(got, gram[mine], "right") - low[mine]
            seed = W.ragged(low[mine], n)
            which, spot = item[seed], at[seed]
            order = np.argsort(which, kind="stable")
            which, spot = which[order], spot[order]
            edge = np.flatnonzero(np.concatenate(([True], np.diff(which) != 0, [True])))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                size = len(self.words[which[a]])
                if k * (b - a) < self.coverage * size - 1e-9:
                    continue
                reach = np.zeros(size + 1, np.int64)
                np.add.at(reach, spot[a:b], 1)
                np.add.at(reach, spot[a:b] + k, -1)
                if np.count_nonzero(np.cumsum(reach)) >= self.coverage * size - 1e-9:
                    yield int(text[mine[0]]), int(which[a])

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text index, item index, coverage, marked words, tiles) at the coverage or above."""
        start, end, of = W.spans(raw, offsets, W.not_alphanumeric())
        word = W.hashes(raw, start, end)
        last, number, doc = -1, {}, np.zeros(0, np.int64)
        for k in self.seeds:
            gram, first = W.grams(word, of, k)
            for text, which in self._candidates(of[first], gram, k):
                if text != last:
                    lo, hi = np.searchsorted(of, text, "left"), np.searchsorted(of, text, "right")
                    a = int(offsets[text])
                    last, number = text, {}
                    doc = np.array([number.setdefault(w, len(number)) for w in _cut(raw[a : int(offsets[text + 1])], start[lo:hi] - a, end[lo:hi] - a)])
                item = np.array([number.get(w, -1) for w in self.words[which]])
                found = tiles(item, doc, k)
                marked = sum(x[2] for x in found)
                if marked >= self.coverage * len(item) - 1e-9:
                    yield text, which, marked / len(item), marked, len(found)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items in blocks of a bounded size; one block unless the benchmark is larger than that."""
    items = texts(benchmark, item_col, text_col)
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r.id, r.text) for r in part.collect()]


def _finder(held: Broadcast) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("item_words", pa.int32()), ("n_tiles", pa.int32())])

    def run(batches):
        bench = held.value
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = batch.column("id")
            rows = [(ids[i].as_py(), bench.ids[j], share, marked, len(bench.words[j]), n) for i, j, share, marked, n in bench.find(*buffers(batch.column("text")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, item_words, n_tiles) of each contaminated pair.

    The documents are never shuffled: each block of the benchmark goes over them in one map pass.
    """
    out = None
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        found = texts(docs, id_col, text_col).mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(Benchmark(items, min_match, coverage))), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no item at the coverage or above."""
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Benchmark(items, min_match, coverage))

        def run(batches, held=held):
            bench = held.value
            for batch in slices(batches, text_col, SLICE_BYTES):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in bench.find(*buffers(batch.column(text_col)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
