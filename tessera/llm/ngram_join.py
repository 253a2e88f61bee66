"""Exact Jaccard self-join of word n-gram sets: a size-aware heavy-light join.

Texts become sets of hashed shingles (``k`` words; a shorter text is one shingle). Equal sets are
one class from the start. Shingles are ordered by how often they occur, rare ones first: a count
sketch over the sets of all documents (equal sets of a slice of the input count once, as they do in
the lists) gives each shingle the logarithm of its bin's load. Sets with similarity
of ``percent`` or more then share shingles within their rarest few (the prefix).

* Light sets (below the boundary) enumerate the subsets of two shingles of their prefix; equal
  subsets meet.
* Heavy sets enter the inverted lists of the single shingles of their prefix, which are scanned.
  Light sets near the boundary enter them too, to meet heavy ones.
* The boundary is the one of least estimated cost: subsets enumerated against list entries
  scanned, from the sizes of all sets and the sketch's expected list length. It is looked for up
  to ``MOST_LIGHT``, from where on the subsets of a set outgrow its text; any boundary gives the
  same links.

A list that the sketch shows to be long is dealt in parts: its sets fall in m chunks, and each two
chunks, and each chunk by itself, are a list of their own, so that no task sorts more than two
chunks. Lists are cut into cells of a bounded number of sets by size, and only cells of compatible
sizes are compared. Cells of the same sets are one. A pair of a cell
is compared by size and by a parity sketch (one bit an element or more): the number of bits that
differ never exceeds the symmetric difference, so nothing similar is lost. Each set carries the
first few of its cells in a common order; a pair that two sets' lists show to meet in an earlier
cell is left to it. Pairs that pass are compared
on the words of their texts, not on hashes. First each set only proposes its first such partner of a cell; once these
links are checked, all pairs of a cell whose components still differ are checked, and no others.
Equal sets are told by 64-bit hashes of their shingles' hashes: among a billion distinct sets the
chance that any two are taken for one is 3 %.

Defined results: null or wordless texts have no set and link with nothing; repeated rows link with
each other; a null id has a set like any other, but never names a component unless all ids of it
are null; an empty table gives an empty result. ``distinct`` keeps one row of each group (the
least id, then the least hash of the text; nulls last) and all rows that link with nothing; rows
that repeat an id are rows of their own, and of rows that repeat id and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import buffers, checkpoint, fresh, key_filter, partitions, passes, slices, texts
from .components import connected

SHINGLE, PERCENT = 4, 85
SLICE_BYTES = 4 << 20
#: log2 of the sketch's bins: 1 MB a map task, whatever the data.
SKETCH = 18
#: List entries of an average bucket, and sets of a cell.
BUCKET_ENTRIES, CELL = 500_000, 2048
#: Entries of a chunk of a long list, as the sketch estimates them.
CHUNK_ENTRIES = 500_000
#: Greatest size from which sets may be heavy.
MOST_LIGHT = 64
#: Cells of each set by which a pair is told to have met before.
FIRST = 8
_LOW = W.U((1 << 58) - 1)


def sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every distinct shingle, sorted by both."""
    start, end, of = W.spans(raw, offsets, W.white_space())
    word = W.hashes(raw, start, end)
    many = W.counts(of, len(offsets) - 1)
    got, at = W.grams(word, of, k)
    text, gram = [of[at]], [got]
    short = many[of] < k
    if short.any():
        for n in range(1, k):
            mine = many[of] == n
            got, at = W.grams(word[mine], of[mine], n)
            text.append(of[mine][at])
            gram.append(got)
    text, gram = np.concatenate(text), np.concatenate(gram)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[first], gram[first]


def _class_ids(text: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit identity of each text's set; the identity of no set is 0."""
    size = W.counts(text, n)
    total = np.zeros(n, W.U)
    np.add.at(total, text, W.mix(gram))
    return size, np.where(size > 0, W.mix(total ^ W.mix(size.astype(W.U))) | W.U(1), W.U(0))


def _first_of_class(h: np.ndarray, n: int) -> np.ndarray:
    """Whether a text is the first of a slice with its set."""
    _, first = np.unique(h, return_index=True)
    out = np.zeros(n, bool)
    out[first] = True
    return out


def _bin(gram: np.ndarray) -> np.ndarray:
    return (gram >> W.U(64 - SKETCH)).astype(np.int64)


def _survey(k: int):
    """One row (id, tag, n, class) a document, and the task's share of the count sketch in blocks."""
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << SKETCH, np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            text, gram = sets(*buffers(batch.column("text")), k)
            size, h = _class_ids(text, gram, batch.num_rows)
            n = batch.num_rows
            bins += np.bincount(_bin(gram[_first_of_class(h, n)[text]]), minlength=len(bins))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(size), pa.array(h.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if bins.any():
            parts = [zstandard.compress(x.tobytes(), 1) for x in bins.reshape(64, -1)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(64, pa.int64()) for _ in range(4)), pa.array(range(64), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _load(survey: DataFrame) -> np.ndarray:
    """The summed sketch: 64 blocks of a fixed size come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(zstandard.decompress(counts), np.int64)
                total[block] = total[block] + got if block in total else got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    rows = survey.where("block is not null").select("block", "counts").repartition(partitions(survey.sparkSession), "block").mapInArrow(run, "block int, counts binary").collect()
    out = np.zeros((64, (1 << SKETCH) // 64), np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _ranks(load: np.ndarray) -> np.ndarray:
    """Each bin's class, 0 to 63: a quarter of an octave above the mean load each."""
    mean = max(load.mean(), 1.0)
    return np.clip(4 * np.log2(np.maximum(load / mean, 1.0)), 0, 63).astype(np.uint64)


def _chunks(load: np.ndarray) -> np.ndarray:
    """Into how many chunks the sets of a bin's shingles fall: by what the bin holds beyond one and a half times the usual."""
    return 1 + (np.maximum(load - 1.5 * np.median(load), 0) // CHUNK_ENTRIES).astype(np.int64)


def _prefix(n, percent: int):
    """Shingles of a set of n of which at least one must be in any similar set's prefix too."""
    return n + (-percent * n) // 100 + 1


def boundary(histogram: dict[int, int], load: np.ndarray, percent: int, most: int = MOST_LIGHT) -> int:
    """The size from which sets are heavy: least (subsets enumerated + entries put in lists and scanned)."""
    total = max(load.sum(), 1)
    # expected length of the list of a shingle, less what unlike shingles of a bin add
    length = max(float((load.astype(float) ** 2).sum() / total - load.mean()), 1.0)

    def cost(x: int) -> float:
        light = sum(c * _prefix(n, percent) * (_prefix(n, percent) + 1) / 2 for n, c in histogram.items() if n < x)
        return light + sum(c * _prefix(n, percent) * (1 + length) for n, c in histogram.items() if 100 * n >= percent * x)

    return min(range(2, most + 1), key=lambda x: (cost(x), x))


def _entries(text: np.ndarray, token: np.ndarray, chunks: np.ndarray, size: np.ndarray, percent: int, heavy_from: int) -> tuple[np.ndarray, ...]:
    """(key, text, place, chunks) of list entries and subsets; tokens are sorted by text, rare first. Place -1: a subset.

    The list of a subset is no longer than that of its rarer shingle.
    """
    start = np.cumsum(size) - size
    # below this size a similar set must be an equal set
    alone = (100 * (size + 1) > 100 * size * 100 // percent) & (size * 100 < percent * (size + 1))
    listed = np.flatnonzero((100 * size >= percent * heavy_from) & ~alone & (size > 0))
    n = _prefix(size[listed], percent)
    at = W.ragged(start[listed], n)
    owner = np.repeat(listed, n)
    keys, texts_, places, parts = [token[at]], [owner], [at - start[owner]], [chunks[at]]
    for s in np.unique(size[(size < heavy_from) & ~alone & (size > 1)]):
        mine = np.flatnonzero(size == s)
        p = min(int(_prefix(s, percent)) + 1, int(s))
        i, j = np.triu_indices(p, 1)
        at = start[mine][:, None] + np.arange(p)
        rows, of = token[at], chunks[at]
        keys.append(W.mix(rows[:, i] ^ W.mix(rows[:, j] + W.U(5))).ravel())
        texts_.append(np.repeat(mine, len(i)))
        places.append(np.full(len(mine) * len(i), -1))
        parts.append(np.minimum(of[:, i], of[:, j]).ravel())
    return tuple(map(np.concatenate, (keys, texts_, places, parts)))


def _tokens(text: np.ndarray, gram: np.ndarray, rank: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles numbered so that rare ones are small, sorted within each text, and the chunks of their lists."""
    of = _bin(gram)
    token = (rank[of] << W.U(58)) | (gram & _LOW)
    order = np.lexsort((token, text))
    return token[order], chunks[of[order]]


def _dealt(key: np.ndarray, h: np.ndarray, chunks: np.ndarray, n_buckets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(entry, bucket, key, side) of every list that an entry goes to.

    An entry of a short list goes there, side 2. One of a long list goes to the list of its chunk
    (side 2) and to those that its chunk forms with each other one (side 0 for the lower chunk, 1
    for the higher); each has a bucket of its own. Keys keep their class, so that rare ones stay first.
    """
    short = np.flatnonzero(chunks == 1)
    yield short, (W.mix(key[short]) % W.U(n_buckets)).astype(np.int64), key[short], np.full(len(short), 2, np.int8)
    long = np.flatnonzero(chunks > 1)
    own = (W.mix(h[long] + W.U(3)) % chunks[long].astype(W.U)).astype(np.int64)
    for other in range(int(chunks.max(initial=1)) if len(long) else 0):
        here = np.flatnonzero(chunks[long] > other)
        at, mine = long[here], own[here]
        pair = (np.minimum(mine, other) << 32 | np.maximum(mine, other)).astype(W.U)
        named = (key[at] & ~_LOW) | (W.mix(key[at] ^ W.mix(pair + W.U(7))) & _LOW)
        side = np.where(mine == other, 2, mine > other).astype(np.int8)
        yield at, n_buckets + (W.mix(named) >> W.U(34)).astype(np.int64), named, side


def _lists(k: int, percent: int, rank: np.ndarray, chunks: np.ndarray, heavy_from: int, n_buckets: int):
    """Map side: the entries of each slice, one set of each class, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            text, gram = sets(*buffers(batch.column("text")), k)
            size, h = _class_ids(text, gram, batch.num_rows)
            chosen = _first_of_class(h, batch.num_rows)
            keep = chosen[text]
            key, of, place, parts = _entries(text, *_tokens(text[keep], gram[keep], rank, chunks), np.where(chosen, size, 0), percent, heavy_from)
            for at, bucket, named, side in _dealt(key, h[of], parts, n_buckets):
                if not len(at):
                    continue
                order = np.lexsort((named, bucket))
                at, bucket, named, side = at[order], bucket[order], named[order], side[order]
                edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0, [True])))
                blobs = []
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    mine = at[a:b]
                    fields = (np.array([b - a]), named[a:b], h[of[mine]], size[of[mine]].astype(np.int32), place[mine].astype(np.int32), side[a:b])
                    blobs.append(zstandard.compress(b"".join(x.tobytes() for x in fields), 1))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, W.U, n, 8), np.frombuffer(raw, W.U, n, 8 + 8 * n), np.frombuffer(raw, np.int32, n, 8 + 16 * n), np.frombuffer(raw, np.int32, n, 8 + 20 * n), np.frombuffer(raw, np.int8, n, 8 + 24 * n)


def _cells(percent: int):
    """Reduce side: the sets that share a key, dealt to cells where two or more have compatible sizes and places.

    A cell is named by the sets in it, so that keys that the same sets share are one cell; it
    carries the least of these keys.
    """

    def compatible(key, n):
        near = np.zeros(len(key) + 1, bool)
        near[1:-1] = (key[1:] == key[:-1]) & (percent * n[1:] <= 100 * n[:-1])
        return near[1:] | near[:-1]

    def cells(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, h, n, place, side = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        order = np.lexsort((h, n, key))
        key, h, n, place, side = key[order], h[order], n[order].astype(np.int64), place[order], side[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        alive = np.flatnonzero(first)
        alive = alive[compatible(key[alive], n[alive])]
        key, h, n, place, side = key[alive], h[alive], n[alive], place[alive], side[alive]
        if not len(key):
            return
        # where a pair first meets, no shingle before the place is shared: (100 - percent)(|A| + |B|) >= (100 + percent)(i + j)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lowest = np.repeat(np.minimum.reduceat(place, edge), np.diff(np.append(edge, len(key))))
        alive = (100 - percent) * (n + 100 * n // percent + 1) >= (100 + percent) * (place + lowest)
        key, h, n, place, side = key[alive], h[alive], n[alive], place[alive], side[alive]
        alive = compatible(key, n)
        key, h, n, place, side = key[alive], h[alive], n[alive], place[alive], side[alive]
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        # subsets of two aren't in the shingles' order; as the least key they take part in no comparison of keys
        key = np.where(place < 0, W.U(0), key) ^ W.U(1 << 63)
        part = W.mix(h + np.where(side == 2, 0, side + 1).astype(W.U))
        whole = np.flatnonzero(size <= CELL)
        name = W.mix(np.add.reduceat(part, edge[:-1])[whole])
        # keys are in order, so that of keys with the same sets the least stays
        _, own = np.unique(name, return_index=True)
        rows = W.ragged(edge[:-1][whole[own]], size[whole[own]])
        out = [(rows, np.repeat(name[own], size[whole[own]]), side[rows])]
        for g in np.flatnonzero(size > CELL):
            a, b = edge[g], edge[g + 1]
            # every chunk with itself, and with later chunks whose smallest set is small enough
            for r in range(a, b, CELL):
                x = np.arange(r, min(r + CELL, b))
                mine = part[x].sum()
                out.append((x, np.repeat(W.mix(mine[None]), len(x)), side[x]))
                for c in range(r + CELL, b, CELL):
                    if percent * n[c] > 100 * n[x[-1]]:
                        break
                    y = np.arange(c, min(c + CELL, b))
                    # in a list of two chunks only sets of different chunks
                    for u, v in [(x, y)] if side[a] == 2 else [(x[side[x] == s], y[side[y] != s]) for s in (0, 1)]:
                        both = W.mix(W.mix(part[u].sum()[None]) ^ W.mix(part[v].sum()[None] + W.U(9)))
                        out += [(u, np.repeat(both, len(u)), np.zeros(len(u), np.int8)), (v, np.repeat(both, len(v)), np.ones(len(v), np.int8))]
        rows, cell, sides = (np.concatenate(x) for x in zip(*out, strict=True))
        for x in range(0, len(rows), 100_000):
            at = rows[x : x + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(cell[x : x + 100_000].view(np.int64)), pa.array(sides[x : x + 100_000]), pa.array(h[at].view(np.int64)), pa.array(n[at].astype(np.int32)), pa.array(key[at].view(np.int64))], ["cell", "side", "h", "n", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if bucket != now and held:
                    yield from cells(held)
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield from cells(held)

    return run


def _parity_bits(n: np.ndarray) -> np.ndarray:
    return 1 << np.maximum(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 6)


def _parities(text: np.ndarray, gram: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bit for each residue of the shingles' hashes: whether an odd number of shingles has it."""
    bits = _parity_bits(size)
    base = np.cumsum(bits) - bits
    at = base[text] + (gram & (bits[text] - 1).astype(W.U)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    return [packed[a:b].tobytes() for a, b in zip(base // 8, (base + bits) // 8, strict=True)]


def _again(k: int, wanted: np.ndarray, whole: bool):
    """(class, data) of documents that the filter lets pass, one of each class and slice.

    Data: the whole text or its set's parity sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            batch = batch.filter(pa.array(passes(wanted, batch.column("id").fill_null(-1).to_numpy())))
            if not batch.num_rows:
                continue
            text, gram = sets(*buffers(batch.column("text")), k)
            size, h = _class_ids(text, gram, batch.num_rows)
            _, first = np.unique(h, return_index=True)
            first = first[size[first] > 0]
            if whole:
                column = batch.column("text").cast(pa.large_binary())
                out = [zstandard.compress(column[i].as_py(), 3) for i in first.tolist()]
            else:
                every = _parities(text, gram, size)
                out = [every[i] for i in first]
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(out, pa.binary())], ["h", "data"])

    return run


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _compare(percent: int, crossing: bool):
    """Pairs of a cell that may be similar: each set's first partner, or (crossing) all between components."""

    def pairs(h, n, side, comp, own, met, data) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, n))
        h, n, side, comp, met = (x[order] for x in (h, n, side, comp, met))
        sketch = [data[i] for i in order]
        # earlier cells in which a set is compared with all others
        earlier = (met[:, :, 0] < own[0]) | ((met[:, :, 0] == own[0]) & (met[:, :, 1] < own[1]))
        words = np.array([len(x) // 8 for x in sketch])
        levels = {}
        for w in np.unique(words):
            # every larger set's sketch folded to w words
            have = np.flatnonzero((words >= w) & (words <= 4 * w))
            table = np.zeros((len(h), w), W.U)
            for v in np.unique(words[have]):
                mine = have[words[have] == v]
                table[mine] = _fold(np.frombuffer(b"".join(sketch[i] for i in mine), W.U).reshape(len(mine), v), w)
            levels[w] = table
        to = np.searchsorted(n, 100 * n // percent, "right")
        left, right = [], []
        taken = np.zeros(len(h), bool)
        for a in range(len(h)):
            if to[a] <= a + 1:
                continue
            at = np.arange(a + 1, to[a])
            if side[a] != 2:
                at = at[side[at] != side[a]]
            at = at[comp[at] != comp[a]] if crossing else at[~taken[at]]
            if not len(at):
                continue
            apart = np.bitwise_count(levels[words[a]][at] ^ levels[words[a]][a]).sum(1, dtype=np.int64)
            # |A| + |B| - 2 |A & B| >= apart, and |A & B| * (100 + percent) >= percent * (|A| + |B|)
            both = n[a] + n[at]
            at = at[(both - apart) * (100 + percent) >= 2 * percent * both]
            # a pair that is in an earlier cell too is left to it
            before = met[a, earlier[a], 1]
            if len(at) and len(before):
                at = at[~(met[at][:, :, 1, None] == before).any((1, 2))]
            if len(at):
                left.append(np.full(len(at), h[a]))
                right.append(h[at])
                taken[at] = True
        if not left:
            none = np.zeros(0, np.int64)
            return none, none
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            table = pa.Table.from_batches(held)
            column = lambda c: table[c].to_numpy()
            comp = column("comp")
            if len(comp) > 1 and not (crossing and (comp == comp[0]).all()):
                lists = table["met"].combine_chunks()
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                met = np.full((len(comp), 2 * FIRST), 2**63 - 1)
                met[np.repeat(np.arange(len(comp)), size), W.ragged(np.zeros(len(comp), np.int64), size)] = lists.flatten().to_numpy(zero_copy_only=False)
                own = int(column("key").min()), int(column("cell")[0])
                a, b = pairs(column("h"), column("n").astype(np.int64), column("side"), comp, own, met.reshape(-1, FIRST, 2), table["data"].to_pylist())
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        now, held = None, []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if cell[x] != now and held:
                    yield from out(held)
                    held = []
                now = cell[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from out(held)

    return run


def shingles(text: bytes, k: int) -> set[bytes]:
    """The shingles themselves: k words (all of a shorter text) in lower case with a space between."""
    words = text.lower().split()  # of bytes: A-Z alone, white space 0x20 and 0x09 to 0x0D
    k = min(k, len(words)) or 1
    return set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def _similar(k: int, percent: int):
    """The pairs whose sets are similar, word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, set()
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a != last:
                    last, held = a, shingles(zstandard.decompress(x.as_buffer()), k)
                other = shingles(zstandard.decompress(y.as_buffer()), k)
                shared = len(held & other)
                keep.append(100 * shared >= percent * (len(held) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of classes whose sets are similar, compared on the whole texts."""
    one = pairs.join(members.select(F.col("h").alias("a"), F.col("data").alias("x")), "a")
    both = one.join(members.select(F.col("h").alias("b"), F.col("data").alias("y")), "b")
    return checkpoint(both.select("a", "b", "x", "y").mapInArrow(_similar(k, percent), "a bigint, b bigint"))


def _tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(id, tag, n, h) of every row, the tag a hash of its text and h naming its set, and the links (a, b) between classes that suffice for the components."""
    rows = texts(docs, id_col, text_col)
    spark = rows.sparkSession
    survey = checkpoint(rows.withColumn("tag", _tag(F.col("text"))).mapInArrow(_survey(k), "id bigint, tag bigint, n bigint, h bigint, block int, counts binary"))
    each = survey.where("block is null").select("id", "tag", "n", "h")
    load = _load(survey)
    small = {r.n: r.c for r in each.where("n between 1 and 200").groupBy("n").agg(F.countDistinct("h").alias("c")).collect()}
    heavy_from = boundary(small, load, percent)
    entries = each.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0))).first()[0]
    n_buckets = max(partitions(spark), int(entries // BUCKET_ENTRIES) + 1)
    rank = _ranks(load)
    blobs = rows.mapInArrow(_lists(k, percent, rank, _chunks(load), heavy_from, n_buckets), "bucket int, blob binary")
    dealt = blobs.repartition(max(partitions(spark), n_buckets // 4), "bucket").sortWithinPartitions("bucket")
    cells = dealt.mapInArrow(_cells(percent), "cell bigint, side tinyint, h bigint, n int, key bigint")
    cells = checkpoint(cells.groupBy("cell", "side", "h").agg(F.min("n").alias("n"), F.min("key").alias("key")))

    # classes that some cell holds, each by the document of least id
    met = cells.select("h").distinct()
    first = each.where("n > 0").groupBy("h").agg(F.min("id").alias("id"))
    wanted = checkpoint(met.join(first, "h"))
    passing = key_filter(wanted, "id")
    sketches = (rows.mapInArrow(_again(k, passing, False), "h bigint, data binary").join(met, "h", "left_semi").groupBy("h").agg(F.min("data").alias("data")))
    early = cells.where("side = 2").groupBy("h").agg(F.slice(F.sort_array(F.collect_list(F.struct("key", "cell"))), 1, FIRST).alias("first"))
    sketches = checkpoint(sketches.join(early.select("h", F.flatten(F.transform("first", lambda x: F.array(x["key"], x["cell"]))).alias("met")), "h", "left"))

    def candidates(crossing: bool, component: DataFrame | None) -> DataFrame:
        held = cells.join(sketches, "h")
        if component is not None:
            held = held.join(component.select(F.col("node").alias("h"), F.col("root").alias("comp")), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
        else:
            held = held.withColumn("comp", F.col("h"))
        by_cell = held.select("cell", "side", "h", "n", "key", "comp", "met", "data").repartition(max(partitions(spark), n_buckets // 4), "cell").sortWithinPartitions("cell")
        return checkpoint(by_cell.mapInArrow(_compare(percent, crossing), "a bigint, b bigint").distinct())

    proposed = candidates(False, None)
    ends = proposed.select(F.col("a").alias("h")).unionByName(proposed.select(F.col("b").alias("h"))).distinct()
    passing = key_filter(wanted.join(ends, "h", "left_semi"), "id")

    def members(bits: np.ndarray, who: DataFrame) -> DataFrame:
        return checkpoint(rows.mapInArrow(_again(k, bits, True), "h bigint, data binary").join(who, "h", "left_semi").groupBy("h").agg(F.min("data").alias("data")))

    links = _verified(proposed, members(passing, ends), k, percent)
    more = candidates(True, connected(links)).join(proposed, ["a", "b"], "left_anti")
    more = checkpoint(more)
    if not more.isEmpty():
        ends = more.select(F.col("a").alias("h")).unionByName(more.select(F.col("b").alias("h"))).distinct()
        links = links.unionByName(_verified(more, members(key_filter(wanted.join(ends, "h", "left_semi"), "id"), ends), k, percent))
    return each, links


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    each, links = classes(docs, id_col, text_col, k, percent)
    component = connected(links)
    first = each.where("n > 0").groupBy("h").agg(F.min("id").alias("id"))
    named = first.join(component.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.join(least, "root").select("h", "component_id")
    return each.join(of_class, "h", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns: one row of each group, and every row that links with nothing.

    A row goes by its id and its text's hash, never by its id alone.
    """
    each, links = classes(docs, id_col, text_col, k, percent)
    rows = each.where("n > 0").groupBy("h", "id", "tag").agg(F.count("*").alias("n"))
    rows = checkpoint(rows.join(connected(links).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h")))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    judged = checkpoint(rows.join(first, "root").select("id", "tag", "n", (order == F.col("first")).alias("stays")))
    own_id, own_tag, id_name, tag_name = fresh("own_id"), fresh("own_tag"), fresh("id"), fresh("tag")
    named = lambda which: judged.where(which).select(F.col("id").alias(id_name), F.col("tag").alias(tag_name))
    marked = docs.withColumns({own_id: docs[id_col].cast("bigint"), own_tag: _tag(docs[text_col].cast("string"))})
    same = F.col(own_id).eqNullSafe(F.col(id_name)) & (F.col(own_tag) == F.col(tag_name))
    kept = marked.join(named("not stays"), same, "left_anti")
    repeated = checkpoint(named("stays and n > 1"))
    if not repeated.isEmpty():
        one = kept.join(repeated, same, "left_semi").dropDuplicates([own_id, own_tag])
        kept = kept.join(repeated, same, "left_anti").unionByName(one)
    return kept.select(*docs.columns)
