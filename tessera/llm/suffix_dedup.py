"""Removal of repeated byte strings by a range-partitioned, anchored suffix array.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one. Matches never cross documents and are judged on the input.

Every window of 100 bytes has one *leading token*: of the 93 tokens of 8 bytes in it, the one of
least hash, the leftmost of equals. Equal windows have equal leading tokens at equal offsets. So
successive windows with the same leading token travel together, as one *anchored suffix*: the
suffix at the token with the bytes in front of it that its windows need. That is about 2 % of all
suffixes and three times the text, instead of a hundred times.

1. Anchored suffixes that repeat within a slice of a map task are settled there: all but the
   earliest go (a pre-aggregation that keeps hot passages from the buckets). Their spans travel in
   parcels of their own, dealt evenly, that no bucket holds.
2. Sampled splitters range-partition the others by leading token. Splitters lie between tokens,
   so that equal windows never stand on two sides of a boundary. Their number follows the text's
   size up to ``MOST_SPLITTERS``, and the sample follows their number; beyond that each range is
   dealt to several buckets by a hash of the token, so that buckets don't grow. A token that is
   hot in the sample is dealt by the bytes around it that all windows of a third of the offsets
   share.
3. Each bucket sorts its anchored suffixes by multikey quicksort, eight bytes a character. Where a
   suffix parts from all others, windows that reach beyond that character are unique. The others
   are compared as whole windows: by rolling hashes, and then byte by byte with the earliest of
   their group. All but the earliest of equals are marked.
4. Marked spans meet their document again by id, and the bytes outside them are kept.

Defined results: a null text is empty; texts under 100 bytes keep all bytes; a null id counts as
the largest; rows that repeat an id are documents of their own, ordered by their text's hash, and
rows that repeat id and text are one document that stands there several times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import NO_ID, buffers, partitions, slices, tagged

WINDOW = 100
TOKEN = 8
_TOKENS = WINDOW - TOKEN + 1
SLICE_BYTES = 4 << 20
#: Text bytes of an average bucket; a bucket is sorted in memory.
BUCKET_BYTES = 5 << 19
#: Splitters at most (1 MB); documents sampled for them at least, and tokens of each.
MOST_SPLITTERS, SAMPLE_DOCS, SAMPLE_TOKENS = 1 << 17, 4000, 32
#: The bucket number of settled spans.
_SETTLED = -1
_BLOBS = "bucket bigint, part bigint, blob binary"
_SPANS = "id bigint, tag bigint, s int, e int"
_PARTS = np.array([0, 31, 62, _TOKENS])


def anchored(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of each anchored suffix, in order."""
    found = []
    ends = offsets[1:]
    for low in range(0, max(len(raw) - WINDOW + 1, 0), W.SPAN):
        part = raw[low : low + W.SPAN + WINDOW - 1]
        n = len(part) - TOKEN + 1
        windows = len(part) - WINDOW + 1
        token = np.ndarray((n,), ">u8", np.ascontiguousarray(part), strides=(1,)).astype(W.U)
        key = ((token ^ (token >> W.U(29))) * W.U(0xBF58476D1CE4E5B9)) & W.U(0xFFFFFFFF00000000)
        key |= np.arange(n, dtype=W.U)
        width = 1
        while 2 * width <= _TOKENS:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[:windows], key[_TOKENS - width : _TOKENS - width + windows])
        anchor = (key & W.U(0xFFFFFFFF)).astype(np.int64)
        cross = np.zeros(windows + 1, np.int32)
        b = ends[(ends > low) & (ends < low + len(part))] - low
        np.add.at(cross, np.clip(b - WINDOW + 1, 0, windows), 1)
        np.add.at(cross, np.clip(b, 0, windows), -1)
        valid = np.cumsum(cross[:-1]) == 0
        turn = np.ones(windows + 1, bool)
        turn[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        edge = np.flatnonzero(turn)
        first, last = edge[:-1], edge[1:] - 1
        keep = valid[first]
        found.append((first[keep] + low, last[keep] + low, anchor[first[keep]] + low))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def tokens_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return raw[at[:, None] + np.arange(TOKEN)].copy().view(">u8").ravel().astype(W.U)


def _representatives(key: np.ndarray) -> np.ndarray:
    """The place of the first of equal keys, for each."""
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), np.int64)
    out[order] = order[first][np.cumsum(first) - 1] if len(key) else order
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from a equal those from b."""
    out = np.empty(len(a), bool)
    step = max(1, W.SPAN // max(int(size.max(initial=1)), 1))
    for x in range(0, len(a), step):
        n = size[x : x + step].astype(np.int64)
        same = data[W.ragged(a[x : x + step], n)] == data[W.ragged(b[x : x + step], n)]
        out[x : x + step] = np.add.reduceat(same, np.cumsum(n) - n) == n
    return out


def first_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, runs: bool = False) -> np.ndarray:
    """For each span of ``data`` the first one with the same bytes; ``key`` is a hash of them.

    With ``runs`` (one size for all spans), a span behind one whose match stands before its own
    match is compared in its last byte alone.
    """
    rep = _representatives(key)
    later = np.flatnonzero(rep != np.arange(len(rep)))
    if not len(later):
        return rep
    whole = np.ones(len(later), bool)
    if runs:
        whole[1:] = (np.diff(later) != 1) | (np.diff(start[later]) != 1) | (np.diff(start[rep[later]]) != 1)
    same = np.empty(len(later), bool)
    same[whole] = _equal(data, start[later[whole]], start[rep[later[whole]]], size[later[whole]])
    tail = later[~whole]
    same[~whole] = data[start[tail] + size[tail] - 1] == data[start[rep[tail]] + size[tail] - 1]
    if runs and not same.all():  # what follows an unequal span has to be compared whole
        same[~whole] = _equal(data, start[tail], start[rep[tail]], size[tail])
    if not same.all():  # unlike spans of one hash: told apart by their bytes
        for group in np.unique(rep[later[~same]]):
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(rep == group).tolist():
                rep[i] = seen.setdefault(data[start[i] : start[i] + size[i]].tobytes(), i)
    return rep


def _pack(ids, tags, at, offset, size, data, dup) -> bytes:
    head = np.array([len(ids), len(dup[0])], np.int64)
    delta = lambda x: np.diff(x, prepend=x.dtype.type(0))
    parts = [head, delta(ids), delta(tags), at.astype(np.int32), offset.astype(np.uint8), size.astype(np.uint8), delta(dup[0]), delta(dup[1]), dup[2].astype(np.int32), dup[3].astype(np.int32), data]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def _unpack(blob: bytes) -> tuple:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, m = raw[:16].view(np.int64)
    out, at = [], 16
    for kind, size in ((np.int64, n), (np.int64, n), (np.int32, n), (np.uint8, n), (np.uint8, n), (np.int64, m), (np.int64, m), (np.int32, m), (np.int32, m)):
        to = at + size * np.dtype(kind).itemsize
        out.append(raw[at:to].copy().view(kind))
        at = to
    for k in (0, 1, 5, 6):
        out[k] = np.cumsum(out[k])
    return (*out, raw[at:])


def _deal(splitters: np.ndarray, hot: np.ndarray, n_buckets: int, per_range: int):
    """Map side: anchored suffixes of each slice, settled where they repeat in it, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            order = np.lexsort((batch.column("tag").to_numpy(), batch.column("id").to_numpy()))
            batch = batch.take(pa.array(order))
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            raw, offsets = buffers(batch.column("text"))
            first, last, anchor = anchored(raw, offsets)
            if not len(first):
                continue
            token = tokens_at(raw, anchor)
            bucket = np.searchsorted(splitters, token, "right") * per_range
            if per_range > 1:
                bucket += (W.mix(token) % W.U(per_range)).astype(np.int64)
            # hot tokens: cut by thirds of the offsets, deal by the bytes that all windows of a third share
            is_hot = np.isin(token, hot)
            if is_hot.any():
                cut = [(first[~is_hot], last[~is_hot], anchor[~is_hot], bucket[~is_hot])]
                f, z, a = first[is_hot], last[is_hot], anchor[is_hot]
                for low, high in zip(_PARTS[:-1], _PARTS[1:], strict=True):
                    x, y = np.maximum(f, a - high + 1), np.minimum(z, a - low)
                    some = x <= y
                    x, y, b = x[some], y[some], a[some]
                    # all of these windows hold the bytes from anchor - low to anchor + WINDOW - high
                    key = W.hashes(raw, b - low, b + WINDOW - high + 1, False)
                    cut.append((x, y, b, (W.mix(key + W.U(low)) % W.U(n_buckets)).astype(np.int64)))
                first, last, anchor, bucket = (np.concatenate(x) for x in zip(*cut, strict=True))
                order = np.argsort(first, kind="stable")
                first, last, anchor, bucket = first[order], last[order], anchor[order], bucket[order]
            doc = np.searchsorted(offsets, first, "right") - 1
            size = last - first + WINDOW
            # equal bytes around unlike anchors are unlike suffixes
            key = W.mix(W.hashes(raw, first, first + size, False) ^ W.mix((anchor - first).astype(W.U)))
            own = first_of(raw, first, size, key) == np.arange(len(first))
            at = first - offsets[doc]
            spans = lambda k: (ids[doc[k]], tags[doc[k]], at[k], at[k] + size[k])
            ship, dup = np.flatnonzero(own), np.flatnonzero(~own)
            order = ship[np.argsort(bucket[ship], kind="stable")]
            edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
            none = spans(dup[:0])
            names, parts, blobs = [], [], []
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                mine = order[x:y]
                blobs.append(_pack(ids[doc[mine]], tags[doc[mine]], at[mine], anchor[mine] - first[mine], size[mine], raw[W.ragged(first[mine], size[mine])], none))
                names.append(bucket[mine[0]])
                parts.append(bucket[mine[0]])
            if len(dup):
                nothing = dup[:0]
                blobs.append(_pack(ids[nothing], tags[nothing], at[nothing], at[nothing], at[nothing], raw[:0], spans(dup)))
                names.append(_SETTLED)
                parts.append(int(W.mix(np.array([ids[0], offsets[-1]], np.int64).view(W.U)).sum() >> W.U(1)))
            for x in range(0, len(blobs), 256):
                yield pa.RecordBatch.from_arrays([pa.array(names[x : x + 256], pa.int64()), pa.array(parts[x : x + 256], pa.int64()), pa.array(blobs[x : x + 256], pa.binary())], ["bucket", "part", "blob"])

    return run


def multikey(word_at, n: int, most: int) -> np.ndarray:
    """Multikey quicksort of n strings by characters ``word_at(depth, strings)``, all parts of a depth at once.

    Returns for each string the depth at which it parted from all others (``most`` if it never did).
    """
    depth = np.full(n, most, np.int64)
    live, part = np.arange(n), np.zeros(n, np.int64)
    for d in range(most):
        if not len(live):
            break
        word = word_at(d, live)
        order = np.lexsort((word, part))
        live, part, word = live[order], part[order], word[order]
        turn = np.ones(len(live) + 1, bool)
        turn[1:-1] = (part[1:] != part[:-1]) | (word[1:] != word[:-1])
        alone = turn[:-1] & turn[1:]
        depth[live[alone]] = d
        part = np.cumsum(turn[:-1])[~alone]
        live = live[~alone]
    return depth


def _mark(blobs: list[bytes]) -> Iterator[tuple]:
    """Reduce side: the spans of one bucket that also start earlier, as (ids, tags, starts, ends)."""
    ids, tags, at, offset, size, dup_id, dup_tag, dup_s, dup_e, data = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    if len(dup_id):
        yield dup_id, dup_tag, dup_s, dup_e
    n = len(ids)
    if n < 2:
        return
    begin = np.cumsum(size, dtype=np.int64) - size
    pad = np.concatenate((data, np.zeros(WINDOW + TOKEN, np.uint8)))
    heads = np.ndarray((len(pad) - TOKEN + 1,), ">u8", pad, strides=(1,))
    anchor, stop = begin + offset, begin + size

    def word_at(depth: int, live: np.ndarray) -> np.ndarray:
        at = np.minimum(anchor[live] + depth * TOKEN, len(heads) - 1)
        left = np.clip(stop[live] - at, 0, TOKEN)
        word = heads[at].astype(W.U)
        short = left < TOKEN  # beyond the end: zeros, so that equal bytes stay together
        word[short] &= ~((W.U(1) << (W.U(8) * (TOKEN - left[short]).astype(W.U))) - W.U(1)) if short.any() else W.U(0)
        word[left == 0] = 0
        return word

    shared = (multikey(word_at, n, -(-WINDOW // TOKEN)) + 1) * TOKEN - 1
    # windows begin, begin + 1, ...: the k-th has offset - k bytes before the anchor, so it reaches WINDOW - offset + k beyond
    windows = size.astype(np.int64) - WINDOW + 1
    fit = np.clip(shared - WINDOW + offset.astype(np.int64) + 1, 0, windows)
    some = np.flatnonzero(fit > 0)
    order = some[np.lexsort((at[some], tags[some], ids[some]))]
    count = fit[order]
    start = W.ragged(begin[order], count)
    if len(start) < 2:
        return
    owner = np.repeat(np.arange(len(order)), count)
    by = np.argsort(start)  # hashes are taken in order of place
    key = np.empty(len(start), W.U)
    key[by] = W.rolled(data, start[by], start[by] + WINDOW)
    del by
    dup = first_of(data, start, np.full(len(start), WINDOW), key, True) != np.arange(len(start))
    turn = np.ones(len(dup) + 1, bool)
    turn[1:-1] = (dup[1:] != dup[:-1]) | (owner[1:] != owner[:-1])
    edge = np.flatnonzero(turn)
    first, last = edge[:-1], edge[1:] - 1
    keep = dup[first]
    first, last = first[keep], last[keep]
    whose = order[owner[first]]
    base = at[whose].astype(np.int64) - begin[whose]
    yield ids[whose], tags[whose], start[first] + base, start[last] + base + WINDOW


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans(blobs):
        for ids, tags, s, e in _mark(blobs):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["id", "tag", "s", "e"])

    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if bucket == _SETTLED:
                yield from spans([blob.as_py()])
                continue
            if bucket != now and held:
                yield from spans(held)
                held = []
            now = bucket
            held.append(blob.as_py())
    if held:
        yield from spans(held)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        raw, offsets = buffers(batch.column("text"))
        _, _, anchor = anchored(raw, offsets)
        if len(anchor):
            token = tokens_at(raw, anchor)
            doc = np.searchsorted(offsets, anchor, "right") - 1
            order = np.lexsort((W.mix(token ^ anchor.astype(W.U)), doc))
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order], "left")
            yield pa.RecordBatch.from_arrays([pa.array(token[order[rank < SAMPLE_TOKENS]].view(np.int64))], ["token"])


def plan(n: int, size: int) -> tuple[int, int, int, int]:
    """Ranges, buckets a range, documents to sample and the hash below which a row is sampled, for n rows of ``size`` bytes."""
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    ranges = min(n_buckets, MOST_SPLITTERS + 1)
    wanted = max(SAMPLE_DOCS, ranges)
    return ranges, -(-n_buckets // ranges), wanted, min(2**63 - 1, (wanted << 64) // max(n, 1) - 2**63)


def _spans(rows: DataFrame, n: int, size: int) -> DataFrame:
    spark = rows.sparkSession
    ranges, per_range, wanted, below = plan(n, size)
    # rows that repeat id and text have one hash: the limit bounds what they may add
    sampled = rows.where(F.xxhash64("id", "tag") <= F.lit(below)).select("text")
    token = np.sort(sampled.mapInArrow(_sample, "token bigint").limit(2 * wanted * SAMPLE_TOKENS).toArrow()["token"].to_numpy().view(W.U))
    splitters = np.unique(token[(np.arange(1, ranges) * len(token)) // ranges]) if len(token) else token
    kinds, count = np.unique(token, return_counts=True)
    hot = kinds[count > max(8, len(token) // (2 * ranges))]
    n_buckets = ranges * per_range
    blobs = rows.mapInArrow(_deal(splitters, hot, n_buckets, per_range), _BLOBS)
    dealt = blobs.repartition(max(partitions(spark), n_buckets // 16), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_buckets, _SPANS)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames, half of what the shuffle's own compression makes of them."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches, "text", SLICE_BYTES):
        frames = [pack(t.as_buffer()) for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(frames, pa.binary())], ["id", "tag", "frame"])


def _unsqueeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress

    def out(batch: pa.RecordBatch, low: int, held: list[bytes]) -> pa.RecordBatch:
        part = batch.slice(low, len(held))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(held, pa.large_binary()).cast(pa.large_string()), part.column("s"), part.column("e")], ["id", "text", "s", "e"])

    for batch in batches:
        low, held, size = 0, [], 0
        for frame in batch.column("frame"):
            held.append(unpack(frame.as_buffer()))
            size += len(held[-1])
            if size >= SLICE_BYTES:
                yield out(batch, low, held)
                low, held, size = low + len(held), [], 0
        if held:
            yield out(batch, low, held)


def _gather(rows: DataFrame, spans: DataFrame) -> DataFrame:
    rows = rows.mapInArrow(_squeeze, "id bigint, tag bigint, frame binary")
    per_doc = spans.groupBy("id", "tag").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    return rows.join(per_doc.hint("shuffle_hash"), ["id", "tag"], "left")


def _removed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and a mask of the bytes to remove."""
    raw, offsets = buffers(batch.column("text"))
    cover = np.zeros(len(raw) + 1, np.int32)
    for name, sign in (("s", 1), ("e", -1)):
        column = batch.column(name)
        doc = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
        np.add.at(cover, offsets[doc] + column.flatten().to_numpy(zero_copy_only=False), sign)
    return raw, offsets, np.cumsum(cover[:-1]) > 0


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, n, size, _ = tagged(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unsqueeze(batches):
            raw, offsets, gone = _removed(batch)
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(raw)]
            rise[inner] = gone[inner]
            total, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, rise))
            sha = [hashlib.sha256(raw[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets])), pa.array(sha)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    got = _gather(rows, _spans(rows, n, size)).mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return got.withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumnRenamed("id", "doc_id")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary) of every row: the bytes that stay, which may cut a character."""
    rows, n, size, _ = tagged(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unsqueeze(batches):
            raw, offsets, gone = _removed(batch)
            left = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(left, pa.binary())], ["id", "kept"])

    got = _gather(rows, _spans(rows, n, size)).mapInArrow(run, "id bigint, kept binary")
    return got.withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumnRenamed("id", "doc_id")
