"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on toxic text, one on ordinary text. Samples are the
words of the texts (A-Z as a-z, without punctuation), each as often as documents hold it. Toxic
text is mostly ordinary, and so is most of what the trainer takes from it. So each segment of the
toxic dictionary is tried by itself, in front of the ordinary one: it stays if the bytes that it
saves occur in ``LEAST`` or more of the toxic words and at least ``RATIO`` times as often in a
toxic document as in an ordinary one. No words are listed or picked by any other measure.

The windows of a text are its words, and besides these its runs of ``RUN`` words, each between a
lead-in and a tail that both dictionaries hold, so that every frame is entropy coded, matches can
reach to the window's end and lengths compare byte by byte. A window's distance is its length
under the ordinary dictionary less its length under the toxic one (the ordinary one with the
toxic segments in front; the other has as many bytes of noise there, so that offsets cost the
same). How a text's distances are spread (share and number of windows at or above each
threshold, mean, greatest) goes through a logistic regression that is calibrated on labelled rows.

Both the dictionaries and the calibration are fitted to bounded samples of labelled rows outside
fold 1: ``max_docs`` documents a class (lowest hashes of the id first; of an id that repeats, the
least text), their words that two or more of them hold (a word is at most ``WORD_BYTES``),
``SAMPLES`` of these for the trainer, and ``max_rows`` rows for the calibration. What the fit
learns doesn't depend on how the table is partitioned. Every window of every text is scored. A
worker keeps the distances of words it has met, up to ``MEMO`` of them.

Defined results: null texts are empty; an empty text has one empty window; without toxic or
without ordinary labels the score is the smoothed share of toxic labels (0.5 without labels);
null or other label values are left out; repeated rows score alike; a null id is carried, in fold 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as Z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import buffers, checkpoint, fold, slices, texts

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
MAX_DOCS, MAX_ROWS = 3000, 20_000
SLICE_BYTES = 4 << 20
MEMO = 400_000
#: Longer words are cut into several.
WORD_BYTES = 40
#: Words of a longer window.
RUN = 6
_STEPS = (1, 2, 3, 4, 5, 6)
N_FEATURES = 2 * (3 + 2 * len(_STEPS))
#: Bytes of the trained dictionaries before segments are tried, and of the trainer's own segments.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT = 131_072, 8192, 32
#: Words that the trainer gets at most.
SAMPLES = 200_000
#: A segment stays if it saves SAVED bytes or more in LEAST toxic words, and RATIO times as often in toxic documents as in others.
SAVED, LEAST, RATIO = 2, 10, 6.0
#: A segment is tried on the words that share so many successive bytes with it.
SHARED = 6


def _parameters() -> Z.ZstdCompressionParameters:
    return Z.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=16, strategy=Z.STRATEGY_LAZY2, format=Z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)


def _coder(content: bytes) -> Z.ZstdCompressor:
    kept = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=_parameters())
    return Z.ZstdCompressor(dict_data=kept, compression_params=_parameters())


def _noise(n: int) -> bytes:
    return np.random.default_rng(1).integers(0, 256, n).astype(np.uint8).tobytes()


class Distance:
    """The two dictionaries (about ten KB) and the distances that this worker has worked out."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.parts = toxic, ordinary
        self.lead, self.tail = ordinary[-40:-16] + b" ", b" " + ordinary[-16:]
        self.coders = [_coder(x + ordinary) for x in (toxic, _noise(len(toxic)))]
        self.memo: dict[int, int] = {}

    def of(self, window: bytes) -> int:
        toxic, ordinary = self.coders
        text = self.lead + window + self.tail
        return len(ordinary.compress(text)) - len(toxic.compress(text))

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        start, end, of = W.spans(raw, offsets, W.not_alphanumeric())
        pieces = -(-(end - start) // WORD_BYTES)
        if len(start) and pieces.max() > 1:
            k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, of = np.repeat(start, pieces) + k * WORD_BYTES, np.repeat(of, pieces)
            end = np.minimum(start + WORD_BYTES, np.repeat(end, pieces))
        kinds, first, which = np.unique(W.hashes(raw, start, end), return_index=True, return_inverse=True)
        low = W.lower_table()[raw].tobytes()
        if len(self.memo) > MEMO:
            self.memo.clear()
        got = np.empty(len(kinds))
        for i, (key, a, b) in enumerate(zip(kinds.tolist(), start[first].tolist(), end[first].tolist(), strict=True)):
            d = self.memo.get(key)
            if d is None:
                d = self.memo[key] = self.of(low[a:b])
            got[i] = d
        # runs of words of one text, with one space between
        place = np.arange(len(of)) - np.searchsorted(of, of, "left")
        heads = np.flatnonzero(place % RUN == 0)
        a, b, edges = start.tolist(), end.tolist(), [*heads.tolist(), len(start)]
        runs = [self.of(b" ".join([low[a[i] : b[i]] for i in range(x, y)])) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        return np.column_stack((_spread(got[which], of, n), _spread(np.array(runs, float), of[heads], n)))


def _spread(d: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How the distances of each text's windows are spread."""
    count = np.bincount(of, minlength=n)
    some = np.maximum(count, 1)
    most = np.where(count > 0, -99.0, 0.0)
    np.maximum.at(most, of, d)
    above = np.stack([np.bincount(of, d >= k, n) for k in _STEPS])
    return np.column_stack((most, np.bincount(of, d, n) / some, np.log1p(count), (above / some).T, np.log1p(above).T))


def _dictionary(words: list[bytes], counts: list[int], size: int) -> bytes:
    """Content of a dictionary trained on words, each ``counts`` times; the words themselves where they are too few."""
    samples = [w for w, n in zip(words, counts, strict=True) for _ in range(n)]
    samples = [samples[i] for i in np.random.default_rng(7).permutation(len(samples))[:SAMPLES]]
    try:
        return Z.train_dictionary(size, samples, k=SEGMENT, d=8).as_bytes()
    except Z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def segments(content: bytes) -> list[bytes]:
    """The words and parts of words in a trained dictionary."""
    return [s for s in dict.fromkeys(re.findall(rb" ?[^ ]+ ?", content)) if len(s) >= SHARED]


def _tried(parts: list[bytes], ordinary: bytes):
    """(segment, toxic, ordinary): in how many documents, word by word, it saves SAVED bytes or more."""
    index: dict[bytes, set[int]] = {}
    for k, s in enumerate(parts):
        for i in range(len(s) - SHARED + 1):
            index.setdefault(s[i : i + SHARED], set()).add(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, tail = ordinary[-40:-16], ordinary[-16:]
        longest = max(map(len, parts))
        bare = _coder(_noise(longest) + ordinary)
        texts_, sizes, counts = [], [], []
        meets: dict[int, list[int]] = {}
        for batch in batches:
            for word, toxic, other in zip(*(batch.column(c).to_pylist() for c in ("word", "toxic", "ordinary")), strict=True):
                meet = set().union(*(index.get(word[i : i + SHARED], ()) for i in range(len(word) - SHARED + 1)))
                for k in meet:
                    meets.setdefault(k, []).append(len(texts_))
                if meet:
                    texts_.append(lead + word + tail)
                    sizes.append(len(bare.compress(texts_[-1])))
                    counts.append((toxic, other))
        total = np.zeros((len(parts), 2), np.int64)
        for k, rows in meets.items():  # one segment's tables (a quarter of a MB) at a time
            compress = _coder(_noise(longest - len(parts[k])) + parts[k] + ordinary).compress
            for i in rows:
                if sizes[i] - len(compress(texts_[i])) >= SAVED:
                    total[k] += counts[i]
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], ["segment", "toxic", "ordinary"])

    return run


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    marked = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    return marked.where((fold(F.col("id"), FOLDS) != HELD_OUT) & F.col("y").isin(0, 1))


def dictionaries(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Distance | None:
    """Trains the two dictionaries; None if a class has no labelled document."""
    marked = _labelled(labels, id_col, label_col)
    by_class = [marked.where(F.col("y") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(max_docs) for y in (0, 1)]
    picked = F.broadcast(by_class[0].unionByName(by_class[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            raw, offsets = buffers(batch.column("text"))
            start, end, of = W.spans(raw, offsets, W.not_alphanumeric())
            key = W.hashes(raw, start, end)
            _, first = np.unique(W.mix(key ^ W.mix(of.astype(W.U))), return_index=True)
            first = first[end[first] - start[first] <= WORD_BYTES]
            low = W.lower_table()[raw].tobytes()
            words = [b" " + low[a:b] + b" " for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            y = batch.column("y").to_numpy()
            # the empty word counts documents
            yield pa.RecordBatch.from_arrays([pa.array([*words, *[b""] * len(y)], pa.binary()), pa.array(np.concatenate((y[of[first]], y)).astype(np.int64))], ["word", "y"])

    one = texts(docs, id_col, text_col).join(picked, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    seen = one.mapInArrow(run, "word binary, y bigint").groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("ordinary"))
    seen = checkpoint(seen.where((F.col("toxic") + F.col("ordinary") >= 2) | (F.col("word") == F.lit(b""))))
    rows = seen.orderBy("word").toArrow()
    words, toxic, ordinary = (rows[c].to_pylist() for c in ("word", "toxic", "ordinary"))
    n_toxic, n_ordinary = (toxic[0], ordinary[0]) if words and not words[0] else (0, 0)
    if not n_toxic or not n_ordinary:
        return None
    words, toxic, ordinary = words[1:], toxic[1:], ordinary[1:]
    common = _dictionary(words, ordinary, ORDINARY_BYTES)
    parts = segments(_dictionary(words, toxic, TOXIC_BYTES))
    if not parts:
        return Distance(b"", common)
    tried = seen.where(F.col("word") != F.lit(b"")).mapInArrow(_tried(parts, common), "segment bigint, toxic bigint, ordinary bigint")
    tried = tried.groupBy("segment").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).collect()
    stay = [(r.toxic / n_toxic - r.ordinary / n_ordinary, parts[r.segment]) for r in tried if r.toxic >= LEAST and r.toxic * n_ordinary > RATIO * r.ordinary * n_toxic]
    return Distance(b"".join(s for _, s in sorted(stay)), common)


def measured(docs: DataFrame, distance: Distance, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of every document, in one map pass."""
    held = docs.sparkSession.sparkContext.broadcast(distance.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(held.value)
        for batch in slices(batches, "text", SLICE_BYTES):
            x = own.features(*buffers(batch.column("text"))).astype(np.float32)
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows], ["id", "features"])

    return texts(docs, id_col, text_col).mapInArrow(run, "id bigint, features array<float>")


_kept: dict = {}


def _worker(parts: tuple[bytes, bytes]) -> Distance:
    key = hash(parts)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Distance(*parts)
    return _kept[key]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: means, scales and weights (the last: intercept)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
    return mean, scale, w


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, max_docs: int = MAX_DOCS, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    distance = dictionaries(docs, labels, id_col, text_col, label_col, max_docs)
    if distance is None:
        toxic, n = _labelled(labels, id_col, label_col).agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
        got = texts(docs, id_col, text_col).select(F.col("id").alias("doc_id"), F.lit((toxic + 0.5) / (n + 1)).alias("score"))
    else:
        seen = checkpoint(measured(docs, distance, id_col, text_col))
        marked = _labelled(labels, id_col, label_col).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
        rows = seen.join(F.broadcast(marked), "id").orderBy(F.xxhash64("id"), "id", "y", "features").limit(max_rows).toArrow()
        y = rows["y"].to_numpy().astype(float)
        mean, scale, w = calibrate(rows["features"].combine_chunks().flatten().to_numpy().reshape(len(y), N_FEATURES).astype(float), y)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, N_FEATURES)
                margin = ((x - mean) / scale * w[:-1]).sum(1) + w[-1]  # row by row, so that a score doesn't depend on its batch
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["doc_id", "score"])

        got = seen.mapInArrow(run, "doc_id bigint, score double")
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
