"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learnt by cyclic boosting: round after round, one
feature after the other, a tree of at most three cuts is fitted to the gradient of the log loss
and added, shrunk, to that feature's table. The pairs of features whose joint cuts explain most
of what is left get tables of their own in the same way. A score is the logistic function of the
sum of one bin of each table.

Features come from the whole text's bytes, words and lines alone. The model is fitted on the
driver to a bounded sample of labelled rows (``max_rows``, lowest hashes of the id first);
features and scores are computed on the executors, in one map pass each.

Defined results: null texts are empty; empty texts get the score of a document whose counts are
all zero; without labels every score is 0.5, with labels of one class it is that class's smoothed
share; null or other label values are left out; repeated rows are scored alike; a null id is
carried and belongs to fold 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import buffers, checkpoint, fold, slices, texts

FOLDS = 5
THRESHOLD = 0.3
MAX_ROWS = 20_000
SLICE_BYTES = 4 << 20
FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "short_words", "distinct_words", "repeated_trigrams",
    "lower", "upper", "digit", "space", "punctuation", "bang", "symbol", "non_ascii", "log_lines", "line_length", "repeated_lines", "ended_lines",
]
_CLASSES = 8


def _classes() -> np.ndarray:
    of = np.full(256, 6)  # other symbols
    of[128:] = 7
    of[97:123], of[65:91], of[48:58] = 0, 1, 2
    of[[32, *range(9, 14)]] = 3
    of[[ord(c) for c in ".,;:'\"()-"]] = 4
    of[[33, 63]] = 5
    return of.astype(np.int64)


_CLASS = _classes()
_LINE_END = np.arange(256) == 10
_SENTENCE_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _distinct(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    key = np.sort((text.astype(W.U) << W.U(40)) | (value >> W.U(24)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return W.counts((key[first] >> W.U(40)).astype(np.int64), n)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    start, end, of = W.spans(raw, offsets, W.white_space())
    word, length, many = W.hashes(raw, start, end), (end - start).astype(float), W.counts(of, n)
    total, square = np.bincount(of, length, n), np.bincount(of, length * length, n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    gram, at = W.grams(word, of, 3)
    n_grams = W.counts(of[at], n)
    line_start, line_end, line_of = W.spans(raw, offsets, _LINE_END)
    line, n_lines = W.hashes(raw, line_start, line_end), W.counts(line_of, n)
    ended = np.bincount(line_of, _SENTENCE_END[raw[line_end - 1]] if len(line_end) else None, n)
    some, lines, grams, bytes_ = (np.maximum(x, 1) for x in (many, n_lines, n_grams, size))
    mean = total / some
    return np.column_stack((
        np.log1p(size), np.log1p(many), mean, np.sqrt(np.maximum(square / some - mean * mean, 0)), np.log1p(longest), np.bincount(of, length <= 2, n) / some,
        _distinct(of, word, n) / some, 1 - (_distinct(of[at], gram, n) + (n_grams == 0)) / grams,
        *(kinds / bytes_[:, None]).T, np.log1p(n_lines), np.log1p(size / lines), 1 - (_distinct(line_of, line, n) + (n_lines == 0)) / lines, ended / lines,
    ))


@dataclass
class Gam:
    """Additive lookup tables: one a feature, one a chosen pair of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _quantiles(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, n) / n))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, float]:
    """The best place to cut a row of bins in two, and the gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0, 0.0
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return k + 1, float(gain[k])


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """The values by bin of a tree of that depth."""
    k, gain = _cut(g, h, ridge) if depth else (0, 0.0)
    if not k or gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate((_tree(g[:k], h[:k], ridge, depth - 1), _tree(g[k:], h[k:], ridge, depth - 1)))


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut in both directions of a table of bins: the four quadrants' values, and the gain."""
    cg, ch = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))
    best, out = -1.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            gain = sum(a * a / (b + ridge) for a, b in zip(*parts, strict=True))
            if gain > best:
                value = [a / (b + ridge) for a, b in zip(*parts, strict=True)]
                best = gain
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 6, rounds: int = 120, pair_rounds: int = 30, n_pairs: int = 5, rate: float = 0.1, ridge: float = 5.0) -> Gam:
    """Fits the tables to rows ``x`` (finite) and labels ``y`` (0 or 1)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    n_features = x.shape[1]
    model.edges = [_quantiles(x[:, j], bins) for j in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_quantiles(x[:, j], coarse_bins) for j in range(n_features)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    margin = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n_features):
            g, h = slope()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), ridge)
            model.tables[j] += step
            margin += step[at[j]]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slope()
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell = low[a] * shape[1] + low[b]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = sorted(((_cross(*grid(a, b)[1:], ridge)[1], a, b) for a in range(n_features) for b in range(a) if len(model.coarse[a]) and len(model.coarse[b])), reverse=True)
    chosen = {(a, b): np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for _, a, b in gains[:n_pairs]}
    for _ in range(pair_rounds):
        for (a, b), values in chosen.items():
            cell, g, h = grid(a, b)
            step = rate * _cross(g, h, ridge)[0]
            values += step
            margin += step.ravel()[cell]
    model.pairs = [(a, b, v) for (a, b), v in chosen.items()]
    return model


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of every document, in one map pass."""
    schema = pa.schema([("id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            x = features(*buffers(batch.column("text"))).astype(np.float32)
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "id bigint, features array<float>")


def _marked(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, y) of the labelled rows that the model may be fitted to."""
    marked = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    return marked.where((fold(F.col("id"), FOLDS) != 0) & F.col("y").isin(0, 1)).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)


def train(seen: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Fits the model to at most ``max_rows`` labelled rows outside fold 0 of ``measured`` documents."""
    rows = seen.join(F.broadcast(_marked(labels, id_col, label_col, max_rows)), "id").orderBy(F.xxhash64("id"), "id", "y", "features").limit(max_rows).toArrow()
    y = rows["y"].to_numpy().astype(float)
    x = rows["features"].combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, y)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    seen = checkpoint(measured(docs, id_col, text_col))
    model = train(seen, labels, id_col, label_col, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], ["doc_id", "score"])

    got = seen.mapInArrow(run, "doc_id bigint, score double")
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents, with all their columns, that score at the threshold or above.

    Features are worked out for the labelled rows to fit the model, and then once for every text.
    """
    ids = F.broadcast(_marked(labels, id_col, label_col, max_rows).select("id").distinct())
    own = texts(docs, id_col, text_col).join(ids, "id", "left_semi")
    model = train(measured(own, "id", "text"), labels, id_col, label_col, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE_BYTES):
            x = features(*buffers(batch.column(text_col))).astype(np.float32)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
