"""Embedding near-duplicates: an exact range join by cosine in metric cells.

Unit vectors are points; cosine of ``COSINE`` or more is a chord of at most r = sqrt(2 - 2 COSINE).
Equal vectors are one point with a weight. Points are also seen in a projection to their ``AXES``
leading principal axes (fitted to at most ``FIT`` points, those of least hash). A projection never
makes a distance longer, so that points within r stay within r there, and what it tells apart is
apart.

In the projection pivots split the points into cells by nearest pivot. Their number follows the
number of points, from ``LEAST_PIVOTS`` up; where a cell still holds more than ``PART`` points,
more pivots are sampled from it. A point can have partners in another cell only if it lies within
r of the border and of the ball around that cell's points; by the triangle inequality and its form
for bisectors,

    d(x, other) - d(x, own) <= 2 r
    (d(x, other)^2 - d(x, own)^2) / (2 d(own, other)) <= r
    d(x, other) <= radius(other) + r

must all hold, and only then it is copied there. Cells are numbered, and a point is only copied
to cells of higher numbers, so that two points meet in one cell. Each cell works alone: it
compares its own points with each other and with the copies, counts for both, and needs nothing
of other cells. Inside a cell, blocks whose distances to the pivot differ by more than r are
passed over, then pairs that the projection tells apart; what is left is multiplied in double
precision. No pairs are written: a cell gives counts by point and links that join the components
of what it holds, at most one a point and a few more.

What is sent depends on the data. Where vectors are clustered a point goes to few cells. In many
dimensions without clusters every cell, however it is cut, lies within r of most points (README
has figures), and copies and comparisons grow with the number of cells.

At most ``MOST_PIVOTS`` pivots (2 MB) go to the executors; a cell that holds more than ``PART``
points even so is dealt in parts of its own points, each of which gets the copies.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers link with
nothing; vectors of unlike lengths never link; repeated rows are vectors of their own; a null id
never names a component unless all ids of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import checkpoint, partitions
from .components import connected

COSINE = 0.95
#: Own points that a task holds at most (32 MB at 64 numbers each).
PART = 65_536
LEAST_PIVOTS, MOST_PIVOTS = 4, 16_384
#: Principal axes of the projection, and points that they are fitted to.
AXES, FIT = 16, 4096
#: Rounds of sampling more pivots in large cells.
ROUNDS = 3
#: What rounding may add to a distance; it only lets more pass.
_SLACK = 1e-6


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, point) with the unit vector's bytes, null where the vector can't link."""
    for batch in batches:
        column = batch.column("vector")
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        end = np.cumsum(size)
        out: list[bytes | None] = [None] * len(size)
        for n in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == n)
            x = flat[(end[rows] - n)[:, None] + np.arange(n)]
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(1, keepdims=True)  # so that squares can't overflow
                x = x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0
            for i in np.flatnonzero(np.isfinite(x).all(1)):
                out[rows[i]] = x[i].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "point"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), size)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


def axes(x: np.ndarray) -> np.ndarray:
    """The leading principal axes of points, as orthonormal columns."""
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES])


def _homes(pivots: np.ndarray, basis: np.ndarray, share: np.ndarray | None = None):
    """(cell, d) of every point; with ``share`` the points that a hash picks, that share of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                d = _distances(_matrix(batch.column("point"), len(basis)) @ basis, pivots)
                home = d.argmin(1)
                point = pa.nulls(len(d), pa.binary()) if share is None else batch.column("point")
                out = pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home]), point], ["cell", "d", "point"])
                if share is not None:
                    luck = W.mix(batch.column("key").to_numpy().view(W.U) ^ W.U(0x5EED)) / 2.0**64
                    out = out.filter(pa.array(luck < share[home]))
                yield out

    return run


def near_cells(d: np.ndarray, home: np.ndarray, between: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which cells may hold partners of points with distances d from the pivots; a point's own cell always."""
    n = np.arange(len(d))
    own = d[n, home][:, None]
    apart = between[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        border = (d * d - own * own) / (2 * apart) <= reach
    near = (d - own <= 2 * reach) & (border | (apart <= 2 * _SLACK)) & (d <= radius + reach)
    near[n, home] = True
    return near


def _deal(pivots: np.ndarray, basis: np.ndarray, radius: np.ndarray, parts: np.ndarray, reach: float):
    """Each point to its own cell's part, and to the parts of later cells, and later parts of its cell, where it may have partners."""
    between = _distances(pivots, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                d = _distances(_matrix(batch.column("point"), len(basis)) @ basis, pivots)
                n = np.arange(len(d))
                home = d.argmin(1)
                mine = (W.mix(batch.column("key").to_numpy().view(W.U)) % parts[home].astype(W.U)).astype(np.int64)
                near = near_cells(d, home, between, radius, reach) & (np.arange(len(pivots)) >= home[:, None])
                row, cell = np.nonzero(near)
                part = W.ragged(np.zeros(len(row), np.int64), parts[cell])
                row, cell = np.repeat(row, parts[cell]), np.repeat(cell, parts[cell])
                later = (cell > home[row]) | (part > mine[row])
                row, cell, part = row[later], cell[later], part[later]
                rows = np.concatenate((n, row))
                task = np.concatenate((home << 32 | mine, cell << 32 | part))
                role = np.repeat(np.array([0, 1], np.int8), [len(n), len(row)])
                dist = np.concatenate((d[n, home], d[row, cell]))
                for x in range(0, len(rows), 8192):
                    pick = pa.array(rows[x : x + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(task[x : x + 8192]), pa.array(role[x : x + 8192]), pa.array(dist[x : x + 8192]), *(batch.column(c).take(pick) for c in ("key", "weight", "point"))], ["task", "role", "d", "key", "weight", "point"])

    return run


def _counts(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(count), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["key", "n_links", "a", "b"])


class _Part:
    """The own points of one task, their counts, and labels that tell which are joined so far."""

    def __init__(self, table: pa.Table, basis: np.ndarray, cosine: float):
        self.basis, self.cosine = basis, cosine
        self.reach = np.sqrt(2 - 2 * cosine) + _SLACK
        order = np.argsort(table["d"].to_numpy(), kind="stable")
        self.x = _matrix(table["point"].combine_chunks(), len(basis))[order]
        self.key, self.d, self.weight = (table[c].to_numpy()[order] for c in ("key", "d", "weight"))
        self.low = self.x @ basis
        self.square = (self.low * self.low).sum(1)
        self.count, self.label = np.zeros(len(order), np.int64), np.arange(len(order))
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def among(self) -> None:
        """The own points meet each other."""
        for a in range(0, len(self.key), 256):
            b = slice(a, a + 256)
            for _ in self.meet(self.key[b], self.weight[b], self.d[b], self.x[b], self.low[b]):
                pass

    def meet(self, key, weight, d, x, low=None) -> Iterator[pa.RecordBatch]:
        """Counts and links of the own points with a block of others; counts of the others, if they are copies."""
        copies = low is None
        low = x @ self.basis if copies else low
        a, b = np.searchsorted(self.d, d.min() - self.reach), np.searchsorted(self.d, d.max() + self.reach, "right")
        for top in range(a, b, 4096):
            rows = slice(top, min(top + 4096, b))
            close = self.square[rows, None] + (low * low).sum(1) - 2 * (self.low[rows] @ low.T) <= self.reach * self.reach
            some = close.any(0)
            if not some.any():
                continue
            mine = top + np.flatnonzero(close.any(1))
            hit = (self.x[mine] @ x[some].T >= self.cosine) & (self.key[mine, None] != key[some])
            if not hit.any():
                continue
            self.count[mine] += hit @ weight[some]
            self._join(mine, key[some], hit)
            if copies:
                yield _counts(key[some], self.weight[mine] @ hit)

    def _join(self, mine: np.ndarray, key: np.ndarray, hit: np.ndarray) -> None:
        some = hit.any(0)
        hit, key, none = hit[:, some], key[some], len(self.label)
        while True:
            label = self.label[mine]
            least = np.where(hit, label[:, None], none).min(0)
            new = np.minimum(label, np.where(hit, least, none).min(1))
            moved = new < label
            if not moved.any():
                break
            self.links.append((self.key[label[moved]], self.key[new[moved]]))
            self.label[mine] = new
        self.links.append((key, self.key[least]))

    def results(self) -> Iterator[pa.RecordBatch]:
        yield _counts(self.key, self.count)
        if self.links:
            a, b = (np.concatenate(x) for x in zip(*self.links, strict=True))
            pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            n = len(pair)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["key", "n_links", "a", "b"])


def _cells(basis: np.ndarray, cosine: float):
    """Rows sorted by task, role and distance: the own points first, then blocks of the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, part = None, [], None

        def built() -> _Part | None:
            if part is not None or not own:
                return part
            new = _Part(pa.Table.from_batches(own), basis, cosine)
            new.among()
            return new

        def done() -> Iterator[pa.RecordBatch]:
            last = built()
            if last is not None:
                yield from last.results()

        for batch in batches:
            task, role = batch.column("task").to_numpy(), batch.column("role").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (role[1:] != role[:-1]), [True])))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if task[a] != now:
                    yield from done()
                    now, own, part = task[a], [], None
                if role[a] == 0:
                    own.append(batch.slice(a, b - a))
                    continue
                part = built()
                for x in range(a, b if part is not None else a, 256):
                    block = batch.slice(x, min(256, b - x))
                    yield from part.meet(*(block.column(c).to_numpy() for c in ("key", "weight", "d")), _matrix(block.column("point"), len(basis)))
        yield from done()

    return run


def n_pivots(n: int) -> int:
    """Several cells from the start; with the square root of the points, and by ``PART`` where that asks for more."""
    return min(max(LEAST_PIVOTS, int(n**0.5) // 14, -(-2 * n // PART)), MOST_PIVOTS, max(n, 1))


def split(mine: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The projection, and the pivots with their cells' radius and number of points."""
    n = mine.count()
    k = n_pivots(n)
    sampled = _matrix(mine.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(max(k, FIT)).select("point").toArrow()["point"].combine_chunks(), size)
    basis = axes(sampled[:FIT])
    pivots = sampled[:k] @ basis
    for left in range(ROUNDS, -1, -1):
        radius, count = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        for r in mine.mapInArrow(_homes(pivots, basis), "cell int, d double, point binary").groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():
            radius[r.cell], count[r.cell] = r.r, r.n
        wanted = np.where(count > PART, 2.0 * count / PART, 0.0)
        room = MOST_PIVOTS - len(pivots)
        if not left or not wanted.any() or room <= 0:
            return basis, pivots, radius, count
        share = wanted * min(1.0, room / wanted.sum()) / np.maximum(count, 1)
        more = mine.mapInArrow(_homes(pivots, basis, share), "cell int, d double, point binary").limit(room).select("point").toArrow()["point"].combine_chunks()
        pivots = np.concatenate((pivots, _matrix(more, size) @ basis))
    raise AssertionError


def deal(mine: DataFrame, size: int, cosine: float) -> tuple[DataFrame, np.ndarray, int]:
    """The points with their copies (task, role, d, key, weight, point), the projection, and the number of tasks."""
    basis, pivots, radius, count = split(mine, size)
    parts = np.maximum(-(-count // PART), 1)
    dealt = mine.mapInArrow(_deal(pivots, basis, radius, parts, np.sqrt(2 - 2 * cosine) + _SLACK), "task bigint, role tinyint, d double, key bigint, weight bigint, point binary")
    return dealt, basis, int(parts.sum())


def _of_length(points: DataFrame, size: int, cosine: float) -> DataFrame:
    """(key, n_links, a, b): counts by point and links of points of one length."""
    mine = points.where(F.octet_length("point") == 8 * size)
    dealt, basis, tasks = deal(mine, size, cosine)
    ordered = dealt.repartition(max(partitions(points.sparkSession), tasks), "task").sortWithinPartitions("task", "role", "d")
    return ordered.mapInArrow(_cells(basis, cosine), "key bigint, n_links bigint, a bigint, b bigint")


def distinct_points(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(id, digest) of every row, digest null where the vector can't link, and the points (digest, first, weight, point, key)."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    seen = rows.mapInArrow(_points, "id bigint, point binary").withColumn("digest", F.unhex(F.sha2("point", 256)))
    seen = checkpoint(seen)
    points = seen.where("point is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.min("point").alias("point"))
    return seen.select("id", "digest"), checkpoint(points.withColumn("key", F.monotonically_increasing_id()))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    seen, points = distinct_points(vectors, id_col, vector_col)
    sizes = [r.n for r in points.select((F.octet_length("point") / 8).cast("int").alias("n")).distinct().collect()]
    found = None
    for size in sizes:
        got = _of_length(points, size, cosine)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return seen.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = checkpoint(found)
    component = connected(found.where("a is not null").select("a", "b"))
    count = found.where("key is not null").groupBy("key").agg(F.sum("n_links").alias("n_links"))
    of_point = points.select("key", "digest", "first", "weight").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = of_point.groupBy("root").agg(F.min("first").alias("component_id"))
    of_point = of_point.join(least, "root").join(count, "key", "left").select("digest", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = seen.join(of_point, "digest", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))
