"""Tables of immutable Parquet batches with row identity.

A table is a folder of batches and a versioned manifest that lists those that count. Each
statement writes a batch of its own and publishes it in the manifest, so that concurrent inserts
don't meet and readers see whole batches only. A row's identity is its batch's number and its
place there. Deletes add identities to batches of their own, which a scan leaves out by an
anti-join: broadcast while the manifest counts few of them, shuffled beyond.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Code, EngineError
from ..plans.bound import Relation
from .store import Folder, Versions

PAGE, SLOT = "_tid_page", "_tid_slot"
_IDENTITY = T.StructType([T.StructField(PAGE, T.LongType()), T.StructField(SLOT, T.LongType())])
#: Deleted identities (16 bytes each) that a scan broadcasts at most.
BROADCAST_DELETES = 1_000_000


@dataclass(frozen=True)
class TupleId:
    page_id: int
    slot_idx: int


class TableFormat(Protocol):
    """What a table format offers; a catalog opens tables by a factory of these."""

    def schema(self) -> Relation: ...
    def dataframe(self, identity: bool = False) -> DataFrame: ...
    def insert_rows(self, rows: Iterable[tuple]) -> list[TupleId]: ...
    def delete(self, ids: TupleId | Iterable[TupleId]) -> None: ...
    def update(self, tid: TupleId, row: tuple) -> TupleId: ...
    def drop(self) -> None: ...


def row_bytes(relation: Relation, row: tuple) -> int:
    """Size of a row in the compatibility format: count, null bitmap, offset and length a column, payload."""
    n = len(relation.columns)
    payload = sum(0 if v is None else c.type.fixed_size or len(str(v).encode()) for c, v in zip(relation.columns, row, strict=True))
    return 4 + -(-n // 8) + 8 * n + payload


class ParquetTable:
    """``max_row_bytes`` turns on the row size limit: rows before an oversize one stay, as page stores have it."""

    def __init__(self, spark: SparkSession, relation: Relation, path: str, max_row_bytes: int | None = None):
        self.spark, self.relation, self.path, self.max_row_bytes = spark, relation, path.rstrip("/"), max_row_bytes
        self._manifest = Versions(Folder(spark, f"{self.path}/manifest"), {"next": 1, "batches": [], "deletes": []})
        self._columns = T.StructType([T.StructField(c.name, c.type.spark) for c in relation.columns])

    def schema(self) -> Relation:
        return self.relation

    # --- reading

    def dataframe(self, identity: bool = False) -> DataFrame:
        """All live rows; with ``identity`` also (_tid_page, _tid_slot). Lazy, pruned and pushed down to the files."""
        state = self._manifest.read()
        stored = T.StructType([T.StructField(f"c{c.number}", c.type.spark) for c in self.relation.columns] + _IDENTITY.fields)
        names = [F.col(f"c{c.number}").alias(c.name) for c in self.relation.columns]
        paths = [f"{self.path}/{b['path']}" for b in state["batches"]]
        rows = self.spark.read.schema(stored).parquet(*paths) if paths else self.spark.createDataFrame([], stored)
        if state["deletes"]:
            gone = self.spark.read.schema(_IDENTITY).parquet(*(f"{self.path}/{d['path']}" for d in state["deletes"]))
            if sum(d["rows"] for d in state["deletes"]) <= BROADCAST_DELETES:
                gone = F.broadcast(gone)
            rows = rows.join(gone, [PAGE, SLOT], "left_anti")
        return rows.select(*names, *([PAGE, SLOT] if identity else []))

    def scan(self) -> list[tuple]:
        return [tuple(r) for r in self.dataframe().collect()]

    def scan_rows(self) -> Iterator[tuple[TupleId, tuple]]:
        """Rows with their identity in its order, a partition at a time."""
        ordered = self.dataframe(True).orderBy(PAGE, SLOT)
        for r in ordered.toLocalIterator():
            yield TupleId(r[-2], r[-1]), tuple(r[:-2])

    # --- writing

    def _check(self, row: tuple) -> None:
        if len(row) != len(self.relation.columns):
            raise EngineError(Code.InvalidArgument, f"row has {len(row)} values, table '{self.relation.name}' {len(self.relation.columns)} columns")
        for c, v in zip(self.relation.columns, row, strict=True):
            if v is None and not c.nullable:
                raise EngineError(Code.InvalidArgument, f"NULL in non-nullable column '{c.name}'")

    def insert_rows(self, rows: Iterable[tuple]) -> list[TupleId]:
        """Adds rows as one batch, all or none (but see ``max_row_bytes``); returns their identities."""
        rows = [tuple(r) for r in rows]
        fit = rows
        if self.max_row_bytes is not None:
            over = next((i for i, r in enumerate(rows) if row_bytes(self.relation, r) > self.max_row_bytes), None)
            fit = rows[:over]
        for r in fit:
            self._check(r)
        out: list[TupleId] = []
        if fit:
            out, batch = self._stage(fit)
            self._manifest.change(lambda s: s["batches"].append(batch))
        if len(fit) < len(rows):
            raise EngineError(Code.OutOfMemory, f"row of more than {self.max_row_bytes} bytes")
        return out

    def _stage(self, rows: list[tuple]) -> tuple[list[TupleId], dict]:
        """Writes rows as a batch that no manifest lists yet."""
        page = self._reserve()
        stored = T.StructType([T.StructField(f"c{c.number}", c.type.spark, c.nullable) for c in self.relation.columns] + _IDENTITY.fields)
        try:
            frame = self.spark.createDataFrame([Row(*r, page, i) for i, r in enumerate(rows)], stored)
        except Exception as e:
            raise EngineError(Code.InvalidArgument, f"a row doesn't fit table '{self.relation.name}': {e}") from e
        return [TupleId(page, i) for i in range(len(rows))], self._written(frame.coalesce(1), page, len(rows))

    def insert(self, row: tuple) -> TupleId:
        return self.insert_rows([row])[0]

    def append(self, frame: DataFrame) -> int:
        """Adds a DataFrame with the table's columns, by name, as one batch, without gathering it; returns the batch number."""
        by_name = {n.lower(): n for n in frame.columns}
        missing = [c.name for c in self.relation.columns if c.name.lower() not in by_name]
        if missing:
            raise EngineError(Code.InvalidArgument, f"no column {missing[0]!r}")
        columns = []
        for c in self.relation.columns:
            given = F.col(f"`{by_name[c.name.lower()]}`").cast(c.type.spark)
            columns.append((given if c.nullable else F.when(given.isNotNull(), given).otherwise(F.raise_error(F.lit(f"NULL in non-nullable column '{c.name}'")).cast(c.type.spark))).alias(f"c{c.number}"))
        page = self._reserve()
        batch = self._written(frame.select(*columns, F.lit(page).cast("bigint").alias(PAGE), F.monotonically_increasing_id().alias(SLOT)), page, None)
        self._manifest.change(lambda s: s["batches"].append(batch))
        return page

    def delete(self, ids: TupleId | Iterable[TupleId]) -> None:
        """Marks rows as gone; NotFound, and nothing changed, if one isn't there."""
        ids = {ids} if isinstance(ids, TupleId) else set(ids)
        gone = self._found(ids)
        mark = self._marked(gone, len(ids))
        self._manifest.change(lambda s: s["deletes"].append(mark))

    def _found(self, ids: set[TupleId]) -> DataFrame:
        """The identities as a frame; NotFound if one isn't there."""
        gone = self.spark.createDataFrame([(t.page_id, t.slot_idx) for t in sorted(ids, key=lambda t: (t.page_id, t.slot_idx))], _IDENTITY)
        if self.dataframe(True).join(F.broadcast(gone) if len(ids) <= BROADCAST_DELETES else gone, [PAGE, SLOT], "left_semi").count() != len(ids):
            raise EngineError(Code.NotFound, "no such row")
        return gone

    def delete_where(self, frame: DataFrame) -> int:
        """Marks all rows of ``frame``, a filter of ``dataframe(identity=True)``, as gone; returns how many."""
        gone = frame.select(PAGE, SLOT)
        n = gone.count()
        if n:
            mark = self._marked(gone, n)
            self._manifest.change(lambda s: s["deletes"].append(mark))
        return n

    def _marked(self, gone: DataFrame, n: int) -> dict:
        """Writes identities that no manifest lists as deleted yet."""
        path = f"deletes/{uuid.uuid4().hex}"
        gone.write.parquet(f"{self.path}/{path}")
        return {"path": path, "rows": n}

    def update(self, tid: TupleId, row: tuple) -> TupleId:
        """A delete and an insert in one change of the manifest; the row gets a new identity."""
        self._check(tuple(row))
        if self.max_row_bytes is not None and row_bytes(self.relation, tuple(row)) > self.max_row_bytes:
            raise EngineError(Code.OutOfMemory, f"row of more than {self.max_row_bytes} bytes")
        mark = self._marked(self._found({tid}), 1)
        (new,), batch = self._stage([tuple(row)])

        def edit(state: dict[str, Any]) -> None:
            state["deletes"].append(mark)
            state["batches"].append(batch)

        self._manifest.change(edit)
        return new

    def compact(self) -> None:
        """Rewrites all live rows, with their identities, as one batch without deletes."""
        before = self._manifest.read()
        path = f"batches/{uuid.uuid4().hex}"
        stored = [F.col(f"`{c.name}`").alias(f"c{c.number}") for c in self.relation.columns]
        self.dataframe(True).select(*stored, PAGE, SLOT).write.parquet(f"{self.path}/{path}")

        def edit(state: dict[str, Any]) -> None:
            if any(x not in state[k] for k in ("batches", "deletes") for x in before[k]):
                raise EngineError(Code.ExecutorError, "another compaction came first")
            state["batches"] = [{"path": path, "rows": None}, *(b for b in state["batches"] if b not in before["batches"])]
            state["deletes"] = [d for d in state["deletes"] if d not in before["deletes"]]

        self._manifest.change(edit)

    def drop(self) -> None:
        Folder(self.spark, self.path).delete()

    def _reserve(self) -> int:
        state = self._manifest.change(lambda s: s.update(next=s["next"] + 1))
        return state["next"] - 1

    def _written(self, frame: DataFrame, page: int, rows: int | None) -> dict:
        path = f"batches/{page}-{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/{path}")
        return {"path": path, "rows": rows}
