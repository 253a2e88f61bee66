"""Token counts as delta-maintained rollups.

A rollup keeps additive totals (documents, tokens, bytes) by source, language and tokenizer
version. It is fed with batches of signed changes: an insert adds a document's counts, a delete
takes them away, a revision takes away the counts that were booked and adds the new ones. A
batch is first summed by key on the executors; only these sums are written, to a folder that
nobody reads yet. Then one small file with the batch's name is created, which fails if it is
there: of several writers of a batch one books it, and a job that is repeated after a failure
can't count twice. ``compact`` sums the batches so far into one folder, under a file of its own
that says which ones it holds.

Defined results: null texts count no tokens and no bytes but are documents; null source or
language are keys of their own; repeated rows count as often as they stand there; an empty batch
commits and changes nothing; totals that come to zero documents and zero tokens disappear.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Folder
from .common import buffers, slices

KEY = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint"
SLICE_BYTES = 4 << 20
#: The split pattern that belongs to the byte-level vocabularies (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encodings: dict = {}


def encoding(ranks: bytes | dict, name: str):
    """The tokenizer, built once in each Python worker."""
    if name not in _encodings:
        import tiktoken

        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def count(docs: DataFrame, vocabulary: str, version: str, sign: str | None = None, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Signed sums by key of one change set; ``sign`` names a column of +1 and -1 (default: all +1).

    The vocabulary is read on the driver and goes to the executors by broadcast (about 1 MB,
    fixed by the file). Each worker sums its batches, so that a key sends a row per batch only.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = docs.select(
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        (F.coalesce(F.col(f"`{sign}`").cast("bigint"), F.lit(1)) if sign else F.lit(1).cast("bigint")).alias("sign"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(held.value, version).encode_ordinary
        for batch in slices(batches, "text", SLICE_BYTES):
            sign = batch.column("sign")
            _, offsets = buffers(batch.column("text"))
            tokens = pa.array([len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            sizes = pa.array(offsets[1:] - offsets[:-1], pa.int64())
            got = pa.table({"source": batch.column("source"), "lang": batch.column("lang"), "n_docs": sign, "n_tokens": pc.multiply(tokens, sign), "n_bytes": pc.multiply(sizes, sign)}).group_by(["source", "lang"]).aggregate([(c, "sum") for c in SUMS])
            n = got.num_rows
            yield pa.RecordBatch.from_arrays([got["source"].combine_chunks(), got["lang"].combine_chunks(), pa.array([version] * n, pa.string()), *(got[f"{c}_sum"].combine_chunks().cast(pa.int64()) for c in SUMS)], names=[*KEY, *SUMS])

    return _sum(rows.mapInArrow(run, DELTA))


def _sum(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS))


class Rollup:
    """Totals in a folder of the shared store: ``batches`` names what is booked, ``snapshots`` what is summed up, ``data`` has the sums."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, self.path)

    @staticmethod
    def _name(batch_id: str) -> str:
        return base64.urlsafe_b64encode(batch_id.encode()).decode().rstrip("=") or "-"

    def committed(self, batch_id: str) -> bool:
        return self._name(batch_id) in self._folder.names("batches")

    def _write(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Books the signed sums under ``batch_id``; False, and nothing booked, if that batch already is."""
        if self.committed(batch_id):
            return False
        changes = [c.select(*KEY, *SUMS) for c in changes] or [self.spark.createDataFrame([], DELTA)]
        data = self._write(_sum(reduce(DataFrame.unionByName, changes)))
        if self._folder.create(f"batches/{self._name(batch_id)}", data):
            return True
        self._folder.delete(f"data/{data}")
        return False

    def _state(self) -> tuple[dict, list[str]]:
        """The last snapshot, and the booked batches that it doesn't hold."""
        booked = self._folder.names("batches")
        numbers = self._folder.names("snapshots")
        last = json.loads(self._folder.read(f"snapshots/{numbers[-1]}")) if numbers else {"data": None, "batches": []}
        return last, sorted(set(booked) - set(last["batches"]))

    def _booked(self) -> DataFrame:
        last, more = self._state()
        data = [x for x in [last["data"], *(self._folder.read(f"batches/{b}") for b in more)] if x]
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/data/{d}" for d in data)) if data else self.spark.createDataFrame([], DELTA)
        return _sum(rows)

    def compact(self) -> bool:
        """Sums all booked batches into one snapshot; False if another one came first. Batches stay known by name."""
        last, more = self._state()
        data = self._write(self._booked())
        number = len(self._folder.names("snapshots")) + 1
        if self._folder.create(f"snapshots/{number:012d}", json.dumps({"data": data, "batches": [*last["batches"], *more]})):
            return True
        self._folder.delete(f"data/{data}")
        return False

    def totals(self) -> DataFrame:
        return self._booked().where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0) | (F.col("n_bytes") != 0))


def revision(before: DataFrame, after: DataFrame) -> list[DataFrame]:
    """The change set that replaces the counts ``before`` by ``after``."""
    return [negated(before), after]


def negated(counts: DataFrame) -> DataFrame:
    """The change set that takes the counts away."""
    return counts.select(*KEY, *((-F.col(c)).alias(c) for c in SUMS))
