"""What the operators share: the recovery folder, input normalisation and batch slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where neither the setting nor the context has one, on a local master, a local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
    return named or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it from there; no lineage is left."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"{name}_{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, so that no other column of the input can clash with a working column."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that each slice holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(text_col))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: What a null id is for working steps: the largest.
NO_ID = 2**63 - 1


class Tagged(NamedTuple):
    rows: DataFrame
    count: int
    bytes: int
    repeats: bool


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagged:
    """(id, tag, text) with the number of rows, their bytes of text and whether some id repeats.

    A null id becomes NO_ID and a null text empty. ``tag`` tells rows of one id apart by their
    text; it is 0 throughout unless some id repeats.
    """
    rows = texts(docs, id_col, text_col).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n, distinct, size = rows.agg(F.count("*"), F.countDistinct("id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tag = F.lit(0).cast("bigint") if n == distinct else F.xxhash64("text")
    return Tagged(rows.select("id", tag.alias("tag"), "text"), n, size, n != distinct)


#: log2 of the bits of a key filter (1 MB); a full one only lets more pass.
FILTER = 23


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit table of a fixed size of the keys; whatever passes it is still joined exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER, bool)
        for batch in batches:
            bits[_bit(batch.column(0).fill_null(-1).to_numpy())] = True
        if bits.any():
            words = np.packbits(bits, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["at", "bits"])

    rows = keys.select(column).mapInArrow(run, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER) // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _bit(keys: np.ndarray) -> np.ndarray:
    return (W.mix(keys.astype(np.int64).view(W.U)) & W.U((1 << FILTER) - 1)).astype(np.int64)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = _bit(keys)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
