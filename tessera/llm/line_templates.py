"""Line deduplication by log templates in a tree of fixed depth.

A line's tokens are its white-space separated words; a token with a digit is a variable field.
The tree's first level is the number of tokens, the next ``DEPTH`` levels are the leading tokens
(variable fields alike). What differs from the sequential parser of that kind is that no step
depends on the order of lines, so that the result is the same however the corpus is partitioned:
in a leaf that holds several distinct lines, a place behind the leading ones is constant if more
than half of its lines (each counted once a document) have the same token, or a field, there.
Lines that agree with the constants in a share of ``SIMILARITY`` of these places or more are one
template, whose other places are variable fields. The leading tokens are alike by construction and
don't count. The vote is repeated on the lines that are left over; where it gives no template,
they are split by their tokens at the place whose most frequent token has most votes (the first
such place, of those where the lines differ). It ends where fewer than ``MIN_DOCS`` documents or
a single line are left. Any other line is a template of its own, with its digit fields.

A template that occurs in ``MIN_DOCS`` documents or more recurs: its lines are dropped, all but
the first by document id and place. Lines without tokens stay.

Counts are aggregations by leaf, line or template, with map-side combination. Only lines of leaves
that recur take part, and of these only lines of leaves with several distinct lines send their
tokens; both are found by a bit filter of a fixed size, which may let more lines pass and changes
no result. Leaves (or parts of them) of up to ``LOCAL_TOKENS`` tokens are voted on to the end in one
task each; larger ones take a round of votes as aggregations and joins, until what is left of them
is that small. No join has the leaf alone for a key: what a vote decided goes to its lines by
broadcast while it has ``BROADCAST_ROWS`` rows or fewer, and else by a join salted by line.

Defined results: a null text is empty and has no lines; a null id counts as the largest; rows
that repeat an id are documents of their own, told apart by their text; rows that repeat id and
text are one document that stands there several times, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import NO_ID, Tagged, buffers, checkpoint, fresh, key_filter, partitions, passes, slices, tagged

DEPTH = 4
SIMILARITY = 0.7
MIN_DOCS = 10
SLICE_BYTES = 4 << 20
#: Rows (at most 32 bytes each) that a join broadcasts, and what a larger join spreads a key over.
BROADCAST_ROWS, SALTS = 1 << 16, 32
#: Tokens of a part's distinct lines (8 bytes each) that one task takes at a time.
LOCAL_TOKENS = 1 << 20
_LINE_END = np.arange(256) == 10
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
#: The hash of a variable field.
FIELD = W.seeds(1, 4242)[0]


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, number and number of tokens of each line that has tokens; the masked token hashes; each line's first token."""
    start, end, of = W.spans(raw, offsets, W.white_space())
    token = W.hashes(raw, start, end, False)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    token[digits[end] > digits[start]] = FIELD
    breaks = np.concatenate(([0], np.cumsum(raw == 10)))
    number = breaks[start] - breaks[offsets[of]]
    first = np.ones(len(token), bool)
    first[1:] = (of[1:] != of[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(first)
    return of[at], number[at], np.diff(np.append(at, len(token))), token, at


def _keys(n: np.ndarray, token: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf and masked line of each line, as hashes."""
    leaf = W.mix(n.astype(W.U))
    for k, seed in enumerate(W.seeds(depth, 99)):
        have = n > k
        leaf[have] = W.mix(leaf[have] ^ (token[at[have] + k] * (seed | W.U(1))))
    place = np.arange(len(token)) - np.repeat(at, n)
    parts = W.mix(token ^ W.mix(place.astype(W.U) + W.U(3)))
    total = np.concatenate((np.zeros(1, W.U), np.cumsum(parts, dtype=W.U)))
    return leaf, W.mix((total[at + n] - total[at]) ^ leaf)


def _wanted(table: np.ndarray):
    """The lines whose leaves the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(table, batch.column("leaf").to_numpy())))

    return run


def _parse(depth: int):
    """(id, tag, number, leaf, line) of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            of, number, n, token, at = _lines(*buffers(batch.column("text")))
            leaf, line = _keys(n, token, at, depth)
            pick = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("tag").take(pick), pa.array(number.astype(np.int32)), pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64))], ["id", "tag", "number", "leaf", "line"])

    return run


def _tokens(depth: int, wanted: np.ndarray):
    """(leaf, line, tokens) of the distinct lines of a slice whose leaves the filter lets pass; the tokens behind the leading ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            of, number, n, token, at = _lines(*buffers(batch.column("text")))
            leaf, line = _keys(n, token, at, depth)
            _, first = np.unique(line, return_index=True)
            pick = first[passes(wanted, leaf[first].view(np.int64)) & (n[first] > depth)]
            size = n[pick] - depth
            values = token[W.ragged(at[pick] + depth, size)]
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[pick].view(np.int64)), pa.array(line[pick].view(np.int64)), lists], ["leaf", "line", "tokens"])

    return run


def _told(lines: DataFrame, small: DataFrame, on: list[str], how: str, by: str = "line") -> DataFrame:
    """Joins lines with what was decided for their parts, however many lines a part has; ``by`` spreads them."""
    small = checkpoint(small)
    if small.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(small), on, how)
    salt = fresh("salt")
    many = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [*on, salt], how).drop(salt)


def voted(tokens: np.ndarray, docs: np.ndarray, part: int, similarity: float, min_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, lines) of each general template of a part: a row of tokens and a number of documents a line."""
    agenda = [(W.U(part), np.arange(len(docs)))]
    while agenda:
        name, lines = agenda.pop()
        if len(lines) < 2 or docs[lines].sum() < min_docs:
            continue
        mine, weight = tokens[lines], docs[lines]
        top, most = np.empty(mine.shape[1], np.int64), np.empty(mine.shape[1], np.int64)
        for place in range(mine.shape[1]):
            kinds, which = np.unique(mine[:, place], return_inverse=True)
            votes = np.bincount(which, weight).astype(np.int64)
            best = len(votes) - 1 - int(np.argmax(votes[::-1]))  # of equals the greatest token
            top[place], most[place] = kinds[best], votes[best]
        constant = 2 * most > weight.sum()
        same = (mine[:, constant] == top[constant]).sum(1)
        general = (same > 0) & (same >= similarity * mine.shape[1])
        if general.any():
            yield int(name.view(np.int64)), lines[general]
            agenda.append((W.mix(np.array([name ^ W.U(0xB0B)]))[0], lines[~general]))
            continue
        open_ = np.flatnonzero(most < weight.sum())
        if len(open_):
            place = int(open_[np.argmax(most[open_])])
            for token in np.unique(mine[:, place]):
                child = W.mix(np.array([name ^ W.mix(token[None].view(W.U) + W.U(place))[0]]))[0]
                agenda.append((child, lines[mine[:, place] == token]))


def _local(similarity: float, min_docs: int):
    """Rows sorted by part: all votes of each part."""

    def results(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        part, docs = int(table["part"][0].as_py()), table["docs"].to_numpy()
        tokens = table["tokens"].combine_chunks().flatten().to_numpy().reshape(len(docs), -1)
        for name, lines in voted(tokens, docs, int(np.array([part]).view(W.U)[0]), similarity, min_docs):
            pick = pa.array(lines)
            yield pa.RecordBatch.from_arrays([table["leaf"].combine_chunks().take(pick), table["line"].combine_chunks().take(pick), pa.array(np.full(len(lines), name))], ["leaf", "line", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            part = batch.column("part").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if part[a] != now and held:
                    yield from results(held)
                    held = []
                now = part[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from results(held)

    return run


def _general(told: DataFrame, similarity: float, min_docs: int) -> DataFrame:
    """(leaf, line, part) of the lines that belong to a general template; ``part`` names it."""
    rest = told.withColumn("part", F.col("leaf"))
    found = []
    while True:
        size = rest.groupBy("part").agg(F.sum("docs").alias("left"), F.count("*").alias("n"), F.sum(F.size("tokens")).alias("size")).where((F.col("left") >= min_docs) & (F.col("n") > 1))
        rest = checkpoint(_told(rest, size.select("part", (F.col("size") <= LOCAL_TOKENS).alias("small")), ["part"], "inner"))
        small = rest.where("small").select("part", "leaf", "line", "docs", "tokens").repartition(partitions(rest.sparkSession), "part").sortWithinPartitions("part")
        found.append(checkpoint(small.mapInArrow(_local(similarity, min_docs), "leaf bigint, line bigint, part bigint")))
        rest = rest.where("not small").drop("small")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        places = rest.select("part", "line", "docs", F.posexplode("tokens").alias("place", "token"))
        votes = places.groupBy("part", "place", "token").agg(F.sum("docs").alias("docs"))
        top = checkpoint(votes.groupBy("part", "place").agg(F.max(F.struct("docs", "token")).alias("top"), F.sum("docs").alias("all")))
        constant = top.where("2 * top.docs > all").select("part", "place", F.col("top.token").alias("token"))
        agree = _told(places, constant, ["part", "place", "token"], "left_semi").groupBy("part", "line").agg(F.count("*").alias("same"))
        judged = rest.join(agree, ["part", "line"], "left").withColumn("general", F.coalesce(F.col("same") >= F.lit(similarity) * F.size("tokens"), F.lit(False))).drop("same")
        judged = checkpoint(judged)
        found.append(judged.where("general").select("leaf", "line", "part"))
        # what a template left over is voted on again; a part without a template is split by the place whose first token has most votes
        state = judged.groupBy("part").agg(F.max("general").alias("has"))
        split = top.where("top.docs < all").groupBy("part").agg(F.max(F.struct("top.docs", -F.col("place"))).alias("best")).select("part", (-F.col("best.col2")).alias("place"))
        state = state.join(split, "part", "left").where("has or place is not null")
        child = F.when(F.col("has"), F.xxhash64("part", F.lit(len(found)))).otherwise(F.xxhash64("part", "place", F.get("tokens", F.col("place"))))
        rest = checkpoint(_told(judged.where(~F.col("general")).drop("general"), state, ["part"], "inner").withColumn("part", child).drop("has", "place"))


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> tuple[Tagged, DataFrame]:
    """The documents with their tags, and (id, tag, numbers) of the lines to drop."""
    own = tagged(docs, id_col, text_col)
    rows = own.rows
    shape = "id bigint, tag bigint, number int, leaf bigint, line bigint"
    parsed = checkpoint(rows.mapInArrow(_parse(depth), shape))
    in_docs = parsed.select("leaf", "id", "tag").distinct().groupBy("leaf").agg(F.count("*").alias("docs"))
    lines = checkpoint(parsed.mapInArrow(_wanted(key_filter(in_docs.where(F.col("docs") >= min_docs), "leaf")), shape))

    each = checkpoint(lines.select("leaf", "line", "id", "tag").distinct().groupBy("leaf", "line").agg(F.count("*").alias("docs")))
    several = each.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("docs")).where((F.col("n") > 1) & (F.col("docs") >= min_docs))
    told = rows.mapInArrow(_tokens(depth, key_filter(several, "leaf")), "leaf bigint, line bigint, tokens array<bigint>")
    told = checkpoint(told.groupBy("leaf", "line").agg(F.min("tokens").alias("tokens")).join(each, ["leaf", "line"]))
    members = _general(told, similarity, min_docs)

    # a general template is named by its part of the leaf, any other by its line
    named = lines.join(members, ["leaf", "line"], "left").select("id", "tag", "number", F.col("part").isNotNull().alias("general"), F.coalesce("part", "line").alias("template"))
    named = checkpoint(named)
    per_doc = named.groupBy("general", "template", "id", "tag").agg(F.min("number").alias("number"))
    found = per_doc.groupBy("general", "template").agg(F.count("*").alias("docs"), F.min(F.struct("id", "tag", "number")).alias("first")).where(F.col("docs") >= min_docs)
    drop = _told(named, found, ["general", "template"], "inner", "id").where(F.struct("id", "tag", "number") != F.col("first")).select("id", "tag", "number")
    return own, drop.groupBy("id", "tag").agg(F.array_distinct(F.collect_list("number")).alias("numbers"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the listed lines, with their line ends, out of the texts."""
    for batch in slices(batches, "text", SLICE_BYTES):
        raw, offsets = buffers(batch.column("text"))
        cut = batch.column("numbers")
        count = cut.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        ends = np.flatnonzero(raw == 10)
        # a line begins at the text's start or behind a line end; it reaches to the next line end, that included
        before = np.searchsorted(ends, offsets)
        n_lines = np.diff(before) + 1
        n_lines[np.diff(offsets) == 0] = 0
        gone = np.zeros(len(raw) + 1, np.int32)
        doc = np.repeat(np.arange(batch.num_rows), count)
        line = before[doc] + cut.flatten().to_numpy(zero_copy_only=False)
        has_end = line < before[doc + 1]
        begin = np.where(line > before[doc], ends[np.maximum(line - 1, 0)] + 1, offsets[doc]) if len(ends) else offsets[doc]
        stop = np.where(has_end, ends[np.minimum(line, len(ends) - 1)] + 1, offsets[doc + 1]) if len(ends) else offsets[doc + 1]
        np.add.at(gone, begin, 1)
        np.add.at(gone, stop, -1)
        keep = np.cumsum(gone[:-1]) == 0
        total = np.concatenate(([0], np.cumsum(keep)))
        size = np.diff(total[offsets])
        out = raw[keep]
        # with a last line that no line end follows, the line end before it goes
        drop_end = np.zeros(batch.num_rows, bool)
        drop_end[doc[~has_end]] = True
        drop_end &= size > 0
        last = np.cumsum(size)[drop_end] - 1
        out = np.delete(out, last)
        size = size - drop_end
        text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), text, pa.array(n_lines), pa.array(count)], ["id", "tag", "text", "n_lines", "n_dropped"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row: the text without the lines that were dropped."""
    own, drop = recurring(docs, id_col, text_col, depth, similarity, min_docs)
    got = own.rows.join(drop.hint("shuffle_hash"), ["id", "tag"], "left").mapInArrow(_apply, "id bigint, tag bigint, text string, n_lines bigint, n_dropped bigint")
    return got.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text", "n_lines", "n_dropped")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, with all their columns, without the dropped lines; those that lose all their lines go."""
    own, drop = recurring(docs, id_col, text_col, depth, similarity, min_docs)
    tag = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) if own.repeats else F.lit(0).cast("bigint")
    id_name, tag_name, numbers = fresh("id"), fresh("tag"), fresh("numbers")
    names = drop.select(F.col("id").alias(id_name), F.col("tag").alias(tag_name), F.col("numbers").alias(numbers)).hint("shuffle_hash")
    joined = docs.join(names, (F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)) == F.col(id_name)) & (tag == F.col(tag_name)), "left").drop(id_name, tag_name)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE_BYTES):
            work = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col), batch.column(numbers)], ["id", "tag", "text", "numbers"])
            for out in _apply(iter([work])):
                text = out.column("text")
                keep = (out.column("n_dropped").to_numpy() == 0) | (np.diff(buffers(text)[1]) > 0)
                yield pa.RecordBatch.from_arrays([text if c == text_col else batch.column(c) for c in columns], columns).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
