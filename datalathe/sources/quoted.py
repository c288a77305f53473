"""Records of CSV files whose quoted texts hold line breaks, read split by split.

Whether a line starts a record depends on all quotes before it. A split has only two ways to start, at a
record or inside a quoted text, so one scan follows both through every split and keeps where they end: one row
per split. Chained in file order these give every split's true start, and a second scan cuts it into records.
A record that runs over the end of its split is put together from the pieces.

A quote opens a text only at the start of a field; elsewhere it is a character like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FILE, START, MONO = "__file", "__start", "__mono"


class ChangedSplits(RuntimeError):
    """The second scan was planned with other splits than the first."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they stand between line feeds, with their file, split and order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(START),
        F.monotonically_increasing_id().alias(MONO),
    )


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted text is open at the end of the line."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Stretches of lines of one split, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(FILE).dictionary_encode(), batch.column(START).to_numpy()
        codes = files.indices.to_numpy()
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield (files.dictionary[int(codes[a])].as_py(), int(starts[a])), batch.slice(a, b - a)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, ends from a record, ends from inside) of each split."""
    found: dict[tuple[str, int], list[bool]] = {}
    for split, part in _splits(batches):
        ends = found.setdefault(split, [False, True])
        value = part.column("value")
        for line in value.filter(pc.match_substring(value, '"')).to_pylist():
            ends[:] = [ends_inside(line, e) for e in ends]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([s[0] for s in found], pa.string()), pa.array([s[1] for s in found], pa.int64()),
            pa.array([e[0] for e in found.values()], pa.bool_()), pa.array([e[1] for e in found.values()], pa.bool_()),
        ],
        names=[FILE, START, "fresh", "within"],
    )


def split_starts(text: DataFrame) -> dict[tuple[str, int], bool]:
    """Whether each split that has lines starts inside a quoted text; an entry per split of the input."""
    rows = text.mapInArrow(_followed, f"{FILE} string, {START} long, fresh boolean, within boolean").collect()
    starts, file, inside = {}, None, False
    for r in sorted(rows, key=lambda r: (r[FILE], r[START])):
        if r[FILE] != file:
            file, inside = r[FILE], False
        starts[r[FILE], r[START]] = inside
        inside = r["within"] if inside else r["fresh"]
    return starts


def _cut(part: pa.RecordBatch, inside: bool) -> tuple[np.ndarray, bool]:
    """Which lines start a record, and whether the last one leaves a text open."""
    value = part.column("value")
    quoted = np.flatnonzero(pc.match_substring(value, '"').to_numpy(zero_copy_only=False))
    starts, last = np.full(part.num_rows, not inside), 0
    for i, line in zip(quoted.tolist(), value.take(pa.array(quoted)).to_pylist()):
        after = ends_inside(line, inside)
        if after != inside:
            starts[i + 1 :] = not after
            inside = after
    return starts, inside


def records(text: DataFrame, starts: dict[tuple[str, int], bool]) -> DataFrame:
    """(record, file, start, order, piece): whole records, and pieces of those that cross the end of a split.

    ``piece`` is 0 for the last piece of a split, which starts a record, 1 for a first piece, which goes on with one.
    Blank lines are left out; the order counts a split's records from 0, and a file's first one, its header, is -1.
    """

    def work(batches):
        # The record being read: its lines, and whether an earlier split began it.
        split, held, head, inside, number = None, [], False, False, 0
        for now, part in _splits(batches):
            if now != split:
                yield from _ended(split, held, head, inside, number)
                if now not in starts:
                    raise ChangedSplits(f"{now[0]} is cut at {now[1]}, which the first scan did not do")
                split, held, inside, number = now, [], starts[now], 0 if now[1] else -1
                head = inside
            begins, inside = _cut(part, inside)
            value, at = part.column("value"), np.flatnonzero(begins)
            held += value.slice(0, int(at[0]) if len(at) else part.num_rows).to_pylist()
            if not len(at):
                continue
            for row in _ended(split, held, head, False, number):
                yield row
                number += not head
            # All records but the last end before the next one starts.
            edges = np.append(at, part.num_rows).tolist()
            alone: list[str] = []
            for first, end in zip(edges[:-2], edges[1:-1]):
                alone.append(value[first].as_py() if end == first + 1 else "\n".join(value.slice(first, end - first).to_pylist()))
            alone = [r for r in alone if not r.isspace() and r]
            if alone:
                yield _rows(split, alone, number, None)
                number += len(alone)
            held, head = value.slice(edges[-2]).to_pylist(), False
        yield from _ended(split, held, head, inside, number)

    return text.mapInArrow(work, f"record string, {FILE} string, {START} long, {MONO} long, piece int")


def _ended(split: tuple[str, int], held: list[str], head: bool, inside: bool, number: int) -> Iterator[pa.RecordBatch]:
    """What was read of a record when its split or the record itself ends, unless it is blank."""
    text = "\n".join(held)
    if held and (head or inside or not (text.isspace() or not text)):
        yield _rows(split, [text], number, 1 if head else 0 if inside else None)


_ARROW = pa.schema([("record", pa.string()), (FILE, pa.string()), (START, pa.int64()), (MONO, pa.int64()), ("piece", pa.int32())])


def _rows(split: tuple[str, int], texts: list[str], number: int, piece: int | None) -> pa.RecordBatch:
    n = len(texts)
    columns = texts, [split[0]] * n, [split[1]] * n, range(number, number + n), [piece] * n
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def joined(pieces: DataFrame) -> DataFrame:
    """(record, file, start, order) of the records that cross a split's end, at the place of their first piece."""
    along = Window.partitionBy(FILE).orderBy(START, F.desc("piece"))
    numbered = pieces.withColumn("number", F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).over(along))
    whole = F.array_sort(F.collect_list(F.struct(START, MONO, "record")))
    grouped = numbered.groupBy(FILE, "number").agg(whole.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return grouped.select(text.alias("record"), FILE, F.col("parts")[0][START].alias(START), F.col("parts")[0][MONO].alias(MONO))
