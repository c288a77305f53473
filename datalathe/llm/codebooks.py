"""Vector codes by k-means over the parts of integer vectors, with Drake and Hamerly's adaptive bounds.

A component x becomes ``floor(scale * x)`` and a vector is cut into equal consecutive parts. The codebook of a
part position starts as that part of the kept rows with the smallest ids; a round assigns every part to its
nearest entry (squared distance, ties to the lower index) and moves each entry to the floor of its
parts' mean. Entries without parts stay.

Between rounds a table keeps, for each row and part, the assigned entry, the b next closest
entries with a lower bound of the distance to each, in ascending order, and one outer bound for all other
entries. When entries have moved, a bound shrinks by what its entry moved, the outer one by the
largest move. The distance to the assigned entry is computed in integers. Where it lies below the first
bound the part is settled. Where it reaches only the first few, these are verified by integer
distances; where it reaches the outer bound, all entries are. Bounds are held in 16 bits, rounded down,
so they settle nothing that integers would not, and ties are always verified.

b starts at an eighth of the entries and follows, slice by slice of rows, the depth that settles 95 % of the parts
that needed a look; a row's own b is the length of its list. It changes the work, never the result.

Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors count as filled up with
zeros, to a multiple of the number of parts. Rows with equal ids are rows of their own; for the first entries
they come in the order of their integers, rows without an id after all others. With fewer rows than entries the
codebook has an entry per row. Components whose error could leave 64 bits are an error. Extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from datalathe.llm.common import map_arrow, sliced
from datalathe.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows worked on at a time, the share of uncertain parts that b should settle, and the least b.
ROWS, SETTLED, LEAST = 1024, 0.95, 2
_ROW, _STATE = "id long, label string, v array<int>", "code binary, near binary, low binary, outer binary"


def _down(x: np.ndarray) -> np.ndarray:
    """Lower bounds in 16 bits, none below zero and none above x."""
    x = np.clip(x, 0, np.where(np.isinf(x), np.inf, 65504.0))
    y = x.astype(np.float16)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float16(0)), y)


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Integer squared distances (part, entry)."""
    return (parts * parts).sum(1)[:, None] - 2 * (parts @ book.T) + (book * book).sum(1)


def ranked(parts: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """(assigned entry, b next ones, their lower bounds, outer bound, squared distance) from all distances."""
    d = squared(parts, book)
    order = np.argsort(d, axis=1, kind="stable")
    roots = np.sqrt(np.take_along_axis(d, order[:, : b + 2], 1).astype(np.float64)) * (1 - 1e-12)
    outer = roots[:, b + 1] if d.shape[1] > b + 1 else np.full(len(parts), np.inf)
    return order[:, 0], order[:, 1 : b + 1], _down(roots[:, 1 : b + 1]), _down(outer), np.take_along_axis(d, order[:, :1], 1)[:, 0]


def moved_on(
    parts: np.ndarray, book: np.ndarray, moves: np.ndarray, code: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray
) -> tuple[np.ndarray, ...]:
    """What ``ranked`` gives, from the bounds before the entries moved by ``moves``; and the depth each part needed.

    Depth 0 is settled at once, b + 1 needed all entries.
    """
    b = near.shape[1]
    code, near = code.astype(np.int64), near.astype(np.int64)
    low = np.maximum(0, low.astype(np.float64) - moves[near])
    outer = np.maximum(0, outer.astype(np.float64) - moves.max(initial=0))
    # From the outer bound inwards, so the bounds ascend again.
    low = np.minimum.accumulate(np.column_stack([low, outer])[:, ::-1], axis=1)[:, ::-1][:, :b]
    away = parts - book[code]
    error = (away * away).sum(1)
    own = np.sqrt(error.astype(np.float64)) * (1 + 1e-12)
    depth = np.where(outer <= own, b + 1, (low <= own[:, None]).sum(1))
    low, outer = _down(low), _down(outer)
    for t in np.unique(depth[(depth > 0) & (depth <= b)]).tolist():
        at = np.flatnonzero(depth == t)
        seen = np.column_stack([code[at], near[at, :t]])
        away = parts[at][:, None] - book[seen]
        d = (away * away).sum(2)
        order = np.lexsort((seen, d), axis=1)
        seen, d = np.take_along_axis(seen, order, 1), np.take_along_axis(d, order, 1)
        code[at], near[at, :t], error[at] = seen[:, 0], seen[:, 1:], d[:, 0]
        low[at, :t] = _down(np.sqrt(d[:, 1:].astype(np.float64)) * (1 - 1e-12))
    if len(at := np.flatnonzero(depth > b)):
        code[at], near[at], low[at], outer[at], error[at] = ranked(parts[at], book, b)
    return code, near, low, outer, error, depth


def narrower(b: int, depth: np.ndarray) -> int:
    """The next b: the depth that settles most of the parts that needed a look at listed entries."""
    looked = depth[(depth > 0) & (depth <= b)]
    return b if not len(looked) else min(b, max(LEAST, int(np.quantile(looked, SETTLED, method="higher"))))


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(row, part, component) of a batch's integer vectors."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def _first(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The state after the first assignment."""
    parts, entries = books.shape[:2]
    b = min(entries - 1, max(LEAST, entries // 8))

    def work(batches):
        for batch in sliced(batches, ROWS):
            x = _parts(batch, parts)
            found = [ranked(x[:, p], books[p], b) for p in range(parts)]
            yield {c: batch.column(c) for c in ("id", "label", "v")} | _packed(found)

    return map_arrow(rows, work, f"{_ROW}, {_STATE}")


def _packed(found: list[tuple[np.ndarray, ...]]) -> dict:
    """State columns of a slice of rows, from the parts' (code, near, low, outer)."""
    code, near, low, outer = (np.stack([f[i] for f in found], 1) for i in range(4))
    rows = lambda x, kind: [r.tobytes() for r in np.ascontiguousarray(x.astype(kind))]
    return {"code": rows(code, np.uint8), "near": rows(near, np.uint8), "low": rows(low, np.float16), "outer": rows(outer, np.float16)}


def _of_one_width(batches, parts: int):
    """(b, slices of rows whose lists have b entries)."""
    for batch in sliced(batches, ROWS):
        widths = np.fromiter((len(v.as_py()) for v in batch.column("near")), np.int64, batch.num_rows) // parts
        for b in np.unique(widths).tolist():
            yield b, batch.filter(pa.array(widths == b))


def _unpacked(batch: pa.RecordBatch, parts: int, b: int) -> tuple[np.ndarray, ...]:
    joined = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)
    n = batch.num_rows
    return (
        joined("code", np.uint8).reshape(n, parts), joined("near", np.uint8).reshape(n, parts, b),
        joined("low", np.float16).reshape(n, parts, b), joined("outer", np.float16).reshape(n, parts),
    )


def _again(state: DataFrame, books: np.ndarray, moves: np.ndarray, last: bool) -> DataFrame:
    """The state after the entries have moved; the last time codes and errors only."""
    parts = len(books)

    def work(batches):
        wanted = 255
        for b, batch in _of_one_width(batches, parts):
            x = _parts(batch, parts)
            code, near, low, outer = _unpacked(batch, parts, b)
            found = [
                moved_on(x[:, p], books[p], moves[p], code[:, p], near[:, p], low[:, p], outer[:, p]) for p in range(parts)
            ]
            if last:
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                yield {
                    "id": batch.column("id"), "label": batch.column("label"), "code": [c.tobytes().hex() for c in codes],
                    "error": sum(f[4] for f in found),
                }
            else:
                wanted = min(wanted, narrower(b, np.concatenate([f[5] for f in found])))
                yield {c: batch.column(c) for c in ("id", "label", "v")} | _packed([_cut(f, wanted) for f in found])

    return map_arrow(state, work, "id long, label string, code string, error long" if last else f"{_ROW}, {_STATE}")


def _cut(found: tuple[np.ndarray, ...], b: int) -> tuple[np.ndarray, ...]:
    """The state with lists of at most b entries; what is left out falls under the outer bound."""
    code, near, low, outer = found[:4]
    if near.shape[1] > b:
        outer = np.minimum(outer, low[:, b:].min(1))
    return code, near[:, :b], low[:, :b], outer


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries at the floor of their parts' mean; summed in each task before anything is moved."""
    parts, entries, width = books.shape

    def work(batches):
        sums, times = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in sliced(batches, ROWS):
            x, code = _parts(batch, parts), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                times[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(times)
        yield {"part": p, "entry": e, "times": times[p, e], "sums": sums[p, e].tolist()}

    summed = map_arrow(state.select("v", "code"), work, "part int, entry int, times long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    after = books.copy()
    for row in summed.groupBy("part", "entry").agg(F.sum("times").alias("times"), *totals).collect():
        after[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["times"] for i in range(width)]
    return after


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def encode(
    df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of the kept rows; ``label_error`` over all rows without a label."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, at least one part and no negative number of rounds")
    x = F.col(f"`{vector}`").cast("array<double>")
    group = F.col(f"`{label}`").cast("string") if label else F.lit(None).cast("string")
    kept = df.select(F.col(f"`{key}`").cast("long").alias("id"), group.alias("label"), x.alias("x"))
    kept = kept.where(F.coalesce(F.forall("x", _finite), F.lit(False)))
    size, most = kept.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    if size is None:
        return df.sparkSession.range(0).selectExpr(
            f"id as `{key}`", "string(id) as code", "id as error", "id as label_error", "string(id) as codebooks_sha256"
        )
    width = max(1, math.ceil(size / parts))
    if (most or 0) * scale >= 2**30 / math.sqrt(parts * width):
        raise ValueError("components too large: squared distances could leave 64 bits")
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("int"))
    rows = kept.select("id", "label", F.concat(whole, F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("x"))).alias("v"))
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    state, before = cut_lineage(_first(rows, books)), books
    for i in range(rounds):
        after = _means(state, before)
        if i < rounds - 1:
            state = cut_lineage(_again(state, after, _moves(before, after), last=False))
            before = after
    final = after if rounds else before
    # Read twice below, so written once.
    coded = cut_lineage(_again(state, final, _moves(before, final), last=True))
    # Summed by label before the join, which adaptive execution can split at a large label.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(map(str, final.reshape(-1).tolist())).encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _moves(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Upper bounds of what the entries moved, by part."""
    return np.sqrt(((after - before) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12)
