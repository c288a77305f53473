"""Exact top-k by inner product over a bit-sliced index.

Vectors become integers, ``floor(scale * x)``, and rows stand in blocks. In a block every attribute
keeps its leading ``slice_bits`` bits as slices: bitmaps with one bit per row. For a query, the
slices of all attributes are added with bitmap arithmetic alone: an attribute enters once for every
bit of the query's component, shifted by that bit, as it is or complemented by the component's
sign; carry-save adders turn the bitmaps of one weight into a sum and carries. The k-th largest
sum of a block follows from its slices, the most significant first, by counting rows. The bits left
out change a score by no more than a known width, so only rows within it of the k-th sum can be
among the best: these boundary rows are scored exactly. The blocks' best rows then meet, k for each
query and block. No result is approximate.

Queries come in blocks as well, and every block of rows meets every block of queries: the given
query set against all rows. Both tables are written once; memory is one block of each.

Vectors that are null or hold null or non-finite components take no part; shorter ones are filled
up with zeros. Values are never changed: where the lengths of the longest vectors allow a score outside 64 bits,
an error is raised before any is computed. Null ids take no part. A row is never compared with rows of its
own id; each row of a repeated query id is a query with results of its own, under the same id.
Ties go to the smaller id. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from datalathe.llm.common import map_arrow
from datalathe.session import cut_lineage

SCALE, SLICE_BITS, BLOCK_ROWS, BLOCK_QUERIES = 1024, 5, 32_768, 128
_BLOCK = "rows int, ids binary, vectors binary, low int, shift int, bits int, slices binary"
_QUERIES = "queries int, query_ids binary, query_vectors binary, query_block string"


def _sliced(values: np.ndarray, slice_bits: int) -> tuple[int, int, int, np.ndarray]:
    """Lowest leading part, bits left out, bits kept and bitmaps (attribute, bit, word) of a block."""
    span = int(values.max()) - int(values.min())
    shift = max(0, span.bit_length() - slice_bits)
    lead = values >> shift
    low = int(lead.min())
    lead = (lead - low).astype(np.uint32)
    bits = max(1, int(lead.max()).bit_length())
    rows, attributes = values.shape
    words = -(-rows // 64)
    slices = np.zeros((attributes, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((lead >> b & 1).astype(np.uint8), axis=0, bitorder="little")
        slices[:, b, : len(packed)] = packed.T
    return low, shift, bits, slices.view(np.uint64)


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of bitmaps given by weight, as slices from the least significant."""
    out, weight = [], 0
    while weight < len(columns):
        column = columns[weight]
        carries = columns[weight + 1] if weight + 1 < len(columns) else []
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            half = a ^ b
            column.insert(0, half ^ c)
            carries.append((a & b) | (half & c))
        if len(column) == 2:
            a, b = column
            column = [a ^ b]
            carries.append(a & b)
        if weight + 1 == len(columns) and carries:
            columns.append(carries)
        out.append(column[0] if column else None)
        weight += 1
    return out


def kth_largest(slices: list[np.ndarray], valid: np.ndarray, k: int) -> int | None:
    """The k-th largest value among valid rows, from the most significant slice downward; None if there are fewer."""
    if int(np.bitwise_count(valid).sum()) < k:
        return None
    above, equal, value = np.zeros_like(valid), valid.copy(), 0
    for s in reversed(slices):
        ones = np.zeros_like(valid) if s is None else equal & s
        if int(np.bitwise_count(above | ones).sum()) >= k:
            equal, value = ones, value << 1 | 1
        else:
            above, value = above | ones, value << 1
            equal = equal if s is None else equal & ~s
    return value


def at_least(slices: list[np.ndarray], valid: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the valid rows whose value is at least ``least``."""
    if least <= 0:
        return valid
    if least >> len(slices):
        return np.zeros_like(valid)
    above, equal = np.zeros_like(valid), valid.copy()
    for i in range(len(slices) - 1, -1, -1):
        s = slices[i] if slices[i] is not None else np.zeros_like(valid)
        if least >> i & 1:
            equal = equal & s
        else:
            above |= equal & s
            equal = equal & ~s
    return above | equal


class Block:
    """A block of rows of the index."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, shift: int, bits: int, slices: np.ndarray):
        self.ids, self.vectors, self.shift, self.bits, self.slices = ids, vectors, shift, bits, slices
        self.complements = ~slices
        rows = np.zeros(slices.shape[-1] * 64, np.uint8)
        rows[: len(ids)] = 1
        self.all = np.packbits(rows, bitorder="little").view(np.uint64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best k rows."""
        columns: list[list[np.ndarray]] = [[]]
        for d in np.flatnonzero(query).tolist():
            size = abs(int(query[d]))
            source = self.slices[d] if query[d] > 0 else self.complements[d]
            while len(columns) < size.bit_length() + self.bits:
                columns.append([])
            for c in range(size.bit_length()):
                if size >> c & 1:
                    for b in range(self.bits):
                        columns[c + b].append(source[b])
        sums = add_slices(columns)
        valid = self.all.copy()
        for row in np.flatnonzero(self.ids == query_id).tolist():
            valid[row >> 6] &= ~np.uint64(1 << (row & 63))
        bound = kth_largest(sums, valid, k)
        if bound is None:
            chosen = valid
        else:
            # What the bits left out can add to any row less what they can take from another.
            width = ((1 << self.shift) - 1) * int(np.abs(query).sum())
            chosen = at_least(sums, valid, bound - (width >> self.shift))
        at = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        scores = self.vectors[at].astype(np.int64) @ query
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[order]], scores[order]


def _integers(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, x): rows that take part, with scaled components rounded down, still as doubles."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.coalesce(F.forall(x, _finite), F.lit(False))
    rows = df.where(F.col(f"`{key}`").isNotNull() & fine)
    # As doubles, which hold values past 64 bits too; such large ones have no fraction.
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**62, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("x"))


def _filled(rows: DataFrame, size: int) -> DataFrame:
    """(id, v): filled up to ``size`` integers."""
    return rows.select("id", F.concat(F.transform("x", lambda v: v.cast("long")), F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))).alias("v"))


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _matrix(batch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, size)


def index(rows: DataFrame, size: int, slice_bits: int = SLICE_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of rows (id, v): one row per block."""

    def work(batches):
        for ids, values in _blocks(batches, size, block_rows):
            low, shift, bits, slices = _sliced(values, slice_bits)
            yield {
                "rows": [len(ids)], "ids": [ids.tobytes()], "vectors": [_narrow(values).tobytes()], "low": [low],
                "shift": [shift], "bits": [bits], "slices": [slices.tobytes()],
            }

    return map_arrow(rows, work, _BLOCK)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int32) if np.abs(values).max(initial=0) < 1 << 31 else values


def _blocks(batches, size: int, most: int):
    ids, values, held = [], [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, min(most - held, batch.num_rows - start))
            ids.append(part.column("id").to_numpy())
            values.append(_matrix(part, size))
            held += part.num_rows
            start += part.num_rows
            if held == most:
                yield np.concatenate(ids), np.concatenate(values)
                ids, values, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(values)


def _query_blocks(rows: DataFrame, size: int, most: int) -> DataFrame:
    def work(batches):
        for ids, values in _blocks(batches, size, most):
            yield {
                "queries": [len(ids)], "query_ids": [ids.tobytes()],
                "query_vectors": [values.astype(np.int64).tobytes()], "query_block": [uuid.uuid4().hex],
            }

    return map_arrow(rows, work, _QUERIES)


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, slice_bits: int = SLICE_BITS,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best rows; ``queries`` has the columns of the rows."""
    parts = [_integers(d, key, vector, scale) for d in (df, queries)]
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    found = [p.agg(F.max(F.size("x")), F.max(length)).first() for p in parts]
    size = max(f[0] or 0 for f in found)
    if size <= 0:
        return df.sparkSession.range(0).selectExpr("id as query_id", "0 as rank", f"id as `{key}`", "id as score")
    if max(f[1] or 0 for f in found) >= 2.0**62 or (found[0][1] or 0) * (found[1][1] or 0) >= 2.0**63 * (1 - 1e-9):
        raise ValueError("vectors too long: a score could leave 64 bits")
    blocks = cut_lineage(index(_filled(parts[0], size), size, slice_bits, block_rows))
    asked = cut_lineage(_query_blocks(_filled(parts[1], size), size, block_queries))
    # A task per block of rows; the index moves once, the queries go to each of them.
    blocks = blocks.repartition(max(1, blocks.count()))

    def work(pairs):
        for batch in pairs:
            for i in range(batch.num_rows):
                yield from _answers({n: batch.column(n)[i].as_py() for n in batch.schema.names}, size, k)

    best = map_arrow(blocks.crossJoin(asked), work, "query_block string, query int, query_id long, id long, score long")
    order = Window.partitionBy("query_block", "query", "query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _answers(row: dict, size: int, k: int):
    rows, bits = row["rows"], row["bits"]
    block = Block(
        np.frombuffer(row["ids"], np.int64),
        np.frombuffer(row["vectors"], np.int32 if len(row["vectors"]) == 4 * rows * size else np.int64).reshape(rows, size),
        row["shift"],
        bits,
        np.frombuffer(row["slices"], np.uint64).reshape(size, bits, -1),
    )
    queries = np.frombuffer(row["query_vectors"], np.int64).reshape(-1, size)
    for i, (query_id, query) in enumerate(zip(np.frombuffer(row["query_ids"], np.int64).tolist(), queries)):
        ids, scores = block.top(query_id, query, k)
        n = len(ids)
        yield {
            "query_block": [row["query_block"]] * n, "query": [i] * n, "query_id": [query_id] * n, "id": ids, "score": scores,
        }
