"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``nodes`` points on a ring of 64-bit hashes; a row belongs to the first point at
or after the hash of its key. No shard takes more than its capacity, ``1 + slack`` times the mean:
a full shard's further rows go on clockwise to the next shard with room. With no slack the
capacities are the row count dealt out as evenly as can be, so counts differ by one at most
(law ``rows``). Each shard takes rows of its own arcs first and then what others could not hold,
so adding a shard moves few rows besides those the lower capacity pushes out.

Rows of an arc are alike, so only their number per arc decides where they go: at most
``shards * nodes`` counts reach the driver, whatever the data. A row's place in its arc is the
number of earlier rows there: within its task counted while reading, plus one start per arc and
task. Places are written once, so they stay the same when tasks run again. A key that a third of
all rows hold fills its arc and overflows like any other; nothing is gathered by key.

Null keys hash like any value. Repeated rows get places of their own. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from datalathe.llm.common import map_arrow, with_fields
from datalathe.session import cut_lineage

NODES = 128


class Ring:
    """Points of the shards' virtual nodes in hash order."""

    def __init__(self, shards: int, nodes: int = NODES):
        if shards < 1 or nodes < 1:
            raise ValueError("a ring needs shards and nodes")
        points = sorted(
            (xxhash.xxh64_intdigest(f"{s}/{v}", 42) - (1 << 63), s) for s in range(shards) for v in range(nodes)
        )
        self.shards = shards
        self.points = np.array([p for p, _ in points], np.int64)
        self.owners = [s for _, s in points]

    def arcs(self, hashes: np.ndarray) -> np.ndarray:
        """The point each hash belongs to; past the last point the ring starts again."""
        return np.searchsorted(self.points, hashes, side="left") % len(self.points)

    def capacities(self, rows: int, slack: float) -> list[int]:
        if slack > 0:
            return [int(-(-rows * (1 + slack) // self.shards))] * self.shards
        return [rows // self.shards + (s < rows % self.shards) for s in range(self.shards)]

    def fill(self, counts: dict[int, int], slack: float = 0.0) -> list[tuple[int, int, int, int]]:
        """Where the rows of each arc go: (arc, first row in the arc, shard, first slot in the shard)."""
        room = self.capacities(sum(counts.values()), slack)
        used = [0] * self.shards
        segments, left = [], {}

        def give(arc: int, start: int, shard: int, rows: int) -> None:
            segments.append((arc, start, shard, used[shard]))
            used[shard] += rows
            room[shard] -= rows

        for arc in sorted(counts):
            own = self.owners[arc]
            taken = min(counts[arc], room[own])
            if taken:
                give(arc, 0, own, taken)
            if taken < counts[arc]:
                left[arc] = taken
        for arc, start in left.items():
            at = arc
            while start < counts[arc]:
                at = (at + 1) % len(self.owners)
                taken = min(counts[arc] - start, room[self.owners[at]])
                if taken:
                    give(arc, start, self.owners[at], taken)
                    start += taken
        return sorted(segments)


def assign(df: DataFrame, shards: int, key: str = "doc_id", nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """The input with ``shard`` and ``slot``; slots of a shard run from 0 without gaps."""
    out = with_fields(df.schema, "shard int, slot long")
    ring, names = Ring(shards, nodes), df.columns

    def locate(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(len(ring.points), np.int64)
        for batch in batches:
            arcs = ring.arcs(batch.column("__hash").to_numpy())
            order = np.argsort(arcs, kind="stable")
            ordered = arcs[order]
            first = np.searchsorted(ordered, ordered, side="left")
            before = np.empty(len(arcs), np.int64)
            before[order] = np.arange(len(arcs)) - first + seen[ordered]
            seen += np.bincount(arcs, minlength=len(seen))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "__hash"}
            yield columns | {"__arc": arcs, "__task": np.full(len(arcs), task), "__before": before}

    schema = with_fields(df.schema, "__arc int, __task int, __before long")
    rows = cut_lineage(map_arrow(df.withColumn("__hash", F.xxhash64(f"`{key}`")), locate, schema))
    parts = rows.groupBy("__arc", "__task").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("__arc").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its true size decides about broadcasting.
    parts = cut_lineage(parts.withColumn("__origin", F.coalesce(F.sum("rows").over(earlier), F.lit(0))))
    counts = {r["__arc"]: r["n"] for r in parts.groupBy("__arc").agg(F.sum("rows").alias("n")).collect()}
    segments = np.array(ring.fill(counts, slack), np.int64).reshape(-1, 4)
    before_arc = np.zeros(len(ring.points) + 1, np.int64)
    before_arc[1:] = np.cumsum([counts.get(a, 0) for a in range(len(ring.points))])
    starts = before_arc[segments[:, 0]] + segments[:, 1]

    def place(batches):
        for batch in batches:
            arc, rank = (batch.column(c).to_numpy() for c in ("__arc", "__rank"))
            at = before_arc[arc] + rank
            found = np.searchsorted(starts, at, side="right") - 1
            columns = {n: batch.column(n) for n in names}
            yield columns | {"shard": segments[found, 2], "slot": segments[found, 3] + at - starts[found]}

    ranked = rows.join(parts.drop("rows"), ["__arc", "__task"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in df.columns], "__arc", (F.col("__origin") + F.col("__before")).alias("__rank"))
    return map_arrow(ranked, place, out)


def documents(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Placed rows with the size and checksum of their text; counts per shard are at most one apart."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(f"`{key}`"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32")
    )
    return assign(rows, shards, key).select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )
