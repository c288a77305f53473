"""Packing token streams into fixed windows whose sources keep target proportions.

Each source is a queue: its documents' token ids, one after the other in reading order. A deficit
round robin serves the queues in quanta: each round gives every queue credit in proportion to its
target, and a queue is served once its credit reaches a quantum, so what it lacks in one window is
made up in the next. Served in order of the time at which credit for it is complete, quantum j of
a queue with target w comes at time (2j + 1) / w, ties to the earlier queue. How many quanta of
any queue come before a given time has a closed form, so every quantum's place in the global
sequence follows from the queue targets and totals alone. Tasks then place their own documents
independently, and deficits carry over from window to window and from partition to partition as
if one server had dealt them. No row is moved for it.

By default a queue's target is its share of all tokens, so all queues last to the end. With other
targets, a queue that runs dry leaves its share to the others.

Two passes: the first encodes each text once and writes ids with their place in the task's part of
the source; a table of totals per source and task gives every part its start in its source; the second
cuts and places pieces. Sources whose share is under a quantum per window stand behind one queue, so
a round has at most window / quantum + 1 queues however many sources there are. That queue's own
stream is dealt by the same round robin from its sources, each by its share again. More than
``FAN`` of them form a tree by the hash of their names, with about so many children a node, and
each node's stream is dealt from its children's. A source's row has the totals along its way up,
so no list of all sources is held anywhere.

Windows hold ``window`` tokens. The last tokens, fewer than a window, become sequences of
descending powers of two, which need no padding.

Null texts are empty and give the end token alone; a null source is a source. Repeated rows are
packed like any others. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from datalathe.llm.bpe import codec
from datalathe.llm.common import map_arrow, payloads, sliced
from datalathe.session import cut_lineage

WINDOW, QUANTUM, END_ID = 2048, 64, 1
#: Name of the queue of all sources too small for one of their own; others have numbers from 0.
REST = -1
#: Bits of the hash that a level of the tree behind that queue takes; so many children a node.
FAN_BITS = 6
FAN = 1 << FAN_BITS

PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)


def own_queues(df: DataFrame, source: str, text: str, window: int, quantum: int) -> list:
    """The sources with at least a quantum's share of a window by bytes: at most window / quantum of them."""
    size = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + 1
    sizes = cut_lineage(df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0]
    if not total:
        return []
    least = -(-total * quantum // window)
    return sorted(
        (r["source"] for r in sizes.where(F.col("size") >= F.lit(least)).collect()),
        key=lambda s: (s is None, s or ""),
    )


def tokenised(
    df: DataFrame, path: str, queues: list, key: str, text: str, source: str, end_id: int, memo: int | None = None
) -> DataFrame:
    """Rows (key, source, queue, task, before, tokens, ids); ``before``: tokens of the source earlier in the task."""
    number = {s: i for i, s in enumerate(queues)}

    def work(batches):
        coder = codec(path, memo)
        width = np.uint16 if max(coder.size - 1, end_id) < 1 << 16 else np.uint32
        task = TaskContext.get().partitionId()
        served = {}
        for batch in sliced(batches):
            queue, before, tokens, ids = [], [], [], []
            for name, data in zip(batch.column("source").to_pylist(), payloads(batch.column("__text"))):
                own = np.append(coder.encode(data), np.uint32(end_id)).astype(width)
                q = number.get(name, REST)
                queue.append(q)
                before.append(served.get(name, 0))
                tokens.append(len(own))
                ids.append(own.tobytes())
                served[name] = served.get(name, 0) + len(own)
            yield {
                "key": batch.column("key"), "source": batch.column("source"), "queue": queue,
                "task": [task] * len(queue), "before": before, "tokens": tokens, "ids": ids,
            }

    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("__text")
    )
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, source string, queue int, task int, before long, tokens long, ids binary"
    return map_arrow(rows, work, schema)


class Schedule:
    """Places of the queues' tokens in the global sequence."""

    def __init__(self, totals: dict[int, int], weights: dict[int, int] | None, window: int, quantum: int):
        self.queues = sorted(totals)
        self.totals = np.array([totals[q] for q in self.queues], np.int64)
        self.quanta = -(-self.totals // quantum)
        given = self.quanta if weights is None else [max(1, int(weights.get(q, 1))) for q in self.queues]
        self.weights = np.array(given, np.int64)
        self.window, self.quantum = window, quantum
        self.total = int(self.totals.sum())
        self.full = self.total // window
        # The rest as powers of two, largest first.
        rest, sizes = self.total % window, []
        for bit in range(window.bit_length(), -1, -1):
            if rest >> bit & 1:
                sizes.append(1 << bit)
        self.tail = self.full * window + np.cumsum([0, *sizes])

    def before(self, queue: int, quanta: np.ndarray) -> np.ndarray:
        """Tokens of all queues that come before the given quanta of one queue."""
        own = self.queues.index(queue)
        # Products of two weights can pass 64 bits from about 10^11 tokens a queue on.
        large = float(self.weights.max()) * (2.0 * float(quanta.max(initial=0)) + 2.0) >= 2.0**62
        time = 2 * quanta + 1
        time = time.astype(object) if large else time
        weight = int(self.weights[own])
        tokens = np.zeros(len(quanta), np.int64)
        for i, (w, n, total) in enumerate(zip(self.weights.tolist(), self.quanta.tolist(), self.totals.tolist())):
            if i == own:
                served = quanta
            else:
                # Quanta k of queue i with (2k + 1) / w before the time, at it where the queue goes first.
                served = ((time * w - (0 if i < own else 1)) // weight + 1) // 2
                served = np.minimum(served, n).astype(np.int64)
            tokens += np.minimum(served * self.quantum, total)
        return tokens

    def spread(self, queue: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Parts of stretches of a queue's stream by quanta: (stretch, first, end, place in the global sequence)."""
        quantum = self.quantum
        first, last = starts // quantum, (starts + lengths - 1) // quantum
        n = last - first + 1
        stretch = np.repeat(np.arange(len(starts)), n)
        chunk = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[stretch]
        low = np.maximum(chunk * quantum, starts[stretch])
        high = np.minimum((chunk + 1) * quantum, (starts + lengths)[stretch])
        return stretch, low, high, self.before(queue, chunk) + low - chunk * quantum

    def place(self, queue: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut stretches of a queue's stream into pieces: (stretch, offset in it, length, sequence, offset there)."""
        window = self.window
        stretch, low, high, at = self.spread(queue, starts, lengths)
        # Cut where a sequence ends inside a chunk: at most once by full windows, then by each of the last few.
        edges = [np.minimum((at // window + 1) * window, self.full * window), *self.tail[1:-1].tolist()]
        for edge in edges:
            inside = (at < edge) & (at + high - low > edge)
            if inside.any():
                edge = np.broadcast_to(edge, at.shape)[inside]
                middle = low[inside] + edge - at[inside]
                stretch = np.concatenate([stretch, stretch[inside]])
                low, high = np.concatenate([low, middle]), np.concatenate([np.where(inside, 0, high), high[inside]])
                high[np.flatnonzero(inside)] = middle
                at = np.concatenate([at, edge])
        order = np.lexsort((low, stretch))
        stretch, low, high, at = stretch[order], low[order], high[order], at[order]
        whole = at < self.full * window
        tail = np.searchsorted(self.tail, at, side="right") - 1
        sequence = np.where(whole, at // window, self.full + tail)
        offset = np.where(whole, at % window, at - self.tail[np.maximum(tail, 0)])
        # Neighbours that continue each other in one sequence are one piece.
        new = np.ones(len(at), bool)
        new[1:] = (stretch[1:] != stretch[:-1]) | (at[1:] != (at + high - low)[:-1]) | (sequence[1:] != sequence[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1 if len(at) else begin
        return stretch[begin], low[begin] - starts[stretch[begin]], high[end] - low[begin], sequence[begin], offset[begin]


@lru_cache(maxsize=1024)
def _node(totals: tuple, weights: tuple | None, window: int, quantum: int) -> Schedule:
    return Schedule(dict(enumerate(totals)), weights and dict(enumerate(weights)), window, quantum)


def upwards(way: list[dict], weighted: bool, starts: np.ndarray, lengths: np.ndarray, window: int, quantum: int):
    """Stretches of a source's stream as parts of the rest queue's: (stretch, offset in it, start there, length)."""
    stretch, offset = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for level in way:
        schedule = _node(tuple(level["totals"]), tuple(level["weights"]) if weighted else None, window, quantum)
        part, low, high, at = schedule.spread(level["own"], starts, lengths)
        # Neighbours that continue each other in the parent's stream are one part.
        new = np.ones(len(at), bool)
        new[1:] = (part[1:] != part[:-1]) | (at[1:] != (at + high - low)[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        part, low, high, at = part[begin], low[begin], high[end], at[begin]
        stretch, offset = stretch[part], offset[part] + low - starts[part]
        starts, lengths = at, high - low
    return stretch, offset, starts, lengths


def ways(parts: DataFrame) -> DataFrame:
    """(source, way) of the rest queue's sources: on each level from below its number there, all totals and numbers of sources."""
    rest = cut_lineage(parts.where(F.col("queue") == REST).groupBy("source").agg(F.sum("tokens").alias("total")))
    levels, n = 0, rest.count()
    while n > FAN << FAN_BITS * levels:
        levels += 1
    hashed = F.pmod(F.xxhash64("source"), F.lit(1 << FAN_BITS * levels))
    # Names are compared as texts with a mark, so that null is one too.
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    found = rest.select("source", name.alias("child"), hashed.alias("node"))
    below = rest.select(name.alias("child"), hashed.alias("node"), "total", F.lit(1).cast("long").alias("n"))
    way = []
    for level in range(levels + 1):
        nodes = below.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("child", "total", "n"))).alias("children"))
        own = F.array_position(F.col("children.child"), F.col("child")) - 1
        step = F.struct(own.cast("int").alias("own"), F.col("children.total").alias("totals"), F.col("children.n").alias("weights"))
        found = found.join(nodes, "node").withColumn(f"way{level}", step).drop("children")
        way.append(f"way{level}")
        # The next level's children are this one's nodes.
        up = F.shiftright("node", FAN_BITS)
        below = below.groupBy("node").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        below = below.select(F.col("node").alias("child"), up.alias("node"), "total", "n")
        found = found.withColumn("child", F.col("node")).withColumn("node", up)
    return found.select("source", F.array(*way).alias("way"))


def pack(
    df: DataFrame,
    path: str,
    targets: dict[str, float] | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    memo: int | None = None,
) -> DataFrame:
    """One row per piece: key, place in the document, checksum of its ids, sequence and offset there.

    ``targets``: relative token proportions by source name (others count 1); by default each
    source's share of all tokens. ``memo``: fragments that a worker keeps, by default ``bpe.MEMO_FRAGMENTS``.
    """
    if window % quantum:
        raise ValueError("the window must be a multiple of the quantum")
    queues = own_queues(df, source, text, window, quantum)
    if targets is not None:
        queues = sorted({*targets, *queues}, key=lambda s: (s is None, s or ""))
    ids = cut_lineage(tokenised(df, path, queues, key, text, source, end_id, memo))
    parts = ids.groupBy("queue", "source", "task").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("queue", "source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and task of the first pass; written, so that its true size decides about broadcasting.
    parts = cut_lineage(parts.withColumn("origin", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))))
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("tokens").alias("n")).collect()}
    kind = ids.schema["key"].dataType.simpleString()
    out = f"`{key}` {kind}, {PIECES}"
    weights = None
    if targets is not None:
        # Each source behind the rest queue counts 1, too.
        others = parts.where(F.col("queue") == REST).select("source").distinct().count()
        weights = {i: round(1_000_000 * targets.get(s, 1)) for i, s in enumerate(queues)} | {REST: 1_000_000 * others}
    schedule = Schedule(totals, weights, window, quantum) if totals else None

    def work(batches):
        for batch in sliced(batches):
            yield _pieces(batch, schedule, key, weights is not None)

    found = cut_lineage(ways(parts)).withColumnRenamed("source", "way_source") if REST in totals else None
    parts = parts.drop("tokens").withColumnRenamed("source", "part_source")
    if found is not None:
        parts = parts.join(found, (F.col("queue") == REST) & F.col("part_source").eqNullSafe(F.col("way_source")), "left").drop("way_source")
        parts = cut_lineage(parts)
    same = (ids["queue"] == parts["queue"]) & (ids["task"] == parts["task"]) & ids["source"].eqNullSafe(parts["part_source"])
    placed = ids.join(parts, same)
    carried = [ids[c] for c in ("key", "source", "queue", "before", "tokens", "ids")] + [parts[c] for c in ("origin", "way") if c in parts.columns]
    return map_arrow(placed.select(*carried), work, out)


def _pieces(batch, schedule: Schedule, key: str, weighted: bool) -> dict:
    queue, before, origin, tokens = (
        batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "before", "origin", "tokens")
    )
    found = [[], [], [], [], []]
    for q in np.unique(queue).tolist():
        rows = np.flatnonzero(queue == q)
        if q != REST:
            stretch, *rest = schedule.place(q, (origin + before)[rows], tokens[rows])
            for into, values in zip(found, (rows[stretch], *rest)):
                into.append(values)
            continue
        of_source: dict = {}
        for r in rows.tolist():
            of_source.setdefault(batch.column("source")[r].as_py(), []).append(r)
        up = [[], [], [], []]
        for own in of_source.values():
            way, own = batch.column("way")[own[0]].as_py(), np.array(own)
            stretch, *rest = upwards(way, weighted, (origin + before)[own], tokens[own], schedule.window, schedule.quantum)
            for into, values in zip(up, (own[stretch], *rest)):
                into.append(values)
        own, begin, starts, lengths = (np.concatenate(f) for f in up)
        stretch, offset, *rest = schedule.place(q, starts, lengths)
        for into, values in zip(found, (own[stretch], begin[stretch] + offset, *rest)):
            into.append(values)
    row, start, length, sequence, offset = (np.concatenate(f) for f in found)
    sums = np.empty(len(row), np.int64)
    order = np.argsort(row, kind="stable")
    at = 0
    for r, n in zip(*np.unique(row, return_counts=True)):
        own = batch.column("ids")[int(r)].as_py()
        ids = np.frombuffer(own, np.uint16 if len(own) == 2 * tokens[r] else np.uint32).astype("<u4")
        view = memoryview(ids.tobytes())
        for i in order[at : at + n].tolist():
            sums[i] = zlib.crc32(view[4 * start[i] : 4 * (start[i] + length[i])])
        at += n
    return {
        key: batch.column("key").take(pa.array(row)), "start": start, "length": length, "ids_crc32": sums,
        "doc_tokens": tokens[row], "sequence_id": sequence, "offset": offset,
        "source": batch.column("source").take(pa.array(row)),
    }

