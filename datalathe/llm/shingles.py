"""Near-duplicates by the Jaccard similarity of word shingles, complete: every pair at the threshold is found.

Words are stretches without white space, A-Z in lower case; a text's set holds the hashes of its
distinct ``width``-word shingles (a shorter text is one shingle, a text without words has the
empty set). Word hashes are XXH64, mixed into 64-bit shingle hashes. Texts with equal sets are one node.

First candidates come from ``simhash``: a set's fingerprint has the bits that over half of its hashes have, and keys of the Golay
code find all fingerprints within two bits. Nodes with one fingerprint meet the least of them, linked fingerprints meet through their least
nodes, and all are verified on the sets. That finds near copies of long texts; most pairs at the threshold differ in more bits.

The others come from a prefix filter. All shingles have one order; of a set of n, a partner with
similarity t shares at least ceil(t n), so the first n - ceil(t n) + 1 of both sets hold their first
common shingle. The order is that of the hashes, except that shingles which a sample shows to be
frequent come last, the most frequent at the very end. Any order finds every pair; this one keeps
common lines out of the prefixes. A pair passes a shared shingle when both sizes and the places there
leave room for the overlap it needs (length and positional filters), which holds at its first common one.

A large group under one shingle is not paired off at once. Under each shingle a hub, the node with the fewest
shingles before it and so the one nearest to what the group has in common, is verified against all others, and
the links found are joined to components. Pairs inside one component could change nothing, so only pairs across components are left.
Where these are few for the nodes they stand for, they are verified. Where they are many, texts share much and are
no links, such as letters from one template. Among the nodes of such groups a shingle that only one of them holds is in no overlap, so nodes of equal size that agree in all
others (a class) have the same overlap with every node outside: one of each class stands for all, first against the
members of its own, then against the other classes. A link between two classes joins each to all of the other.
Every pair at the threshold is thus inside a component, verified, or of two classes that were.

Verification counts the sets' common hashes. Before sets are moved, sketches are compared: a sketch has a
bit for each residue of the hashes, set where an odd number of shingles fall. Two sketches differ in no more
bits than the sets have shingles that only one of them holds, so no pair at the threshold is lost. A sketch
has at least as many bits as its set has shingles; a longer one is folded to the other's length.

A null key is never the group's least unless all its keys are null. Repeated rows are members like any other.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from datalathe.llm.common import map_arrow, payloads, row_struct, sliced, with_fields
from datalathe.llm import simhash
from datalathe.llm.components import components
from datalathe.session import cut_lineage

WIDTH, THRESHOLD = 5, Fraction(4, 5)
#: One in so many nodes is looked at for frequent shingles; those in so many of them are put last, up to so many.
#: They decide about the order only, not about what is found.
SAMPLE, FREQUENT, MOST_FREQUENT = 32, 4, 200_000

#: Pairs across components under a shingle, for each of its nodes, that are few enough to verify them all.
DIRECT = 32

#: Up to so many dropped rows are broadcast, so that the texts of the others stay where they are.
DROPPED = 1_000_000

#: Least bits of a sketch. Bits of the filter for nodes whose sets are wanted, for each such node and at most.
SKETCH, WANTED_BITS, WANTED_MOST = 64, 16, 1 << 26

_MIX, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = hashes[:n].copy()
    for k in range(1, width):
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
        mixed += hashes[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _FINISH
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def needed(n: int, threshold: Fraction = THRESHOLD) -> int:
    """Shingles that a set of n shares at least with a partner at the threshold."""
    return -(-n * threshold.numerator // threshold.denominator)


def prefix(own: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """The first shingles of an ascending set in the common order; ``frequent``: ascending hashes with their ranks."""
    length = len(own) - needed(len(own), threshold) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        late = frequent[at] == own
        if late.any():
            own = np.concatenate([own[~late], own[late][np.argsort(ranks[at[late]], kind="stable")]])
    return own[:length]


def sketch(own: np.ndarray) -> bytes:
    bits = max(SKETCH, 1 << (len(own) - 1).bit_length()) if len(own) else SKETCH
    times = np.bincount((own >> np.uint64(7)).astype(np.int64) % bits, minlength=bits)
    return np.packbits(times & 1).tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ at the shorter one's length."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _with_sets(df: DataFrame, text: str, carried: str, width: int, threshold: Fraction) -> DataFrame:
    """The input with ``node`` (hash of the text's set), ``size``, ``sketch``, ``fingerprint`` and ``keys`` (its prefix) of the set."""
    kept = df.columns
    frequent, ranks = _frequent(df.select(F.col(carried).getField(text).cast("string").alias("text")), width)

    def work(batches):
        for batch in sliced(batches, 200):
            nodes, sizes, sketches, prints, keys = [], [], [], [], []
            for data in payloads(batch.column(carried).field(text)):
                own = shingle_set(data, width)
                nodes.append(xxhash.xxh64_intdigest(own.astype("<u8").tobytes()))
                sizes.append(len(own))
                sketches.append(sketch(own))
                prints.append(simhash.majority(own))
                keys.append(prefix(own, frequent, ranks, threshold).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            yield {c: batch.column(c) for c in kept} | {
                "node": np.array(nodes, np.uint64).view(np.int64), "size": sizes, "sketch": sketches,
                "fingerprint": np.array(prints, np.uint64).view(np.int64),
                "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
            }

    return map_arrow(df, work, with_fields(df.schema, "node long, size long, sketch binary, fingerprint long, keys array<long>"))


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles frequent in a sample, in ascending order, and their ranks by number of texts."""

    def work(batches):
        seen = set()
        for batch in sliced(batches, 100):
            found = [np.zeros(0, np.uint64)]
            for data in payloads(batch.column("text")):
                if (node := xxhash.xxh64_intdigest(data)) not in seen:
                    seen.add(node)
                    found.append(shingle_set(data, width))
            keys, times = np.unique(np.concatenate(found), return_counts=True)
            yield {"key": keys.view(np.int64), "times": times}

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = map_arrow(sample, work, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    top = counted.where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "key").limit(MOST_FREQUENT).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - order).astype(np.int64)


def _room(a: str, b: str, threshold: Fraction) -> Column:
    """Whether two sets' sizes and places of a shared shingle, their first, leave room for the overlap they need."""
    p, q = threshold.numerator, threshold.denominator
    col = lambda side, name: F.col(f"{side}_{name}").cast("long")
    most = F.least(col(a, "size") - col(a, "place"), col(b, "size") - col(b, "place"))
    return most * (p + q) >= (col(a, "size") + col(b, "size")) * p


class _Sets:
    """The nodes of written rows, and the sets of those that were asked for; a text's set is made again once at most."""

    def __init__(self, rows: DataFrame, text: str, width: int, threshold: Fraction):
        self.rows, self.text, self.width, self.threshold = rows.where("size > 0"), text, width, threshold
        # One row of each node, by its number, so that copies neither count as partners nor move twice.
        self.firsts = cut_lineage(self.rows.groupBy("node").agg(F.min("number").alias("number")).select("number"))
        self.nodes = cut_lineage(self.first_rows("number", "node", "size", "sketch", "fingerprint"))
        # An empty list of rows would be a Python RDD, and every read of the sets would start its workers.
        self.held = rows.sparkSession.range(0).select(F.col("id").alias("node"), F.lit(None).cast("binary").alias("set"))

    def first_rows(self, *columns: str) -> DataFrame:
        return self.rows.select("number", *columns).join(self.firsts, "number", "left_semi").select(*columns)

    def hold(self, nodes: DataFrame) -> None:
        """Makes the sets of the nodes that are not there yet."""
        nodes = nodes.select("node").distinct().join(self.held, "node", "left_anti")
        nodes = cut_lineage(nodes.join(self.nodes.select("number", "node"), "node").select("number"))
        n = nodes.count()
        if not n:
            return
        bits = 1 << min(WANTED_MOST.bit_length() - 1, max(10, (WANTED_BITS * n).bit_length()))
        # A flag for each node's first row, so that texts are picked where they stand and never move.
        slot = F.pmod(F.xxhash64("number"), F.lit(bits))
        words = nodes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
        set_bits = words.agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).toArrow()
        flags = np.zeros(bits // 64, np.int64)
        flags[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy()
        width = self.width

        def work(batches):
            for batch in sliced(batches, 100):
                slots = batch.column("slot").to_numpy()
                chosen = batch.filter(pa.array((flags[slots >> 6] >> (slots & 63) & 1).astype(bool)))
                sets = [shingle_set(t, width).tobytes() for t in payloads(chosen.column("text"))]
                yield {"number": chosen.column("number"), "node": chosen.column("node"), "set": sets}

        text = F.col("row").getField(self.text).cast("string").alias("text")
        made = map_arrow(self.rows.select("number", "node", slot.alias("slot"), text), work, "number long, node long, set binary")
        # The flags let a few others through.
        self.held = self.held.unionAll(cut_lineage(made.join(nodes, "number", "left_semi").select("node", "set")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose sets reach the threshold."""
        p, q = self.threshold.numerator, self.threshold.denominator

        def alike(batches):
            for batch in sliced(batches, 1000):
                differing = [*map(differing_bits, batch.column("x").to_pylist(), batch.column("y").to_pylist())]
                both = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "n"))
                # With s shared of m + n, s (p + q) >= p (m + n); m + n - 2 s are held by one set only.
                good = pa.array(np.array(differing, np.int64) * (p + q) <= both * (q - p))
                yield {c: batch.column(c).filter(good) for c in "ab"}

        def compare(batches):
            for batch in sliced(batches, 100):
                good = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(shared * q >= (len(x) + len(y) - shared) * p)
                good = pa.array(good, pa.bool_())
                yield {c: batch.column(c).filter(good) for c in "ab"}

        x = self.nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("m"))
        y = self.nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("n"))
        pairs = cut_lineage(map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n"), alike, "a long, b long"))
        self.hold(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))))
        x = self.held.select(F.col("node").alias("a"), F.col("set").alias("x"))
        y = self.held.select(F.col("node").alias("b"), F.col("set").alias("y"))
        return cut_lineage(map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), compare, "a long, b long"))

    def classes(self, nodes: DataFrame) -> DataFrame:
        """(node, class) of the nodes: those of one size with equal shingles apart from such as only one of all nodes holds."""

        def work(batches):
            for batch in sliced(batches, 100):
                sets = [np.frombuffer(s.as_py(), np.int64) for s in batch.column("set")]
                yield {"node": np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets]), "key": np.concatenate(sets)}

        self.hold(nodes)
        wanted = cut_lineage(nodes.select("node").distinct().join(self.nodes.select("node", "size"), "node"))
        each = map_arrow(self.held.join(wanted, "node", "left_semi"), work, "node long, key long")
        shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
        core = each.join(shared, "key").groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(2))).alias("y")
        )
        sized = cut_lineage(wanted.join(core, "node", "left").na.fill(0, ["n", "x", "y"]))
        same = ["size", "n", "x", "y"]
        return cut_lineage(sized.join(sized.groupBy(same).agg(F.min("node").alias("class")), same).select("node", "class"))


def _pairs(entries: DataFrame, node: str, apart: Column, threshold: Fraction) -> DataFrame:
    """Distinct (a, b) of all entries under one key that stand apart and leave room for the threshold."""
    a, b = (
        entries.select("key", F.col(node).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in entries.columns if c not in ("key", node)])
        for s in "ab"
    )
    return a.join(b, "key").where((F.col("a") < F.col("b")) & apart & _room("a", "b", threshold)).select("a", "b").distinct()


def _near(sets: _Sets) -> DataFrame:
    """(key, node, size, place) of the shingles that stand in the prefixes of two nodes or more.

    A shingle is a key of its own for every class of sizes, each with the next; partners differ by no more.
    """
    each = sets.first_rows("node", "size", "keys")
    each = each.select("node", F.col("size").cast("int").alias("size"), F.posexplode("keys").alias("place", "key"))
    held = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("key")
    some = cut_lineage(each.join(cut_lineage(held(each)), "key").select("key", "node", "size", "place"))
    # The small sum keeps a partner at the very bound from falling two classes lower by rounding.
    size_class = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / float(sets.threshold) + 1e-9))
    by_size = some.withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    by_size = by_size.withColumn("key", F.xxhash64("key", "class")).drop("class")
    return cut_lineage(by_size.join(held(by_size), "key").select(*some.columns))


def _alike_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or within two bits, enough to connect all of these."""
    least = cut_lineage(nodes.groupBy("fingerprint").agg(F.min("node").alias("least")))
    copies = nodes.join(least, "fingerprint").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    a, b = (least.select(F.col("fingerprint").alias(s), F.col("least").alias(f"{s}_node")) for s in "ab")
    near = simhash.links(least).join(a, "a").join(b, "b")
    return copies.unionAll(near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))).distinct()


def links(rows: DataFrame, text: str, width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Verified links (a, b) between nodes, enough to connect all pairs at the threshold."""
    sets = _Sets(rows, text, width, threshold)
    first = cut_lineage(_alike_prints(sets.nodes))
    early = sets.verified(first)
    near = _near(sets)
    hubs = near.groupBy("key").agg(F.min(F.struct("place", "size", "node")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.node").alias("h"), F.col("hub.size").alias("h_size"), F.col("hub.place").alias("h_place"))
    met = near.join(hubs, "key").withColumns({"n": F.col("node"), "n_size": F.col("size"), "n_place": F.col("place")})
    met = met.where((F.col("n") != F.col("h")) & _room("n", "h", threshold))
    tested = cut_lineage(met.select(F.least("n", "h").alias("a"), F.greatest("n", "h").alias("b")).distinct())
    found = early.unionAll(sets.verified(tested.join(first, ["a", "b"], "left_anti")))
    tested = tested.unionAll(first)
    label = F.coalesce("component", "node").alias("label")
    labelled = cut_lineage(near.join(components(found), "node", "left").select(*near.columns, label))
    whole = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("labels")
    )
    large = (F.col("n") * F.col("n") - F.col("nn")) / 2 > DIRECT * F.col("n")
    whole = cut_lineage(whole.where("labels > 1").select("key", large.alias("large")))
    few = labelled.join(whole.where("not large").select("key"), "key")
    pairs = _pairs(few, "node", F.col("a_label") != F.col("b_label"), threshold)
    many = cut_lineage(labelled.join(whole.where("large").select("key"), "key"))
    classes = sets.classes(many)
    own = classes.where("node <> class").select(F.least("node", "class").alias("a"), F.greatest("node", "class").alias("b"))
    entries = many.join(classes, "node").groupBy("key", "class", "size").agg(
        F.min("place").alias("place"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    apart = F.least("a_low", "b_low") != F.greatest("a_high", "b_high")
    between = cut_lineage(_pairs(entries, "class", apart, threshold))
    left = cut_lineage(pairs.unionAll(own).join(tested, ["a", "b"], "left_anti").unionAll(between).distinct())
    alike = sets.verified(left)
    # A link between classes holds for all their members.
    of_classes = alike.join(between, ["a", "b"], "left_semi")
    a, b = (classes.select(F.col("class").alias(s), F.col("node").alias(f"{s}_node")) for s in "ab")
    to_b = of_classes.join(a, "a").select(F.col("a_node").alias("a"), "b")
    to_a = of_classes.join(b, "b").select("a", F.col("b_node").alias("b"))
    return found.unionAll(alike).unionAll(to_a).unionAll(to_b)


def deduplicated(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: Fraction = THRESHOLD
) -> DataFrame:
    """One row of each group with the input's columns: that of the least key; of rows that repeat it, the first read."""
    numbered = df.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{key}`").alias("id"), row_struct(df, "row"))
    # Written once with its numbers, so every later pass sees the same ones.
    rows = cut_lineage(_with_sets(numbered, text, "row", width, threshold))
    linked = components(links(rows, text, width, threshold))
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"))
    labelled = cut_lineage(nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least"))
    lowest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = rows.select("number", "id", "node").join(labelled.drop("least").join(lowest, "component"), "node")
    first = joined.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("number").alias("number"))
    dropped = cut_lineage(rows.select("number").join(first, "number", "left_anti"))
    if dropped.count() <= DROPPED:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "number", "left_anti").select("row.*")
