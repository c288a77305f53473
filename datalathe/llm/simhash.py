"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

Fingerprints: words are stretches without white space, A-Z in lower case; every 3-word shingle
(repeats included; a shorter text is one shingle) is hashed with XXH64, and a fingerprint bit is
1 when it is set in over half of the hashes. Texts without words have fingerprint zero.

Links: two fingerprints are linked at two or fewer differing bits. The 64 bits are three segments
of 22, 21 and 21 bits. Two errors leave at least one segment without any, and whatever the errors,
each other segment has two at most. The (23, 12) Golay code is perfect: every 23-bit word lies
within three bits of exactly one codeword. A word at distance three is also near five further
codewords at distance four; the codewords at distance three or less, with those five, give a word
one or six 12-bit indices, and two words that differ in up to two bits always share one. So a
fingerprint's keys are, per segment, the exact segment with each index of the next segment: about
16 keys of 33 bits or more. Equal keys are candidates, verified bit by bit.

Copies share a fingerprint and are one node. A key that many fingerprints share is not paired
off: there each fingerprint names itself and its 64 one-bit neighbours, two fingerprints are
linked exactly when they name a common one, and all who name it are linked to the least of them.
The same components result, from 65 rows a fingerprint instead of all pairs.

Null texts count as empty. A null key column stays in its group but is never the group's id,
unless all its keys are null. Repeated rows are members like any other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from datalathe.llm.common import map_arrow, payloads, row_struct, with_fields
from datalathe.llm.components import components
from datalathe.session import cut_lineage

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Low bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
#: Up to so many fingerprints under one key are compared in pairs; more are linked by neighbours.
PAIRED = 64


def fingerprint(data: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[i:j] for i, j in zip(starts[: -width + 1 or None].tolist(), ends[width - 1 :].tolist())]
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", carried: str | None = None) -> DataFrame:
    """The input without its text, with a signed 64-bit fingerprint.

    With ``carried`` the text is a field of that struct column, which stays as it is.
    """
    kept = [c for c in df.columns if carried or c != text]

    def work(batches):
        for batch in batches:
            texts = batch.column(carried).field(text) if carried else batch.column(text)
            found = np.fromiter(map(fingerprint, payloads(texts)), np.uint64, batch.num_rows)
            yield {n: batch.column(n) for n in kept} | {name: found.view(np.int64)}

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    return map_arrow(df, work, with_fields(schema, f"{name} long"))


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 23-bit word's halves, and per remainder the six patterns that lead to its codewords.

    The first pattern is the error itself; where that has three bits, the other five lead to the codewords at
    distance four. Elsewhere all six are the same.
    """
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    units = [remainder(1 << i) for i in range(23)]
    halves = np.zeros((2, 4096), np.int64)
    for half in range(2):
        for i in range(12 if half == 0 else 11):
            halves[half][(np.arange(4096) >> i & 1).astype(bool)] ^= units[12 * half + i]
    patterns = np.zeros((2048, 6), np.int64)
    errors = [0, *(1 << i for i in range(23))]
    errors += [1 << i | 1 << j for i, j in combinations(range(23), 2)]
    triples = [1 << i | 1 << j | 1 << k for i, j, k in combinations(range(23), 3)]

    def of(words):
        return halves[0][words & 4095] ^ halves[1][words >> 12]

    errors = np.array(errors)
    patterns[of(errors)] = errors[:, None]
    triples = np.array(triples)
    patterns[of(triples)] = triples[:, None]
    words = np.arange(1 << 23, dtype=np.int64)
    sevens = np.flatnonzero((of(words) == 0) & (np.bitwise_count(words) == 7))
    for triple, at in zip(triples.tolist(), of(triples).tolist()):
        blocks = sevens[(sevens & triple) == triple]
        patterns[at, 1:] = triple ^ blocks  # the codeword is word ^ error ^ block
    return halves, patterns


def golay_indices(words: np.ndarray) -> np.ndarray:
    """The one or six 12-bit codeword indices of 23-bit words, as rows of six with repeats."""
    halves, patterns = golay()
    near = words[:, None] ^ patterns[halves[0][words & 4095] ^ halves[1][words >> 12]]
    return near >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys of unsigned fingerprints."""
    rows, keys = [], []
    segments = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    for i in range(3):
        indices = golay_indices(segments[(i + 1) % 3])
        once = np.ones(indices.shape, bool)
        once[:, 1:] = indices[:, 1:] != indices[:, :1]
        row, column = np.nonzero(once)
        rows.append(row)
        keys.append(i << 40 | segments[i][row] << 12 | indices[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(prints: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            own = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(own.view(np.uint64))
            yield {"key": keys, "fingerprint": own[rows]}

    return map_arrow(prints.select("fingerprint"), work, "key long, fingerprint long")


def links(prints: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough to connect all within two bits."""
    keyed = _keyed(prints)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # Most keys have one member; what is left is small and written once.
    near = cut_lineage(keyed.join(shared, "key"))
    few, many = near.where(F.col("members") <= PAIRED), near.where(F.col("members") > PAIRED)
    a, b = few.select("key", F.col("fingerprint").alias("a")), few.select("key", F.col("fingerprint").alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (differing <= MAX_BITS)).select("a", "b")
    one_bit = [F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]]
    balls = many.select("fingerprint").distinct().select(
        "fingerprint", F.explode(F.transform(F.array(*one_bit), lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("centre")
    )
    least = balls.groupBy("centre").agg(F.min("fingerprint").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = balls.join(least, "centre").where("fingerprint <> a").select("a", F.col("fingerprint").alias("b"))
    return pairs.unionAll(stars)


def _nodes(rows: DataFrame) -> DataFrame:
    """(fingerprint, component, component_id) of rows (id, fingerprint); component is its least fingerprint."""
    nodes = cut_lineage(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    found = components(links(nodes)).withColumnRenamed("node", "fingerprint")
    # Without links to others a fingerprint is its own component.
    labelled = nodes.join(found, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least"
    )
    lowest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return cut_lineage(labelled.drop("least").join(lowest, "component"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fingerprint as 16 hexadecimal digits, component_id (the least key reachable)."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = cut_lineage(with_fingerprints(rows))
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    joined = rows.join(_nodes(rows), "fingerprint")
    return joined.select(F.col("id").alias(key), hexadecimal.alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group with the input's columns: that of the least key; of rows that repeat it, the first read."""
    numbered = df.select(
        F.monotonically_increasing_id().alias("number"),
        F.col(f"`{key}`").alias("id"),
        row_struct(df, "row"),
    )
    # Written once with its numbers, so every later pass sees the same ones.
    rows = cut_lineage(with_fingerprints(numbered, text, carried="row"))
    found = rows.select("number", "id", "fingerprint").join(_nodes(rows), "fingerprint")
    first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("number").alias("number"))
    return rows.join(first, "number", "left_semi").select("row.*")
