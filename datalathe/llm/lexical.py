"""Ranked lexical search without a document index: an Aho-Corasick automaton of all items' terms reads the texts.

Terms are the maximal stretches of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased.
A text is read with every other character as a blank and a blank at both ends, and the automaton holds each
term between two blanks, so it reports whole terms only; neighbours share their blank. A term leads to
the items that hold it.

Two scans: the first counts documents, terms and each term's documents; between them every term gets its weight;
the second scores, and each task keeps an item's best ``k`` so far and drops only what k others beat. Scores are
integers: with N documents that have a term, L terms in them, n terms in the document, df documents
with the term and tf of it in the document, ``w = floor(1000 ln((2N+2) / (2df+1)))`` and
``m = 100 - 50 + 50 n N div L``, a term adds ``w * (1000000000 tf div (1000 tf + 20 m))``.

Items are the given query set. They are dealt by a hash of their id into blocks of bounded size, each with an
automaton broadcast to all tasks and the two scans of its own, so neither it nor the kept scores
grow with the number of items. An item's own distinct terms must fit in memory.

Items with equal ids are one; items without an id or without terms give no rows. Documents with equal ids are ranked each
for itself; those without an id take part and come last among equal scores. A null or empty text has no
terms and is not counted. Texts are read whole. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from datalathe.llm.common import map_arrow, payloads, sliced
from datalathe.session import cut_lineage

TOP = 50
#: Items, and pairs of an item and a term, in a block; products of a document's terms and their items added at once.
BLOCK_ITEMS, BLOCK_TERMS, ADDED, DOCUMENTS = 5_000, 500_000, 500_000, 256
#: Parts that an item's candidates are cut into before the last ranking.
PARTS = 32

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a term as they are, A-Z in lower case, all others as blanks.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_second = itemgetter(1)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, term)."""
    lowered = F.translate(F.col(f"`{text}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col(f"`{key}`").cast("long").alias("item"), F.explode(F.split(lowered, _BETWEEN)).alias("term"))
    return terms.where("item IS NOT NULL AND term <> ''").distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds the terms, by number, in texts made by ``guarded``."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term.encode().decode('latin-1')} ", i)
    found.make_automaton()
    return found


def guarded(data: bytes) -> tuple[int, str]:
    """Number of terms, and the text's bytes as characters with blanks between and around the terms."""
    plain = data.translate(_BYTES)
    return len(plain.split()), f" {plain.decode('latin-1')} "


def _scanned(batches, found: ahocorasick.Automaton):
    """(row number, terms, {term: times}) of the texts that have a term, batch by batch."""
    for batch in sliced(batches, 500):
        texts = []
        for i, data in enumerate(payloads(batch.column("text"))):
            n, text = guarded(data)
            if n:
                texts.append((i, n, Counter(map(_second, found.iter(text)))))
        yield batch, texts


def _counts(docs: DataFrame, shared, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each term."""

    def work(batches):
        n, length, df = 0, 0, np.zeros(terms, np.int64)
        for _, texts in _scanned(batches, shared.value[0]):
            n += len(texts)
            length += sum(t[1] for t in texts)
            for _, _, times in texts:
                df[np.fromiter(times, np.int64, len(times))] += 1
        held = np.flatnonzero(df)
        yield {"term": np.concatenate([[-2, -1], held]), "times": np.concatenate([[n, length], df[held]])}

    rows = map_arrow(docs.select("text"), work, "term long, times long").groupBy("term").agg(F.sum("times").alias("times")).collect()
    found = {r["term"]: r["times"] for r in rows}
    df = np.zeros(terms, np.int64)
    for term, times in found.items():
        if term >= 0:
            df[term] = times
    return found.get(-2, 0), found.get(-1, 0), df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The best ``k`` documents of each item so far; ties to the smaller id, documents without an id last."""

    def __init__(self, items: int, k: int):
        self.items, self.k, self.held = items, k, 0
        self.least = np.ones(items, np.int64)  # a score below it cannot be among the best
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc: np.ndarray) -> None:
        kept = score >= self.least[item]
        self.parts.append((item[kept], score[kept], missing[kept], doc[kept]))
        self.held += len(self.parts[-1][0])
        if self.held > 4 * self.items * self.k + 10_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """(item, score, missing, doc) of the best."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        item, score, missing, doc = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((doc, missing, -score, item))
        of = item[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]
        item, score, missing, doc = (c[order] for c in (item, score, missing, doc))
        full = np.flatnonzero(np.bincount(item, minlength=self.items) >= self.k)
        self.least[full] = score[np.searchsorted(item, full, side="right") - 1]
        self.parts, self.held = [(item, score, missing, doc)], len(item)
        return self.parts[0]


def _best(docs: DataFrame, shared, w: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """Each task's best (item_id, doc_id, score)."""

    def work(batches):
        found, starts, posted, ids = shared.value
        items = len(ids)
        best = Best(items, k)
        for batch, texts in _scanned(batches, found):
            doc = batch.column("doc")
            missing, doc = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64), doc.fill_null(0).to_numpy()
            held, added, rows = [], 0, []
            for i, size, times in texts:
                term, tf = np.fromiter(times, np.int64, len(times)), np.fromiter(times.values(), np.int64, len(times))
                m = 50 + 50 * size * n // length
                held.append((term, w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m)), np.full(len(term), len(rows))))
                rows.append(i)
                added += int((starts[term + 1] - starts[term]).sum())
                if added >= ADDED or len(rows) == DOCUMENTS:
                    _scored(best, held, np.array(rows), starts, posted, items, missing, doc)
                    held, added, rows = [], 0, []
            if rows:
                _scored(best, held, np.array(rows), starts, posted, items, missing, doc)
        item, score, missing, doc = best.cut()
        yield {"item_id": ids[item], "doc_id": [None if m else d for m, d in zip(missing.tolist(), doc.tolist())], "score": score}

    return map_arrow(docs, work, "item_id long, doc_id long, score long")


def _scored(best: Best, held: list, rows: np.ndarray, starts, posted, items: int, missing, doc) -> None:
    """Adds what the documents' terms give to their items and offers the sums."""
    term, value, at = (np.concatenate(c) for c in zip(*held))
    times = starts[term + 1] - starts[term]
    ends = np.cumsum(times)
    if not len(ends) or not ends[-1]:
        return
    place = np.repeat(starts[term] - (ends - times), times) + np.arange(ends[-1])
    cells, where = np.unique(np.repeat(at, times) * items + posted[place], return_inverse=True)
    scores = np.zeros(len(cells), np.int64)
    np.add.at(scores, where, np.repeat(value, times))
    row = rows[cells // items]
    best.add(cells % items, scores, missing[row], doc[row])


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item, rank, document, score) of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    pairs = cut_lineage(item_terms(items, item, item_text))
    held, distinct = pairs.agg(F.count(F.lit(1)), F.countDistinct("item")).first()
    blocks = max(1, math.ceil(held / block_terms), math.ceil(distinct / block_items))
    parts = []
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        ids, owner = np.unique(own.column("item").to_numpy(), return_inverse=True)
        words, term = np.unique(np.array(own.column("term").to_pylist(), object), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))])
        posted = owner[np.argsort(term, kind="stable")]
        # Term t leads to the items ``posted[starts[t]:starts[t + 1]]``.
        shared = spark.sparkContext.broadcast((automaton(words.tolist()), starts, posted, ids))
        n, length, df = _counts(texts, shared, len(words))
        if n:
            parts.append(_best(texts, shared, weights(n, df), n, length, k))
    if not parts:
        return spark.range(0).selectExpr(f"id as `{item}`", "0 as rank", f"id as `{key}`", "id as score")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # An item has k rows from each task; they are ranked in parts first, so no task gets all of an item's.
    within = Window.partitionBy("item_id", "part").orderBy(*order)
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    found = found.withColumn("place", F.row_number().over(within)).where(F.col("place") <= k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item), "rank", F.col("doc_id").alias(key), "score")
