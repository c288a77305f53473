"""Text quality by a generalised additive model with pairwise interactions.

Each text gives a few figures (``FEATURES``) over all its bytes and words. Figures are put into
bins at quantiles of the training rows. Cyclic boosting visits the features in turn, many times:
each visit fits a tree of up to four leaves to the gradients in that feature's bins and adds a
little of it to the feature's lookup table. The pairs whose cells explain most of what is left
then get tables of their own, boosted the same way with one cut per axis. A text's score is the
logistic function of one table entry per feature and pair, added up for a whole batch at once.

Only the figures enter a score; keys, languages, sources and labels do not. Training uses at most
about ``max_rows`` labelled rows, chosen by a hash of their key, whatever their number; scoring
covers every row. Rows whose CRC-32 of the key, written as text, is 2 modulo 4 never train.

Null texts count as empty and are scored. Labels other than 0 and 1, null keys and repeated
labels: null labels and keys train nothing, others count as 1 when positive, repeated rows count
each time. With no labels at all every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from datalathe.llm.common import map_arrow, payloads, row_struct, sliced, with_fields
from datalathe.session import cut_lineage

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "symbols", "exclamations", "bars", "stops", "commas",
    "distinct_words", "repeated_neighbours", "repeated_lines", "words_per_line", "marked_words", "non_ascii",
)
MAX_ROWS, BINS, PAIR_BINS = 20_000, 32, 8
ROUNDS, RATE, PAIRS, PAIR_ROUNDS, SMOOTHING = 120, 0.15, 6, 60, 1.0
THRESHOLD, FOLDS, HELD_OUT = 0.7, 4, 2

_MASKS = np.zeros((10, 256), bool)
for _row, _bytes in enumerate(
    (
        b" \t\n\v\f\r", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#*$%&<>@^~_=+\\/", b"!", b"|", b".?", b",;:",
        bytes(range(128, 192)),
    )
):
    _MASKS[_row, list(_bytes)] = True
_MASKS = _MASKS.astype(np.float64)
_MARKS = frozenset(b"#*$%&|<>!@^~_=+\\/")


def figures(data: bytes) -> list[float]:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    space, upper, lower, digits, symbols, exclaimed, bars, stops, commas, tails = (_MASKS @ counts).tolist()
    words = data.split()
    n = len(words)
    chars = len(data) - tails - space
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    per_char, per_word = 1.0 / max(chars, 1.0), 1.0 / max(n, 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)), chars * per_word, float((lengths > 20).sum()) * per_word, upper / max(upper + lower, 1.0),
        digits * per_char, symbols * per_char, exclaimed * per_word, bars * per_word, stops * per_word,
        commas * per_word, len(set(words)) * per_word, sum(map(eq, words, words[1:])) * per_word,
        (len(lines) - len(set(lines))) / max(len(lines), 1), n / max(len(lines), 1),
        sum(w[-1] in _MARKS for w in words) * per_word, tails * per_char,
    ]


def with_figures(df: DataFrame, text: str = "text", name: str = "figures", carried: str | None = None, drop: bool = False) -> DataFrame:
    """The input with the figures of each text as an array; ``drop`` leaves the text out.

    With ``carried`` the text is a field of that struct column.
    """
    kept = [c for c in df.columns if not (drop and c == text)]

    def work(batches):
        for batch in sliced(batches):
            texts = batch.column(carried).field(text) if carried else batch.column(text)
            yield {n: batch.column(n) for n in kept} | {name: [figures(t) for t in payloads(texts)]}

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    return map_arrow(df, work, with_fields(schema, f"{name} array<double>"))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Model:
    """Lookup tables of features and pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for p in self.pairs for f in p}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values nearest to equal shares."""
    distinct = np.unique(values)
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1), method="nearest"))
    return (distinct[1:] + distinct[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTHING)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut through ordered bins, and the first bin right of it."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree of depth two."""
    out = np.zeros(len(g))
    gain, at = _cut(g, h)
    parts = [(0, at), (at, len(g))] if gain > 0 else [(0, len(g))]
    for low, high in parts:
        gain, at = _cut(g[low:high], h[low:high])
        for a, b in [(low, low + at), (low + at, high)] if gain > 0 else [(low, high)]:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTHING)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best pair of cuts, one per axis."""
    corners = []
    for m in (g, h):
        c = m.cumsum(0).cumsum(1)
        ul, u, left, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        corners.append((ul, u - ul, left - ul, total - u - left + ul))
    if not corners[0][0].size:
        return 0.0, np.zeros_like(g)
    gains = sum(_gain(a, b) for a, b in zip(*corners)) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for rows, columns in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                          (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + SMOOTHING)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Model:
    """Tables for figures x and labels y (0 or 1)."""
    if not len(y):
        return Model()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    model.edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def gradients():
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for table, own in zip(model.tables, bins):
            g, h = gradients()
            step = RATE * _shallow_tree(
                np.bincount(own, g, minlength=len(table)), np.bincount(own, h, minlength=len(table))
            )
            table += step
            total += step[own]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def cells(a, b, weights):
        return np.bincount(coarse[a] * sizes[b] + coarse[b], weights, minlength=sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = gradients()
    gains = {p: _cross(cells(*p, g), cells(*p, h))[0] for p in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted((p for p in gains if gains[p] > 0), key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            step = RATE * _cross(cells(a, b, g), cells(a, b, h))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def train(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows that are not held out, ``max_rows`` of them at most.

    Of more rows a sample is taken by a hash of key, figures and place in the table, so copies of a key are chosen
    one by one.
    """
    known = labels.select(F.col(f"`{key}`").alias("__key"), (F.col(f"`{label}`") > 0).cast("double").alias("__label"))
    known = known.where(F.col("__label").isNotNull() & ~held_out("__key"))
    rows = measured.select(F.col(f"`{key}`").alias("__key"), "figures").join(known, "__key")
    by = F.xxhash64("__key", "figures", "__label")
    rows = cut_lineage(rows.withColumn("__by", by).withColumn("__place", F.xxhash64("__by", F.monotonically_increasing_id())))
    found = rows.count()
    if found > max_rows:
        # Somewhat more than wanted, so that the ordering below is of few rows.
        share = (max_rows + 10 * max_rows**0.5 + 10) / found
        rows = rows.where(F.pmod("__place", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("__place").limit(max_rows)
    got = rows.orderBy("__by", "__place").select("figures", "__label").toArrow()
    x = np.asarray(got.column("figures").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit(x, np.asarray(got.column("__label")))


def scored(measured: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The measured rows with a score in place of the figures."""
    kept = [c for c in measured.columns if c != "figures"]

    def work(batches):
        for batch in sliced(batches):
            x = batch.column("figures").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield {n: batch.column(n) for n in kept} | {name: pa.array(model.score(x))}

    schema = with_fields(measured.drop("figures").schema, f"{name} double")
    return map_arrow(measured, work, schema)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: key, held_out, score and predicted (1 from a score of 0.7)."""
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__in"))
    measured = cut_lineage(with_figures(rows, "__in", drop=True))
    out = scored(measured, train(measured, labels, key, max_rows=max_rows))
    return out.select(
        f"`{key}`", held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def filtered(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows the model accepts, with the input's columns; without labels no row is rejected."""
    packed = df.select(row_struct(df, "__row"), F.col(f"`{key}`"))
    # Written with its figures, so texts are neither measured twice nor moved.
    measured = cut_lineage(with_figures(packed, text, carried="__row"))
    model = train(measured, labels, key, max_rows=max_rows)
    if not model.tables:
        return measured.select("__row.*")
    return scored(measured.drop(key), model).where(F.col("score") >= THRESHOLD).select("__row.*")
