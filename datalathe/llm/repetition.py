"""Quality rules on repetition inside a text, from a suffix array.

Words are stretches without white space (space and U+0009 to U+000D). The words of many texts
stand in one array; ranks of their suffixes come from prefix doubling, where only suffixes that
still share their rank are looked at again, and suffixes of different texts never compare equal.
The longest common prefix (LCP) of neighbours in suffix order gives, for every position, the
length of the longest substring that starts there and occurs again in the same text: the LCP
intervals are the maximal repeated substrings, and the union of their occurrences is the union
of these spans. So one array answers all rules:

* words inside a 3-word window that occurs twice or more (``n_repeat_words``),
* words inside a repeat of at least ``min_repeat`` words (``n_covered_words``),
* the longest repeat in words (``longest_repeat``).

A row fails the base rules with fewer than ``min_words`` words or when 3-word repeats take over
half its words. It fails the method with more than ``max_covered`` of its words inside long
repeats, or one repeat longer than ``max_longest``.

Null and empty texts have no words and fail the base rules. Rows are judged one by one: ties,
repeated rows and extra columns do not matter. A text is processed whole; memory is bounded by
the longest text of a batch, as one text is the unit of the result.
"""

from __future__ import annotations

from itertools import count
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from datalathe.llm.common import map_arrow, payloads, row_struct, with_fields

WINDOW = 3
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 50
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Texts are joined into one suffix array up to about this many words.
CHUNK_WORDS = 300_000

_RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long"
)
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\v\f\r")] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_TAIL = (np.arange(256) & 0xC0) == 0x80


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys, and which of them are shared."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    # The rank is the place of the group's first member, so ranks of a group's parts stay inside it.
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(len(keys), np.int64)
    rank[order] = first[group]
    shared = np.empty(len(keys), bool)
    shared[order] = np.diff(np.append(first, len(keys)))[group] > 1
    return rank, shared


def suffix_ranks(symbols: np.ndarray, text_of: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until no two are equal.

    ``symbols``: small non-negative ids; ``text_of``: the ascending number of the text each
    belongs to. A suffix ends with its text, and an ended one sorts first.
    """
    n = len(symbols)
    rank, shared = _dense(text_of * (symbols.max(initial=0) + 1) + symbols)
    levels, width = [rank], 1
    open_ = np.flatnonzero(shared)
    while len(open_):
        ahead = open_ + width
        inside = ahead < n
        second = np.zeros(len(open_), np.int64)
        here = ahead[inside]
        second[inside] = np.where(text_of[here] == text_of[open_[inside]], rank[here] + 1, 0)
        part, shared = _dense(rank[open_] * (n + 1) + second)
        # Inside its group a suffix moves by the number of members before its part.
        group_rank = rank[open_]
        base = np.full(n + 1, n, np.int64)
        np.minimum.at(base, group_rank, part)
        rank = rank.copy()
        rank[open_] = group_rank + part - base[group_rank]
        levels.append(rank)
        open_ = open_[shared]
        width *= 2
    return levels


def longest_repeats(symbols: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring starting there that occurs again in its text."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    levels = suffix_ranks(symbols, text_of)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    for k in range(len(levels) - 1, -1, -1):
        a, b = left[live] + lcp[live], right[live] + lcp[live]
        inside = (a < n) & (b < n)
        inside[inside] = (text_of[a[inside]] == text_of[left[live[inside]]]) & (
            text_of[b[inside]] == text_of[right[live[inside]]]
        )
        inside[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        lcp[live[inside]] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[left] = lcp
    np.maximum.at(longest, right, lcp)
    return longest


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Flags of positions inside a repeat of at least ``least`` symbols."""
    at = np.flatnonzero(longest >= least)
    steps = np.zeros(len(longest) + 1, np.int64)
    steps[at] += 1
    np.subtract.at(steps, at + longest[at], 1)
    return np.cumsum(steps[:-1]) > 0


def _measure(texts: list[bytes], words: list[list[bytes]], min_repeat: int) -> dict[str, list]:
    ids: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = np.fromiter((ids[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    longest = longest_repeats(symbols, np.repeat(np.arange(len(words)), sizes))
    # Windows of three: a repeat of three words or more, cut to three.
    repeated = _covered(np.where(longest >= WINDOW, WINDOW, 0), WINDOW)
    covered = _covered(longest, min_repeat)
    ends = np.cumsum(sizes)
    per_text = [slice(int(e - n), int(e)) for e, n in zip(ends, sizes)]
    raw = [np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]
    lines = [[x for x in t.split(b"\n") if not x.isspace() and x] for t in texts]
    return {
        "n_words": sizes.tolist(),
        "word_chars": [int(r[~_IS_SPACE & ~_IS_TAIL].sum()) for r in raw],
        "n_symbols": [int(r[_IS_SYMBOL].sum()) for r in raw],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": [int(repeated[s].sum()) for s in per_text],
        "n_covered_words": [int(covered[s].sum()) for s in per_text],
        "longest_repeat": [int(longest[s].max(initial=0)) for s in per_text],
    }


def measure(
    df: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, carried: str | None = None, drop: bool = False
) -> DataFrame:
    """The input's columns with the counts of each text; ``drop`` leaves the text out.

    With ``carried`` the text is a field of that struct column.
    """
    kept = [c for c in df.columns if not (drop and c == text)]

    def work(batches):
        for batch in batches:
            column = batch.column(carried).field(text) if carried else batch.column(text)
            start, texts, words, n = 0, [], [], 0
            for i, data in enumerate(payloads(column)):
                texts.append(data)
                words.append(data.split())
                n += len(words[-1])
                if n >= CHUNK_WORDS or i == batch.num_rows - 1:
                    part = batch.slice(start, len(texts))
                    yield {c: part.column(c) for c in kept} | _measure(texts, words, min_repeat)
                    start, texts, words, n = i + 1, [], [], 0

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    return map_arrow(df, work, with_fields(schema, _RESULT))


def judged(
    measured: DataFrame,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """``base_failed`` and ``kept`` for measured rows."""
    n = F.col("n_words")
    failed = (n < min_words) | (F.col("n_repeat_words") * 100 > n * max_repeat_percent)
    fine = (F.col("n_covered_words") <= n * max_covered) & (F.col("longest_repeat") <= max_longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Per row: key, counts and verdicts."""
    return judged(measure(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__in")), "__in", drop=True), **limits)


def filtered(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows whose text passes, with the input's own columns."""
    rows = judged(measure(df.select(row_struct(df, "__row")), text, carried="__row"), **limits)
    return rows.where("kept").select("__row.*")
