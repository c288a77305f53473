"""Exact, linearly interpolated quantiles without sorting or shuffling the data.

``percentile`` keeps every distinct value of a column in one task, and a global
sort moves the whole column. Here each wanted rank is searched: a sketch brackets
it, one counting pass proves how many rows lie below and inside the bracket, and
the few rows inside are taken in order. Too many rows inside means another round
on the narrower bracket, about accuracy/4 times smaller each time. All passes are
map-side aggregates, so only sketches and counts travel, and a value that holds a
large share of the rows ends the search at once because both pivots fall on it.

Of many columns the ranks are searched digit by digit instead. Values become rows (column, value), and one
map-side aggregate counts them by column and digit: neither the plan nor the number of rounds grows with the
columns of a block. A digit is one of 1024 steps between the ends of the cell searched, by logarithm while these are far
apart. The count keeps each digit's least and largest value, so a hot value ends its search at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from datalathe.functions.scalars import non_nan, number
from datalathe.session import together

ACCURACY = 10_000
# Most values all open brackets of one pass may bring along, so the pass stays small.
VALUE_BUDGET = 1_000_000
# Columns of one aggregate, as wider ones take long to plan and cannot be compiled, and of one search by digits.
BLOCK_COLUMNS = 16


class _Search:
    """One open interval (low, high) of one column that holds wanted ranks."""

    def __init__(self, index, low, high, base, size, ranks):
        self.index, self.low, self.high = index, low, high
        self.base, self.size, self.ranks = base, size, sorted(ranks)
        self.a = self.b = None

    def inside(self, v: str) -> str:
        """SQL text: the value lies in the open interval."""
        parts = [f"{v} IS NOT NULL"]
        if self.low is not None:
            parts.append(f"{v} > {number(self.low)}")
        if self.high is not None:
            parts.append(f"{v} < {number(self.high)}")
        return " AND ".join(parts)

    def positions(self) -> list[float]:
        slack = 2.0 / ACCURACY
        first = (self.ranks[0] - self.base) / max(self.size - 1, 1)
        last = (self.ranks[-1] - self.base) / max(self.size - 1, 1)
        return [max(0.0, first - slack), min(1.0, last + slack)]

    def expected(self) -> float:
        lo, hi = self.positions()
        return (hi - lo) * self.size + 2


def lerp(a: float, b: float, t: float) -> float:
    """Interpolate from the nearer end, as NumPy does."""
    if a == b:
        return a
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1.0 - t)


def rank_pair(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    k = min(int(math.floor(h)), n - 1)
    return k, min(k + 1, n - 1), h - k


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float],
    budget: int = VALUE_BUDGET,
) -> dict[str, list[float | None]]:
    """Quantiles of several numeric expressions, all found in the same passes."""
    names = list(values)
    if not names:
        return {}
    if len(names) > BLOCK_COLUMNS:
        # A block reads its own columns only, so blocks side by side read nothing twice.
        blocks = [names[i : i + BLOCK_COLUMNS] for i in range(0, len(names), BLOCK_COLUMNS)]
        share = budget // len(blocks)
        jobs = {str(i): lambda b=b: _by_digits(df, {n: values[n] for n in b}, probs, share) for i, b in enumerate(blocks)}
        return {n: q for part in together(df.sparkSession, jobs).values() for n, q in part.items()}
    base = df.select(*[non_nan(values[n]).alias(f"v{i}") for i, n in enumerate(names)])
    slack = 2.0 / ACCURACY
    brackets = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    wanted = _array(brackets)
    first = base.agg(
        *[F.expr(f"count(v{i}) AS n{i}") for i in range(len(names))],
        *[F.expr(f"percentile_approx(v{i}, {wanted}, {ACCURACY}) AS q{i}") for i in range(len(names))],
    ).first()

    counts = [first[f"n{i}"] for i in range(len(names))]
    found: dict[tuple[int, int], float] = {}
    open_: list[_Search] = []
    for i, n in enumerate(counts):
        for j, p in enumerate(probs):
            if n:
                k0, k1, _ = rank_pair(n, p)
                s = _Search(i, None, None, 0, n, {k0, k1})
                s.a, s.b = first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]
                open_.append(s)

    while open_:
        open_ = _count_round(base, open_, found, budget)
        if open_:
            _sketch_round(base, open_)

    out: dict[str, list[float | None]] = {}
    for i, n in enumerate(counts):
        row: list[float | None] = []
        for p in probs:
            if not n:
                row.append(None)
                continue
            k0, k1, t = rank_pair(n, p)
            row.append(lerp(found[i, k0], found[i, k1], t) + 0.0)
        out[names[i]] = row
    return out


#: Steps of a digit, and the ratio of a cell's ends from which they are steps of the logarithm.
DIGIT, FAR = 1024, 8.0
#: Whole numbers below it are the same as doubles.
_WHOLE = 2.0**53


@dataclass
class _Cell:
    """Values of one sign in [low, high] of a column, with the ranks wanted among them; ``base`` values are smaller."""

    column: int
    low: float
    high: float
    base: int
    size: int
    ranks: list[int]


def _by_digits(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], budget: int) -> dict[str, list[float | None]]:
    names = list(values)
    each = F.array(*[non_nan(values[n]).cast("double") for n in names])
    base = df.select(F.posexplode(each).alias("c", "v")).where("v IS NOT NULL")
    kind = "CASE WHEN v = double('-inf') THEN 0 WHEN v < 0 THEN 1 WHEN v = 0 THEN 2 WHEN v < double('inf') THEN 3 ELSE 4 END"
    facts = base.groupBy("c", F.expr(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    types = [f.dataType for f in df.select(*[values[n] for n in names]).schema.fields]
    found: dict[tuple[int, int], float] = {}
    counts, cells, exact = [0] * len(names), [], []
    rows = facts.orderBy("c", "kind").collect()
    for c, n in enumerate(names):
        own = [f for f in rows if f["c"] == c]
        if not isinstance(types[c], (T.DoubleType, T.FloatType)) and any(abs(f[e]) >= _WHOLE for f in own for e in ("low", "high")):
            exact.append(n)
            continue
        counts[c], start = sum(f["n"] for f in own), 0
        ranks = sorted({k for p in probs for k in rank_pair(counts[c], p)[:2]})
        for f in own:
            _place(_Cell(c, f["low"], f["high"], start, f["n"], [k for k in ranks if start <= k < start + f["n"]]), found, cells)
            start += f["n"]
    while cells:
        cells = _digit_round(base, cells, found, budget)
    # Whole numbers that doubles do not tell apart.
    out = exact_quantiles(df, {n: values[n] for n in exact}, probs, budget)
    for c, n in enumerate(names):
        if n not in exact:
            pairs = [rank_pair(counts[c], p) for p in probs] if counts[c] else []
            out[n] = [lerp(found[c, a], found[c, b], t) + 0.0 for a, b, t in pairs] or [None] * len(probs)
    return out


def _place(cell: _Cell, found: dict, cells: list[_Cell]) -> None:
    """Takes the ranks at the cell's ends as found, and keeps the cell if others are left."""
    left = []
    for k in cell.ranks:
        if cell.low == cell.high or k == cell.base:
            found[cell.column, k] = cell.low
        elif k == cell.base + cell.size - 1:
            found[cell.column, k] = cell.high
        else:
            left.append(k)
    if left:
        cell.ranks = left
        cells.append(cell)


def _digit_round(base: DataFrame, cells: list[_Cell], found: dict, budget: int) -> list[_Cell]:
    # The smallest cells that together fit the budget are listed value by value.
    listed, room = set(), budget
    for i in sorted(range(len(cells)), key=lambda i: cells[i].size):
        room -= cells[i].size
        if room >= 0:
            listed.add(i)
    rows = [(i, c.column, c.low, c.high, i in listed) for i, c in enumerate(cells)]
    # As many rows as there are open searches: a few for each column.
    table = base.sparkSession.createDataFrame(rows, "cell int, c int, lo double, hi double, listed boolean")
    met = base.join(F.broadcast(table), "c").where("v >= lo AND v <= hi")
    share = lambda f: f"({f('v')} - {f('lo')}) / ({f('hi')} - {f('lo')})"
    plain, logs = share(str), share(lambda x: f"(signum({x}) * ln(abs({x})))")
    # The sign turns the logarithm round for negative values, so that it rises with them.
    ratio = f"greatest(hi / lo, lo / hi) >= {FAR}D"
    digit = F.expr(f"if(listed, v, least(floor({DIGIT} * if({ratio}, {logs}, {plain})), {DIGIT - 1}))")
    counted = met.select("cell", "v", digit.alias("digit")).groupBy("cell", "digit")
    got = counted.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).toArrow()
    columns = {n: got.column(n).to_numpy() for n in ("cell", "n", "low", "high")}
    order = np.lexsort((columns["low"], columns["cell"]))
    cell_of, n, low, high = (columns[x][order] for x in ("cell", "n", "low", "high"))
    still: list[_Cell] = []
    for i, cell in enumerate(cells):
        at = slice(*np.searchsorted(cell_of, [i, i + 1]))
        ends = cell.base + np.cumsum(n[at])
        places = np.searchsorted(ends, cell.ranks, side="right")
        for j in np.unique(places).tolist():
            size = int(n[at][j])
            ranks = [k for k, p in zip(cell.ranks, places.tolist()) if p == j]
            _place(_Cell(cell.column, float(low[at][j]), float(high[at][j]), int(ends[j]) - size, size, ranks), found, still)
    return still


def _array(values: Sequence[float]) -> str:
    return f"array({', '.join(number(v) for v in values)})"


def _sketch_round(base: DataFrame, searches: list[_Search]) -> None:
    aggs = []
    for s_i, s in enumerate(searches):
        v = f"v{s.index}"
        chosen = f"if({s.inside(v)}, {v}, NULL)"
        aggs.append(F.expr(f"percentile_approx({chosen}, {_array(s.positions())}, {ACCURACY}) AS q{s_i}"))
    row = base.agg(*aggs).first()
    for s_i, s in enumerate(searches):
        s.a, s.b = row[f"q{s_i}"]


def _count_round(base, searches, found, budget) -> list[_Search]:
    share = budget / len(searches)
    aggs = []
    for s_i, s in enumerate(searches):
        v, a, b = f"v{s.index}", number(s.a), number(s.b)
        between = f"{v} > {a} AND {v} < {b}"
        tests = {"lt": f"{s.inside(v)} AND {v} < {a}", "ea": f"{v} = {a}", "in": between, "eb": f"{v} = {b}"}
        aggs += [F.expr(f"count_if({t}) AS {name}{s_i}") for name, t in tests.items()]
        # The sketch bounds the number of rows between its pivots, so the list is bounded too.
        if s.a != s.b and s.expected() <= share:
            aggs.append(F.expr(f"sort_array(collect_list(if({between}, {v}, NULL))) AS vs{s_i}"))
    row = base.agg(*aggs).first().asDict()

    still: list[_Search] = []
    for s_i, s in enumerate(searches):
        lt, ea, within = row[f"lt{s_i}"], row[f"ea{s_i}"], row[f"in{s_i}"]
        eb = row[f"eb{s_i}"] if s.a != s.b else 0
        listed = row.get(f"vs{s_i}")
        below, middle, above = [], [], []
        for r in s.ranks:
            q = r - s.base
            if q < lt:
                below.append(r)
            elif q < lt + ea:
                found[s.index, r] = s.a
            elif q < lt + ea + within:
                if listed is not None:
                    found[s.index, r] = listed[q - lt - ea]
                else:
                    middle.append(r)
            elif q < lt + ea + within + eb:
                found[s.index, r] = s.b
            else:
                above.append(r)
        if below:
            still.append(_Search(s.index, s.low, s.a, s.base, lt, below))
        if middle:
            still.append(_Search(s.index, s.a, s.b, s.base + lt + ea, within, middle))
        if above:
            passed = lt + ea + within + eb
            still.append(_Search(s.index, s.b, s.high, s.base + passed, s.size - passed, above))
    return still
