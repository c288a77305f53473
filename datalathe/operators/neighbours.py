"""Exact nearest neighbours for rows with gaps, by pivot cells pruned with the triangle inequality.

Features are standardised; a gap among them counts as the feature's mean. Rows that have the value are
donors. A point that many donors share keeps the ``k`` with the smallest row ids, as no other can be among its
nearest. A bounded sample of the points gives pivots, and donors belong to the cell of their nearest pivot, in
blocks of near-equal distance to it. For a row with a gap, the k-th distance to sampled points bounds the k-th
distance to all. A block is read only if its span of distances to its pivot, and its cell's border to the
row's own cell, leave room for a point within that bound. Rows with equal features are one question.

Squared distances are compared at nine decimals; ties go to the smaller row id. Nothing is approximate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from datalathe.functions.kinds import ROW_ID, is_numeric, numeric_columns, require_column, require_numeric
from datalathe.functions.scalars import col, missing, non_nan, present
from datalathe.session import cut_lineage

#: Points in the sample, pivots, rows in a block of donors, and questions answered at once against a block.
SAMPLE, PIVOTS, BLOCK, ASKED = 32_768, 256, 2048, 512
#: Cells nearest to a question's own one whose sampled points bound its k-th distance.
AROUND = 8
DECIMALS, SLACK = 9, 1e-6


def feature_columns(df: DataFrame, column: str, features: list[str] | None, row_id: str = ROW_ID) -> list[str]:
    """The given features, else all other numeric columns."""
    names = features if features is not None else [c for c in numeric_columns(df, row_id) if c != column]
    for name in names:
        require_numeric(df, name, "a feature of the nearest neighbours")
    if not names or column in names:
        raise ValueError(f"nearest neighbours for '{column}' need numeric features other than itself")
    return names


def scales(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each feature that has any spread."""
    aggs = [f(non_nan(col(c)).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = df.agg(*aggs).first()
    return {c: (found[f"m{i}"], found[f"s{i}"]) for i, c in enumerate(features) if found[f"s{i}"]}


def _point(by: dict[str, tuple[float, float]]) -> Column:
    at = [F.coalesce((non_nan(col(c)).cast("double") - mean) / deviation, F.lit(0.0)) for c, (mean, deviation) in by.items()]
    return F.array(*at) if at else F.array(F.lit(0.0))


def _matrix(points: pa.Array, size: int) -> np.ndarray:
    return points.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, dimension by dimension, so equal points are exactly 0 apart."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += (x[:, j][:, None] - y[:, j]) ** 2
    return out


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    kind = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in kind.fields])

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


class Cells:
    """Pivots with the points of the sample around them."""

    def __init__(self, sample: np.ndarray):
        count = max(1, min(PIVOTS, math.isqrt(len(sample))))
        self.pivots = sample[:count]
        cell = np.argmin(_distances(sample, self.pivots), axis=1)
        order = np.argsort(cell, kind="stable")
        self.sample, self.edges = sample[order], np.searchsorted(cell[order], np.arange(count + 1))
        self.apart = np.sqrt(_distances(self.pivots, self.pivots))

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distances to all pivots."""
        d = np.sqrt(_distances(x, self.pivots))
        return d.argmin(1), d

    def bounds(self, x: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
        """No less than the k-th distance of each row; infinite where the sample has fewer points."""
        out = np.full(len(x), np.inf)
        if len(self.sample) < k:
            return out
        for c in np.unique(cell).tolist():
            near = np.argsort(self.apart[c], kind="stable")[:AROUND]
            points = np.concatenate([self.sample[self.edges[n] : self.edges[n + 1]] for n in near])
            points = points if len(points) >= k else self.sample
            at = np.flatnonzero(cell == c)
            for start in range(0, len(at), ASKED):
                part = at[start : start + ASKED]
                out[part] = np.sqrt(np.partition(_distances(x[part], points), k - 1, axis=1)[:, k - 1])
        return out


def _blocks(donors: DataFrame, cells: Cells, size: int, parts: int, value: str) -> DataFrame:
    """Blocks of donors (r, value, z) in order of their cell and distance to its pivot."""

    def assigned(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                cell, d = cells.own(_matrix(part.column("z"), size))
                yield {"r": part.column("r"), "value": part.column("value"), "z": part.column("z"), "cell": cell, "d": d[np.arange(len(cell)), cell]}

    def packed(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks()
                cell = whole.column("cell").to_numpy()
                # A block ends with its cell or when it is full; the rest waits for the next batch.
                end = min(BLOCK, int(np.searchsorted(cell, cell[0], side="right")))
                yield _block(whole.slice(0, end), size)
                held, rows = whole.slice(end).to_batches(), rows - end
        whole = pa.Table.from_batches(held).combine_chunks() if held else None
        while rows:
            cell = whole.column("cell").to_numpy()
            end = int(np.searchsorted(cell, cell[0], side="right"))
            yield _block(whole.slice(0, end), size)
            whole, rows = whole.slice(end), rows - end

    placed = _mapped(donors, assigned, f"r long, value {value}, z array<double>, cell int, d double")
    ordered = placed.repartitionByRange(parts, "cell", "d").sortWithinPartitions("cell", "d")
    blocks = _mapped(ordered, packed, f"cell int, lo double, hi double, rows binary, points binary, held array<{value}>")
    return cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))


def _block(rows: pa.Table, size: int) -> dict:
    d = rows.column("d").to_numpy()
    points = _matrix(rows.column("z").combine_chunks(), size)
    return {
        "cell": [int(rows.column("cell")[0].as_py())], "lo": [d[0]], "hi": [d[-1]], "rows": [rows.column("r").to_numpy().tobytes()],
        "points": [np.ascontiguousarray(points).tobytes()], "held": [rows.column("value").to_pylist()],
    }


def _looked_up(asked: DataFrame, cells: Cells, size: int, k: int) -> DataFrame:
    """(q, z, bound, cell, lo, hi): the spans of distances to each pivot where a question's nearest may lie."""

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ASKED):
                part = batch.slice(start, ASKED)
                x = _matrix(part.column("z"), size)
                own, d = cells.own(x)
                bound = cells.bounds(x, own, k) * (1 + SLACK) + SLACK
                # A point of another cell is nearer to that pivot: it lies beyond the border between both.
                apart = cells.apart[own]
                mine = d[np.arange(len(own)), own][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = np.where(apart > 0, (d * d - mine * mine) / (2 * apart), 0)
                at, cell = np.nonzero(border <= bound[:, None])
                near = d[at, cell]
                yield {
                    "q": part.column("q").take(pa.array(at)), "z": part.column("z").take(pa.array(at)), "cell": cell,
                    "lo": near - bound[at], "hi": near + bound[at],
                }

    return _mapped(asked, work, "q long, z array<double>, cell int, lo double, hi double")


def _packed_questions(met: DataFrame, size: int) -> DataFrame:
    """(block, qs, zs): up to ``ASKED`` questions for one block in a row."""

    def work(batches):
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
            q, z = batch.column("q").to_numpy(), _matrix(batch.column("z"), size)
            spans = [(s, min(s + ASKED, e)) for a, e in zip(edges[:-1], edges[1:]) for s in range(a, e, ASKED)]
            yield {
                "block": [int(block[s]) for s, _ in spans], "qs": [q[s:e].tobytes() for s, e in spans],
                "zs": [np.ascontiguousarray(z[s:e]).tobytes() for s, e in spans],
            }

    return _mapped(met.sortWithinPartitions("block"), work, "block long, qs binary, zs binary")


def neighbours(donors: DataFrame, asked: DataFrame, k: int, size: int, value: str) -> DataFrame:
    """(q, rank, r, value): the k nearest donors (r, value, z) of each question (q, z)."""
    ordered = Window.partitionBy("z").orderBy("r")
    donors = cut_lineage(donors.withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= k).drop("n"))
    count = donors.count()
    if not count:
        return donors.sparkSession.createDataFrame([], f"q long, rank int, r long, value {value}")
    sample = donors.select("z").orderBy(F.xxhash64("z", "r"), "r").limit(SAMPLE).toArrow().column("z").combine_chunks()
    cells = Cells(_matrix(sample, size))
    blocks = _blocks(donors, cells, size, max(1, math.ceil(count / (8 * BLOCK))), value)
    spans = cut_lineage(blocks.select("cell", "block", F.col("lo").alias("from"), F.col("hi").alias("to")))
    met = _looked_up(asked, cells, size, k).join(spans, "cell").where("from <= hi and to >= lo").select("q", "z", "block")
    asking = _packed_questions(met, size)

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                q, z = np.frombuffer(row["qs"].as_py(), np.int64), np.frombuffer(row["zs"].as_py()).reshape(-1, size)
                r, points = np.frombuffer(row["rows"].as_py(), np.int64), np.frombuffer(row["points"].as_py()).reshape(-1, size)
                d = np.round(_distances(z, points), DECIMALS)
                if d.shape[1] > k:
                    kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                    a, b = np.nonzero(d <= kth[:, None])
                else:
                    a, b = np.nonzero(np.ones_like(d, bool))
                order = np.lexsort((r[b], d[a, b], a))
                a, b = a[order], b[order]
                kept = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b = a[kept], b[kept]
                yield {"q": q[a], "d": d[a, b], "r": r[b], "value": row["held"].values.take(pa.array(b))}

    best = _mapped(asking.join(blocks.select("block", "rows", "points", "held"), "block"), work, f"q long, d double, r long, value {value}")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "r"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "r", "value")


def fill_from_neighbours(
    df: DataFrame, source: DataFrame, column: str, by: dict[str, tuple[float, float]], k: int = 5, row_id: str = ROW_ID
) -> DataFrame:
    """``column`` of ``df`` with gaps filled from the ``k`` nearest rows of ``source`` that have it.

    Numbers get the neighbours' mean (as double), other values the most frequent one, the smallest of tied ones.
    Without a row that has the value, gaps stay.
    """
    require_column(df, column)
    numeric = is_numeric(source, column)
    kind = "double" if numeric else source.schema[column].dataType.simpleString()
    size = max(1, len(by))
    value = present(source, column)
    donors = source.where(~missing(source, column)).select(
        col(row_id).cast("long").alias("r"), (value.cast("double") if numeric else value).alias("value"), _point(by).alias("z")
    )
    gaps = df.where(missing(df, column)).select(_point(by).alias("z")).distinct()
    asked = cut_lineage(gaps.withColumn("q", F.monotonically_increasing_id()))
    found = neighbours(donors, asked, k, size, kind)
    if numeric:
        of = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
        answer = F.aggregate(of, F.lit(0.0), lambda a, v: a + v) / F.count(F.lit(1))
        answers = found.groupBy("q").agg(answer.alias("__filled"))
    else:
        counted = found.groupBy("q", "value").agg(F.count(F.lit(1)).alias("n"))
        answers = counted.groupBy("q").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("__filled"))
    answers = cut_lineage(answers.join(asked, "q").select(F.col("z").alias("__z"), "__filled"))
    # Only rows with a gap meet the answers.
    kept = df.where(~missing(df, column))
    filled = df.where(missing(df, column)).withColumn("__at", _point(by)).join(answers, F.col("__at") == F.col("__z"), "left")
    as_filled = (present(df, column).cast("double") if numeric else present(df, column)).alias(column)
    return kept.select(*[as_filled if c == column else col(c) for c in df.columns]).unionAll(
        filled.select(*[F.col("__filled").alias(column) if c == column else col(c) for c in df.columns])
    )
