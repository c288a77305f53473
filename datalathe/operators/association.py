"""Pearson, Spearman, Kendall and Cramér's V over all pairs of columns.

Pearson is one map-side aggregate. The others start from joint counts
``(pair, x, y, w)``: all pairs are counted in one job, and everything after works on
distinct value pairs, however many rows share them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import ROW_ID, numeric_columns
from datalathe.functions.ordering import running_total
from datalathe.functions.scalars import col, non_nan, number, number_sql, present, round_dp, text
from datalathe.session import cut_lineage, plain_result

METHODS = ("pearson", "spearman", "kendall")
HIGH_CORRELATION = 0.8

# Most pairs of one JVM aggregate, so its generated code stays compilable.
PAIRS_PER_PASS = 60
# Distinct points one task counts by itself, and blocks per axis when there are more.
LEAF_POINTS = 1_000_000
BLOCKS = 400


def pair_columns(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


@dataclass(frozen=True)
class _Centre:
    """What one pass learns about a column before pairs are formed."""

    mean: float | None
    gaps: bool
    constant: bool


def _centres(df: DataFrame, columns: list[str]) -> dict[str, _Centre]:
    row = df.agg(
        F.expr("count(1) AS rows"),
        *[
            F.expr(f"struct(count({v}) AS n, avg({v}) AS mean, min({v}) AS lo, max({v}) AS hi) AS c{i}")
            for i, v in enumerate(number_sql(c) for c in columns)
        ],
    ).first()
    out = {}
    for i, c in enumerate(columns):
        s = row[f"c{i}"]
        out[c] = _Centre(s["mean"], s["n"] < row["rows"], s["n"] == 0 or s["lo"] == s["hi"])
    return out


def _pair_frame(df: DataFrame, pairs: list[tuple[str, str]], values: dict[str, str], centres) -> DataFrame:
    """``(column_a, column_b, correlation)`` of centred expressions.

    A few pairs without gaps are one map-side aggregate of the JVM, with squares shared between pairs. Many pairs,
    and pairs with gaps, are products of matrices per Arrow batch in one scan, as an aggregate per pair
    could neither be compiled nor share a scan. One rule for a constant side: equal ends over the pair's own rows.
    """
    gappy = [p for p in pairs if any(centres[c].gaps for c in p)]
    plain = [p for p in pairs if p not in set(gappy)] if gappy else pairs
    if len(plain) > PAIRS_PER_PASS:
        gappy, plain = pairs, []
    parts = []
    if plain:
        names = sorted({c for pair in plain for c in pair if not centres[c].constant})
        place = {c: i for i, c in enumerate(names)}
        base = df.selectExpr(*[f"{values[c]} AS v{i}" for c, i in place.items()], "1 AS one")
        aggs = [f"sum(v{i} * v{i}) AS s{i}" for i in place.values()]
        entries = []
        for a, b in plain:
            formula = "double(NULL)"
            if a in place and b in place:
                i, j = place[a], place[b]
                aggs.append(f"sum(v{i} * v{j}) AS p{i}_{j}")
                formula = f"p{i}_{j} / sqrt(s{i} * s{j})"
            entries.append(f"named_struct('column_a', {text(a)}, 'column_b', {text(b)}, 'correlation', {formula})")
        wide = base.agg(F.expr("count(1) AS rows"), *[F.expr(e) for e in aggs])
        parts.append(wide.selectExpr(f"inline(array({', '.join(entries)}))"))
    if gappy:
        parts.append(_pair_matrix(df, gappy, values, centres))
    return reduce(DataFrame.unionByName, parts)


#: Share of its squares about the common mean that a pair's own spread must reach; below it the pair is summed anew about its own means.
WELL_CENTRED = 1e-6
_SUMS = ("n", "x", "y", "xx", "yy", "xy")
_ENDS = ("xlo", "xhi", "ylo", "yhi")


def _pair_matrix(df: DataFrame, pairs: list[tuple[str, str]], values: dict[str, str], centres) -> DataFrame:
    names = sorted({c for pair in pairs for c in pair if not centres[c].constant})
    place = {c: i for i, c in enumerate(names)}
    wanted = [(i, place[a], place[b]) for i, (a, b) in enumerate(pairs) if a in place and b in place]
    if not wanted:
        return _named(df, pairs, df.sparkSession.createDataFrame([], "pair int, r double"), "r")
    pair, first, second = (np.array(v, np.int64) for v in zip(*wanted))
    holes = [i for c, i in place.items() if centres[c].gaps]
    base = df.selectExpr(*[f"double({values[c]}) AS v{i}" for c, i in place.items()])

    def products(batches):
        """Sums and ends over a task's rows for each pair, where both are present."""
        k = len(names)
        total, squares, rows, sums = np.zeros((4, k, k)), np.zeros((k, k)), 0, np.zeros(k)
        lo, hi = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            gaps = np.isnan(x[:, holes]).any() if holes else False
            if not gaps:
                # All rows count for all pairs: one product.
                squares += x.T @ x
                rows, sums = rows + len(x), sums + x.sum(0)
                if holes and len(x):
                    np.minimum(lo, x.min(0)[:, None], out=lo)
                    np.maximum(hi, x.max(0)[:, None], out=hi)
                continue
            there = ~np.isnan(x)
            for j in range(k):
                # The ends of every column where column j is present.
                own = x if there[:, j].all() else x[there[:, j]]
                if len(own):
                    np.fmin(lo[:, j], np.fmin.reduce(own, axis=0), out=lo[:, j])
                    np.fmax(hi[:, j], np.fmax.reduce(own, axis=0), out=hi[:, j])
            there, x = there.astype(np.float64), np.where(there, x, 0.0)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        n, s, ss, p = total
        n, s, ss, p = n + rows, s + sums[:, None], ss + np.diag(squares)[:, None], p + squares
        found = (n[first, second], s[first, second], s[second, first], ss[first, second], ss[second, first], p[first, second])
        ends = (lo[first, second], hi[first, second], lo[second, first], hi[second, first])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (pair, *found, *ends)], names=["pair", *_SUMS, *_ENDS])

    schema = "pair long, " + ", ".join(f"{c} double" for c in (*_SUMS, *_ENDS))
    merged = [F.sum(c).alias(c) for c in _SUMS] + [(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in _ENDS]
    # A row per pair, which the caller has listed.
    rows = base.mapInArrow(products, schema).groupBy("pair").agg(*merged).collect()
    out, poor = [], []
    for r in rows:
        constant = bool(holes) and not (r["xhi"] > r["xlo"] and r["yhi"] > r["ylo"])
        if r["n"] < 2 or constant:
            continue
        dx, dy = (r[f"{s}{s}"] - r[s] * r[s] / r["n"] for s in "xy")
        if holes and not (dx > WELL_CENTRED * r["xx"] and dy > WELL_CENTRED * r["yy"]):
            poor.append(r)
        elif dx > 0 and dy > 0:
            out.append((r["pair"], (r["xy"] - r["x"] * r["y"] / r["n"]) / (dx * dy) ** 0.5))
    for start in range(0, len(poor), PAIRS_PER_PASS):
        part = [(r["pair"], *(place[c] for c in pairs[r["pair"]]), r["xlo"], r["ylo"]) for r in poor[start : start + PAIRS_PER_PASS]]
        out += _about_own_means(base, part)
    return _named(df, pairs, df.sparkSession.createDataFrame(out, "pair int, r double"), "r")


def _about_own_means(base: DataFrame, pairs: list[tuple[int, int, int, float, float]]) -> list[tuple[int, float]]:
    """Correlations of ill-centred pairs: means about one of their own values first, then products about these means."""
    sides, means = [], []
    for p, i, j, x0, y0 in pairs:
        both = f"v{i} IS NOT NULL AND v{j} IS NOT NULL"
        sides.append((f"if({both}, v{i} - {number(x0)}, NULL)", f"if({both}, v{j} - {number(y0)}, NULL)"))
        means += [f"avg({s}) AS {n}{p}" for s, n in zip(sides[-1], "xy")]
    found = base.agg(*[F.expr(m) for m in means]).first()
    aggs = []
    for (p, *_), (x, y) in zip(pairs, sides):
        x, y = f"({x} - {number(found[f'x{p}'])})", f"({y} - {number(found[f'y{p}'])})"
        aggs += [f"sum({x} * {x}) AS xx{p}", f"sum({y} * {y}) AS yy{p}", f"sum({x} * {y}) AS xy{p}"]
    sums = base.agg(*[F.expr(a) for a in aggs]).first()
    return [(p, sums[f"xy{p}"] / (sums[f"xx{p}"] * sums[f"yy{p}"]) ** 0.5) for p, *_ in pairs if sums[f"xx{p}"] > 0 and sums[f"yy{p}"] > 0]


def pearson(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(column_a, column_b, correlation)`` over pairwise complete rows; NULL beside a constant.

    One pass finds the means, the next sums centred products; no row is shuffled. Pairs whose own rows lie close
    together far from the columns' means are summed again about their own.
    """
    centres = _centres(df, columns)
    values = {c: f"{number_sql(c)} - {number(k.mean)}" for c, k in centres.items() if k.mean is not None}
    return _pair_frame(df, pairs or pair_columns(columns), values, centres)


def joint_counts(df: DataFrame, pairs: list[tuple[str, str]], as_type: str = "double") -> DataFrame:
    """``(pair, x, y, w)`` over rows where both columns of a pair have a value."""
    args = [F.lit(len(pairs))]
    for i, (a, b) in enumerate(pairs):
        args += [F.lit(i), present(df, a).cast(as_type), present(df, b).cast(as_type)]
    return (
        df.select(F.stack(*args).alias("pair", "x", "y"))
        .where("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("pair", "x", "y")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def _named(df: DataFrame, pairs: list[tuple[str, str]], values: DataFrame, value: str) -> DataFrame:
    """Pair numbers turned into column names; pairs without a value keep NULL."""
    names = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_a string, column_b string"
    )
    return names.join(values, "pair", "left").select("column_a", "column_b", F.col(value).alias("correlation"))


def _distinct(df: DataFrame, columns: list[str]) -> list[int]:
    """Approximate numbers of distinct values, from one map-side sketch pass."""
    return list(df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(columns)]).first())


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of average ranks over the complete rows of each pair.

    A column without gaps has the same ranks in every pair, so all such columns are ranked
    at once. Pairs with gaps are ranked pair by pair.
    """
    centres = _centres(df, columns)
    pairs = pair_columns(columns)
    whole = [c for c in columns if not centres[c].gaps and not centres[c].constant]
    easy = [p for p in pairs if p[0] in whole and p[1] in whole]
    hard = [p for p in pairs if p not in easy]
    parts = []
    if easy:
        parts.append(_spearman_whole(df, [c for c in whole if any(c in p for p in easy)], easy, centres))
    if hard:
        parts.append(_spearman_pairs(df, hard))
    return reduce(DataFrame.unionByName, parts)


def _spearman_whole(df, columns, pairs, centres) -> DataFrame:
    ranked = _ranked(df.select(*[present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), max(_distinct(df, columns)) <= LEAF_POINTS)
    return _pair_frame(ranked, pairs, {c: f"r{i}" for i, c in enumerate(columns)}, centres)


def _ranked(values: DataFrame, bounded: bool) -> DataFrame:
    """The rows with, for each column without gaps, twice the distance of its value's average rank to the mean rank.

    All columns are counted in one histogram and ranked in one pass over it. A table of at most ``LEAF_POINTS`` ranks is looked up
    inside the scan; a larger one joins all cells by column and value at once, and the cells of a row meet again.
    """
    k = len(values.columns)
    rows = values.count()
    cells = values.select(F.posexplode(F.array(*values.columns)).alias("c", "v"))
    counts = cells.groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt"))
    ranks = running_total(counts, "c", "v", "cnt", bounded).select("c", "v", F.expr(f"double(2 * before + cnt - {rows}L)").alias("r"))
    ranks = cut_lineage(ranks)
    names = [f"r{i}" for i in range(k)]
    if ranks.count() > LEAF_POINTS:
        # Numbered before the rows are taken apart, which one projection would do the other way round.
        numbered = values.withColumn("row", F.monotonically_increasing_id())
        placed = numbered.select("row", F.posexplode(F.array(*values.columns)).alias("c", "v"))
        whole = F.array_sort(F.collect_list(F.struct("c", "r")))
        together = placed.join(ranks, ["c", "v"]).groupBy("row").agg(whole.alias("x"))
        return together.select(*[F.col("x")[i]["r"].alias(n) for i, n in enumerate(names)])
    table = ranks.orderBy("c", "v").toArrow()
    edges = np.searchsorted(table.column("c").to_numpy(), np.arange(k + 1))
    found = [(table.column("v").to_numpy()[a:b], table.column("r").to_numpy()[a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def looked_up(batches):
        for batch in batches:
            columns = [r[np.searchsorted(v, x.to_numpy(zero_copy_only=False))] if len(v) else x for x, (v, r) in zip(batch.columns, found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], names=names)

    return values.mapInArrow(looked_up, ", ".join(f"{n} double" for n in names))


def _spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    columns = sorted({c for p in pairs for c in p})
    bounded = max(_distinct(df, columns)) <= LEAF_POINTS
    joint = joint_counts(df, pairs)

    def ranks(axis: str) -> DataFrame:
        counts = joint.groupBy("pair", axis).agg(F.sum("w").alias("cnt"))
        before = running_total(counts, "pair", axis, "cnt", bounded)
        # Rank relative to the mean rank, so large ranks do not cancel later.
        return before.select("pair", axis, (F.col("before") + F.col("cnt") / 2.0).alias(f"r{axis}"))

    total = joint.groupBy("pair").agg(F.sum("w").alias("n"))
    placed = joint.join(ranks("x"), ["pair", "x"]).join(ranks("y"), ["pair", "y"]).join(total, "pair")
    dx, dy, w = F.col("rx") - F.col("n") / 2.0, F.col("ry") - F.col("n") / 2.0, F.col("w")
    sums = placed.groupBy("pair").agg(
        F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy")
    )
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return _named(df, pairs, sums.withColumn("r", F.when(spread > 0, F.col("xy") / spread)), "r")


def discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Total weight of pairs with a smaller x and a larger y, for points of one task.

    Points are split by the bits of their x rank: at each bit, the left and right
    halves of a group meet once, and a running sum over y counts the crossings.
    """
    _, rx = np.unique(x, return_inverse=True)
    _, ry = np.unique(y, return_inverse=True)
    w = w.astype(np.float64)
    span = 2 * (int(ry.max()) + 1)
    total = 0.0
    for bit in range(int(rx.max()).bit_length()):
        group, right = rx >> (bit + 1), (rx >> bit) & 1
        order = np.argsort(group * span + 2 * ry + right, kind="stable")
        g, r, weight = group[order], right[order].astype(bool), w[order]
        left = np.where(r, 0.0, weight)
        running = np.cumsum(left)
        ends = np.flatnonzero(np.r_[g[1:] != g[:-1], True])
        end_of = np.repeat(running[ends], np.diff(np.r_[-1, ends]))
        total += float(np.sum(weight[r] * (end_of[r] - running[r])))
    return total


def discordant_pairs(points: DataFrame, leaf: int = LEAF_POINTS, blocks: int = BLOCKS) -> DataFrame:
    """``(pair, d)`` from ``(pair, x, y, w)``, for any number of points per pair.

    A group that fits one task is counted there. A larger one is cut into blocks of x
    and of y. Point pairs in different blocks of both need only block counts. Those in one x block
    and different y blocks are discordant as the numbers of their y blocks are, and those in one y block as their values
    are: smaller groups handled the same way. A value that is a border is a block alone, without
    discordant pairs in it, and is left out, so hot values end at once. Borders decide about sizes only, not about the count.
    """
    schema = "pair int, d double"

    def count(key: tuple, table: pa.Table) -> pa.Table:
        d = discordant(*(table.column(c).to_numpy() for c in "xyw"))
        return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([d], pa.float64())})

    current = points.select("pair", F.lit("").alias("gid"), "x", "y", "w")
    results = []
    while True:
        sizes = current.groupBy("pair", "gid").agg(F.count(F.lit(1)).alias("size"))
        large = [(r["pair"], r["gid"]) for r in sizes.where(F.col("size") > leaf).collect()]  # their number is bounded by points div leaf
        if not large:
            results.append(current.groupBy("pair", "gid").applyInArrow(count, schema))
            break
        mark = current.sparkSession.createDataFrame(large, current.select("pair", "gid").schema)
        results.append(current.join(F.broadcast(mark), ["pair", "gid"], "left_anti").groupBy("pair", "gid").applyInArrow(count, schema))
        # Written out because two kinds of smaller groups and the cells are made of it.
        cut = cut_lineage(_in_blocks(current.join(F.broadcast(mark), ["pair", "gid"]), blocks))
        cells = cut.groupBy("pair", "gid", "bx", "by").agg(F.sum("w").alias("w"))
        cells = cells.select("pair", "gid", F.col("bx").alias("x"), F.col("by").alias("y"), "w")
        results.append(cells.groupBy("pair", "gid").applyInArrow(count, schema))
        # The block in the middle of an odd number is a single value's.
        in_x = cut.where("bx % 2 = 0").groupBy("pair", "gid", "bx", "x", "by").agg(F.sum("w").alias("w"))
        current = cut_lineage(
            in_x.select("pair", F.concat_ws("/", "gid", F.concat(F.lit("x"), "bx")).alias("gid"), "x", F.col("by").cast("double").alias("y"), "w")
            .unionAll(cut.where("by % 2 = 0").select("pair", F.concat_ws("/", "gid", F.concat(F.lit("y"), "by")).alias("gid"), "x", "y", "w"))
        )
    return reduce(DataFrame.unionAll, results).groupBy("pair").agg(F.sum("d").alias("d"))


def _in_blocks(large: DataFrame, blocks: int) -> DataFrame:
    """The points with the numbers ``bx`` and ``by`` of their blocks: odd for a border's own value, even between borders."""
    steps = [k / blocks for k in range(1, blocks)]
    ends = large.groupBy("pair", "gid").agg(*[F.percentile_approx(c, steps, 20 * blocks).alias(c) for c in "xy"])
    borders = {(r["pair"], r["gid"]): [np.unique(np.array(r[c], np.float64)) for c in "xy"] for r in ends.collect()}

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs, gids = batch.column("pair").to_numpy(), batch.column("gid").dictionary_encode()
            found = np.zeros((2, batch.num_rows), np.int32)
            groups = pairs.astype(np.int64) * len(gids.dictionary) + gids.indices.to_numpy()
            for g in np.unique(groups):
                rows = groups == g
                of = borders[int(g) // len(gids.dictionary), gids.dictionary[int(g) % len(gids.dictionary)].as_py()]
                for k, c in enumerate("xy"):
                    values = batch.column(c).to_numpy()[rows]
                    found[k, rows] = np.searchsorted(of[k], values, "left") + np.searchsorted(of[k], values, "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[0]), pa.array(found[1])], names=[*batch.schema.names, "bx", "by"])

    rows = large.select("pair", "gid", "x", "y", "w")
    return rows.mapInArrow(work, "pair int, gid string, x double, y double, w long, bx int, by int")


def kendall(df: DataFrame, columns: list[str], leaf: int = LEAF_POINTS, blocks: int = BLOCKS) -> DataFrame:
    """Tau-b per pair, exact, from joint counts."""
    pairs = pair_columns(columns)
    # Written once, as five aggregates read it.
    joint = cut_lineage(joint_counts(df, pairs))

    def tied(c: Column) -> Column:
        c = c.cast("double")
        return F.sum(c * (c - 1.0) / 2.0)

    by_x = joint.groupBy("pair", "x").agg(F.sum("w").alias("c")).groupBy("pair").agg(tied(F.col("c")).alias("tx"))
    by_y = joint.groupBy("pair", "y").agg(F.sum("w").alias("c")).groupBy("pair").agg(tied(F.col("c")).alias("ty"))
    whole = joint.groupBy("pair").agg(F.sum("w").cast("double").alias("n"), tied(F.col("w")).alias("txy"))
    d = discordant_pairs(joint, leaf, blocks)
    parts = whole.join(by_x, "pair").join(by_y, "pair").join(d, "pair")
    all_pairs = F.col("n") * (F.col("n") - 1.0) / 2.0
    balance = all_pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2.0 * F.col("d")
    spread = F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty")))
    tau = F.when(spread > 0, F.greatest(F.least(balance / spread, F.lit(1.0)), F.lit(-1.0)))
    return _named(df, pairs, parts.select("pair", tau.alias("tau")), "tau")


def correlations(
    df: DataFrame, method: str = "pearson", columns: list[str] | None = None, row_id: str | None = ROW_ID
) -> DataFrame:
    """``(column_a, column_b, correlation)`` at three decimals for every pair of numeric columns."""
    if method not in METHODS:
        raise ValueError(f"unknown correlation method '{method}'")
    columns = columns or numeric_columns(df, row_id)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    raw = {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method](df, columns)
    return raw.select("column_a", "column_b", round_dp(F.col("correlation"), 3).alias("correlation"))


@plain_result
def correlation_matrix(
    df: DataFrame, method: str = "pearson", columns: list[str] | None = None, row_id: str | None = ROW_ID
) -> dict:
    """Square matrix of the pairs; the diagonal is 1 where the column varies."""
    columns = columns or numeric_columns(df, row_id)
    if len(columns) < 2:
        return {"columns": columns, "matrix": [], "method": method}
    values = {}
    for r in correlations(df, method, columns, row_id).collect():
        values[r["column_a"], r["column_b"]] = values[r["column_b"], r["column_a"]] = r["correlation"]
    ends = df.agg(
        *[F.min(non_nan(col(c))).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(non_nan(col(c))).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    for i, c in enumerate(columns):
        values[c, c] = 1.0 if ends[f"lo{i}"] is not None and ends[f"lo{i}"] != ends[f"hi{i}"] else None
    return {"columns": columns, "matrix": [[values[a, b] for b in columns] for a in columns], "method": method}


def high_pairs(df: DataFrame, threshold: float = HIGH_CORRELATION, row_id: str | None = ROW_ID) -> DataFrame:
    """Pairs whose rounded Pearson correlation reaches the threshold in size."""
    return correlations(df, "pearson", row_id=row_id).where(F.abs("correlation") >= threshold)


def top_correlated(df: DataFrame, column: str, n: int = 5, row_id: str | None = ROW_ID) -> DataFrame:
    """``(column, correlation)`` of the ``n`` numeric columns most correlated with one column."""
    others = [c for c in numeric_columns(df, row_id) if c != column]
    if not others:
        return df.sparkSession.createDataFrame([], "column string, correlation double")
    r = pearson(df, [column, *others], [(column, o) for o in others])
    place = F.array_position(F.array(*[F.lit(o) for o in others]), F.col("column_b"))
    return (
        r.select(F.col("column_b").alias("column"), round_dp(F.col("correlation"), 3).alias("correlation"), place.alias("position"))
        .orderBy(F.abs("correlation").desc_nulls_last(), "position")
        .limit(n)
        .select("column", "correlation")
    )


def cramers_v(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, correlation)``: bias-corrected Cramér's V of every pair.

    The chi-squared sum over the full grid needs only the cells that occur. A two by
    two grid gets the continuity correction; its four deviations have one size.
    """
    pairs = pair_columns(columns)
    joint = joint_counts(df, pairs, "string")
    rows = joint.groupBy("pair", "x").agg(F.sum("w").cast("double").alias("row"))
    cols = joint.groupBy("pair", "y").agg(F.sum("w").cast("double").alias("col"))
    total = joint.groupBy("pair").agg(F.sum("w").cast("double").alias("n"))
    by_row = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("r"), F.sum(1.0 / F.col("row")).alias("inv_r"))
    by_col = cols.groupBy("pair").agg(F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("col")).alias("inv_k"))
    o = F.col("w").cast("double")
    cells = joint.join(rows, ["pair", "x"]).join(cols, ["pair", "y"]).join(total, "pair")
    sums = cells.groupBy("pair").agg(
        F.sum(o * o / (F.col("row") * F.col("col"))).alias("q"),
        F.max(F.abs(o - F.col("row") * F.col("col") / F.col("n"))).alias("deviation"),
    )
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    corrected = F.greatest(F.col("deviation") - 0.5, F.lit(0.0))
    yates = corrected * corrected * n * F.col("inv_r") * F.col("inv_k")
    chi2 = F.when((r == 2) & (k == 2), yates).when((r == 1) | (k == 1), 0.0).otherwise(n * (F.col("q") - 1.0))
    less = F.nullif(n - 1.0, F.lit(0.0))
    phi2 = F.greatest(chi2 / n - (k - 1) * (r - 1) / less, F.lit(0.0))
    r_corr, k_corr = r - (r - 1) * (r - 1) / less, k - (k - 1) * (k - 1) / less
    denominator = F.least(k_corr - 1.0, r_corr - 1.0)
    v = F.when(denominator > 0, F.sqrt(phi2 / denominator)).otherwise(0.0)
    parts = sums.join(by_row, "pair").join(by_col, "pair").join(total, "pair")
    named = _named(df, pairs, parts.select("pair", v.alias("v")), "v")
    return named.select("column_a", "column_b", F.coalesce("correlation", F.lit(0.0)).alias("correlation"))


@plain_result
def categorical_matrix(df: DataFrame, columns: list[str]) -> dict:
    """Symmetric Cramér's V matrix at three decimals, diagonal 1."""
    if len(columns) < 2:
        return {"columns": columns, "matrix": []}
    values = {}
    for row in cramers_v(df, columns).collect():
        v = round(row["correlation"], 3)
        values[row["column_a"], row["column_b"]] = values[row["column_b"], row["column_a"]] = v
    return {"columns": columns, "matrix": [[1.0 if a == b else values[a, b] for b in columns] for a in columns]}
