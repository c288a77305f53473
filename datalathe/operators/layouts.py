"""Date layouts of a text column, inferred from the whole column.

Every text is reduced to a signature: digits become 9, with one or two digits alike, and stretches of letters become
``a``. A histogram of signatures tells which layouts a column holds. Where day and month are both numbers before
the year, numbers above 12 tell them apart: each separator is judged by its own values, then by
those of the column's other separators; what nothing decides is reported as ambiguous and read
as the fixed layouts of :func:`parse_timestamp` do, month first, or day first between dots.

The histogram has one row per known signature and one for the rest, whatever the texts, so it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datalathe.functions.kinds import require_column
from datalathe.functions.scalars import col, strip
from datalathe.operators.steps import Fitted

SEPARATORS = ("/", "-", ".")
DAY, MONTH = "day_first", "month_first"
#: What is read where nothing tells day and month apart.
USUAL = {"/": MONTH, "-": MONTH, ".": DAY}
ISO = "iso"

# Signatures and layouts of dates that can be read in one way, and of times of day that may follow.
_DATES = {f"9999{s}9{s}9": f"yyyy{s}M{s}d" for s in SEPARATORS} | {
    "a 9, 9999": "MMM d, yyyy", "a 9 9999": "MMM d yyyy", "9 a 9999": "d MMM yyyy", "9-a-9999": "d-MMM-yyyy", "99999999": "yyyyMMdd",
}
_TIMES = {"": "", " 9:9": " H:mm", " 9:9:9": " H:mm:ss", "a9:9:9": "'T'H:mm:ss"}
#: Signature to layout, and signature to the separator of day and month in an order to be decided.
PLAIN = {d + t: layout + time for d, layout in _DATES.items() for t, time in _TIMES.items()}
OPEN = {f"9{s}9{s}9999{t}": (s, time) for s in SEPARATORS for t, time in _TIMES.items()}

SCHEMA = "column string, layout string, rows long, day_first_rows long, month_first_rows long, order string, status string"


def signature(text: Column) -> Column:
    """The known signature of a trimmed text, ``iso`` for other texts that start like an ISO date, else NULL."""
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]+", "a")
    shape = F.regexp_replace(shape, "(?<!9)99(?!9)", "9")
    return F.when(shape.isin(*PLAIN, *OPEN), shape).when(shape.rlike("^9999($|-)"), F.lit(ISO))


def _leading(text: Column, i: int) -> Column:
    """The first or second number of a text in an open layout."""
    return F.regexp_extract(text, r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]", i).try_cast("int")


def _histogram(df: DataFrame, columns: list[str]) -> dict[str, list]:
    for c in columns:
        require_column(df, c)
    entries = F.array(*[F.struct(F.lit(i).alias("at"), strip(col(c).cast("string")).alias("text")) for i, c in enumerate(columns)])
    texts = df.select(F.inline(entries)).where("text <> ''").withColumn("signature", signature(F.col("text")))
    a, b, is_open = _leading(F.col("text"), 1), _leading(F.col("text"), 2), F.col("signature").isin(*OPEN)
    counted = texts.groupBy("at", "signature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_open & (a > 12) & (b <= 12)).alias("day"),
        F.count_if(is_open & (b > 12) & (a <= 12)).alias("month"),
    )
    found = {c: [] for c in columns}
    for r in counted.collect():
        found[columns[r["at"]]].append(r)
    return found


def _orders(found: list) -> dict[str, tuple[str, str]]:
    """Separator -> (order, how it was decided), for the separators that stand in open layouts."""
    proof = {}
    for r in found:
        if r["signature"] in OPEN:
            day, month = proof.get(OPEN[r["signature"]][0], (0, 0))
            proof[OPEN[r["signature"]][0]] = day + r["day"], month + r["month"]
    days, months = (sum(p[i] for p in proof.values()) for i in (0, 1))
    out = {}
    for s, (day, month) in proof.items():
        if day and month:
            out[s] = (DAY if day > month else MONTH, "mixed")
        elif day or month:
            out[s] = (DAY if day else MONTH, "decided")
        elif bool(days) != bool(months):
            out[s] = (DAY if days else MONTH, "borrowed")
        else:
            out[s] = (USUAL[s], "ambiguous")
    return out


def _layout(shape: str, order: str) -> str:
    s, time = OPEN[shape]
    return (f"d{s}M{s}yyyy" if order == DAY else f"M{s}d{s}yyyy") + time


def infer_layouts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column and layout found: rows, the rows that prove an order, the order and how it was decided.

    ``status``: ``certain`` (one way to read), ``decided``, ``mixed`` (both orders are proved; undecided values follow the more
    frequent one), ``borrowed`` (from other separators), ``ambiguous``, ``unknown`` (no layout; ``layout`` is NULL).
    Missing and empty texts count nowhere.
    """
    rows = []
    for c, found in _histogram(df, columns).items():
        orders = _orders(found)
        for r in found:
            shape = r["signature"]
            if shape in OPEN:
                order, status = orders[OPEN[shape][0]]
                rows.append((c, _layout(shape, order), r["rows"], r["day"], r["month"], order, status))
            else:
                layout = ISO if shape == ISO else PLAIN.get(shape)
                rows.append((c, layout, r["rows"], 0, 0, None, "certain" if layout else "unknown"))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (r[0], r[1] or "")), SCHEMA)


def fit_datetime(df: DataFrame, column: str) -> Fitted:
    """Texts to timestamps by the layouts of this column; a text in none of them becomes NULL.

    Each text is parsed once, in the layout of its signature. A value that proves its own order is read in that.
    """
    found = _histogram(df, [column])[column]
    orders = {s: order for s, (order, _) in _orders(found).items()}
    shapes = sorted(r["signature"] for r in found if r["signature"] is not None)
    return by_layouts(column, shapes, orders)


def by_layouts(column: str, shapes: list[str], orders: dict[str, str]) -> Fitted:
    def transform(d: DataFrame) -> DataFrame:
        new = parsed(strip(col(column).cast("string")), shapes, orders).alias(column)
        return d.select(*[new if n == column else col(n) for n in d.columns])

    params = {"column": column, "target_type": "datetime", "layouts": "infer"}
    return Fitted("convert_dtype", params, {"signatures": shapes, "orders": orders}, transform)


def parsed(text: Column, shapes: list[str], orders: dict[str, str]) -> Column:
    """The timestamp of a text whose signature is one of ``shapes``."""
    shape, out = signature(text), F.lit(None).cast("timestamp")
    read = lambda layout: F.try_to_timestamp(text, F.lit(layout))
    for s in reversed(shapes):
        if s == ISO:
            value = text.try_cast("timestamp")
        elif s in PLAIN:
            layout = PLAIN[s]
            # Full names of months are a layout of their own.
            value = F.coalesce(read(layout), read(layout.replace("MMM", "MMMM"))) if "MMM" in layout else read(layout)
        else:
            day_first = F.when(_leading(text, 1) > 12, True).when(_leading(text, 2) > 12, False).otherwise(orders[OPEN[s][0]] == DAY)
            value = F.when(day_first, read(_layout(s, DAY))).otherwise(read(_layout(s, MONTH)))
        out = F.when(shape == s, value).otherwise(out)
    return out
