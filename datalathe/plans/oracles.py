"""The same results in plain SQL over the same tables, for checking the queries."""

from __future__ import annotations

from datalathe.plans.queries import AFTER_EDIT, BEFORE_EDIT, DIRTY_EVENTS, MIXED_DATES, PRIORITIES, SWITCH, WIDE
from datalathe.sources.files import NA_TOKENS

DIRTY = DIRTY_EVENTS.replace("{events}", "events")

# Columns of the tables used below, with their kind.
LINEITEM = [
    ("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"),
    ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime"),
]
EVENTS = [
    ("ts", "datetime"), ("user_id", "integer"), ("value", "float"), ("value_copy", "float"), ("event_type", "string"),
    ("tags", "string"), ("num_text", "string"), ("whole_float", "float"), ("date_text", "string"),
    ("const_col", "string"),
]
DTYPES = {"integer": "bigint", "float": "double", "string": "string", "datetime": "timestamp_ntz"}
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DELIMITERS = ["|", ",", ";", "/"]
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def with_dirty(body: str, *ctes: str) -> str:
    extra = "".join(f", {c}" for c in ctes)
    return f"WITH dirty AS ({DIRTY}){extra} {body}"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def even(expr: str, digits: int) -> str:
    """Half-even rounding of a double by scaling, as the engine's own columns are rounded."""
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(({expr})::DOUBLE * {scale}, 0) / {scale} + 0.0::DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def pct(part: str, whole: str) -> str:
    return f"coalesce({even(f'({part})::DOUBLE / nullif(({whole})::DOUBLE, 0) * 100', 2)}, 0)"


def skew_of(table: str, x: str) -> str:
    """Population skewness from centred moments."""
    m = f"(SELECT avg({x}) FROM {table})"
    return f"(SELECT avg(pow({x} - {m}, 3)) / pow(avg(pow({x} - {m}, 2)), 1.5) FROM {table})"


def kurt_of(table: str, x: str) -> str:
    m = f"(SELECT avg({x}) FROM {table})"
    return f"(SELECT avg(pow({x} - {m}, 4)) / pow(avg(pow({x} - {m}, 2)), 2) - 3 FROM {table})"


def mode_of(table: str, c: str) -> str:
    return (
        f"(SELECT CAST(v AS VARCHAR) FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL "
        f"GROUP BY 1 ORDER BY n DESC, v ASC LIMIT 1))"
    )


def base(table: str, c: str, mark: str = "") -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing_count, "
        f"{pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage, "
        f"count(DISTINCT {c}) AS unique_count, {even(f'count(DISTINCT {c}) / count(*)::DOUBLE', 4)} AS cardinality_ratio"
        f"{mark} FROM {table}"
    )


ORACLES: dict[str, str] = {}

# -- profiling -----------------------------------------------------------------------------

ORACLES["profile_base"] = union(base("lineitem", c) for c, _ in LINEITEM)
ORACLES["profile_mode"] = union(f"SELECT '{c}' AS \"column\", {mode_of('lineitem', c)} AS mode" for c, _ in LINEITEM)
ORACLES["entropy"] = with_dirty(
    union(
        f"SELECT '{c}' AS \"column\", {even('-sum(p * log2(p))', 4)} AS entropy FROM (SELECT count(*) / "
        f"sum(count(*)) OVER ()::DOUBLE AS p FROM dirty WHERE {c} IS NOT NULL GROUP BY {c})"
        for c, _ in EVENTS
    )
)
ORACLES["profile_moments"] = union(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 5)} AS mean, {r(f'stddev_samp({c})', 5)} AS std, "
    f"{r(f'var_samp({c})', 0)} AS variance, {r(skew_of('lineitem', c), 5)} AS skewness, "
    f"{r(f'kurtosis_pop({c})', 5)} AS kurtosis FROM lineitem"
    for c in LINE_NUMBERS
)
QUARTILES = (
    "{mean} AS mean, {median} AS median, {lo} AS minimum, {hi} AS maximum, {q1} AS q1, {q3} AS q3"
)


def quartiles(c: str, digits: int) -> str:
    return QUARTILES.format(
        mean=r(f"avg({c})", digits), median=r(f"quantile_cont({c}, 0.5)", digits), lo=r(f"min({c} + 0.0)", digits),
        hi=r(f"max({c} + 0.0)", digits), q1=r(f"quantile_cont({c}, 0.25)", digits),
        q3=r(f"quantile_cont({c}, 0.75)", digits),
    )


ORACLES["profile_numeric"] = union(
    f"SELECT '{c}' AS \"column\", {quartiles(c, 6)}, {r(f'max({c} + 0.0) - min({c} + 0.0)')} AS range FROM lineitem"
    for c in LINE_NUMBERS
)
NUMERICAL = ["user_id", "value", "value_copy", "whole_float"]
NO_NUMBERS = ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "median", "minimum", "maximum", "q1", "q3", "std"))
ORACLES["profile_dirty"] = with_dirty(
    union(
        base(
            "dirty", c,
            f", '{DTYPES[k]}' AS dtype, "
            + (f"{quartiles(c, 4)}, {r(f'stddev_samp({c})', 4)} AS std" if c in NUMERICAL else NO_NUMBERS),
        )
        for c, k in EVENTS
    )
)
NULLS = " + ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c, _ in EVENTS)
NAMES = ", ".join(c for c, _ in EVENTS)


# -- logical types ---------------------------------------------------------------------------

def words(table: str, c: str, order: str) -> str:
    """Mean number of words of the texts."""
    return (
        f"(SELECT avg(len(regexp_extract_all({c}, '\\S+'))) FROM "
        f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL))"
    )


def id_rule(table: str, c: str, kind: str, order: str) -> str:
    ratio = f"(count(DISTINCT {c}) / nullif(count({c}), 0)::DOUBLE)"
    if kind == "integer":
        shape = f"count({c}) = count(*)"
    elif kind == "string":
        shape = f"{words(table, c, order)} <= 1.5"
    else:
        return "false"
    name = f"regexp_matches('{c}', '(^id$|_id$|^id_|uuid|guid)', 'i')"
    return f"coalesce({shape} AND {ratio} > 0.95 AND ({name} OR {ratio} = 1.0), false)"


def delimiter_row(table: str, c: str, d: str, i: int) -> str:
    return (
        f"SELECT '{c}' AS col, '{d}' AS d, {i} AS p, "
        f"(SELECT avg(CASE WHEN contains({c}, '{d}') THEN 1.0::DOUBLE ELSE 0 END) FROM {table} WHERE {c} IS NOT NULL) AS s, "
        f"count(*) AS toks, count(DISTINCT t) AS vocab, (SELECT count({c}) FROM {table}) AS n "
        f"FROM (SELECT trim(unnest(string_split({c}, '{d}')), {BLANKS}) AS t FROM {table} WHERE {c} IS NOT NULL)"
    )


def best_delimiters(table: str, columns: list[str]) -> str:
    rows = union(delimiter_row(table, c, d, i) for c in columns for i, d in enumerate(DELIMITERS))
    return (
        f"delims AS (SELECT col, d FROM (SELECT col, d, row_number() OVER (PARTITION BY col ORDER BY "
        f"s * (1 - vocab / toks::DOUBLE) DESC, p) AS k FROM ({rows}) WHERE s >= 0.5 AND 1 - vocab / toks::DOUBLE > 0.5 "
        f"AND toks / n::DOUBLE > 1.1) WHERE k = 1)"
    )


TEXTS = [c for c, k in EVENTS if k == "string"]


def detected(c: str, kind: str) -> str:
    rest = {
        "datetime": "'datetime'", "integer": "'numerical'", "float": "'numerical'",
        "string": f"CASE WHEN EXISTS (SELECT 1 FROM delims WHERE col = '{c}') THEN 'multi_label' "
        f"WHEN count(DISTINCT {c}) / count(*)::DOUBLE < 0.05 THEN 'categorical' ELSE 'text' END",
    }[kind]
    return f"CASE WHEN {id_rule('dirty', c, kind, 'row_id')} THEN 'id' ELSE {rest} END"


TYPE_ROWS = "types AS (" + union(
    f"SELECT '{c}' AS \"column\", '{DTYPES[k]}' AS dtype, {detected(c, k)} AS detected_type FROM dirty GROUP BY ()" for c, k in EVENTS
) + ")"
ORACLES["column_types"] = with_dirty(
    "SELECT \"column\", dtype, detected_type, CASE WHEN \"column\" = 'whole_float' THEN 'categorical' "
    "ELSE detected_type END AS effective_type, \"column\" = 'whole_float' AS is_overridden FROM types",
    best_delimiters("dirty", TEXTS), TYPE_ROWS,
)
KINDS = ["numerical", "categorical", "boolean", "datetime", "text", "id", "multi_label", "mixed"]
ORACLES["overview"] = with_dirty(
    f"SELECT count(*) AS rows, {len(EVENTS)}::BIGINT AS columns, ({NULLS})::BIGINT AS missing_values_total, "
    f"{pct(NULLS, f'count(*) * {len(EVENTS)}')} AS missing_percentage, "
    f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {NAMES} FROM dirty)))::BIGINT AS duplicate_rows, "
    + ", ".join(
        f"(SELECT count(*) FROM types WHERE detected_type = '{t}')::BIGINT AS {t}_columns" for t in KINDS
    )
    + " FROM dirty",
    best_delimiters("dirty", TEXTS), TYPE_ROWS,
)
ORACLES["summarize_column"] = with_dirty(
    f"SELECT {r('avg(value)')} AS mean, {r('quantile_cont(value, 0.5)')} AS median, {r('stddev_samp(value)')} AS std, "
    "count(*) - count(value) AS missing_count, count(*) AS row_count FROM dirty"
)
ORDERS = [
    ("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
]
CUSTOMER = [
    ("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"),
    ("c_mktsegment", "string"),
]
ORACLES["detect_id"] = union(
    f"SELECT '{c}' AS \"column\", {id_rule('orders', c, k, 'o_orderkey')} AS is_id FROM orders GROUP BY ()" for c, k in ORDERS
)
ORACLES["detect_id_text"] = union(
    f"SELECT '{c}' AS \"column\", {id_rule('customer', c, k, 'c_custkey')} AS is_id FROM customer GROUP BY ()" for c, k in CUSTOMER
)
ORACLES["detect_multi_label"] = with_dirty(
    union(f"SELECT '{c}' AS \"column\", (SELECT d FROM delims WHERE col = '{c}') AS delimiter" for c, _ in EVENTS),
    best_delimiters("dirty", TEXTS),
)
ORACLES["detect_multi_label_text"] = (
    f"WITH {best_delimiters('documents', ['text', 'lang', 'source'])} "
    + union(
        f"SELECT '{c}' AS \"column\", (SELECT d FROM delims WHERE col = '{c}') AS delimiter"
        for c in ("text", "lang", "source")
    )
)
ORACLES["detect_datetime"] = with_dirty(
    union(
        f"SELECT '{c}' AS \"column\", "
        + (
            f"(SELECT avg(CASE WHEN try_cast({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9 FROM "
            f"(SELECT {c} FROM dirty WHERE {c} IS NOT NULL))"
            if k == "string"
            else "false"
        )
        + " AS is_datetime_convertible"
        for c, k in EVENTS
    )
)
ORACLES["detect_int"] = with_dirty(
    union(
        f"SELECT '{c}' AS \"column\", " + (f"bool_and({c} = round({c}))" if k == "float" else "false")
        + " AS is_int_convertible FROM dirty" + ("" if k == "float" else " GROUP BY ()")
        for c, k in EVENTS
    )
)
ORACLES["detect_category"] = with_dirty(
    union(
        f"SELECT '{c}' AS \"column\", {str(k == 'string').lower()} AND count(DISTINCT {c}) / count(*)::DOUBLE < 0.5 "
        "AS is_category_beneficial FROM dirty"
        for c, k in EVENTS
    )
)

# -- categories and distributions ------------------------------------------------------------


def frequencies(table: str, c: str) -> str:
    return (
        f"SELECT CAST({c} AS VARCHAR) AS category, count(*) AS count, "
        f"{pct('count(*)', f'(SELECT count({c}) FROM {table})')} AS percentage, "
        f"(SELECT count(DISTINCT {c}) FROM {table}) AS total_unique FROM {table} WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count DESC, {c} LIMIT 20"
    )


ORACLES["category_freq"] = frequencies("events", "event_type")
ORACLES["category_freq_top"] = frequencies("orders", "o_custkey")
ORACLES["multi_label_profile"] = with_dirty(
    "SELECT '|' AS delimiter, (SELECT count(DISTINCT t) FROM toks WHERE t <> '') AS vocabulary_size, "
    f"{even('(SELECT count(*) FROM toks) / (SELECT count(tags) FROM dirty)::DOUBLE', 2)} AS avg_labels_per_row, "
    "t AS label, count(*) AS count FROM toks WHERE t <> '' GROUP BY t ORDER BY count DESC, label LIMIT 20",
    f"toks AS (SELECT trim(unnest(string_split(tags, '|')), {BLANKS}) AS t FROM dirty WHERE tags IS NOT NULL)",
)


def bins(table: str, x: str, count: str = "count") -> str:
    """Bin of each value by comparing it with all edges."""
    edges = f"(SELECT min({x} + 0.0) AS lo, max({x} + 0.0) AS hi FROM {table})"
    step = "((hi - lo) / 30)"
    return (
        f"SELECT b.range::INTEGER AS bin, {even(f'lo + b.range * {step}', 4)} AS lower_edge, "
        f"{even(f'CASE WHEN b.range = 29 THEN hi ELSE lo + (b.range + 1) * {step} END', 4)} AS upper_edge, "
        f"(SELECT count(*) FROM {table} WHERE {x} >= b.range * {step} + lo AND ({x} < (b.range + 1) * {step} + lo "
        f"OR (b.range = 29 AND {x} <= hi))) AS {count} FROM range(30) b, {edges}"
    )


ORACLES["histogram"] = bins("events", "value")
ORACLES["boxplot_stats"] = (
    f"SELECT 'value' AS \"column\", {r('quantile_cont(value, 0.25)')} AS q1, {r('quantile_cont(value, 0.5)')} AS median, "
    f"{r('quantile_cont(value, 0.75)')} AS q3, {r('min(value + 0.0)')} AS minimum, {r('max(value + 0.0)')} AS maximum FROM events"
)
ORACLES["boxplot_values"] = with_dirty(
    "SELECT row_number() OVER (ORDER BY row_id) - 1 AS position, value FROM (SELECT row_id, value FROM dirty "
    "WHERE value IS NOT NULL ORDER BY row_id LIMIT 3000)"
)
ORACLES["distribution"] = with_dirty(
    f"SELECT bin, count, {r(skew_of('dirty', 'value'))} AS skewness, {r(kurt_of('dirty', 'value'))} AS kurtosis "
    f"FROM ({bins('dirty', 'value')})"
)
ORACLES["jarque_bera"] = with_dirty(
    union(
        f"SELECT '{c}' AS \"column\", n, {r('jb', 2)} AS statistic, {r('exp(-jb / 2)', 4)} AS p_value FROM (SELECT "
        f"count({c}) AS n, count({c}) / 6.0 * (pow({skew_of('dirty', c)}, 2) + pow({kurt_of('dirty', c)}, 2) / 4) AS jb FROM dirty)"
        for c in ("value", "whole_float")
    )
)

# -- quality -----------------------------------------------------------------------------------


def flag(name: str, text_rule, other: str = "false") -> str:
    return with_dirty(
        union(
            f"SELECT '{c}' AS \"column\", {text_rule(c) if k == 'string' else other} AS {name} FROM dirty GROUP BY ()"
            for c, k in EVENTS
        )
    )


ORACLES["whitespace_flag"] = flag("has_whitespace", lambda c: f"coalesce(bool_or({c} <> trim({c}, {BLANKS})), false)")
ORACLES["case_flag"] = flag(
    "has_case_inconsistency",
    lambda c: f"count(DISTINCT lower(trim({c}, {BLANKS}))) < count(DISTINCT trim({c}, {BLANKS}))",
)
ORACLES["constant_flag"] = with_dirty(
    union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) = 1 AS is_constant FROM dirty" for c, _ in EVENTS)
)
ORACLES["low_variance_flag"] = with_dirty(
    union(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 1 AND "
        f"{even(f'count(DISTINCT {c}) / count(*)::DOUBLE', 4)} < 0.01 AS is_low_variance FROM dirty"
        for c, _ in EVENTS
    )
)
ORACLES["dup_rows"] = with_dirty(
    f"SELECT (sum(n) - count(*))::BIGINT AS count, {pct('sum(n) - count(*)', 'sum(n)')} AS percentage, "
    f"sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM dirty GROUP BY {NAMES})"
)
ROUNDED = ", ".join(
    r(c) + f" AS {c}" if k == "float" else c for c, k in EVENTS
)
for _name, _pick in (("dedup_first", "min"), ("dedup_last", "max")):
    ORACLES[_name] = with_dirty(
        f"SELECT row_id, {ROUNDED} FROM (SELECT {_pick}(row_id) AS row_id, {NAMES} FROM dirty GROUP BY {NAMES})"
    )
ORACLES["dup_preview"] = with_dirty(
    "SELECT (SELECT count(*) FROM ranked WHERE k > 1) AS duplicate_count, (SELECT count(*) FROM ranked WHERE k = 1) "
    "AS rows_after_removal, row_id, user_id FROM ranked WHERE k > 1 ORDER BY row_id LIMIT 5",
    f"ranked AS (SELECT row_id, user_id, row_number() OVER (PARTITION BY {NAMES} ORDER BY row_id) AS k FROM dirty)",
)
PAIRS = [(a, b) for i, (a, ka) in enumerate(EVENTS) for b, kb in EVENTS[i + 1 :] if ka == kb]
ORACLES["dup_columns"] = with_dirty(
    union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b FROM dirty HAVING bool_and({a} IS NOT DISTINCT FROM {b})"
        for a, b in PAIRS
    )
)


def all_but(dropped: str) -> str:
    names = ", ".join(r(c) + f" AS {c}" if k == "float" else c for c, k in EVENTS if c != dropped)
    return with_dirty(f"SELECT row_id, {names} FROM dirty")


ORACLES["drop_dup_columns"] = all_but("value_copy")
ORACLES["drop_column"] = all_but("const_col")

# -- missing values ------------------------------------------------------------------------------

MEDIAN = "(SELECT quantile_cont(value, 0.5) FROM dirty)"
for _name, _column, _expr in (
    ("impute_mean", "value", r("coalesce(value, (SELECT avg(value) FROM dirty))")),
    ("impute_median", "value", r(f"coalesce(value, {MEDIAN})")),
    ("impute_mode", "event_type", f"coalesce(event_type, {mode_of('dirty', 'event_type')})"),
    ("impute_constant", "event_type", "coalesce(event_type, 'Unknown')"),
    ("impute_ffill", "value", r("last_value(value IGNORE NULLS) OVER (ORDER BY row_id)")),
    ("impute_bfill", "value", r("last_value(value IGNORE NULLS) OVER (ORDER BY row_id DESC)")),
    ("impute_ffill_text", "event_type", "last_value(event_type IGNORE NULLS) OVER (ORDER BY row_id)"),
):
    ORACLES[_name] = with_dirty(f"SELECT row_id, {_expr} AS {_column} FROM dirty")
ORACLES["impute_drop"] = with_dirty(f"SELECT row_id, {r('value')} AS value FROM dirty WHERE value IS NOT NULL")


def knn(column: str, features: tuple[str, ...], k: int, answer: str) -> tuple[str, str]:
    """All rows with a gap against all that have the value."""
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(features))
    at = ", ".join(f"coalesce(({c} - m{i}) / s{i}, 0) AS z{i}" for i, c in enumerate(features))
    apart = " + ".join(f"(q.z{i} - d.z{i}) * (q.z{i} - d.z{i})" for i in range(len(features)))
    return f"""SELECT z.row_id, {answer.format(fill="f.fill")} AS {column} FROM z LEFT JOIN (
      SELECT row_id, {"avg(v)" if column == "value" else "arg_min(v, (-n, v))"} AS fill FROM (
        SELECT row_id, v, count(*) OVER (PARTITION BY row_id, v) AS n FROM (
          SELECT q.row_id, d.v, row_number() OVER (PARTITION BY q.row_id ORDER BY round({apart}, 9), d.row_id) AS rank
          FROM z q JOIN z d ON q.v IS NULL AND d.v IS NOT NULL) WHERE rank <= {k}) GROUP BY row_id) f USING (row_id)""", f"""
      z AS (SELECT row_id, {column} AS v, {at} FROM dirty, (SELECT {stats} FROM dirty))"""


ORACLES["impute_knn"] = with_dirty(*knn("value", ("user_id", "whole_float"), 5, r("coalesce(z.v, {fill})")))
ORACLES["impute_knn_text"] = with_dirty(*knn("event_type", ("value", "user_id"), 3, "coalesce(z.v, {fill})"))
ORACLES["impute_preview"] = with_dirty(
    f"SELECT row_id, {r(MEDIAN)} AS value, (SELECT count(*) - count(value) FROM dirty) AS before_missing, "
    "0::BIGINT AS after_missing, "
    f"{r(f'(SELECT avg(coalesce(value, {MEDIAN})) FROM dirty)')} AS after_mean, "
    f"{r(f'(SELECT stddev_samp(coalesce(value, {MEDIAN})) FROM dirty)')} AS after_std "
    "FROM dirty WHERE value IS NULL ORDER BY row_id LIMIT 5"
)
ORACLES["impute_compare"] = with_dirty(
    union(
        f"SELECT '{v}' AS version, {r(f'avg({x})')} AS mean, {r(f'quantile_cont({x}, 0.5)')} AS median, "
        f"{r(f'stddev_samp({x})')} AS std, count(*) - count({x}) AS missing_count, count(*) AS row_count FROM dirty {w}"
        for v, x, w in (
            ("before", "value", ""),
            ("after_a", "coalesce(value, (SELECT avg(value) FROM dirty))", ""),
            ("after_b", "value", "WHERE value IS NOT NULL"),
        )
    )
)

# -- outliers ----------------------------------------------------------------------------------------


def bounds(table: str, c: str) -> str:
    """Row ``b`` with quartile, z-score and MAD bounds of one column."""
    return (
        f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m, s, med, "
        f"(SELECT quantile_cont(abs({c} - q.med), 0.5) FROM {table}) AS mad FROM (SELECT quantile_cont({c}, 0.25) AS q1, "
        f"quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, 0.5) AS med FROM {table}) q)"
    )


MASKS = {
    "iqr": "({c} < lo OR {c} > hi)",
    "zscore": "(abs(({c} - m) / nullif(s, 0)) > 3.0)",
    "modified_zscore": "(abs(0.6745 * ({c} - med) / nullif(mad, 0)) > 3.5)",
}


def counted(table: str, c: str, method: str) -> str:
    mask = MASKS[method].format(c=c)
    flagged = f"count(CASE WHEN {mask} THEN 1 END)"
    return (
        f"SELECT '{c}' AS \"column\", {flagged} AS outlier_count, {pct(flagged, f'count({c})')} AS outlier_percentage "
        f"FROM {table}, {bounds(table, c)}"
    )


for _name, _method in (("outliers_iqr", "iqr"), ("outliers_zscore", "zscore"), ("outliers_modz", "modified_zscore")):
    ORACLES[_name] = with_dirty(union(counted("dirty", c, _method) for c in ("value", "whole_float")))
ORACLES["outliers_documents"] = counted("documents", "n_chars", "iqr")
ORACLES["outliers_remove"] = with_dirty(
    f"SELECT row_id, {r('value')} AS value FROM dirty, {bounds('dirty', 'value')} "
    f"WHERE value IS NULL OR NOT {MASKS['iqr'].format(c='value')}"
)
for _name, _low, _high in (
    ("iqr", "lo", "hi"),
    ("z", "m - 3.0 * s", "m + 3.0 * s"),
    ("modz", "med - 3.5 * mad / 0.6745", "med + 3.5 * mad / 0.6745"),
):
    ORACLES[f"outliers_cap_{_name}"] = with_dirty(
        f"SELECT row_id, {r(f'CASE WHEN value > {_high} THEN {_high} WHEN value < {_low} THEN {_low} ELSE value END')} "
        f"AS value FROM dirty, {bounds('dirty', 'value')}"
    )
ORACLES["outliers_sample"] = with_dirty(
    f"SELECT row_id, value FROM dirty, {bounds('dirty', 'value')} WHERE {MASKS['iqr'].format(c='value')} "
    "ORDER BY row_id LIMIT 20"
)

# -- conversion ----------------------------------------------------------------------------------------

for _name, _column, _expr in (
    ("convert_int", "num_text", "try_cast(num_text AS BIGINT)"),
    ("convert_int_float", "value", "round_even(value, 0)::BIGINT"),
    ("convert_float", "num_text", r("try_cast(num_text AS DOUBLE)")),
    ("convert_string", "user_id", "CAST(user_id AS VARCHAR)"),
    ("convert_datetime", "date_text", "try_cast(date_text AS TIMESTAMP)"),
    ("convert_category", "event_type", "event_type"),
):
    ORACLES[_name] = with_dirty(f"SELECT row_id, {_expr} AS {_column} FROM dirty")
MIXED = MIXED_DATES.replace("{orders}", "orders")
MINUTES = "to_minutes(CAST(o_orderkey % 24 * 60 + o_orderkey % 60 AS BIGINT))"
ORACLES["convert_datetime_mixed"] = (
    f"SELECT o_orderkey, CASE WHEN date_text IS NULL OR date_text = 'n/a' THEN NULL WHEN o_orderkey % 10 = 2 THEN o_orderdate + {MINUTES} "
    f"WHEN o_orderkey % 10 = 9 OR (o_orderkey % 10 = 4 AND day(o_orderdate) > 12) THEN o_orderdate + {MINUTES} + to_seconds(7) "
    f"ELSE o_orderdate END AS date_text FROM ({MIXED})"
)
# Layout, the rows in it, and the numbers that stand first and second where an order is to be found.
LAYOUTS = [
    ("M-d-yyyy", r"\d+-\d+-\d{4}", "month_first", "decided"), ("MMM d, yyyy", r"[A-Z][a-z]+ \d+, \d+", None, "certain"),
    ("d MMM yyyy", r"\d+ [A-Z][a-z]+ \d+", None, "certain"), ("d-MMM-yyyy", r"\d+-[A-Z][a-z]+-\d+", None, "certain"),
    ("d.M.yyyy", r" \d+\.\d+\.\d{4}", "day_first", "ambiguous"), ("d/M/yyyy", r"\d+/\d+/\d{4}", "day_first", "decided"),
    ("d/M/yyyy H:mm", r"\d+/\d+/\d{4} \d+:\d+", "day_first", "decided"), ("yyyy-M-d", r"\d{4}-\d+-\d+", None, "certain"),
    ("yyyy/M/d H:mm:ss", r"\d{4}/\d+/\d+ \d+:\d+:\d+", None, "certain"), ("yyyyMMdd", r"\d{8}", None, "certain"),
    (None, "n/a", None, "unknown"),
]
ORACLES["date_layouts"] = union(
    f"SELECT 'date_text' AS \"column\", {f"'{layout}'" if layout else 'NULL::VARCHAR'} AS layout, count(*) AS rows, "
    + ", ".join(
        f"count(*) FILTER (WHERE {'true' if order else 'false'} AND try_cast(regexp_extract(trim(date_text), '{first}', 1) AS INTEGER) > 12) AS {name}"
        for name, first in (("day_first_rows", r"^(\d+)"), ("month_first_rows", r"^\d+\D(\d+)"))
    )
    + f", {f"'{order}'" if order else 'NULL::VARCHAR'} AS \"order\", '{status}' AS status FROM ({MIXED}) "
    f"WHERE regexp_full_match(date_text, '{pattern}')"
    for layout, pattern, order, status in LAYOUTS
)
ORACLES["convert_preview"] = with_dirty(
    "SELECT (SELECT count(*) - count(num_text) FROM dirty) AS before_missing, "
    "(SELECT count(*) - count(try_cast(num_text AS DOUBLE)) FROM dirty) AS after_missing, "
    "(SELECT count(num_text) - count(try_cast(num_text AS DOUBLE)) FROM dirty) AS newly_invalid_count, "
    "num_text AS before, try_cast(num_text AS DOUBLE) AS after FROM dirty WHERE num_text IS NOT NULL ORDER BY row_id LIMIT 5"
)

# -- transforms --------------------------------------------------------------------------------------------

ORACLES["tx_log"] = f"SELECT o_orderkey, {r('ln(o_totalprice)')} AS o_totalprice FROM orders"
ORACLES["tx_sqrt"] = f"SELECT event_id, {r('sqrt(value)')} AS value FROM events"
ORACLES["tx_none"] = f"SELECT event_id, {r('value')} AS value FROM events"
ORACLES["tx_preview"] = (
    "WITH after AS (SELECT sqrt(value) AS value FROM events) "
    "SELECT b.bin, b.count AS before_count, a.count AS after_count, "
    f"{r(skew_of('events', 'value'))} AS before_skewness, {r(skew_of('after', 'value'))} AS after_skewness "
    f"FROM ({bins('events', 'value')}) b JOIN ({bins('after', 'value')}) a ON a.bin = b.bin"
)

# -- association ---------------------------------------------------------------------------------------------


def pearson(table: str, columns: list[str]) -> str:
    return union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {even(f'corr({a}::DOUBLE, {b}::DOUBLE)', 3)} AS correlation FROM {table}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


def spearman(table: str, columns: list[str]) -> str:
    def rank(x: str) -> str:
        return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"

    return union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {even('corr(ra, rb)', 3)} AS correlation FROM (SELECT "
        f"({rank(a)})::DOUBLE AS ra, ({rank(b)})::DOUBLE AS rb FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


def kendall(table: str, columns: list[str]) -> str:
    """Tau-b by comparing all pairs of joint counts."""
    return union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, (WITH j AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w "
        f"FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), s AS (SELECT sum(CASE WHEN (p.x - q.x) * "
        f"(p.y - q.y) > 0 THEN p.w * q.w WHEN (p.x - q.x) * (p.y - q.y) < 0 THEN -p.w * q.w ELSE 0 END) / 2 AS cd "
        f"FROM j p, j q), t AS (SELECT sum(w) * (sum(w) - 1) / 2 AS n0 FROM j), "
        f"u AS (SELECT sum(c * (c - 1) / 2) AS tx FROM (SELECT sum(w) AS c FROM j GROUP BY x)), "
        f"v AS (SELECT sum(c * (c - 1) / 2) AS ty FROM (SELECT sum(w) AS c FROM j GROUP BY y)) "
        f"SELECT {even('cd / sqrt((n0 - tx) * (n0 - ty))', 3)} FROM s, t, u, v) AS correlation"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


NUMBERS = [c for c, k in LINEITEM if k in ("integer", "float")]
DIRTY_NUMBERS = [c for c, k in EVENTS if k in ("integer", "float")]
RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
ORACLES["corr_pearson"] = pearson("lineitem", NUMBERS)
ORACLES["corr_pearson_gaps"] = with_dirty(pearson("dirty", ["row_id", *DIRTY_NUMBERS]))
ORACLES["corr_spearman"] = spearman("lineitem", RANKED)
ORACLES["corr_spearman_gaps"] = with_dirty(spearman("dirty", ["value", "user_id", "whole_float"]))
ORACLES["corr_kendall"] = kendall("lineitem", ["l_quantity", "l_discount", "l_linenumber"])
ORACLES["corr_kendall_wide"] = kendall("orders", ["o_custkey", "o_totalprice"])
ORACLES["high_pairs"] = with_dirty(
    f"SELECT * FROM ({pearson('dirty', DIRTY_NUMBERS)}) WHERE abs(correlation) >= 0.8"
)
ORACLES["top_correlated"] = (
    "SELECT other AS \"column\", correlation FROM ("
    + union(
        f"SELECT '{c}' AS other, {i} AS position, {even(f'corr(l_extendedprice, {c}::DOUBLE)', 3)} AS correlation FROM lineitem"
        for i, c in enumerate(x for x in NUMBERS if x != "l_extendedprice")
    )
    + ") ORDER BY abs(correlation) DESC, position LIMIT 5"
)


def cramers(table: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, (WITH j AS (SELECT CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y, "
        f"count(*)::DOUBLE AS o FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), "
        f"rs AS (SELECT x, sum(o) AS rt FROM j GROUP BY x), cs AS (SELECT y, sum(o) AS ct FROM j GROUP BY y), "
        f"d AS (SELECT sum(o) AS n, (SELECT count(*) FROM rs)::DOUBLE AS r, (SELECT count(*) FROM cs)::DOUBLE AS k FROM j), "
        f"g AS (SELECT coalesce(o, 0) AS o, rt * ct / n AS e, r, k FROM rs CROSS JOIN cs CROSS JOIN d LEFT JOIN j USING (x, y)), "
        f"h AS (SELECT sum(CASE WHEN r = 2 AND k = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e "
        f"ELSE pow(o - e, 2) / e END) AS chi2 FROM g), "
        f"p AS (SELECT greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS phi, "
        f"least(k - pow(k - 1, 2) / (n - 1), r - pow(r - 1, 2) / (n - 1)) - 1 AS den FROM h, d) "
        f"SELECT {r('CASE WHEN den <= 0 THEN 0 ELSE sqrt(phi / den) END')} FROM p) AS correlation"
        for a, b in pairs
    )


ORACLES["cramers_v"] = cramers("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"])
ORACLES["cramers_v_gaps"] = with_dirty(cramers("dirty", ["event_type", "tags", "num_text"]))

# -- encoding ------------------------------------------------------------------------------------------------

ORACLES["enc_onehot"] = "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS \"o_orderstatus_{s}\"" for s in ("F", "O", "P")
) + " FROM orders"
CODES = "codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_type AS v FROM dirty WHERE event_type IS NOT NULL))"
ORACLES["enc_label"] = with_dirty(
    "SELECT row_id, code AS event_type FROM dirty LEFT JOIN codes ON v = event_type", CODES
)
ORACLES["enc_label_wide"] = "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer"
ORACLES["enc_ordinal"] = (
    "SELECT o_orderkey, CASE o_orderpriority "
    + " ".join(f"WHEN '{v}' THEN {i}::BIGINT" for i, v in enumerate(PRIORITIES))
    + " END AS o_orderpriority FROM orders"
)
ORACLES["enc_frequency"] = with_dirty(
    "SELECT row_id, CASE WHEN event_type IS NOT NULL THEN count(*) OVER (PARTITION BY event_type) END AS event_type FROM dirty"
)
ORACLES["enc_binary"] = with_dirty(
    "SELECT row_id, " + ", ".join(f"((code >> {b}) & 1)::INTEGER AS event_type_bin_{b}" for b in range(4))
    + " FROM dirty LEFT JOIN codes ON v = event_type",
    CODES,
)
ORACLES["enc_multilabel"] = with_dirty(
    "SELECT row_id, " + ", ".join(
        f"CASE WHEN list_contains(string_split(tags, '|'), '{t}') THEN 1 ELSE 0 END AS tags_{t}"
        for t in ("api", "app", "click", "error", "purchase", "signup", "view", "web")
    ) + " FROM dirty"
)

# -- scaling -------------------------------------------------------------------------------------------------

X = "l_extendedprice"
for _name, _expr, _digits in (
    ("scale_standard", f"({X} - avg({X}) OVER ()) / stddev_samp({X}) OVER ()", 6),
    ("scale_minmax", f"({X} - min({X}) OVER ()) / (max({X}) OVER () - min({X}) OVER ())", 6),
    (
        "scale_robust",
        f"({X} - (SELECT quantile_cont({X}, 0.5) FROM lineitem)) / (SELECT quantile_cont({X}, 0.75) - quantile_cont({X}, 0.25) FROM lineitem)",
        6,
    ),
    ("scale_maxabs", f"{X} / max(abs({X})) OVER ()", 6),
    ("scale_l2", f"{X} / sqrt(sum({X} * {X}) OVER ())", 9),
):
    ORACLES[_name] = f"SELECT l_orderkey, l_linenumber, {r(_expr, _digits)} AS {X} FROM lineitem"

# -- facts, rules and reports --------------------------------------------------------------------------------


def column_fact_row(i: int, c: str, k: str) -> str:
    number = k in ("integer", "float")
    stats = {
        "mean": f"avg({c})", "median": f"quantile_cont({c}, 0.5)", "std": f"stddev_samp({c})",
        "variance": f"var_samp({c})", "minimum": f"min({c} + 0.0)", "maximum": f"max({c} + 0.0)",
        "range": f"max({c} + 0.0) - min({c} + 0.0)", "skewness": skew_of("dirty", c), "kurtosis": kurt_of("dirty", c),
    }
    ratio = even(f"count(DISTINCT {c}) / count(*)::DOUBLE", 4)
    text = k == "string"
    first = f"(SELECT {c} FROM dirty WHERE {c} IS NOT NULL)"
    parts = [
        f"{i} AS position", f"'{c}' AS \"column\"",
        f"(SELECT detected_type FROM types t WHERE t.\"column\" = '{c}') AS effective_type",
        f"{pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct", f"count(*) - count({c}) AS missing_count",
        f"count(DISTINCT {c}) AS unique_count", f"{ratio} AS cardinality_ratio", f"count({c}) AS count",
        *[f"{r(e, 2 if n == 'variance' else 4) if number else '0.0::DOUBLE'} AS {n}" for n, e in stats.items()],
        (f"coalesce(bool_or({c} <> trim({c}, {BLANKS})), false)" if text else "false") + " AS has_whitespace",
        (f"count(DISTINCT lower(trim({c}, {BLANKS}))) < count(DISTINCT trim({c}, {BLANKS}))" if text else "false")
        + " AS has_case_inconsistency",
        f"count(DISTINCT {c}) = 1 AS is_constant", f"count(DISTINCT {c}) > 1 AND {ratio} < 0.01 AS is_low_variance",
        (f"(SELECT avg(CASE WHEN try_cast({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9 FROM {first})" if text else "false")
        + " AS is_datetime_convertible",
        (f"bool_and({c} = round({c}))" if k == "float" else "false") + " AS is_int_convertible",
        f"{str(text).lower()} AND {ratio} < 0.5 AS is_category_beneficial",
        (f"(SELECT outlier_percentage FROM ({counted('dirty', c, 'iqr')}))" if number else "0.0::DOUBLE") + " AS outlier_pct",
    ]
    return f"SELECT {', '.join(parts)} FROM dirty"


COLUMN_FACTS = union(column_fact_row(i, c, k) for i, (c, k) in enumerate(EVENTS))
DUP_COUNT = f"(SELECT (sum(n) - count(*))::BIGINT FROM (SELECT count(*) AS n FROM dirty GROUP BY {NAMES}))"
EQUAL_PAIRS = union(f"SELECT 1 FROM dirty HAVING bool_and({a} IS NOT DISTINCT FROM {b})" for a, b in PAIRS)
DATASET_FACTS = (
    f"SELECT {pct(DUP_COUNT, '(SELECT count(*) FROM dirty)')} AS duplicate_row_pct, {DUP_COUNT} AS duplicate_row_count, "
    f"(SELECT count(*) FROM ({EQUAL_PAIRS})) AS duplicate_column_count, "
    f"(SELECT count(*) FROM ({pearson('dirty', DIRTY_NUMBERS)}) WHERE abs(correlation) >= 0.8) AS high_correlation_pair_count"
)
ORACLES["column_facts"] = with_dirty(COLUMN_FACTS, best_delimiters("dirty", TEXTS), TYPE_ROWS)
ORACLES["dataset_facts"] = with_dirty(DATASET_FACTS)


def rules_sql() -> str:
    from datalathe.rules.catalog import BUILT_IN

    parts = []
    for number, rule in enumerate(BUILT_IN):
        source = "dataset_facts" if rule["applies_to"] == "dataset" else "facts"
        column = "'(entire dataset)'" if source == "dataset_facts" else '"column"'
        position = "999999" if source == "dataset_facts" else "position"
        scope = "" if rule["applies_to"] in ("dataset", "any") else f"effective_type = '{rule['applies_to']}' AND "
        parts.append(
            f"SELECT '{rule['id']}' AS rule_id, '{rule['category']}' AS category, '{rule['severity']}' AS severity, "
            f"{column} AS \"column\", {position} AS position, {number} AS rule_no FROM {source} WHERE {scope}({rule['condition']})"
        )
    return union(parts)


FACT_CTES = (
    best_delimiters("dirty", TEXTS), TYPE_ROWS, f"facts AS ({COLUMN_FACTS})", f"dataset_facts AS ({DATASET_FACTS})",
    f"recs AS ({rules_sql()})",
)
ORACLES["recommendations"] = with_dirty("SELECT rule_id, category, severity, \"column\" FROM recs", *FACT_CTES)
HEALTH = (
    "pen AS (SELECT least((SELECT sum(missing_count) / (sum(count) + sum(missing_count))::DOUBLE * 100 FROM facts) * 0.5, 25) AS mp, "
    "least((SELECT duplicate_row_count FROM dataset_facts) / (SELECT count(*) FROM dirty)::DOUBLE * 100 * 0.3, 15) AS dp, "
    "least((SELECT sum(CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 0.5 END) FROM recs), 40)::DOUBLE AS rp)"
)
ORACLES["health_score"] = with_dirty(
    f"SELECT {even('greatest(0, 100 - mp - dp - rp)', 1)} AS score, {even('mp', 1)} AS missing_penalty, "
    f"{even('dp', 1)} AS duplicate_penalty, {even('rp', 1)} AS recommendation_penalty, "
    "(SELECT count(*) FROM recs) AS total_recommendations, "
    "(SELECT count(*) FROM recs WHERE severity = 'high') AS high_severity_count FROM pen",
    *FACT_CTES, HEALTH,
)
ORACLES["dashboard"] = with_dirty(
    "SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, position, rule_no) - 1 "
    "AS position, rule_id, \"column\", severity, (SELECT count(*) FROM dirty) AS rows, "
    f"(SELECT {even('greatest(0, 100 - mp - dp - rp)', 1)} FROM pen) AS score FROM recs "
    "QUALIFY row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, position, rule_no) <= 5",
    *FACT_CTES, HEALTH,
)
ORACLES["inspect_column"] = with_dirty(
    "SELECT (SELECT detected_type FROM types WHERE \"column\" = 'value') AS detected_type, "
    f"(SELECT {even('-sum(p * log2(p))', 4)} FROM (SELECT count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM dirty "
    "WHERE value IS NOT NULL GROUP BY value)) AS entropy, (SELECT count(DISTINCT value) FROM dirty) AS unique_count, "
    "o.outlier_count, o.outlier_percentage, c.correlated_with, c.correlation, "
    "(SELECT count(*) FROM recs WHERE \"column\" = 'value')::INTEGER AS recommendation_count FROM "
    f"({counted('dirty', 'value', 'iqr')}) o, (SELECT * FROM ("
    + union(
        f"SELECT '{c}' AS correlated_with, {i} AS position, {even(f'corr(value, {c}::DOUBLE)', 3)} AS correlation FROM dirty"
        for i, c in enumerate(x for x in DIRTY_NUMBERS if x != "value")
    )
    + ") ORDER BY abs(correlation) DESC, position LIMIT 5) c",
    *FACT_CTES,
)

# -- steps, versions, sources ------------------------------------------------------------------------------------

DEDUP = f"dedup AS (SELECT min(row_id) AS row_id, {NAMES} FROM dirty GROUP BY {NAMES})"


def capped_sql(table: str) -> str:
    b = (
        f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, "
        f"quantile_cont(value, 0.75) AS q3 FROM {table}))"
    )
    return f"SELECT t.* REPLACE (CASE WHEN value > hi THEN hi WHEN value < lo THEN lo ELSE value END AS value) FROM {table} t, {b}"


def filled_sql(table: str) -> str:
    return f"SELECT * REPLACE (coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {table})) AS value) FROM {table}"


def minmax_sql(table: str) -> str:
    return f"SELECT * REPLACE ((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value) FROM {table}"


ORACLES["replay_steps"] = with_dirty(
    f"SELECT row_id, {r('value')} AS value, event_type FROM s4",
    DEDUP, f"s2 AS ({filled_sql('dedup')})", f"s3 AS ({capped_sql('s2')})", f"s4 AS ({minmax_sql('s3')})",
)
FEWER = ", ".join(c for c, _ in EVENTS if c != "value_copy")
ORACLES["reorder_steps"] = with_dirty(
    f"SELECT row_id, {r('value')} AS value, event_type FROM s4",
    f"s1 AS ({filled_sql('dirty')})", f"s2 AS ({minmax_sql('s1')})", f"s3 AS ({capped_sql('s2')})",
    f"s4 AS (SELECT min(row_id) AS row_id, {FEWER} FROM s3 GROUP BY {FEWER})",
)
ORACLES["version_history"] = with_dirty(
    "SELECT 1 AS version_num, NULL::VARCHAR AS operation, false AS is_current, count(*) AS rows, count(value) AS values FROM dirty "
    "UNION ALL SELECT 2, 'remove_duplicate_rows', false, count(*), count(value) FROM dedup "
    "UNION ALL SELECT 3, 'impute', true, count(*), count(*) FROM dedup WHERE value IS NOT NULL",
    DEDUP,
)
ORACLES["version_reorder"] = with_dirty(
    f"SELECT row_id, {r('value')} AS value, event_type FROM s3",
    f"s1 AS ({filled_sql('dirty')})", f"s2 AS ({capped_sql('s1')})",
    f"s3 AS (SELECT min(row_id) AS row_id, {NAMES} FROM s2 GROUP BY {NAMES})",
)
ORACLES["replay_check"] = with_dirty(
    f"SELECT true AS matches, count(*) AS current_rows, {len(EVENTS)}::BIGINT AS current_columns, count(*) AS replayed_rows, "
    f"{len(EVENTS)}::BIGINT AS replayed_columns FROM dedup",
    DEDUP,
)
AWKWARD = "concat(tags, ', \"', num_text, '\"', chr(10), ';', CAST(row_id AS VARCHAR))"
CSV_TYPES = {"num_text": "num_text", "ts": "CAST(ts AS VARCHAR)"}
ORACLES["csv_roundtrip"] = with_dirty(
    "SELECT row_number() OVER (ORDER BY row_id) - 1 AS __row_id, "
    + ", ".join(f"{CSV_TYPES.get(c, c)} AS {c}" for c, _ in EVENTS)
    + f", {AWKWARD} AS awkward FROM dirty"
)
_READ = "CASE WHEN {0} IN (" + ", ".join(f"'{t}'" for t in NA_TOKENS) + ") THEN NULL ELSE {0} END"
ORACLES["csv_quoted_split"] = f"""SELECT doc_id AS number, lang, source, length({_READ.format("text")}) AS chars, md5({_READ.format("text")}) AS digest
FROM documents"""
ORACLES["parquet_roundtrip"] = with_dirty(f"SELECT {NAMES} FROM dirty")

# -- what rows and steps become --------------------------------------------------------------------------------------

ORACLES["convert_category_int"] = with_dirty("SELECT row_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_id FROM dirty")
ORACLES["dedup_nan"] = with_dirty(
    f"SELECT row_id, {r('value')} AS value, {DUP_COUNT} AS duplicates FROM dedup", DEDUP
)
ORACLES["fe_strip"] = with_dirty(f"SELECT row_id, trim(event_type, {BLANKS}) AS event_type FROM dirty")
ORACLES["fe_case"] = with_dirty("SELECT row_id, upper(event_type) AS event_type FROM dirty")
DAY = "CAST(date_text AS DATE)"
PARTS = {
    "year": "year({d})", "quarter": "quarter({d})", "month": "month({d})", "day": "day({d})", "hour": "0",
    "day_of_week": "isodow({d}) - 1", "day_of_year": "dayofyear({d})", "week": "weekofyear({d})",
}
ORACLES["fe_date_parts"] = with_dirty(
    "SELECT row_id, " + ", ".join(f"CAST({e.format(d=DAY)} AS INTEGER) AS date_text_{p}" for p, e in PARTS.items()) + " FROM dirty"
)
ROLLED = {"mean": "avg({v})", "sum": "sum({v})", "min": "min({v})", "max": "max({v})"}
ORACLES["fe_rolling"] = with_dirty(
    "SELECT row_id, count(value) OVER w AS value_rolling_count, "
    + ", ".join(
        f"CASE WHEN count(value) OVER w >= 3 THEN {r(e.format(v='value') + ' OVER w')} END AS value_rolling_{s}" for s, e in ROLLED.items()
    )
    + " FROM dirty WINDOW w AS (ORDER BY row_id ROWS 24 PRECEDING)"
)
ORACLES["fe_asof"] = (
    "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_type, value FROM events), "
    "b AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM e "
    "WHERE event_type = 'purchase' GROUP BY ALL) "
    "SELECT e.event_id, b.event_id AS event_id_bought, b.value AS value_bought "
    "FROM e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts"
)
ORACLES["fe_elapsed_since"] = (
    "SELECT event_id, "
    + r("(epoch_us(ts) - epoch_us(max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts))) / 3600000000.0::DOUBLE")
    + " AS hours_since_error FROM events"
)
ORACLES["fe_elapsed"] = with_dirty(
    f"SELECT row_id, {r('(epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 3600000000.0::DOUBLE')} AS ts_hours FROM dirty"
)
ORACLES["fe_text_size"] = (
    "SELECT doc_id, length(text) AS text_length, len(regexp_extract_all(text, '\\S+')) AS text_words FROM documents"
)
ORACLES["fe_bin"] = with_dirty(
    "SELECT row_id, CASE WHEN value IS NOT NULL THEN CAST((SELECT count(*) FROM range(1, 10) t(k) WHERE value >= lo + k * (hi - lo) / 10) AS INTEGER) END "
    "AS value_bin FROM dirty, (SELECT min(value) AS lo, max(value) AS hi FROM dirty)"
)
ORACLES["fe_bin_quantile"] = with_dirty(
    "SELECT row_id, CASE WHEN value IS NOT NULL THEN CAST(value >= a AS INTEGER) + CAST(value >= b AS INTEGER) + CAST(value >= c AS INTEGER) END "
    "AS value_bin FROM dirty, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM dirty)"
)
ORACLES["fe_cyclic"] = with_dirty(
    f"SELECT row_id, {r('whole_float')} AS whole_float, {r('sin(2 * pi() * whole_float / 7)')} AS whole_float_sin, "
    f"{r('cos(2 * pi() * whole_float / 7)')} AS whole_float_cos FROM dirty"
)
ORACLES["enc_onehot_case"] = with_dirty(
    "SELECT row_id, coalesce(code, -1) AS position, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS ones, "
    "(SELECT count(*) FROM codes)::INTEGER AS columns FROM dirty LEFT JOIN codes ON v = event_type",
    CODES,
)
ORACLES["enc_onehot_wide"] = (
    "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS position, 1 AS ones, "
    "(SELECT count(DISTINCT c_name) FROM customer)::INTEGER AS columns FROM customer"
)
ORACLES["enc_multilabel_wide"] = (
    "WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT c_name AS v FROM customer UNION SELECT c_mktsegment FROM customer)) "
    "SELECT c_custkey, least(a.code, b.code) AS position, 2 AS ones, (SELECT count(*) FROM l)::INTEGER AS columns "
    "FROM customer JOIN l a ON a.v = c_name JOIN l b ON b.v = c_mktsegment"
)
ORACLES["scatter_sample"] = with_dirty(
    "SELECT row_id, value AS x, whole_float AS y FROM dirty WHERE value IS NOT NULL AND whole_float IS NOT NULL "
    "ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 3000"
)
ORACLES["version_redo_restore"] = with_dirty(
    "SELECT * FROM (VALUES (0, 'undo', 3), (1, 'undo', 2), (2, 'redo', 3), (3, 'restore', 1)) t(position, action, current) "
    "JOIN (SELECT 1 AS current, count(*) AS rows, count(*) - count(value) AS missing FROM dirty UNION ALL "
    "SELECT 2, count(*), count(*) - count(value) FROM dedup UNION ALL SELECT 3, count(*), 0 FROM dedup) USING (current)",
    DEDUP,
)
ORACLES["dataset_list"] = (
    "SELECT * FROM (VALUES ('events.csv', 4, 4), ('nation.csv', 1, 1)) t(filename, current_version, total_versions)"
)
ORACLES["steps_export"] = with_dirty(
    "SELECT version_num, operation, params, (SELECT count(*) FROM dedup) AS rows, (SELECT count(*) FROM dedup) AS values FROM "
    "(VALUES (2, 'remove_duplicate_rows', 1), (3, 'impute', 2), (4, 'outlier_treatment', 3)) t(version_num, operation, params)",
    DEDUP,
)
ORACLES["type_override"] = with_dirty(
    "SELECT \"column\", CASE WHEN \"column\" = 'whole_float' THEN 'categorical' ELSE detected_type END AS effective_type, "
    "\"column\" = 'whole_float' AS is_overridden FROM types",
    DEDUP, best_delimiters("dedup", TEXTS), TYPE_ROWS.replace("FROM dirty", "FROM dedup"),
)
ORACLES["stored_transform"] = with_dirty(
    f"SELECT row_id, {r('sqrt(value)')} AS value, CASE WHEN event_type IS NOT NULL THEN count(*) OVER (PARTITION BY event_type) END AS event_type FROM s3",
    DEDUP, f"s2 AS ({filled_sql('dedup')})", f"s3 AS ({capped_sql('s2')})",
)
EVERYWHERE = ("mode", "constant", "forward_fill", "backward_fill", "drop_rows")
CELLS = union(
    f"SELECT 'changed' AS change, row_id, '{c}' AS \"column\", 1::BIGINT AS rows, "
    + ", ".join(f"{e} AS {n}" for n, e in found.items())
    + f" FROM gone g JOIN come c USING (row_id) JOIN ids USING (row_id) WHERE olds = 1 AND news = 1 AND g.{c} IS DISTINCT FROM c.{c}"
    for c, found in (
        ("value", {"old_value": r("g.value"), "new_value": r("c.value"), "old_type": "NULL", "new_type": "NULL"}),
        ("event_type", {"old_value": "NULL", "new_value": "NULL", "old_type": "g.event_type", "new_type": "c.event_type"}),
    )
)
ORACLES["version_diff"] = with_dirty(
    CELLS + "".join(
        f" UNION ALL SELECT '{name}', row_id, NULL, {n}::BIGINT, NULL, NULL, NULL, NULL FROM ids WHERE {n} > 0 AND NOT (olds = 1 AND news = 1)"
        for name, n in (("deleted", "olds"), ("inserted", "news"))
    ),
    f"b AS ({BEFORE_EDIT.replace('{rows}', 'dirty')})", f"a AS ({AFTER_EDIT.replace('{rows}', 'dirty')})",
    "gone AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)", "come AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)",
    "ids AS (SELECT row_id, sum(o) AS olds, sum(n) AS news FROM (SELECT row_id, 1 AS o, 0 AS n FROM gone UNION ALL "
    "SELECT row_id, 0, 1 FROM come) GROUP BY row_id)",
)
ORACLES["fitted_batch"] = ORACLES["fitted_stream"] = with_dirty(
    f"SELECT row_id, {r('(least(greatest(coalesce(value, med), lo), hi) - mn) / (mx - mn)')} AS value, code AS event_type "
    "FROM dirty LEFT JOIN codes USING (event_type), bounds, ends, middle",
    f"part AS (SELECT min(row_id) AS row_id, {NAMES} FROM dirty WHERE row_id % 2 = 0 GROUP BY {NAMES})",
    "middle AS (SELECT quantile_cont(value, 0.5) AS med FROM part)", f"f AS ({filled_sql('part')})",
    "bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f))",
    "ends AS (SELECT min(least(greatest(value, lo), hi)) AS mn, max(least(greatest(value, lo), hi)) AS mx FROM f, bounds)",
    "codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM part "
    "WHERE event_type IS NOT NULL))",
)
ORACLES["steps_export_yaml"] = with_dirty(
    f"SELECT row_id, {r('value')} AS value, event_type FROM s3",
    DEDUP, f"s2 AS ({filled_sql('dedup')})", f"s3 AS ({capped_sql('s2')})",
)
ORACLES["strategy_validation"] = union(
    f"SELECT '{c}' AS \"column\", '{s}' AS strategy, {str(s in EVERYWHERE or (s in ('mean', 'median') and kind in ('integer', 'float'))).lower()} AS allowed"
    for c, kind in EVENTS
    for s in ("mean", "median", *EVERYWHERE, "unheard_of")
)
ORACLES["categorical_matrix"] = (
    "WITH v AS (" + cramers("lineitem", ["l_returnflag", "l_linestatus"]) + ") "
    "SELECT a AS column_a, b AS column_b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE (SELECT round(correlation, 3) FROM v) END AS correlation "
    "FROM (VALUES ('l_returnflag'), ('l_linestatus')) x(a), (VALUES ('l_returnflag'), ('l_linestatus')) y(b)"
)
ORACLES["replay_all"] = with_dirty(
    f"SELECT row_id, {r('value')} AS value, {r('try_cast(num_text AS DOUBLE)')} AS num_text, "
    "CASE WHEN event_type IS NOT NULL THEN count(*) OVER (PARTITION BY event_type) END AS event_type, 9 AS columns FROM s5",
    DEDUP, f"s2 AS ({filled_sql('dedup')})", f"s3 AS ({capped_sql('s2')})",
    "s4 AS (SELECT * REPLACE (sqrt(value) AS value) FROM s3)", f"s5 AS ({minmax_sql('s4')})",
)

# -- fitted powers and the normality statistic -------------------------------------------------------------------------


def powered(table: str, key: str, x: str, slope: str, y: str, dy: str) -> str:
    """Values at the likelihood's best power ``l``, standardised; its derivative falls, so ten cells hold its root by turns."""
    ctes = [f"data AS (SELECT {key}, {x} AS x FROM {table})", f"c AS (SELECT count(*) AS n, sum({slope}) AS s FROM data)", "b0 AS (SELECT -4.003::DOUBLE AS l)"]
    for i in range(1, 15):
        step = f"{8.0 / 10**i!r}::DOUBLE"
        ctes.append(
            f"b{i} AS (SELECT max(l) AS l FROM (SELECT l, any_value(s) - any_value(n) * covar_pop({y}, {dy}) / var_pop({y}) AS g FROM "
            f"(SELECT b.l + k * {step} AS l FROM b{i - 1} b, range(10) r(k)), data, c GROUP BY l) WHERE g > 0)"
        )
    return (
        f"WITH {', '.join(ctes)}, t AS (SELECT {key}, {y} AS y FROM data, b14) "
        f"SELECT {key}, {r('(y - avg(y) OVER ()) / stddev_samp(y) OVER ()', 2)} AS {x} FROM t"
    )


ORACLES["tx_boxcox"] = powered(
    "orders", "o_orderkey", "o_totalprice", "ln(x)", "((pow(x, l) - 1) / l)", "(pow(x, l) * ln(x) / l - (pow(x, l) - 1) / (l * l))"
)
ORACLES["tx_yeojohnson"] = powered(
    "customer", "c_custkey", "c_acctbal", "sign(x) * ln(abs(x) + 1)",
    "(CASE WHEN x >= 0 THEN (pow(x + 1, l) - 1) / l ELSE -(pow(1 - x, 2 - l) - 1) / (2 - l) END)",
    "(CASE WHEN x >= 0 THEN pow(x + 1, l) * ln(x + 1) / l - (pow(x + 1, l) - 1) / (l * l) "
    "ELSE pow(1 - x, 2 - l) * ln(1 - x) / (2 - l) - (pow(1 - x, 2 - l) - 1) / ((2 - l) * (2 - l)) END)",
)

# Acklam's rational approximation of the inverse normal distribution, highest power first.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_LOW = 0.02425


def horner(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def inverse_normal(p: str) -> str:
    def tail(q: str) -> str:
        u = f"sqrt(-2 * ln({q}))"
        return f"{horner(_C, u)} / {horner(_D, u)}"

    q = f"({p} - 0.5)"
    middle = f"{horner(_A, f'({q} * {q})')} * {q} / {horner(_B, f'({q} * {q})')}"
    return f"CASE WHEN {p} < {_LOW} THEN {tail(p)} WHEN {p} > 1 - {_LOW} THEN -({tail(f'(1 - {p})')}) ELSE {middle} END"


def normal_row(c: str) -> str:
    """Royston's W from 5000 values in the order of a hash, for more than eleven values."""
    u = "(1 / sqrt(n))"
    last = f"(top / sqrt(ssq) + {horner((-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0), u)})"
    second = f"(next / sqrt(ssq) + {horner((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0), u)})"
    rest = f"((ssq - 2 * top * top - 2 * next * next) / (1 - 2 * {last} * {last} - 2 * {second} * {second}))"
    weight = (
        f"CASE WHEN i = 1 THEN -{last} WHEN i = n THEN {last} WHEN i = 2 THEN -{second} WHEN i = n - 1 THEN {second} "
        f"ELSE m / sqrt({rest}) END"
    )
    mu = horner((0.0038915, -0.083751, -0.31082, -1.5861), "ln(n)")
    sigma = f"exp({horner((0.0030302, -0.082676, -0.4803), 'ln(n)')})"
    z = f"((ln(1 - w) - {mu}) / {sigma})"
    # Far in the tail the upper normal probability is its leading term; here it rounds to nothing.
    p = f"CASE WHEN {z} > 4 THEN exp(-{z} * {z} / 2) / ({z} * sqrt(2 * pi())) END"
    return (
        f"SELECT '{c}' AS \"column\", n::INTEGER AS sample_size, {r('w', 4)} AS statistic, {r(p, 4)} AS p_value, {p} > 0.05 AS is_normal FROM "
        f"(SELECT any_value(n) AS n, pow(sum({weight} * (x - mean)), 2) / sum(pow(x - mean, 2)) AS w FROM (SELECT *, "
        f"sum(m * m) OVER () AS ssq, max(m) OVER () AS top, -(nth_value(m, 2) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next "
        f"FROM (SELECT *, {inverse_normal('((i - 0.375) / (n + 0.25))')} AS m FROM (SELECT x, row_number() OVER (ORDER BY x)::DOUBLE AS i, "
        f"count(*) OVER ()::DOUBLE AS n, avg(x) OVER () AS mean FROM (SELECT {c} AS x FROM dirty WHERE {c} IS NOT NULL "
        "ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 5000)))))"
    )


ORACLES["normality"] = with_dirty(union(normal_row(c) for c in ("value", "whole_float")))

WIDE_TABLE = "wide AS (SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS w{k}" for k, e in enumerate(WIDE, 1)) + " FROM lineitem)"
WIDE_NAMES = [f"w{k}" for k in range(1, len(WIDE) + 1)]
def _switch() -> str:
    names = list(SWITCH)
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            ends = f"min({a}) {both} < max({a}) {both} AND min({b}) {both} < max({b}) {both}"
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'CASE WHEN {ends} THEN corr({a}, {b}) END')} AS correlation FROM e")
    columns = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in SWITCH.items())
    return f"WITH e AS (SELECT {columns} FROM events), c AS ({union(parts)}) SELECT c.*, width FROM c, (VALUES (4), (14)) w(width)"


ORACLES["corr_pearson_switch"] = _switch()
ORACLES["corr_pearson_wide"] = (
    f"WITH {WIDE_TABLE}, k AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for i, a in enumerate(WIDE_NAMES) for b in WIDE_NAMES[i + 1 :])
    + " FROM wide) SELECT split_part(p, '_', 1) AS column_a, split_part(p, '_', 2) AS column_b, "
    + even("r", 3) + " AS correlation FROM (UNPIVOT k ON COLUMNS(*) INTO NAME p VALUE r)"
)
ORACLES["corr_spearman_wide"] = (
    f"WITH {WIDE_TABLE}, ranks AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in WIDE_NAMES)
    + " FROM wide), k AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for i, a in enumerate(WIDE_NAMES) for b in WIDE_NAMES[i + 1 :])
    + " FROM ranks) SELECT split_part(p, '_', 1) AS column_a, split_part(p, '_', 2) AS column_b, "
    + even("r", 3) + " AS correlation FROM (UNPIVOT k ON COLUMNS(*) INTO NAME p VALUE r)"
)
ORACLES["quartiles_wide"] = f"WITH {WIDE_TABLE} " + union(
    f"SELECT '{c}' AS \"column\", {r(f'quantile_cont({c}, 0.25)')} AS q1, {r(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r(f'quantile_cont({c}, 0.75)')} AS q3 FROM wide"
    for c in WIDE_NAMES
)
GROUPED = [("user_id", True), ("value", True), ("whole_float", True), ("date_text", False)]
ORACLES["profile_grouped"] = with_dirty(
    union(
        f"SELECT num_text, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count, "
        f"(SELECT CAST(v AS VARCHAR) FROM (SELECT {c} AS v, count(*) AS n FROM dirty i WHERE i.num_text IS NOT DISTINCT FROM o.num_text "
        f"AND {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS mode, "
        + ", ".join(
            f"{r(e, 4) if number else 'NULL::DOUBLE'} AS {name}"
            for name, e in (
                ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("minimum", f"min({c})"), ("maximum", f"max({c})"),
                ("q1", f"quantile_cont({c}, 0.25)"), ("median", f"quantile_cont({c}, 0.5)"), ("q3", f"quantile_cont({c}, 0.75)"),
            )
        )
        + " FROM dirty o GROUP BY num_text"
        for c, number in GROUPED
    )
)

ORACLES["profile_incremental"] = with_dirty(
    union(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count, "
        f"(SELECT CAST(v AS VARCHAR) FROM (SELECT {c} AS v, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) "
        "AS mode, "
        + ", ".join(
            f"{r(e, 4) if number else 'NULL::DOUBLE'} AS {name}"
            for name, e in (
                ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("minimum", f"min({c})"), ("maximum", f"max({c})"),
                ("skewness", skew_of("dirty", c)), ("kurtosis", kurt_of("dirty", c)),
                ("q1", f"quantile_cont({c}, 0.25)"), ("median", f"quantile_cont({c}, 0.5)"), ("q3", f"quantile_cont({c}, 0.75)"),
            )
        )
        + " FROM dirty"
        for c, number in (*GROUPED, ("event_type", False))
    )
)
