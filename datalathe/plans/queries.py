"""Every operator as a query over the given tables: ``name -> f(spark, folder)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.scalars import col
from datalathe.operators import (
    asof,
    association,
    categorical,
    convert,
    distribution,
    encode,
    features,
    grouped,
    impute,
    layouts,
    outliers,
    profile,
    quality,
    rolling,
    scale,
    transforms,
    types,
)
from datalathe.plans.fitted import FittedPipeline, fit_steps, treat_stream
from datalathe.plans.steps import execute, replay, steps_from_text
from datalathe.rules import engine, facts
from datalathe.session import fresh_path
from datalathe.sources.files import read_csv, write_csv, write_parquet
from datalathe.sources.versions import VersionStore

# The events table with gaps, padded and upper-cased texts, a delimited column, a copied
# column, a constant column and every fiftieth row repeated. Runs unchanged in DuckDB.
DIRTY_EVENTS = """
WITH d AS (
  SELECT event_id AS row_id, ts, user_id,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value_copy,
    CASE WHEN event_id % 13 = 0 THEN NULL
         WHEN event_id % 17 = 0 THEN concat(' ', event_type)
         WHEN event_id % 19 = 0 THEN upper(event_type)
         ELSE event_type END AS event_type,
    concat(event_type, '|', CASE user_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'app' ELSE 'api' END) AS tags,
    CASE WHEN event_id % 23 = 0 THEN 'Unknown' ELSE CAST(user_id % 40 AS STRING) END AS num_text,
    CAST(user_id % 7 AS DOUBLE) AS whole_float,
    CAST(CAST(ts AS DATE) AS STRING) AS date_text,
    'k' AS const_col
  FROM {events})
SELECT * FROM d
UNION ALL
SELECT row_id + 100000000, ts, user_id, value, value_copy, event_type, tags, num_text, whole_float, date_text, const_col
FROM d WHERE row_id % 50 = 0
"""

# Order dates as text in ten layouts: slashes prove day first, hyphens month first, dots hold days up to 12 only.
MIXED_DATES = """
WITH p AS (
  SELECT o_orderkey, o_orderdate,
    CAST(year(o_orderdate) AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m, CAST(day(o_orderdate) AS STRING) AS d,
    lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd,
    substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * CAST(month(o_orderdate) AS INT) - 2, 3) AS mon,
    concat(CAST(o_orderkey % 24 AS STRING), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) AS hm
  FROM {orders})
SELECT o_orderkey, o_orderdate, CASE
    WHEN o_orderkey % 97 = 0 THEN 'n/a'
    WHEN o_orderkey % 89 = 0 THEN NULL
    WHEN o_orderkey % 10 = 0 THEN concat(y, '-', mm, '-', dd)
    WHEN o_orderkey % 10 = 1 THEN concat(d, '/', m, '/', y)
    WHEN o_orderkey % 10 = 2 THEN concat(dd, '/', mm, '/', y, ' ', hm)
    WHEN o_orderkey % 10 = 3 THEN concat(mm, '-', dd, '-', y)
    WHEN o_orderkey % 10 = 4 AND day(o_orderdate) <= 12 THEN concat(' ', d, '.', m, '.', y)
    WHEN o_orderkey % 10 = 5 THEN concat(mon, ' ', d, ', ', y)
    WHEN o_orderkey % 10 = 6 THEN concat(d, ' ', mon, ' ', y)
    WHEN o_orderkey % 10 = 7 THEN concat(d, '-', mon, '-', y)
    WHEN o_orderkey % 10 = 8 THEN concat(y, mm, dd)
    ELSE concat(y, '/', m, '/', d, ' ', hm, ':07') END AS date_text
FROM p
"""

# Edits of a stored table: changed, deleted and inserted rows, and rows repeated under their id, some of them on both sides.
_ALL = "ts, user_id, value, value_copy, event_type, tags, num_text, whole_float, date_text, const_col"
BEFORE_EDIT = f"""
SELECT row_id, {_ALL} FROM {{rows}} UNION ALL SELECT row_id, {_ALL} FROM {{rows}} WHERE row_id % 47 = 0
"""
AFTER_EDIT = f"""
SELECT row_id, ts, user_id, CASE WHEN row_id % 29 = 0 THEN value * 2 ELSE value END AS value, value_copy,
  CASE WHEN row_id % 31 = 0 THEN 'new ' || event_type WHEN row_id % 33 = 0 THEN NULL ELSE event_type END AS event_type,
  tags, num_text, whole_float, date_text, const_col
FROM {{rows}} WHERE row_id % 41 <> 0
UNION ALL SELECT row_id, {_ALL} FROM {{rows}} WHERE row_id % 43 = 0
UNION ALL SELECT row_id + 300000000, {_ALL} FROM {{rows}} WHERE row_id % 37 = 0
"""

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RANK_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
ORDER = "row_id"

# Steps replayed by the version and replay queries.
STEPS = [
    {"version_num": 2, "operation": "remove_duplicate_rows", "operation_params": {"keep": "first"}},
    {"version_num": 3, "operation": "impute", "operation_params": {"column": "value", "strategy": "median"}},
    {"version_num": 4, "operation": "outlier_treatment",
     "operation_params": {"column": "value", "method": "iqr", "action": "cap"}},
    {"version_num": 5, "operation": "scale", "operation_params": {"column": "value", "method": "minmax"}},
    {"version_num": 6, "operation": "drop_column", "operation_params": {"column": "value_copy"}},
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(DIRTY_EVENTS, events=table(spark, folder, "events"))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """All double columns at a fixed number of decimals, without negative zeros."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def record(spark: SparkSession, values: dict, schema: str) -> DataFrame:
    """One result row of a report."""
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(values[n] for n in names)], schema)


QUERIES: dict = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def on_dirty(name: str, build, digits: int = 6, **special: int) -> None:
    QUERIES[name] = lambda spark, folder: rounded(build(dirty_events(spark, folder)), digits, **special)


def on_table(name: str, source: str, build, digits: int = 6, **special: int) -> None:
    QUERIES[name] = lambda spark, folder: rounded(build(table(spark, folder, source)), digits, **special)


# -- profiling -----------------------------------------------------------------------------

on_table("profile_base", "lineitem", lambda d: profile.base_profile(d).drop("mode", "entropy"))
on_table("profile_mode", "lineitem", lambda d: profile.distinct_summary(d).select("column", "mode"))
on_dirty("entropy", lambda d: profile.entropy(d, row_id=ORDER))
on_table(
    "profile_moments",
    "lineitem",
    lambda d: profile.numeric_moments(d, LINE_NUMBERS).select(
        "column", "count", "mean", "std", "variance", "skewness", "kurtosis"
    ),
    5,
    variance=0,
)


@query("profile_numeric")
def profile_numeric(spark, folder):
    d = table(spark, folder, "lineitem").select(*LINE_NUMBERS)
    p = profile.profile(d, {c: "numerical" for c in LINE_NUMBERS}, row_id=None)
    return rounded(p.select("column", "mean", "median", "minimum", "maximum", "q1", "q3", "range"))


@query("profile_dirty")
def profile_dirty(spark, folder):
    p = profile.profile(dirty_events(spark, folder), row_id=ORDER)
    return rounded(
        p.select("column", "dtype", "count", "missing_count", "missing_percentage", "unique_count",
                 "cardinality_ratio", "mean", "median", "std", "minimum", "maximum", "q1", "q3"),
        4,
    )


@query("overview")
def overview(spark, folder):
    o = profile.overview(dirty_events(spark, folder), row_id=ORDER)
    return o.select(
        "rows", "columns", "missing_values_total", "missing_percentage", "duplicate_rows",
        *[F.col("feature_types")[t].alias(f"{t}_columns") for t in types.LOGICAL_TYPES],
    )


@query("summarize_column")
def summarize_column(spark, folder):
    s = profile.summarize_column(dirty_events(spark, folder), "value")
    return rounded(record(spark, s, "mean double, median double, std double, missing_count long, row_count long"))


# -- logical types ---------------------------------------------------------------------------

on_dirty("column_types", lambda d: types.detect_types(d, {"whole_float": "categorical"}, ORDER))
on_table("detect_id", "orders", lambda d: types.detect_ids(d, row_id="o_orderkey", columns=d.columns))
on_table("detect_id_text", "customer", lambda d: types.detect_ids(d, row_id="c_custkey", columns=d.columns))
on_dirty("detect_multi_label", lambda d: types.detect_delimiters(d, row_id=ORDER))
on_table("detect_multi_label_text", "documents", lambda d: types.detect_delimiters(d, ["text", "lang", "source"]))
on_dirty("detect_datetime", lambda d: types.datetime_flags(d, row_id=ORDER))
on_dirty("detect_int", lambda d: types.integer_flags(d, row_id=ORDER))
on_dirty("detect_category", lambda d: types.category_flags(d, row_id=ORDER))

# -- categories and distributions ------------------------------------------------------------

on_table("category_freq", "events", lambda d: categorical.category_frequencies(d, "event_type"))
on_table("category_freq_top", "orders", lambda d: categorical.category_frequencies(d, "o_custkey", 20))
on_dirty("multi_label_profile", lambda d: categorical.multi_label_profile(d, "tags"))
on_table("histogram", "events", lambda d: distribution.histogram(d, "value"))
on_table("boxplot_stats", "events", lambda d: distribution.boxplot_stats(d, "value"))
on_dirty("scatter_sample", lambda d: distribution.scatter(d, "value", "whole_float", ORDER))
on_dirty("normality", lambda d: distribution.normality(d, ["value", "whole_float"], ORDER), 4)
on_dirty("jarque_bera", lambda d: distribution.jarque_bera(d, ["value", "whole_float"]), 4, statistic=2)


@query("boxplot_values")
def boxplot_values(spark, folder):
    b = distribution.boxplot(dirty_events(spark, folder), "value", ORDER)
    return spark.createDataFrame(list(enumerate(b["values"])), "position long, value double")


@query("distribution")
def distribution_report(spark, folder):
    r = distribution.distribution(dirty_events(spark, folder), "value", ORDER)
    counts = r["histogram"]["counts"]
    rows = [(i, c, r["skewness"], r["kurtosis"]) for i, c in enumerate(counts)]
    return rounded(spark.createDataFrame(rows, "bin int, count long, skewness double, kurtosis double"))


# -- quality -----------------------------------------------------------------------------------

on_dirty("whitespace_flag", lambda d: quality.whitespace_flags(d, row_id=ORDER))
on_dirty("case_flag", lambda d: quality.case_flags(d, row_id=ORDER))
on_dirty("constant_flag", lambda d: quality.variation_flags(d, row_id=ORDER).select("column", "is_constant"))
on_dirty("low_variance_flag", lambda d: quality.variation_flags(d, row_id=ORDER).select("column", "is_low_variance"))
on_dirty("dup_rows", lambda d: quality.duplicate_rows(d, ORDER))
on_dirty("dedup_first", lambda d: quality.remove_duplicate_rows(d, "first", ORDER))
on_dirty("dedup_last", lambda d: quality.remove_duplicate_rows(d, "last", ORDER))
on_dirty("dup_columns", lambda d: quality.duplicate_columns_frame(d, ORDER))
on_dirty("drop_dup_columns", lambda d: quality.remove_columns(d, ["value_copy"]))
on_dirty("drop_column", lambda d: quality.remove_columns(d, ["const_col"]))


@query("dup_preview")
def dup_preview(spark, folder):
    d = dirty_events(spark, folder)
    p = quality.duplicate_rows_preview(d, ORDER)
    rows = [(p["duplicate_count"], p["rows_after_removal"], r["row_id"], r["user_id"]) for r in p["sample_duplicate_rows"]]
    return spark.createDataFrame(rows, "duplicate_count long, rows_after_removal long, row_id long, user_id long")


@query("dedup_nan")
def dedup_nan(spark, folder):
    """Missing values of both kinds are equal: every second gap is NaN here, NULL in the others."""
    d = dirty_events(spark, folder)
    nan = F.when(F.col("value").isNull() & (F.col("row_id") % 100_000_000 % 22 == 0) & (F.col("row_id") >= 100_000_000), F.lit(float("nan")))
    d = d.withColumn("value", F.coalesce(nan, "value"))
    kept = quality.remove_duplicate_rows(d, "first", ORDER)
    counted = quality.duplicate_rows(d, ORDER).select(F.col("count").alias("duplicates"))
    return rounded(kept.select("row_id", "value").crossJoin(counted))  # one row


# -- missing values ------------------------------------------------------------------------------

for _name, _column, _strategy, _constant in (
    ("impute_mean", "value", "mean", None),
    ("impute_median", "value", "median", None),
    ("impute_mode", "event_type", "mode", None),
    ("impute_constant", "event_type", "constant", "Unknown"),
    ("impute_ffill", "value", "forward_fill", None),
    ("impute_bfill", "value", "backward_fill", None),
    ("impute_ffill_text", "event_type", "forward_fill", None),
    ("impute_drop", "value", "drop_rows", None),
):
    on_dirty(
        _name,
        lambda d, c=_column, s=_strategy, k=_constant: impute.impute(d, c, s, k, ORDER).select("row_id", c),
    )


@query("impute_knn")
def impute_knn(spark, folder):
    d = dirty_events(spark, folder)
    return rounded(impute.impute(d, "value", "knn", row_id=ORDER, features=["user_id", "whole_float"]).select("row_id", "value"))


@query("impute_knn_text")
def impute_knn_text(spark, folder):
    """Gaps among the features too."""
    d = dirty_events(spark, folder)
    step = {"version_num": 2, "operation": "impute", "operation_params": {
        "column": "event_type", "strategy": "knn", "features": ["value", "user_id"], "neighbours": 3}}
    return replay(d, [step], ORDER).select("row_id", "event_type")


@query("impute_preview")
def impute_preview(spark, folder):
    p = impute.preview_imputation(dirty_events(spark, folder), "value", "median", row_id=ORDER)
    rows = [
        (i, v, p["before"]["missing_count"], p["after"]["missing_count"], p["after"]["mean"], p["after"]["std"])
        for i, v in zip(p["sample_rows"], p["sample_after"])
    ]
    schema = "row_id long, value double, before_missing long, after_missing long, after_mean double, after_std double"
    return rounded(spark.createDataFrame(rows, schema))


@query("impute_compare")
def impute_compare(spark, folder):
    c = impute.compare_strategies(dirty_events(spark, folder), "value", "mean", "drop_rows", ORDER)
    rows = [
        (k, c[k]["mean"], c[k]["median"], c[k]["std"], c[k]["missing_count"], c[k]["row_count"])
        for k in ("before", "after_a", "after_b")
    ]
    schema = "version string, mean double, median double, std double, missing_count long, row_count long"
    return rounded(spark.createDataFrame(rows, schema))


# -- outliers ----------------------------------------------------------------------------------------

for _name, _method in (("outliers_iqr", "iqr"), ("outliers_zscore", "zscore"), ("outliers_modz", "modified_zscore")):
    on_dirty(_name, lambda d, m=_method: outliers.outlier_counts(d, ["value", "whole_float"], m))
on_dirty("outliers_remove", lambda d: outliers.remove_outliers(d, "value", "iqr").select("row_id", "value"))
for _name, _method in (("iqr", "iqr"), ("z", "zscore"), ("modz", "modified_zscore")):
    on_dirty(
        f"outliers_cap_{_name}", lambda d, m=_method: outliers.cap_outliers(d, "value", m).select("row_id", "value")
    )
on_table("outliers_documents", "documents", lambda d: outliers.outlier_counts(d, ["n_chars"], "iqr"))


@query("outliers_sample")
def outliers_sample(spark, folder):
    r = outliers.detect_outliers(dirty_events(spark, folder), "value", "iqr", ORDER)
    rows = list(zip(r["outlier_indices"], r["outlier_values"]))
    return spark.createDataFrame(rows, "row_id long, value double")


# -- conversion ----------------------------------------------------------------------------------------

for _name, _column, _target in (
    ("convert_int", "num_text", "integer"),
    ("convert_int_float", "value", "integer"),
    ("convert_float", "num_text", "float"),
    ("convert_string", "user_id", "string"),
    ("convert_datetime", "date_text", "datetime"),
    ("convert_category", "event_type", "category"),
):
    on_dirty(_name, lambda d, c=_column, t=_target: convert.convert(d, c, t).select("row_id", c))


@query("convert_datetime_mixed")
def convert_datetime_mixed(spark, folder):
    d = spark.sql(MIXED_DATES, orders=table(spark, folder, "orders"))
    params = {"column": "date_text", "target_type": "datetime", "layouts": "infer"}
    return execute(d, "convert_dtype", params).select("o_orderkey", "date_text")


@query("date_layouts")
def date_layouts(spark, folder):
    return layouts.infer_layouts(spark.sql(MIXED_DATES, orders=table(spark, folder, "orders")), ["date_text"])


@query("convert_preview")
def convert_preview(spark, folder):
    p = convert.preview_conversion(dirty_events(spark, folder), "num_text", "float", ORDER)
    rows = [
        (p["before_missing"], p["after_missing"], p["newly_invalid_count"], b, a)
        for b, a in zip(p["sample_before"], p["sample_after"])
    ]
    schema = "before_missing long, after_missing long, newly_invalid_count long, before string, after double"
    return spark.createDataFrame(rows, schema)


on_dirty(
    "convert_category_int",
    lambda d: encode.encode(convert.convert(d, "user_id", "category"), "user_id", "label").select("row_id", "user_id"),
)

# -- new columns from one column -----------------------------------------------------------------------------

on_dirty("fe_strip", lambda d: execute(d, "strip", {"column": "event_type"}, ORDER).select("row_id", "event_type"))
on_dirty("fe_case", lambda d: execute(d, "change_case", {"column": "event_type", "case": "upper"}, ORDER).select("row_id", "event_type"))
on_dirty(
    "fe_date_parts",
    lambda d: execute(d.select("row_id", "date_text"), "date_parts", {"column": "date_text", "parts": list(features.PARTS)}, ORDER).drop("date_text"),
)
on_dirty("fe_elapsed", lambda d: execute(d.select("row_id", "ts"), "elapsed", {"column": "ts", "unit": "hours"}, ORDER).drop("ts"))
on_table("fe_text_size", "documents", lambda d: execute(d.select("doc_id", "text"), "text_size", {"column": "text"}, "doc_id").drop("text"))
on_dirty("fe_bin", lambda d: execute(d.select("row_id", "value"), "bin", {"column": "value"}, ORDER).drop("value"))
on_dirty(
    "fe_bin_quantile",
    lambda d: execute(d.select("row_id", "value"), "bin", {"column": "value", "bins": 4, "method": "quantile"}, ORDER).drop("value"),
)
on_dirty(
    "fe_rolling",
    lambda d: rolling.rolling(d.select("row_id", "value"), "value", 25, rolling.STATISTICS, ORDER, least=3).drop("value"),
)


@query("fe_asof")
def fe_asof(spark, folder):
    """The last purchase before each event, one user with a third of all rows."""
    events = table(spark, folder, "events").select(
        "event_id", "ts", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), "event_type", "value"
    )
    bought = events.where("event_type = 'purchase'")
    out = asof.asof_join(events, bought, ["user_id"], "ts", ["event_id", "value"], "_bought")
    return out.select("event_id", "event_id_bought", "value_bought")


@query("fe_elapsed_since")
def fe_elapsed_since(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    out = asof.elapsed_since(events, events.where("event_type = 'error'"), ["user_id"], "ts", "hours_since_error", "hours")
    return rounded(out.select("event_id", "hours_since_error"))


on_dirty("fe_cyclic", lambda d: execute(d.select("row_id", "whole_float"), "cyclic", {"column": "whole_float", "period": 7}, ORDER))

# -- transforms --------------------------------------------------------------------------------------------

on_table("tx_log", "orders", lambda d: transforms.apply_transform(d, "o_totalprice", "log").select("o_orderkey", "o_totalprice"))
on_table("tx_sqrt", "events", lambda d: transforms.apply_transform(d, "value", "sqrt").select("event_id", "value"))
on_table("tx_none", "events", lambda d: transforms.apply_transform(d, "value", "none").select("event_id", "value"))
# The fitted powers are found by search, so the values are compared in standard units.
on_table(
    "tx_boxcox", "orders",
    lambda d: scale.scale(transforms.apply_transform(d, "o_totalprice", "box_cox"), "o_totalprice", "standard").select("o_orderkey", "o_totalprice"), 2,
)
on_table(
    "tx_yeojohnson", "customer",
    lambda d: scale.scale(transforms.apply_transform(d, "c_acctbal", "yeo_johnson"), "c_acctbal", "standard").select("c_custkey", "c_acctbal"), 2,
)


@query("tx_preview")
def tx_preview(spark, folder):
    p = transforms.preview_transform(table(spark, folder, "events"), "value", "sqrt")
    rows = [
        (i, b, a, p["before_skewness"], p["after_skewness"])
        for i, (b, a) in enumerate(zip(p["before_histogram"]["counts"], p["after_histogram"]["counts"]))
    ]
    schema = "bin int, before_count long, after_count long, before_skewness double, after_skewness double"
    return rounded(spark.createDataFrame(rows, schema))


# -- association ---------------------------------------------------------------------------------------------

on_table("corr_pearson", "lineitem", lambda d: association.correlations(d, "pearson", row_id=None))
on_dirty("corr_pearson_gaps", lambda d: association.correlations(d, "pearson", row_id=None))
WIDE = [f"(l_orderkey * {k} + l_linenumber * {k % 7} + l_partkey) % {90 + k}" for k in range(1, 41)]
on_table(
    "corr_pearson_wide", "lineitem",
    lambda d: association.correlations(d.selectExpr(*[f"CAST({e} AS DOUBLE) AS w{k}" for k, e in enumerate(WIDE, 1)]), "pearson", row_id=None),
)


on_table(
    "corr_spearman_wide", "lineitem",
    lambda d: association.correlations(d.selectExpr(*[f"CAST({e} AS DOUBLE) AS w{k}" for k, e in enumerate(WIDE, 1)]), "spearman", row_id=None),
)

# A side that is far from its mean and nearly constant where the other one is present.
SWITCH = {
    "near": "CASE WHEN event_id % 5 = 0 THEN 1 + (user_id % 5) * 1e-6 ELSE 1000.0 * (user_id % 2) END",
    "gappy": "CASE WHEN event_id % 5 = 0 THEN CAST(user_id % 7 AS DOUBLE) END",
    "flat": "CASE WHEN event_id % 5 = 0 THEN 3 ELSE value END",
    "other": "value",
}


@query("corr_pearson_switch")
def corr_pearson_switch(spark, folder):
    """The same columns correlate alike in a table of four columns and in one of fourteen."""
    events = table(spark, folder, "events")
    parts = []
    for width in (4, 14):
        more = [f"CAST(event_id % {90 + i} AS DOUBLE) AS c{i}" for i in range(width - 4)]
        found = association.pearson(d := events.selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in SWITCH.items()], *more), d.columns)
        parts.append(found.where(col("column_a").isin(*SWITCH) & col("column_b").isin(*SWITCH)).withColumn("width", F.lit(width)))
    return rounded(parts[0].unionByName(parts[1]))


@query("quartiles_wide")
def quartiles_wide(spark, folder):
    """Quartiles of forty columns."""
    d = table(spark, folder, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS w{k}" for k, e in enumerate(WIDE, 1)])
    found = exact_quantiles(d, {c: F.col(c) for c in d.columns}, (0.25, 0.5, 0.75))
    return rounded(spark.createDataFrame([(c, *q) for c, q in found.items()], "column string, q1 double, median double, q3 double"))


on_table("corr_spearman", "lineitem", lambda d: association.correlations(d, "spearman", RANK_COLUMNS))
on_dirty("corr_spearman_gaps", lambda d: association.correlations(d, "spearman", ["value", "user_id", "whole_float"]))
on_table("corr_kendall", "lineitem", lambda d: association.correlations(d, "kendall", ["l_quantity", "l_discount", "l_linenumber"]))
on_table("corr_kendall_wide", "orders", lambda d: association.correlations(d, "kendall", ["o_custkey", "o_totalprice"]))
on_dirty("high_pairs", lambda d: association.high_pairs(d, row_id=ORDER))
on_table("top_correlated", "lineitem", lambda d: association.top_correlated(d, "l_extendedprice", row_id=None))
on_table(
    "cramers_v", "lineitem", lambda d: association.cramers_v(d, ["l_returnflag", "l_linestatus", "l_linenumber"])
)
on_dirty("cramers_v_gaps", lambda d: association.cramers_v(d, ["event_type", "tags", "num_text"]))

# -- encoding ------------------------------------------------------------------------------------------------

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
on_table(
    "enc_onehot", "orders",
    lambda d: encode.encode(d.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "one_hot"),
)
on_dirty("enc_label", lambda d: encode.encode(d, "event_type", "label").select("row_id", "event_type"))
on_table("enc_label_wide", "customer", lambda d: encode.encode(d, "c_name", "label", map_rows=100).select("c_custkey", "c_name"))
on_table(
    "enc_ordinal", "orders",
    lambda d: encode.encode(d, "o_orderpriority", "ordinal", order=PRIORITIES).select("o_orderkey", "o_orderpriority"),
)
on_dirty("enc_frequency", lambda d: encode.encode(d, "event_type", "frequency").select("row_id", "event_type"))
on_dirty("enc_binary", lambda d: encode.encode(d.select("row_id", "event_type"), "event_type", "binary"))
on_dirty("enc_multilabel", lambda d: encode.encode(d.select("row_id", "tags"), "tags", "multi_label"))

@query("enc_onehot_case")
def enc_onehot_case(spark, folder):
    """Values that differ in casing alone, written as a version."""
    store = VersionStore(spark, fresh_path(spark, "datalathe-store"), ORDER)
    dataset = store.add(dirty_events(spark, folder).select("row_id", "event_type"), "events.csv")
    out = store.apply(dataset, "encode", {"column": "event_type", "method": "one_hot"})
    names = [c for c in out.columns if c != ORDER]
    return out.select(ORDER, F.array(*[F.col(f"`{c}`") for c in names]).alias("flags")).select(
        ORDER, (F.array_position("flags", 1) - 1).alias("position"), F.aggregate("flags", F.lit(0), lambda a, x: a + x).alias("ones"),
        F.size("flags").alias("columns"),
    )


def _wide(spark, folder, values: DataFrame, column: str, key: str, method: str, **params):
    """A stored and replayed encoding of one column into a flag for each of very many values."""
    store = VersionStore(spark, fresh_path(spark, "datalathe-store"), key)
    dataset = store.add(values, "wide.csv")
    store.apply(dataset, "encode", {"column": column, "method": method, "form": "sparse", **params})
    out = replay(store.get_version(dataset, 1), store.steps(dataset), key)
    size, places = F.col(f"{column}_flags.size"), F.col(f"{column}_flags.indices")
    first = F.coalesce(F.get(places, 0), F.lit(-1)).cast("long")
    return out.select(key, first.alias("position"), F.size(places).alias("ones"), size.alias("columns"))


@query("enc_onehot_wide")
def enc_onehot_wide(spark, folder):
    return _wide(spark, folder, table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey", "one_hot")


@query("enc_multilabel_wide")
def enc_multilabel_wide(spark, folder):
    d = table(spark, folder, "customer").selectExpr("c_custkey", "concat(c_name, '|', c_mktsegment) AS tags")
    return _wide(spark, folder, d, "tags", "c_custkey", "multi_label", delimiter="|")


# -- scaling -------------------------------------------------------------------------------------------------

for _name, _method, _digits in (
    ("scale_standard", "standard", 6),
    ("scale_minmax", "minmax", 6),
    ("scale_robust", "robust", 6),
    ("scale_maxabs", "maxabs", 6),
    ("scale_l2", "normalize", 9),
):
    on_table(
        _name, "lineitem",
        lambda d, m=_method: scale.scale(d, "l_extendedprice", m).select("l_orderkey", "l_linenumber", "l_extendedprice"),
        _digits,
    )

# -- facts, rules and reports --------------------------------------------------------------------------------

on_dirty("column_facts", lambda d: facts.column_facts(d, row_id=ORDER), 4, variance=2)
on_dirty("dataset_facts", lambda d: facts.dataset_facts(d, ORDER))
on_dirty(
    "recommendations",
    lambda d: engine.recommendations(d, row_id=ORDER).select("rule_id", "category", "severity", "column"),
)


@query("health_score")
def health_score(spark, folder):
    h = engine.health_score(dirty_events(spark, folder), row_id=ORDER)
    penalties = {b["factor"]: b["penalty"] for b in h["breakdown"]}
    row = (
        h["score"], penalties.get("Missing data", 0.0), penalties.get("Duplicate rows", 0.0),
        penalties.get("Active recommendations", 0.0), h["total_recommendations"], h["high_severity_count"],
    )
    schema = (
        "score double, missing_penalty double, duplicate_penalty double, recommendation_penalty double, "
        "total_recommendations long, high_severity_count long"
    )
    return rounded(spark.createDataFrame([row], schema))


@query("inspect_column")
def inspect_column(spark, folder):
    from datalathe.plans.reports import inspect_column as inspect

    r = inspect(dirty_events(spark, folder), "value", row_id=ORDER)
    rows = [
        (
            r["detected_type"], r["entropy"], r["profile"]["unique_count"], r["outlier_summary"]["outlier_count"],
            r["outlier_summary"]["outlier_percentage"], c["column"], c["correlation"], len(r["recommendations"]),
        )
        for c in r["top_correlated_columns"]
    ]
    schema = (
        "detected_type string, entropy double, unique_count long, outlier_count long, outlier_percentage double, "
        "correlated_with string, correlation double, recommendation_count int"
    )
    return rounded(spark.createDataFrame(rows, schema))


@query("dashboard")
def dashboard(spark, folder):
    from datalathe.plans.reports import dashboard as board

    b = board(dirty_events(spark, folder), row_id=ORDER)
    rows = [
        (i, r["rule_id"], r["column"], r["severity"], b["overview"]["rows"], b["health"]["score"])
        for i, r in enumerate(b["quick_recommendations"])
    ]
    schema = "position int, rule_id string, column string, severity string, rows long, score double"
    return rounded(spark.createDataFrame(rows, schema))


# -- steps and versions ----------------------------------------------------------------------------------------


@query("replay_steps")
def replay_steps(spark, folder):
    return rounded(replay(dirty_events(spark, folder), STEPS, ORDER).select("row_id", "value", "event_type"))


@query("reorder_steps")
def reorder_steps(spark, folder):
    """The same steps with scaling before capping, and duplicates removed last."""
    by_version = {s["version_num"]: s for s in STEPS}
    order = [by_version[v] for v in (3, 5, 4, 6, 2)]
    return rounded(replay(dirty_events(spark, folder), order, ORDER).select("row_id", "value", "event_type"))


def _stored(spark, folder) -> tuple[VersionStore, str]:
    store = VersionStore(spark, fresh_path(spark, "datalathe-store"), ORDER)
    dataset = store.add(dirty_events(spark, folder), "events.csv")
    for s in STEPS[:3]:
        store.apply(dataset, s["operation"], s["operation_params"])
    return store, dataset


@query("version_history")
def version_history(spark, folder):
    """Versions after two undos, one new change, and what each of them holds."""
    store, dataset = _stored(spark, folder)
    store.undo(dataset)
    store.undo(dataset)
    store.apply(dataset, "impute", {"column": "value", "strategy": "drop_rows"})
    history = store.history(dataset).select("version_num", "operation", "is_current")
    sizes = None
    for v in (1, 2, 3):
        part = store.get_version(dataset, v).agg(
            F.lit(v).alias("version_num"), F.count(F.lit(1)).alias("rows"), F.count("value").alias("values")
        )
        sizes = part if sizes is None else sizes.unionAll(part)
    return history.join(sizes, "version_num")


@query("version_reorder")
def version_reorder(spark, folder):
    store, dataset = _stored(spark, folder)
    return rounded(store.reorder(dataset, [3, 4, 2]).select("row_id", "value", "event_type"))


@query("replay_check")
def replay_check(spark, folder):
    store, dataset = _stored(spark, folder)
    r = store.replay_check(dataset, strict=True)
    row = (r["matches_current"], *r["current_shape"], *r["replayed_shape"])
    schema = "matches boolean, current_rows long, current_columns long, replayed_rows long, replayed_columns long"
    return spark.createDataFrame([row], schema)


@query("version_redo_restore")
def version_redo_restore(spark, folder):
    """The current version after each of undo, redo and restore."""
    store, dataset = _stored(spark, folder)
    rows = []
    for action in ("undo", "undo", "redo", "restore"):
        found = store.restore(dataset, 1) if action == "restore" else getattr(store, action)(dataset)
        current = next(h["version_num"] for h in store.history_rows(dataset) if h["is_current"])
        rows.append((len(rows), action, current, found.count(), found.where("value IS NULL").count()))
    return spark.createDataFrame(rows, "position int, action string, current int, rows long, missing long")


@query("dataset_list")
def dataset_list(spark, folder):
    """Two stored datasets, one of them deleted again."""
    store, dataset = _stored(spark, folder)
    other = store.add(table(spark, folder, "region"), "region.csv")
    store.add(table(spark, folder, "nation"), "nation.csv")
    store.delete(other)
    return store.list_datasets().select("filename", "current_version", "total_versions")


@query("steps_export")
def steps_export(spark, folder):
    """The recorded steps, exported as JSON, read again and replayed."""
    store, dataset = _stored(spark, folder)
    steps = steps_from_text(store.steps_json(dataset))
    again = replay(store.get_version(dataset, 1), steps, ORDER)
    rows = again.agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("values")).first()
    out = [(s["version_num"], s["operation"], len(s["operation_params"]), rows["rows"], rows["values"]) for s in steps]
    return spark.createDataFrame(out, "version_num int, operation string, params int, rows long, values long")


@query("type_override")
def type_override(spark, folder):
    """Column types of a stored dataset with one override set and another set and cleared."""
    store, dataset = _stored(spark, folder)
    store.set_override(dataset, "whole_float", "categorical")
    store.set_override(dataset, "num_text", "id")
    store.clear_override(dataset, "num_text")
    found = types.detect_types(store.get(dataset), store.overrides(dataset), ORDER)
    return found.select("column", "effective_type", "is_overridden")


@query("stored_transform")
def stored_transform(spark, folder):
    store, dataset = _stored(spark, folder)
    store.apply(dataset, "transform", {"column": "value", "transform": "sqrt"})
    store.apply(dataset, "encode", {"column": "event_type", "method": "frequency"})
    return rounded(store.get(dataset).select("row_id", "value", "event_type"))


@query("version_diff")
def version_diff(spark, folder):
    """Inserted and deleted rows and changed cells from one stored version to the next."""
    rows = dirty_events(spark, folder)
    store = VersionStore(spark, fresh_path(spark, "datalathe-store"), ORDER)
    dataset = store.add(spark.sql(BEFORE_EDIT, rows=rows), "events.csv")
    store.update(dataset, spark.sql(AFTER_EDIT, rows=rows), "edited elsewhere")
    found = store.diff(dataset, 1, 2)
    of = lambda c, side: F.when(F.col("column") == c, F.col(side))
    return rounded(
        found.select(
            "change", "row_id", "column", "rows", of("value", "old").cast("double").alias("old_value"),
            of("value", "new").cast("double").alias("new_value"), of("event_type", "old").alias("old_type"),
            of("event_type", "new").alias("new_type"),
        )
    )


PROFILED = ["user_id", "value", "whole_float", "date_text", "event_type"]


@query("profile_incremental")
def profile_incremental(spark, folder):
    """The profile of a stored table after two appends, of which each is counted alone."""
    events = dirty_events(spark, folder).select(ORDER, *PROFILED)
    store = VersionStore(spark, fresh_path(spark, "datalathe-store"), ORDER)
    dataset = store.add(events.where("row_id % 3 > 0"), "events.csv")
    for rest in (0, 1):
        store.append(dataset, events.where(f"row_id % 3 = 0 AND row_id % 2 = {rest}"))
    return rounded(store.profile(dataset).drop("variance", "range"), 4)


FITTED_STEPS = [
    {"operation": "remove_duplicate_rows", "operation_params": {"keep": "first"}},
    {"operation": "impute", "operation_params": {"column": "value", "strategy": "median"}},
    {"operation": "outlier_treatment", "operation_params": {"column": "value", "method": "iqr", "action": "cap"}},
    {"operation": "scale", "operation_params": {"column": "value", "method": "minmax"}},
    {"operation": "encode", "operation_params": {"column": "event_type", "method": "label"}},
    {"operation": "drop_column", "operation_params": {"column": "value_copy"}},
]


def _saved(spark, events: DataFrame) -> FittedPipeline:
    """Fitted on the rows with an even id, saved and loaded."""
    path = fresh_path(spark, "datalathe-fitted")
    fit_steps(events.where("row_id % 2 = 0"), FITTED_STEPS, ORDER).save(spark, path)
    return FittedPipeline.load(spark, path)


@query("fitted_batch")
def fitted_batch(spark, folder):
    events = dirty_events(spark, folder)
    return rounded(_saved(spark, events).transform(events).select("row_id", "value", "event_type"))


@query("fitted_stream")
def fitted_stream(spark, folder):
    """The saved pipeline over a stream of files, ended and started again from its checkpoint half way."""
    events = dirty_events(spark, folder)
    source, sink, checkpoint = (fresh_path(spark, f"datalathe-{n}") for n in ("source", "sink", "checkpoint"))
    pipeline = _saved(spark, events)
    for rest in (0, 1):
        events.where(F.col("row_id") % 3 > 0 if rest else F.col("row_id") % 3 == 0).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        treat_stream(pipeline, stream, sink, checkpoint).awaitTermination()
    return rounded(spark.read.parquet(sink).select("row_id", "value", "event_type"))


@query("steps_export_yaml")
def steps_export_yaml(spark, folder):
    """The recorded steps, exported as YAML, read again and replayed."""
    store, dataset = _stored(spark, folder)
    again = replay(store.get_version(dataset, 1), steps_from_text(store.steps_yaml(dataset)), ORDER)
    return rounded(again.select("row_id", "value", "event_type"))


@query("strategy_validation")
def strategy_validation(spark, folder):
    """Which imputation strategy each column allows."""
    events = dirty_events(spark, folder)

    def allowed(column, strategy):
        try:
            impute.validate_strategy(events, column, strategy)
        except ValueError:
            return False
        return True

    pairs = [(c, s, allowed(c, s)) for c in events.columns if c != ORDER for s in (*impute.STRATEGIES, "unheard_of")]
    return spark.createDataFrame(pairs, "column string, strategy string, allowed boolean")


@query("categorical_matrix")
def categorical_matrix(spark, folder):
    m = association.categorical_matrix(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])
    rows = [(a, b, m["matrix"][i][j]) for i, a in enumerate(m["columns"]) for j, b in enumerate(m["columns"])]
    return rounded(spark.createDataFrame(rows, "column_a string, column_b string, correlation double"), 3)


on_dirty(
    "profile_grouped",
    lambda d: grouped.grouped_profile(d, ["num_text"], ["user_id", "value", "whole_float", "date_text"], ORDER),
    4,
)


NINE_STEPS = [
    ("remove_duplicate_rows", {"keep": "first"}),
    ("remove_duplicate_columns", {"columns_to_drop": ["value_copy"]}),
    ("impute", {"column": "value", "strategy": "median"}),
    ("convert_dtype", {"column": "num_text", "target_type": "float"}),
    ("outlier_treatment", {"column": "value", "method": "iqr", "action": "cap"}),
    ("transform", {"column": "value", "transform": "sqrt"}),
    ("encode", {"column": "event_type", "method": "frequency"}),
    ("scale", {"column": "value", "method": "minmax"}),
    ("drop_column", {"column": "const_col"}),
]


@query("replay_all")
def replay_all(spark, folder):
    """All nine operations of the registry's first part, one after the other."""
    steps = [{"version_num": i + 2, "operation": o, "operation_params": p} for i, (o, p) in enumerate(NINE_STEPS)]
    out = replay(dirty_events(spark, folder), steps, ORDER)
    return rounded(out.select("row_id", "value", "num_text", "event_type", F.lit(len(out.columns)).alias("columns")))


# -- sources and sinks -------------------------------------------------------------------------------------------


@query("csv_quoted_split")
def csv_quoted_split(spark, folder):
    """Texts with line breaks in files as large as tasks write them, read in splits far smaller than these."""
    path = f"{fresh_path(spark, 'quoted')}/documents.csv"
    write_csv(table(spark, folder, "documents").withColumnRenamed("doc_id", "number"), path, row_id=None)
    size, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(size, "256k")
    try:
        found = read_csv(spark, path)
    finally:
        spark.conf.set(size, before)
    return found.select("number", "lang", "source", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("csv_roundtrip")
def csv_roundtrip(spark, folder):
    """All columns, and a text with quotes, delimiter and line break, exported in row order and ingested again."""
    path = fresh_path(spark, "datalathe-export") + ".csv"
    awkward = F.concat(F.col("tags"), F.lit(', "'), F.col("num_text"), F.lit('"\n;'), F.col("row_id").cast("string"))
    d = dirty_events(spark, folder).withColumn("ts", F.col("ts").cast("string")).withColumn("awkward", awkward)
    write_csv(d, path, ORDER)
    return read_csv(spark, path)


@query("parquet_roundtrip")
def parquet_roundtrip(spark, folder):
    path = fresh_path(spark, "datalathe-export") + ".parquet"
    write_parquet(dirty_events(spark, folder), path, ORDER, keep_order=False)
    return spark.read.parquet(path)
