"""Built-in recommendation rules.

Ids, categories, severities, scopes and conditions are fixed values; conditions are
Spark SQL predicates over the facts of one column (or of the whole dataset).
"""

from __future__ import annotations

_SPARK = "https://spark.apache.org/docs/latest/"
_FUNCTIONS = _SPARK + "api/python/reference/pyspark.sql/functions.html"
_NA = _SPARK + "api/python/reference/pyspark.sql/api/pyspark.sql.DataFrameNaFunctions.html"
_ML = _SPARK + "ml-features.html"


def _rule(id, category, severity, applies_to, condition, recommendation, reason, pros, cons, instead, docs, learn=None):
    return {
        "id": id,
        "category": category,
        "severity": severity,
        "applies_to": applies_to,
        "condition": condition,
        "recommendation": recommendation,
        "reason": reason,
        "advantages": pros,
        "disadvantages": cons,
        "alternatives": instead,
        "docs_url": docs,
        "learning_content": learn,
    }


# What the operations named by the rules do here, and what they cost.
_FILL_COST = "One aggregate finds the value; filling is a column expression, so no row moves."
_DROP_COST = "A filter: the row ids of the kept rows stay, with gaps in the numbering."
_FILL_KEEPS = ["Row count and row ids stay", "The value is stored with the step and replayed"]
_DROP_KEEPS = ["Every remaining value was measured"]


def _learn(concept, why, math, mistakes, example):
    return {
        "concept": concept,
        "why_it_matters": why,
        "math_explanation": math,
        "common_mistakes": mistakes,
        "real_world_example": example,
    }


MISSING = [
    _rule(
        "missing_low_numerical", "missing_values", "low", "numerical", "missing_pct > 0 and missing_pct <= 5",
        "impute with median or drop_rows", _FILL_COST,
        _FILL_KEEPS, ["preview_imputation shows how far mean and deviation move"], ["impute: mean", "impute: drop_rows"], _NA,
    ),
    _rule(
        "missing_moderate_numerical", "missing_values", "medium", "numerical", "missing_pct > 5 and missing_pct <= 30",
        "impute with median", _FILL_COST,
        _FILL_KEEPS, ["The standard deviation of the column falls with every filled row"],
        ["impute: forward_fill where row order means time", "impute: mean"], _ML + "#imputer",
        _learn(
            "An exact median over partitions",
            "The fill value must be the same on every executor and in every replay, so it is computed once and recorded.",
            "A sketch brackets rank (n - 1) / 2, a count proves the bracket, and only the values inside it are sorted.",
            ["Replaying a fill on other data and expecting the recorded number: replay learns it anew",
             "Comparing correlations before and after without looking at the number of complete pairs"],
            "In the dirty events of the tests every eleventh value is missing; the fill gives each the median of the others.",
        ),
    ),
    _rule(
        "missing_high_numerical", "missing_values", "high", "numerical", "missing_pct > 30 and missing_pct <= 60",
        "compare_strategies before any impute", "Two summaries side by side cost three passes over one column.",
        ["The decision rests on this table's own figures"], ["No strategy here looks at other columns"],
        ["drop_column", "impute: median"], _ML + "#imputer",
    ),
    _rule(
        "missing_very_high_numerical", "missing_values", "high", "numerical", "missing_pct > 60", "drop_column",
        "Later scans no longer read the column at all, as Parquet stores columns apart.",
        ["The step can be undone: version 1 keeps the column"], ["Rules over pairs of columns lose this one"],
        ["impute: constant"], _NA,
    ),
    _rule(
        "missing_low_categorical", "missing_values", "low", "categorical", "missing_pct > 0 and missing_pct <= 5",
        "impute with mode or drop_rows", "The mode comes from one histogram, ties go to the smallest value.",
        _FILL_KEEPS, ["category_frequencies of the mode grows by the missing share"],
        ["impute: constant", "impute: drop_rows"], _NA,
    ),
    _rule(
        "missing_moderate_categorical", "missing_values", "medium", "categorical",
        "missing_pct > 5 and missing_pct <= 30",
        "impute with constant or mode", "A constant needs no pass over the data at all.",
        ["A constant can be found and undone later, a mode cannot"], ["label and one_hot encoding get one more code"],
        ["impute: forward_fill"], _NA,
    ),
    _rule(
        "missing_high_categorical", "missing_values", "high", "categorical", "missing_pct > 30",
        "impute with constant, or drop_column", "Cramér's V leaves rows with a gap out, a constant brings them back in.",
        ["Association measures see all rows"], ["The constant can become the most frequent value"], ["drop_column"], _NA,
    ),
    _rule(
        "missing_low_text", "missing_values", "low", "text", "missing_pct > 0 and missing_pct <= 5",
        "impute with constant or drop_rows", _DROP_COST,
        _DROP_KEEPS, ["text_size counts the words of a constant, too"], ["impute: mode"], _NA,
    ),
    _rule(
        "missing_moderate_text", "missing_values", "medium", "text", "missing_pct > 5 and missing_pct <= 50",
        "impute with constant, or drop_column", "text_size gives NULL for a missing text, which a constant would hide.",
        ["text_size before the fill keeps both facts"], ["Distinct counts grow by one"], ["impute: drop_rows"], _NA,
    ),
    _rule(
        "missing_high_text", "missing_values", "high", "text", "missing_pct > 50", "drop_column, after text_size if needed",
        "Texts are most of a table's bytes; without them every pass over full rows is shorter.",
        ["text_size leaves two small columns in its place"], ["parquet versions keep the old column until prune"],
        ["impute: constant"], _NA,
    ),
]

_STRIP = [
    "strip", "One projection inside the scan; values that differed in padding meet in the same group afterwards.",
    ["strip keeps row ids and row count"], ["A later replay on padded data repeats it"], ["change_case after it"], _FUNCTIONS,
]

QUALITY = [
    _rule("whitespace_issues", "data_quality", "low", "categorical", "has_whitespace == True", *_STRIP),
    _rule("whitespace_issues_text", "data_quality", "low", "text", "has_whitespace == True", *_STRIP),
    _rule(
        "case_inconsistency", "data_quality", "medium", "categorical", "has_case_inconsistency == True",
        "change_case to lower", "The histogram of the column holds the same letters under two keys.",
        ["categorical_profile then counts each value once"], ["The old spelling is only in version 1"],
        ["change_case to title", "encode: ordinal with an order that lists both spellings"], _FUNCTIONS,
    ),
    _rule(
        "constant_column", "data_quality", "high", "any", "is_constant == True", "drop_column",
        "Pearson, Kendall and Cramér's V are NULL beside it, and its entropy is 0.",
        ["Pairs of columns fall by one less than the number of columns"], ["drop_column does not look at later data"],
        ["type_override to id, which leaves the column out of the rules"], _SPARK,
    ),
    _rule(
        "low_variance_column", "data_quality", "medium", "any", "is_low_variance == True",
        "categorical_profile first, then drop_column if one value fills it", "The ratio of distinct values to rows is under the limit of this rule.",
        ["Its histogram has few rows, so every look at it is cheap"], ["The ratio falls as rows are added, whatever the values are"],
        ["bin with quantile", "encode: label"], _ML + "#variancethresholdselector",
    ),
    _rule(
        "duplicate_rows_present", "data_quality", "medium", "dataset",
        "duplicate_row_pct > 0 and duplicate_row_pct <= 10",
        "duplicate_preview, then remove_duplicate_rows", "Only rows whose 64-bit hash repeats are compared, so finding them is one narrow shuffle.",
        ["The smallest row id of each group stays, so a replay keeps the same rows"],
        ["Equal events that did happen twice cannot be told from copies"],
        ["remove_duplicate_rows with keep last"], _SPARK,
    ),
    _rule(
        "duplicate_rows_significant", "data_quality", "high", "dataset", "duplicate_row_pct > 10",
        "remove_duplicate_rows before any step that learns a statistic",
        "Quantiles, modes and powers learnt by later steps give each copy its own weight.",
        ["Every later pass reads at least a tenth less"], ["Steps recorded before it were learnt with the copies: replay them"],
        ["read_csv again, if part files were listed twice"], _SPARK,
    ),
    _rule(
        "duplicate_columns_present", "data_quality", "medium", "dataset", "duplicate_column_count > 0",
        "remove_duplicate_columns", "Fingerprints shortlist the pairs and one pass proves them.",
        ["The number of column pairs falls with its square"], ["Steps that name the removed column fail on replay"],
        ["drop_column, one by one"], _SPARK,
    ),
]

DATATYPES = [
    _rule(
        "object_to_datetime", "datatype", "medium", "text", "is_datetime_convertible == True", "convert_dtype to datetime",
        "Eight bytes a value instead of a text, with statistics that let Parquet skip row groups.",
        ["date_parts and elapsed accept the column"], ["preview_conversion counts the texts no layout reads; they become NULL"],
        ["text_size, if the texts are only looked at"], _FUNCTIONS,
    ),
    _rule(
        "object_to_datetime_categorical", "datatype", "medium", "categorical", "is_datetime_convertible == True",
        "convert_dtype to datetime", "The layouts are tried on each distinct text's rows alike, so few texts cost as much as many.",
        ["date_parts and elapsed accept the column"], ["categorical_profile no longer lists it"],
        ["type_override to categorical"], _FUNCTIONS,
    ),
    _rule(
        "float_to_int", "datatype", "low", "numerical", "is_int_convertible == True", "convert_dtype to integer",
        "Parquet packs whole numbers into the bits they need.",
        ["Sums are the same whatever the order of partitions"], ["A mean fill widens the column to double again"],
        ["scale, which needs doubles anyway"], _FUNCTIONS,
    ),
    _rule(
        "object_to_category", "datatype", "low", "categorical", "is_category_beneficial == True and count > 100",
        "convert_dtype to category", "A mark in the schema's metadata; the stored values do not change.",
        ["Types need not be detected again on the next version"], ["The mark is lost by tools that drop metadata"],
        ["type_override to categorical"], _ML + "#stringindexer",
    ),
]

DISTRIBUTION = [
    _rule(
        "high_positive_skew", "distribution", "medium", "numerical", "skewness > 1", "transform with log, or yeo_johnson from zero down",
        "log is one expression in the scan; the fitted powers take three or four scans first.",
        ["preview_transform gives the skewness after each of them in one call"], ["log refuses a column with a value of zero or less"],
        ["box_cox", "outlier_treatment with cap"], _FUNCTIONS,
    ),
    _rule(
        "moderate_positive_skew", "distribution", "low", "numerical", "skewness > 0.5 and skewness <= 1",
        "transform with sqrt", "No statistic is learnt, so a replay gives every row the same value.",
        ["Zero stays zero"], ["sqrt refuses a column with a negative value"], ["yeo_johnson", "bin with quantile"], _FUNCTIONS,
    ),
    _rule(
        "high_negative_skew", "distribution", "medium", "numerical", "skewness < -1", "transform with yeo_johnson",
        "Its power above 1 stretches the upper end; log and sqrt only pull that end in.",
        ["The fitted power is kept with the step"], ["Each replay learns a power of its own"], ["scale: robust"], _FUNCTIONS,
    ),
    _rule(
        "not_normally_distributed", "distribution", "low", "numerical", "skewness >= -0.5 and skewness <= 0.5",
        "transform with none; distribution_report for the rest", "The third moment is near zero, which profile already holds.",
        ["No pass over the data"], ["The report's Shapiro-Wilk value reads a sample of the column"], ["scale: standard"], _FUNCTIONS,
    ),
]

OUTLIERS = [
    _rule(
        "moderate_outliers", "outliers", "medium", "numerical", "outlier_pct > 1 and outlier_pct <= 5",
        "detect_outliers with iqr, then decide", "The fences are two exact quantiles, found without sorting the column.",
        ["detect_outliers lists row ids, so the flagged rows can be looked up"],
        ["The fences move when the step is replayed on other data"],
        ["method zscore", "method modified_zscore", "action cap"], _SPARK,
        _learn(
            "Fences from two quartiles",
            "One fence pair is broadcast to all partitions, so flagging is a filter that the scan can run.",
            "Lower fence q1 - 1.5 (q3 - q1), upper fence q3 + 1.5 (q3 - q1); equal quartiles flag whatever differs.",
            ["Treating twice: after a cap the quartiles are the same, so a second cap finds nothing",
             "Scaling with minmax first and reading the fences in the old unit"],
            "In the smaller events table of the tests 463 of 10,000 values lie outside the fences.",
        ),
    ),
    _rule(
        "significant_outliers", "outliers", "high", "numerical", "outlier_pct > 5",
        "histogram first, then outlier_treatment with iqr", "Thirty bins cost one pass and show whether the flagged values are one heap.",
        ["cap keeps row ids and row count", "remove shortens every later pass"],
        ["cap piles the flagged rows up on one value"],
        ["transform before outlier_treatment", "method modified_zscore"], _SPARK,
        _learn(
            "When the fence cuts a tail",
            "A treatment of this share changes the median of what follows, so steps after it learn other values.",
            "For an exponential column the upper fence lies at 4.8 % of the mass, whatever its rate.",
            ["Replaying remove before remove_duplicate_rows: copies of one outlier count several times in the quartiles",
             "Judging a health score that fell because rows went, not because values improved"],
            "Response times: store yeo_johnson and iqr in both orders and compare what detect_outliers counts.",
        ),
    ),
]

_PAIRS = [
    ["high_pairs lists both names and the value"], ["A pair joined by a third column shows up as three pairs"],
    ["scatter_sample of each pair", "drop_column"], _SPARK + "ml-statistics.html#correlation",
]

CORRELATION = [
    _rule(
        "multicollinearity_detected", "correlation", "medium", "dataset",
        "high_correlation_pair_count > 0 and high_correlation_pair_count <= 3",
        "high_pairs, then correlations with spearman", "Pearson of all columns is one scan without a shuffle; ranks confirm it or show one far value behind it.",
        *_PAIRS,
    ),
    _rule(
        "multicollinearity_significant", "correlation", "high", "dataset", "high_correlation_pair_count > 3",
        "correlation_matrix, then drop_column for the name that occurs most often", "Four pairs and more often share a column.",
        *_PAIRS,
    ),
]

ENCODING = [
    _rule(
        "encoding_low_cardinality", "encoding", "low", "categorical", "unique_count <= 10", "encode: one_hot",
        "Each value is one comparison in the scan, with no join.", ["Column names come from the values"],
        ["Values that first appear in later data get zeros everywhere"], ["encode: label", "encode: ordinal"], _ML + "#onehotencoder",
    ),
    _rule(
        "encoding_high_cardinality", "encoding", "medium", "categorical", "unique_count > 10 and unique_count <= 50",
        "encode: binary, or frequency", "Six columns hold up to 64 codes; a frequency is one.",
        ["The map of values has at most fifty rows and is broadcast"], ["frequency changes with every row that is added"],
        ["encode: one_hot with max_columns as a guard", "encode: label"], _ML,
    ),
    _rule(
        "encoding_very_high_cardinality", "encoding", "high", "categorical", "unique_count > 50",
        "detect_id and text_size before any encode", "Beyond fifty thousand values the map is joined by value, not broadcast.",
        ["If it is an id, nothing needs to be encoded"], ["unique_count alone does not tell an id from a long list"],
        ["encode: frequency", "type_override to text or id"], _ML,
    ),
    _rule(
        "encoding_multi_label", "encoding", "medium", "multi_label", "count > 0", "encode: multi_label",
        "The labels of all cells are counted map-side, then each is one test on the split cell.",
        ["multi_label_profile shows the labels beforehand"], ["The delimiter found is recorded; other data may use another"],
        ["text_size"], _ML,
    ),
]

FEATURES = [
    _rule(
        "fe_datetime_extraction", "feature_engineering", "low", "datetime", "count > 0", "date_parts",
        "All parts come out of one projection in the scan.", ["histogram of a part shows gaps in time"],
        ["Parts follow the session's time zone"], ["cyclic on a part"], _FUNCTIONS,
    ),
    _rule(
        "fe_age_calculation", "feature_engineering", "low", "datetime", "count > 0", "elapsed",
        "Counted up to the column's own maximum, so a replay does not depend on the clock.", ["correlations accept the result"],
        ["A later maximum moves every value"], ["date_parts with the year"], _FUNCTIONS,
    ),
    _rule(
        "fe_text_length", "feature_engineering", "low", "text", "count > 0", "text_size",
        "Characters and words are counted where the text is read; nothing is shuffled.", ["box plots of both find empty and pasted texts"],
        ["NULL texts stay NULL"], ["categorical_profile, if texts repeat"], _FUNCTIONS,
    ),
    _rule(
        "fe_binning_suggestion", "feature_engineering", "low", "numerical", "unique_count > 20", "bin",
        "Equal widths need two numbers, equal counts exact quantiles; both are learnt once.",
        ["cramers_v then accepts the column"], ["One far value can take all but one of ten equal widths"], ["histogram, to choose the method"], _ML + "#bucketizer",
    ),
    _rule(
        "fe_cyclic_encoding", "feature_engineering", "low", "numerical",
        "minimum >= 0 and maximum <= 31 and unique_count <= 31 and unique_count > 5",
        "cyclic with the period the values have", "The range fits hours, weekdays, days of the month and months.",
        ["Two expressions, nothing learnt"], ["The period is a parameter, not found from the data"], ["encode: one_hot"], _FUNCTIONS,
    ),
]

SCALING = [
    _rule(
        "scaling_normal_no_outliers", "scaling", "low", "numerical",
        "skewness >= -0.5 and skewness <= 0.5 and outlier_pct <= 1",
        "scale: standard", "Both of its numbers are map-side sums of one pass.",
        ["The step keeps mean and deviation, so it can be undone by arithmetic"], ["A column without spread is left at 0"],
        ["scale: minmax"], _ML + "#standardscaler",
    ),
    _rule(
        "scaling_outliers_present", "scaling", "medium", "numerical", "outlier_pct > 1", "scale: robust",
        "Three exact quantiles of one sketch and one count; flagged rows only change their ranks.",
        ["A later outlier_treatment with iqr flags the same rows"], ["Equal quartiles leave nothing to divide by"],
        ["outlier_treatment with cap, then scale: standard"], _ML + "#robustscaler",
    ),
    _rule(
        "scaling_bounded_range_needed", "scaling", "low", "numerical",
        "minimum >= 0 and outlier_pct <= 1 and skewness > 0.5",
        "scale: minmax", "Minimum and maximum can come from the Parquet footers.",
        ["Zero and the largest value are the ends of the result"], ["Later rows can fall outside the ends"], ["transform with sqrt first"], _ML + "#minmaxscaler",
    ),
]

# In file order of the topics: correlation, datatypes, distribution, duplicates, encoding, features, missing,
# outliers, quality, scaling.
BUILT_IN = (
    CORRELATION
    + DATATYPES
    + DISTRIBUTION
    + [r for r in QUALITY if r["applies_to"] == "dataset"]
    + ENCODING
    + FEATURES
    + MISSING
    + OUTLIERS
    + [r for r in QUALITY if r["applies_to"] != "dataset"]
    + SCALING
)
