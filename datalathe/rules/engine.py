"""Rules as Spark SQL predicates over facts, and what follows from them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F

from datalathe.functions.kinds import ROW_ID
from datalathe.functions.scalars import round_py
from datalathe.rules.catalog import BUILT_IN
from datalathe.rules.facts import COLUMN_FACTS, DATASET_FACTS, Facts, collect_facts

WHOLE_DATASET = "(entire dataset)"

RULE_SCHEMA = (
    "position int, rule_id string, category string, severity string, applies_to string, condition string, "
    "recommendation string, reason string, advantages array<string>, disadvantages array<string>, "
    "alternatives array<string>, docs_url string, learning_content struct<concept:string,why_it_matters:string,"
    "math_explanation:string,common_mistakes:array<string>,real_world_example:string>"
)

# Penalties of the health score.
SEVERITY_WEIGHTS = {"high": 5.0, "medium": 2.0, "low": 0.5}
MISSING_WEIGHT, MISSING_CAP = 0.5, 25.0
DUPLICATE_WEIGHT, DUPLICATE_CAP = 0.3, 15.0
RECOMMENDATION_CAP = 40.0


def read_rules(path: str) -> list[dict]:
    """Rules from one JSON or YAML file, or from all such files of a folder in name order."""
    p = Path(path)
    files = sorted(f for f in p.iterdir() if f.suffix in (".json", ".yaml", ".yml")) if p.is_dir() else [p]
    rules: list[dict] = []
    for f in files:
        if f.suffix == ".json":
            loaded = json.loads(f.read_text(encoding="utf-8"))
        else:
            import yaml  # optional dependency, only for YAML files

            loaded = yaml.safe_load(f.read_text(encoding="utf-8"))
        rules.extend(loaded or [])
    return rules


def usable_rules(spark: SparkSession, rules: list[dict] | None = None) -> list[dict]:
    """Rules whose condition resolves against the facts; one id counts once, the first wins.

    All conditions are analysed together; only when that fails is each tried alone.
    """
    seen: dict[str, dict] = {}
    for r in BUILT_IN if rules is None else rules:
        if r["id"] in seen:
            # A repeated id adds only the learning content its first entry lacks.
            if not seen[r["id"]].get("learning_content"):
                seen[r["id"]] = {**seen[r["id"]], "learning_content": r.get("learning_content")}
            continue
        seen[r["id"]] = r
    empty = {
        True: spark.createDataFrame([], DATASET_FACTS),
        False: spark.createDataFrame([], COLUMN_FACTS),
    }

    def resolves(group: list[dict], on_dataset: bool) -> bool:
        try:
            empty[on_dataset].select(*[F.expr(f"boolean({r['condition']})") for r in group]).schema
        except (AnalysisException, ParseException):
            return False
        return True

    kept = []
    for on_dataset in (True, False):
        group = [r for r in seen.values() if (r["applies_to"] == "dataset") == on_dataset]
        kept += group if resolves(group, on_dataset) else [r for r in group if resolves([r], on_dataset)]
    order = list(seen)
    return sorted(kept, key=lambda r: order.index(r["id"]))


def rules_frame(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """The usable rules as a DataFrame, in the order they are tried."""
    return _frame(spark, usable_rules(spark, rules))


def _frame(spark: SparkSession, usable: list[dict]) -> DataFrame:
    rows = []
    for i, r in enumerate(usable):
        learn = r.get("learning_content")
        learn = learn and tuple(
            learn.get(k)
            for k in ("concept", "why_it_matters", "math_explanation", "common_mistakes", "real_world_example")
        )
        rows.append(
            (
                i, r["id"], r["category"], r["severity"], r["applies_to"], r["condition"], r["recommendation"],
                r["reason"], r.get("advantages") or [], r.get("disadvantages") or [], r.get("alternatives") or [],
                r.get("docs_url"), learn,
            )
        )
    return spark.createDataFrame(rows, RULE_SCHEMA)


def evaluate(facts: DataFrame, rules: list[dict], on_dataset: bool, numbers: dict[str, int]) -> DataFrame:
    """``(position, column, rule_position)`` of every rule that holds, in one projection."""
    tests = []
    for r in rules:
        if (r["applies_to"] == "dataset") != on_dataset:
            continue
        holds = F.expr(f"boolean({r['condition']})")
        if not on_dataset and r["applies_to"] != "any":
            holds = holds & (F.col("effective_type") == r["applies_to"])
        tests.append(F.when(holds, F.lit(numbers[r["id"]])))
    if on_dataset:
        facts = facts.withColumn("position", F.lit(2**31 - 1)).withColumn("column", F.lit(WHOLE_DATASET))
    return facts.select("position", "column", F.explode(F.array_compact(F.array(*tests))).alias("rule_position"))


def recommendations_from(facts: Facts, rules: list[dict] | None = None) -> DataFrame:
    spark = facts.df.sparkSession
    usable = usable_rules(spark, rules)
    numbers = {r["id"]: i for i, r in enumerate(usable)}
    matched = evaluate(facts.column_frame(), usable, False, numbers)
    if facts.dataset_row is not None:
        matched = matched.unionByName(evaluate(facts.dataset_frame(), usable, True, numbers))
    catalog = _frame(spark, usable).withColumnRenamed("position", "rule_position")
    # The rule catalog has one row per rule file entry.
    return (
        matched.join(F.broadcast(catalog), "rule_position")
        .orderBy("position", "rule_position")
        .select(
            "rule_id", "category", "severity", "column", "recommendation", "reason", "advantages", "disadvantages",
            "alternatives", "docs_url", "learning_content",
        )
    )


def recommendations(
    df: DataFrame, overrides: dict[str, str] | None = None, row_id: str | None = ROW_ID, rules: list[dict] | None = None
) -> DataFrame:
    """All recommendations for a DataFrame: column rules first, in column order, then dataset rules."""
    return recommendations_from(collect_facts(df, overrides, row_id), rules)


def health_from(facts: Facts, recs: list) -> dict:
    """Score from 100 downwards with the penalty of each factor."""
    cells = facts.rows * len(facts.columns)
    missing = sum(p["missing_count"] for p in facts.profiles.values())
    missing_pct = missing / cells * 100 if cells else 0.0
    duplicate_pct = facts.dataset_row[1] / facts.rows * 100 if facts.rows else 0.0
    severities = {s: sum(1 for r in recs if r["severity"] == s) for s in SEVERITY_WEIGHTS}
    penalty_of_recs = min(sum(severities[s] * w for s, w in SEVERITY_WEIGHTS.items()), RECOMMENDATION_CAP)
    factors = [
        ("Missing data", min(missing_pct * MISSING_WEIGHT, MISSING_CAP), f"missing_count={missing} cells={cells}"),
        (
            "Duplicate rows",
            min(duplicate_pct * DUPLICATE_WEIGHT, DUPLICATE_CAP),
            f"repeated_rows={facts.dataset_row[1]} rows={facts.rows}",
        ),
        (
            "Active recommendations",
            penalty_of_recs,
            " ".join(f"{s}={n}" for s, n in severities.items()),
        ),
    ]
    score = 100.0 - sum(p for _, p, _ in factors)
    return {
        "score": max(0.0, round_py(score, 1)),
        "breakdown": [
            {"factor": f, "penalty": round_py(p, 1), "detail": d} for f, p, d in factors if p > 0
        ],
        "total_recommendations": len(recs),
        "high_severity_count": severities["high"],
    }


def health_score(df: DataFrame, overrides=None, row_id: str | None = ROW_ID, rules=None) -> dict:
    facts = collect_facts(df, overrides, row_id)
    return health_from(facts, recommendations_from(facts, rules).select("severity").collect())
