"""Whole tasks as single calls with plain arguments and results, for schedulers and agents; ``SCHEMAS`` describes them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import binning, evaluation, models, scorecard
from .sources import io


def _numeric(df: DataFrame, label: str) -> list[str]:
    return [c for c, t in df.dtypes if c != label and (t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]


def score_predict(spark: SparkSession, data_path: str, card_path: str, output_path: str) -> dict:
    """Score a table with a card and write it."""
    card = scorecard.Scorecard.from_spec(Path(card_path).read_text(encoding="utf-8"))
    scored = card.score(io.read(spark, data_path))
    io.write(scored, output_path, mode="overwrite")
    row = io.read(spark, output_path).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max")).first()
    return {"rows": row["n"], "mean_score": row["mean"], "min_score": row["min"], "max_score": row["max"], "output_path": output_path}


def model_evaluate(spark: SparkSession, data_path: str, card_path: str, target_col: str) -> dict:
    """All metrics of a card on a table with outcomes."""
    card = scorecard.Scorecard.from_spec(Path(card_path).read_text(encoding="utf-8"))
    report = evaluation.evaluation_report(card.score(io.read(spark, data_path)), target_col, "p")
    return {r["metric"]: r["value"] for r in report.collect()}


def feature_select(spark: SparkSession, data_path: str, target_col: str, max_features: int = 10) -> dict:
    """The features of most correlation with the outcome."""
    df = io.read(spark, data_path)
    found = models.correlation_importance(df, _numeric(df, target_col), target_col).where("importance is not null").orderBy(F.desc("importance"), "feature").limit(max_features).collect()
    return {"selected": [r["feature"] for r in found], "importance": {r["feature"]: r["importance"] for r in found}}


def binning_analyze(spark: SparkSession, data_path: str, target_col: str, feature: str, max_bins: int = 5) -> dict:
    """Optimal bins of one feature with their weights of evidence and information value."""
    df = io.read(spark, data_path)
    found = binning.auto_bins(df, [feature], target_col, most=max_bins, least_iv=0.0).orderBy("lo").collect()
    return {"feature": feature, "iv": found[0]["iv"] if found else 0.0, "bins": [{k: r[k] for k in ("lo", "hi", "n", "events", "event_rate", "woe")} for r in found]}


def _schema(description: str, required: dict[str, str], optional: dict[str, tuple[str, int]] | None = None) -> dict:
    properties = {k: {"type": "string", "description": v} for k, v in required.items()} | {k: {"type": "integer", "description": v, "default": d} for k, (v, d) in (optional or {}).items()}
    return {"description": description, "parameters": {"type": "object", "properties": properties, "required": list(required)}}


TOOLS = {f.__name__: f for f in (score_predict, model_evaluate, feature_select, binning_analyze)}
SCHEMAS = {
    "score_predict": _schema("Score a table with a card", {"data_path": "table to score", "card_path": "card as JSON", "output_path": "where to write"}),
    "model_evaluate": _schema("Metrics of a card", {"data_path": "table with outcomes", "card_path": "card as JSON", "target_col": "column of outcomes"}),
    "feature_select": _schema("Features by correlation", {"data_path": "table with outcomes", "target_col": "column of outcomes"}, {"max_features": ("most features", 10)}),
    "binning_analyze": _schema("Bins of a feature", {"data_path": "table with outcomes", "target_col": "column of outcomes", "feature": "column to bin"}, {"max_bins": ("most bins", 5)}),
}


def call(spark: SparkSession, name: str, arguments: dict) -> dict:
    """One call by name; arguments are held against the schema first."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    known = SCHEMAS[name]["parameters"]
    wrong = [f"missing: {k}" for k in known["required"] if k not in arguments] + [f"unknown: {k}" for k in arguments if k not in known["properties"]]
    if wrong:
        raise ValueError("; ".join(wrong))
    return TOOLS[name](spark, **arguments)
