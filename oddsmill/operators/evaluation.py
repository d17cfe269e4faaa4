"""All metrics of a score as one long table, with grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import label as named
from .calibration import brier_and_log_loss, calibration_errors
from .classification import metrics
from .ranking import auc_table, h_measure, ks_table

# Least values of the grades, best first; for errors, greatest values.
GRADES = {
    "auc": ((0.9, "excellent"), (0.8, "good"), (0.7, "fair"), (0.6, "poor")),
    "gini": ((0.6, "strong"), (0.4, "moderate"), (0.2, "weak")),
    "ks": ((0.4, "strong"), (0.3, "moderate"), (0.2, "weak")),
}
BRIER = ([(0.1, "good"), (0.2, "fair")], "poor")


def grade(metric: Column, value: Column) -> Column:
    out = F.when(metric == "brier", named(value, *BRIER))
    for name, steps in GRADES.items():
        one = F.when(value >= steps[0][0], steps[0][1])
        for least, word in steps[1:]:
            one = one.when(value >= least, word)
        out = out.when(metric == name, one.otherwise("very poor"))
    return out


def evaluation_report(df: DataFrame, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    """metric, value, grade of ranking, classification and calibration metrics."""
    parts = [
        (auc_table(df, label, p), ["auc", "gini"]), (ks_table(df, label, p), ["ks"]), (h_measure(df, label, p), ["h_measure"]),
        (metrics(df, label, p, threshold), ["accuracy", "precision", "recall", "f1", "mcc"]),
        (brier_and_log_loss(df, label, p), ["brier", "log_loss"]), (calibration_errors(df, label, p), ["ece", "mce"]),
    ]
    long = None
    for table, names in parts:
        one = table.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("e")).select("e.*")
        long = one if long is None else long.unionByName(one)
    return long.withColumn("grade", grade(F.col("metric"), F.col("value")))


def compare_models(df: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """model, auc, gini, ks, brier: one row a score column."""
    out = None
    for s in scores:
        one = auc_table(df, label, s).select("auc", "gini").crossJoin(ks_table(df, label, s).select("ks")).crossJoin(brier_and_log_loss(df, label, s).select("brier"))  # one row each
        one = one.select(F.lit(s).alias("model"), "auc", "gini", "ks", "brier")
        out = one if out is None else out.unionByName(one)
    return out
