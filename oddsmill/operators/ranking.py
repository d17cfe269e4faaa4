"""Ranking metrics from the cumulative curve of distinct probabilities.

Rows that tie in probability share ranks: where a cut falls inside a tie, its
positives are taken in proportion.  All metrics take ``by`` for one result a
group and ``weight`` for compressed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import roc


def _tpr_fpr() -> tuple[Column, Column]:
    """Rates when the cut is p >= this key."""
    return (F.col("all_pos") - F.col("pos_below")) / F.col("all_pos"), (F.col("all_neg") - F.col("neg_below")) / F.col("all_neg")


def auc_table(df: DataFrame, label: str, p: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """auc, gini, accuracy_ratio; NULL when a class is missing."""
    curve = roc(df, label, p, weight, by)
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / (F.max("all_pos") * F.max("all_neg"))
    out = curve.groupBy(*(by or [])).agg(F.when(F.max("all_pos") * F.max("all_neg") > 0, area).alias("auc"))
    return out.withColumn("gini", 2 * F.col("auc") - 1).withColumn("accuracy_ratio", F.col("gini"))


def ks_table(df: DataFrame, label: str, p: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """ks, threshold, tpr, fpr at the greatest tpr - fpr (of equals, the greatest threshold)."""
    tpr, fpr = _tpr_fpr()
    points = roc(df, label, p, weight, by).withColumn("tpr", tpr).withColumn("fpr", fpr)
    best = points.groupBy(*(by or [])).agg(F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("ks"), F.col(p).alias("threshold"), "tpr", "fpr")).alias("b"))
    return best.select(*(by or []), "b.*")


def roc_points(df: DataFrame, label: str, p: str, weight: str | None = None) -> DataFrame:
    """threshold, tpr, fpr for every distinct p."""
    tpr, fpr = _tpr_fpr()
    return roc(df, label, p, weight).select(F.col(p).alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"))


def _cut_rows(df: DataFrame, values: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(values, "bin int, share double")


def lift_at(df: DataFrame, label: str, p: str, shares: tuple[float, ...] = (0.1, 0.2)) -> DataFrame:
    """share, top_n, captured, lift: rate among the top int(n * share) rows over the base rate (0 if that is 0)."""
    curve = roc(df, label, p)
    cuts = _cut_rows(df, [(i, float(s)) for i, s in enumerate(shares)])
    n = F.col("all_pos") + F.col("all_neg")
    top = F.greatest(F.floor(n * F.col("share")), F.lit(1))
    out = _top_by_share(curve, cuts, lambda: top)
    rate = F.when(F.col("all_pos") > 0, F.col("captured") / F.col("top_n") / (F.col("all_pos") / n)).otherwise(F.lit(0.0))
    return out.select("share", "top_n", "captured", rate.alias("lift"))


def _top_by_share(curve: DataFrame, cuts: DataFrame, top) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    above = F.col("all_pos") + F.col("all_neg") - F.col("pos_below") - F.col("neg_below") - n
    joined = curve.crossJoin(F.broadcast(cuts)).withColumn("top_n", top())  # cuts is a list of fixed length
    share = F.least(F.greatest((F.col("top_n") - above) / n, F.lit(0.0)), F.lit(1.0))
    return joined.groupBy("bin", "share", "top_n").agg(F.sum(share * F.col("pos")).alias("captured"), F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg"))


def gains_curve(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """bin 1..bins: rows in the best bin * (n // bins), positives among them, and both as shares of all."""
    curve = roc(df, label, p)
    cuts = _cut_rows(df, [(i, i / bins) for i in range(1, bins + 1)])
    n = F.col("all_pos") + F.col("all_neg")
    out = _top_by_share(curve, cuts, lambda: F.least(F.col("bin") * F.floor(n / bins), n))
    return out.select("bin", "top_n", "captured", (F.col("top_n") / n).alias("population"), (F.col("captured") / F.col("all_pos")).alias("gain"))


def lift_curve(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """bin 1..bins of n // bins rows, best first (the last takes the remainder): rows, positives, rate, lift."""
    curve = roc(df, label, p)
    cuts = _cut_rows(df, [(i, i / bins) for i in range(0, bins + 1)])
    n = F.col("all_pos") + F.col("all_neg")
    ends = _top_by_share(curve, cuts, lambda: F.when(F.col("bin") == bins, n).otherwise(F.col("bin") * F.floor(n / bins)))
    before = ends.select((F.col("bin") + 1).alias("bin"), F.col("top_n").alias("_n"), F.col("captured").alias("_c"))
    rows, pos = F.col("top_n") - F.col("_n"), F.col("captured") - F.col("_c")
    rate = F.when(rows > 0, pos / rows)
    return ends.join(before, "bin").select("bin", rows.alias("rows"), pos.alias("positives"), rate.alias("rate"), (rate / (F.col("all_pos") / n)).alias("lift"))


def cap_curve(df: DataFrame, label: str, p: str) -> DataFrame:
    """population and captured shares after each distinct p from the top, with the origin."""
    curve = roc(df, label, p)
    n = F.col("all_pos") + F.col("all_neg")
    points = curve.select(((n - F.col("pos_below") - F.col("neg_below")) / n).alias("population"), ((F.col("all_pos") - F.col("pos_below")) / F.col("all_pos")).alias("captured"))
    return points.unionByName(df.sparkSession.createDataFrame([(0.0, 0.0)], "population double, captured double"))


def h_measure(df: DataFrame, label: str, p: str, cost_ratio: float = 1.0) -> DataFrame:
    """1 - least cost over the trivial rule's cost, 0 at least; a cut p >= t costs cost_ratio * FP + FN, the rule min(cost_ratio * P, N)."""
    cost = F.lit(cost_ratio) * (F.col("all_neg") - F.col("neg_below")) + F.col("pos_below")
    trivial = F.least(F.lit(cost_ratio) * F.max("all_pos"), F.max("all_neg"))
    least = F.min(cost)
    return roc(df, label, p).agg(F.when(trivial > 0, F.greatest(1 - least / trivial, F.lit(0.0))).otherwise(F.lit(0.0)).alias("h_measure"))


def ranking_summary(df: DataFrame, label: str, p: str) -> DataFrame:
    """auc, gini, ks, ks_threshold, lift_10, lift_20, h_measure, accuracy_ratio in one row."""
    lifts = lift_at(df, label, p).agg(F.max(F.when(F.col("share") == 0.1, F.col("lift"))).alias("lift_10"), F.max(F.when(F.col("share") == 0.2, F.col("lift"))).alias("lift_20"))
    ks = ks_table(df, label, p).select("ks", F.col("threshold").alias("ks_threshold"))
    return auc_table(df, label, p).crossJoin(ks).crossJoin(lifts).crossJoin(h_measure(df, label, p))  # one row each


def best_youden(df: DataFrame, label: str, p: str) -> DataFrame:
    return ks_table(df, label, p).select("threshold", F.col("ks").alias("score"))
