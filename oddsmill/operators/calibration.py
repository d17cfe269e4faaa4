"""Calibration of probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import chi2_tail, clip_probability, logit, sigmoid
from .stability import quantile_edges, with_quantile_bin


def _known(df: DataFrame, label: str, p: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(p).isNotNull())


def brier_and_log_loss(df: DataFrame, label: str, p: str, by: list[str] | None = None) -> DataFrame:
    y, q = F.col(label), clip_probability(F.col(p), 2.220446049250313e-16)
    return _known(df, label, p).groupBy(*(by or [])).agg(F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), (-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"))


def equal_bins(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration_curve(df: DataFrame, label: str, p: str, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """bin, n, mean_p, rate of the bins that hold rows."""
    known = _known(df, label, p)
    if strategy == "uniform":
        binned = known.withColumn("bin", equal_bins(F.col(p), bins))
    else:
        binned = with_quantile_bin(known, quantile_edges(known, p, bins), p)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate"))


def calibration_errors(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """ece (weighted by rows) and mce over bins of equal width."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return calibration_curve(df, label, p, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def hosmer_lemeshow_statistic(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """statistic and df over bins of equal width, both classes."""
    c = calibration_curve(df, label, p, bins)
    n, e1 = F.col("n"), F.col("n") * F.col("mean_p")
    o1, e0 = n * F.col("rate"), n - n * F.col("mean_p")
    term = F.when(e1 > 0, (o1 - e1) * (o1 - e1) / e1).otherwise(0.0) + F.when(e0 > 0, (o1 - e1) * (o1 - e1) / e0).otherwise(0.0)
    return c.agg(F.sum(term).alias("statistic"), F.greatest(F.count(F.lit(1)) - 2, F.lit(1)).alias("df"))


def hosmer_lemeshow(df: DataFrame, label: str, p: str, bins: int = 10) -> dict:
    row = hosmer_lemeshow_statistic(df, label, p, bins).first()
    tail = chi2_tail(row["statistic"], row["df"])
    return {"statistic": row["statistic"], "df": row["df"], "p_value": tail, "calibrated": tail > 0.05}


def slope_intercept(df: DataFrame, label: str, p: str, rounds: int = 25) -> tuple[float, float]:
    """Unpenalised logistic fit of the label on logit(p), by Newton steps of five sums each.

    Rows are summed by distinct p first, so every step reads the histogram.
    """
    hist = _known(df, label, p).groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("e")).select(logit(F.col(p), 1e-15).alias("z"), "n", "e").cache()
    a, b = 0.0, 1.0
    for _ in range(rounds):
        q = sigmoid(F.lit(a) + F.lit(b) * F.col("z"))
        w, r = F.col("n") * q * (1 - q), F.col("e") - F.col("n") * q
        s = hist.agg(F.sum(w), F.sum(w * F.col("z")), F.sum(w * F.col("z") * F.col("z")), F.sum(r), F.sum(r * F.col("z"))).first()
        det = s[0] * s[2] - s[1] * s[1]
        if not det:
            break
        da, db = (s[2] * s[3] - s[1] * s[4]) / det, (s[0] * s[4] - s[1] * s[3]) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-12:
            break
    hist.unpersist()
    return b, a


def intercept_shift(df: DataFrame, p: str, target: float, low: float = -5.0, high: float = 5.0, rounds: int = 60) -> float:
    """The shift of logit(p) at which the mean probability is ``target``; the nearest end if it lies beyond.

    The mean rises with the shift: Newton steps of three sums over distinct p, halving the range where a step would leave it.
    """
    hist = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("n")).select(logit(F.col(p)).alias("z"), "n").cache()
    shift = 0.0
    for _ in range(rounds):
        q = sigmoid(F.col("z") + F.lit(shift))
        n, mean, slope = hist.agg(F.sum("n"), F.sum(F.col("n") * q), F.sum(F.col("n") * q * (1 - q))).first()
        if not n:
            break
        gap = mean / n - target
        low, high = (low, shift) if gap > 0 else (shift, high)
        step = gap / (slope / n) if slope else math.inf
        after = shift - step if low <= shift - step <= high else (low + high) / 2
        moved, shift = abs(after - shift), after
        if moved < 1e-12:
            break
    hist.unpersist()
    return shift


def shifted(p: Column, shift: float) -> Column:
    return sigmoid(logit(p) + F.lit(shift))


def score_of(p: Column, pdo: float = 20, base_score: float = 600, base_odds: float = 50) -> Column:
    """Points: ``pdo`` more double the odds (1 - p) / p of being good."""
    factor = pdo / math.log(2)
    offset = base_score - factor * math.log(base_odds)
    return F.lit(offset) - F.lit(factor) * logit(p)


def probability_of(score: Column, pdo: float = 20, base_score: float = 600, base_odds: float = 50) -> Column:
    factor = pdo / math.log(2)
    offset = base_score - factor * math.log(base_odds)
    return sigmoid((F.lit(offset) - score) / F.lit(factor))


def score_bands(spark, n_bands: int = 10, low: float = 500, high: float = 700, **scale) -> DataFrame:
    """band, lower, upper, mid, odds, default_probability of ``n_bands`` equal bands, edges cut to whole points."""
    width = (high - low) / n_bands
    bands = spark.range(n_bands).select(F.col("id").cast("int").alias("band"), F.floor(low + F.col("id") * width).alias("lower"), F.floor(low + (F.col("id") + 1) * width).alias("upper"))
    mid = (F.col("lower") + F.col("upper")) / 2
    p = probability_of(mid, **scale)
    return bands.select("*", mid.alias("mid"), ((1 - p) / p).alias("odds"), p.alias("default_probability"))
