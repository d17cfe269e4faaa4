"""Bins and scores by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import psi_term, wilson
from .curves import roc
from .stability import FLOOR


def bin_drift(df: DataFrame, snapshot: str, key: str, label: str) -> DataFrame:
    """snapshot, bin, n, events, event_rate, share, ci_low, ci_high."""
    g = df.groupBy(snapshot, key).agg(F.count(label).alias("n"), F.sum(label).alias("events"))
    lo, hi = wilson(F.col("events"), F.col("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(snapshot))
    return g.select(snapshot, key, "n", "events", (F.col("events") / F.col("n")).alias("event_rate"), share.alias("share"), lo.alias("ci_low"), hi.alias("ci_high"))


def bin_delta(df: DataFrame, snapshot: str, key: str, label: str, baseline=None) -> DataFrame:
    """snapshot, bin, rate_delta, share_delta against the baseline (the first snapshot if None), for bins in both."""
    d = bin_drift(df, snapshot, key, label)
    if baseline is None:
        first = d.agg(F.min(snapshot).alias("_first"))
        base = d.crossJoin(F.broadcast(first)).where(F.col(snapshot) == F.col("_first"))  # one row
    else:
        base = d.where(F.col(snapshot) == baseline)
    b = base.select(F.col(key).alias("_k"), F.col("event_rate").alias("_r"), F.col("share").alias("_s"))
    return d.join(b, F.col(key).eqNullSafe(F.col("_k"))).select(snapshot, key, (F.col("event_rate") - F.col("_r")).alias("rate_delta"), (F.col("share") - F.col("_s")).alias("share_delta"))


def psi_by_snapshot(df: DataFrame, snapshot: str, key: str, baseline) -> DataFrame:
    """snapshot, psi against the baseline snapshot."""
    g = df.groupBy(snapshot, key).agg(F.count(F.lit(1)).alias("n"))
    s = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(snapshot))).select(snapshot, key, "share")
    base = s.where(F.col(snapshot) == baseline).select(F.col(key).alias("_k"), F.col("share").alias("_e"))
    grid = s.select(snapshot).distinct().crossJoin(g.select(key).distinct())  # snapshots x bins, both short lists
    sides = grid.join(s.select(F.col(snapshot).alias("_s"), F.col(key).alias("_sk"), "share"), F.col(snapshot).eqNullSafe(F.col("_s")) & F.col(key).eqNullSafe(F.col("_sk")), "left")
    both = sides.join(base, F.col(key).eqNullSafe(F.col("_k")), "left").where("share is not null or _e is not null")
    term = psi_term(F.coalesce("share", F.lit(FLOOR)), F.coalesce("_e", F.lit(FLOOR)))
    return both.groupBy(snapshot).agg(F.sum(term).alias("psi"))


def stability_by_snapshot(df: DataFrame, snapshot: str, score: str, label: str, threshold: float) -> DataFrame:
    """snapshot, n, approval_rate (score >= threshold), bad_rate, capture_10, capture_20 (bads among the lowest scores)."""
    plain = df.groupBy(snapshot).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) >= threshold).cast("int")).alias("approval_rate"), F.avg(label).alias("bad_rate"))
    curve = roc(df, label, score, by=[snapshot], low=None, high=None)
    n, below = F.col("pos") + F.col("neg"), F.col("pos_below") + F.col("neg_below")

    def captured(parts: int):
        top = F.greatest(F.floor((F.col("all_pos") + F.col("all_neg")) / parts), F.lit(1))
        share = F.least(F.greatest((top - below) / n, F.lit(0.0)), F.lit(1.0))
        return F.when(F.max("all_pos") > 0, F.sum(share * F.col("pos")) / F.max("all_pos"))

    caught = curve.groupBy(F.col(snapshot).alias("_s")).agg(captured(10).alias("capture_10"), captured(5).alias("capture_20"))
    return plain.join(caught, F.col(snapshot).eqNullSafe(F.col("_s")), "left").drop("_s")


def ks_by_snapshot(df: DataFrame, snapshot: str, score: str, label: str) -> DataFrame:
    """snapshot, ks: the greatest lead of the bads over the goods from the lowest score up."""
    curve = roc(df, label, score, by=[snapshot], low=None, high=None)
    lead = (F.col("pos_below") + F.col("pos")) / F.col("all_pos") - (F.col("neg_below") + F.col("neg")) / F.col("all_neg")
    return curve.groupBy(snapshot).agg(F.greatest(F.max(lead), F.lit(0.0)).alias("ks"))


def score_histogram(df: DataFrame, score: str, label: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by,) bin, n, goods, bads over bins of equal width; scores beyond the ends are in the outer bins."""
    place = F.floor((F.col(score) - low) / ((high - low) / bins))
    cell = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(*(by or []), cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(label)).alias("goods"), F.sum(label).alias("bads"))
