"""Cumulative sums over an ordered key, without a window over the whole table.

Rows are summed by distinct key first.  Keys fall into buckets of equal width
between their bounds; bucket totals are summed over the buckets, and each
bucket is summed by itself.  No task holds more than a bucket.  Far outliers
make the other values share few buckets; their distinct values are then sorted
by few tasks, which spill.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 2048


def _same(by: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by), F.lit(True))


def cumulative(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    by: list[str] | None = None,
    low: float | None = 0.0,
    high: float | None = 1.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per (by, distinct key): each sum and ``<name>_below``, its total over smaller keys of the same ``by``.

    NULL keys are left out.  Bounds None are taken from the data.
    """
    by = by or []
    grouped = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if low is None or high is None:
        ends = grouped.groupBy(*by).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        if by:
            ends = ends.select(*[F.col(c).alias(f"_e_{c}") for c in by], "_lo", "_hi")
            grouped = grouped.join(ends, _same(by, "_e_")).drop(*[f"_e_{c}" for c in by])
        else:
            grouped = grouped.crossJoin(F.broadcast(ends))  # one row
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        lo, hi = F.lit(low), F.lit(high)
    place = F.when(hi > lo, F.floor((F.col(key) - lo) / (hi - lo) * buckets)).otherwise(F.lit(0))
    placed = grouped.withColumn("_b", F.greatest(F.least(place, F.lit(buckets - 1)), F.lit(0)).cast("int")).drop("_lo", "_hi")
    totals = placed.groupBy(*by, "_b").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    across = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_b"]], *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_base_{n}") for n in sums])
    on = (F.col("_b") == F.col("_k__b")) & _same(by, "_k_")
    inside = Window.partitionBy(*by, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(bases, on)
    below = [(F.col(f"_base_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below") for n in sums]
    return joined.select(*by, key, *sums, *below)


def roc(df: DataFrame, label: str, p: str, weight: str | None = None, by: list[str] | None = None, **bounds) -> DataFrame:
    """Per distinct p (and ``by``): pos, neg, their sums below, and totals ``all_pos`` and ``all_neg`` attached."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    known = df.where(y.isNotNull())
    curve = cumulative(known, p, {"pos": w * y, "neg": w * (1 - y)}, by, **bounds)
    by = by or []
    totals = known.where(F.col(p).isNotNull()).groupBy(*by).agg(F.sum(w * y).alias("all_pos"), F.sum(w * (1 - y)).alias("all_neg"))
    if not by:
        return curve.crossJoin(F.broadcast(totals))  # one row
    renamed = totals.select(*[F.col(c).alias(f"_{c}") for c in by], "all_pos", "all_neg")
    return curve.join(renamed, _same(by, "_")).drop(*[f"_{c}" for c in by])


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None, out: str = "q", weight: str | None = None) -> DataFrame:
    """One row per ``by`` with array ``out``: exact quantiles, interpolated between neighbours; ``weight`` counts rows.

    The built-in exact percentile holds all values of a group in one task;
    here each rank is looked up on the cumulative curve of distinct values.
    """
    by = by or []
    times = F.col(weight) if weight else F.lit(1)
    curve = cumulative(df, column, {"n": times}, by, low=None, high=None)
    totals = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.sum(times).alias("_all"))
    if by:
        totals = totals.select(*[F.col(c).alias(f"_t_{c}") for c in by], "_all")
        ranked = curve.join(totals, _same(by, "_t_")).drop(*[f"_t_{c}" for c in by])
    else:
        ranked = curve.crossJoin(F.broadcast(totals))  # one row
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    place = F.transform(wanted, lambda s: (F.col("_all") - 1) * s)
    first, last = F.col("n_below"), F.col("n_below") + F.col("n") - 1
    # shares whose lower or upper neighbour is this value; most values have none
    hits = F.filter(
        F.transform(place, lambda h, i: F.struct(i.alias("i"), h.alias("h"), F.floor(h).between(first, last).alias("lo"), F.ceil(h).between(first, last).alias("hi"))),
        lambda x: x["lo"] | x["hi"],
    )
    found = ranked.select(*by, F.col(column).cast("double").alias("_v"), F.explode(hits).alias("_x"))
    low, high = F.max(F.when(F.col("_x.lo"), F.col("_v"))), F.max(F.when(F.col("_x.hi"), F.col("_v")))
    h = F.max("_x.h")
    each = found.groupBy(*by, F.col("_x.i").alias("_i")).agg((low + (h - F.floor(h)) * (high - low)).alias("_q"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias(out))  # one value a share
