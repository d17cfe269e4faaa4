"""Population and characteristic stability, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_of_array, equal_width_bin, ks_pvalue, ks_tail, psi_status, psi_term
from .curves import cumulative, quantiles

#: What an empty share counts as.  Fixed value.
FLOOR = 1e-4


def shares(df: DataFrame, key: str, side: str) -> DataFrame:
    """Share of rows by key, NULL keys included."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select(F.col(key), (F.col("_n") / F.col("_all")).alias(side))  # one row


def psi_breakdown(expected: DataFrame, actual: DataFrame, key: str, floor: float = FLOOR) -> DataFrame:
    """key, expected, actual, psi by category; a category that one side lacks counts as ``floor``."""
    a = shares(actual, key, "actual").withColumnRenamed(key, "_key")
    both = shares(expected, key, "expected").join(a, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    share = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(floor)).otherwise(F.col(c))
    out = both.select(F.coalesce(F.col(key), F.col("_key")).alias(key), share("expected").alias("expected"), share("actual").alias("actual"))
    return out.withColumn("psi", psi_term(F.col("actual"), F.col("expected")))


def psi(expected: DataFrame, actual: DataFrame, key: str, floor: float = FLOOR) -> DataFrame:
    """psi and status in one row."""
    out = psi_breakdown(expected, actual, key, floor).agg(F.sum("psi").alias("psi"))
    return out.withColumn("status", psi_status(F.col("psi")))


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: the distinct inner quantiles, ascending."""
    inner = [k / bins for k in range(1, bins)]
    return quantiles(df, column, inner).select(F.array_sort(F.array_distinct("q")).alias("_edges"))


def with_quantile_bin(df: DataFrame, edges: DataFrame, column: str, out: str = "bin") -> DataFrame:
    """Bins (lo, hi] of ``edges`` (one row); NULL stays NULL."""
    return df.crossJoin(F.broadcast(edges)).withColumn(out, bin_of_array(F.col(column), F.col("_edges"))).drop("_edges")


def psi_numeric(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10, method: str = "quantile", keep_outside: bool = True) -> DataFrame:
    """PSI of a numeric column over bins of the expected side.

    ``quantile`` bins are open to both ends; with ``keep_outside`` false rows
    beyond the expected range are left out; ``width`` bins are equal in width.
    """
    e, a = (d.where(F.col(column).isNotNull()).select(column) for d in (expected, actual))
    if method == "width" or not keep_outside:
        ends = e.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        if not keep_outside:
            a = a.crossJoin(F.broadcast(ends)).where(F.col(column).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # one row
    if method == "width":
        place = lambda d: d.crossJoin(F.broadcast(ends)).select(equal_width_bin(F.col(column), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
        return psi(place(e), place(a), "bin")
    edges = quantile_edges(e, column, bins)
    return psi(with_quantile_bin(e, edges, column).select("bin"), with_quantile_bin(a, edges, column).select("bin"), "bin")


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value): one row a column and row, so that all features share one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.feature", "p.value")


def both_sides(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, ne, na): how often each side has each value, from which edges, shares, gaps and means all follow."""
    side = lambda d, e: unpivoted(d, columns).where("value is not null").select("feature", "value", F.lit(e).alias("e"))
    both = side(expected, 1).unionByName(side(actual, 0))
    return both.groupBy("feature", "value").agg(F.sum("e").alias("ne"), F.sum(1 - F.col("e")).alias("na"))


def _psi_of(h: DataFrame, bins: int) -> DataFrame:
    """feature, psi, and the mean of each side, by quantiles of the expected side."""
    inner = [k / bins for k in range(1, bins)]
    edges = quantiles(h.where("ne > 0"), "value", inner, ["feature"], weight="ne").select(F.col("feature").alias("_f"), F.array_sort(F.array_distinct("q")).alias("_edges"))
    # what is broadcast is a row of edges a column
    binned = h.join(F.broadcast(edges), F.col("feature") == F.col("_f")).withColumn("bin", bin_of_array(F.col("value"), F.col("_edges")))
    total = lambda c: F.sum(F.col("value") * F.col(c))
    n = binned.groupBy("feature", "bin").agg(F.sum("ne").alias("e"), F.sum("na").alias("a"), total("ne").alias("se"), total("na").alias("sa"))
    whole = n.groupBy("feature").agg(F.sum("e").alias("E"), F.sum("a").alias("A"), F.sum("se").alias("SE"), F.sum("sa").alias("SA"), F.collect_list(F.struct("e", "a")).alias("cells"))  # a cell a bin
    share = lambda c, t: F.when(c > 0, c / t).otherwise(F.lit(FLOOR))
    terms = F.transform("cells", lambda c: psi_term(share(c["a"], F.col("A")), share(c["e"], F.col("E"))))
    return whole.select("feature", F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("psi"), (F.col("SE") / F.col("E")).alias("mean_expected"), F.when(F.col("A") > 0, F.col("SA") / F.col("A")).alias("mean_actual"))


def psi_all(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """feature, psi, status of numeric columns by quantiles of the expected side, in one job."""
    return _psi_of(both_sides(expected, actual, columns), bins).select("feature", "psi", psi_status(F.col("psi")).alias("status"))


def csi(expected: DataFrame, actual: DataFrame, segment: str, label: str) -> DataFrame:
    """segment, both event rates and csi; a rate of zero or a missing segment counts as the floor."""
    rate = lambda d, n: d.groupBy(segment).agg(F.avg(label).alias(n))
    a = rate(actual, "actual").withColumnRenamed(segment, "_segment")
    both = rate(expected, "expected").join(a, F.col(segment).eqNullSafe(F.col("_segment")), "full_outer")
    share = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(FLOOR)).otherwise(F.col(c))
    out = both.select(F.coalesce(F.col(segment), F.col("_segment")).alias(segment), share("expected").alias("expected"), share("actual").alias("actual"))
    return out.withColumn("csi", psi_term(F.col("actual"), F.col("expected")))


def ks_two_samples(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """ks, n_expected, n_actual: the greatest gap between the two distribution functions."""
    both = expected.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("e")).unionByName(actual.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("e")))
    both = both.where("v is not null")
    curve = cumulative(both, "v", {"ne": F.col("e"), "na": 1 - F.col("e")}, low=None, high=None)
    totals = both.agg(F.sum("e").alias("E"), F.sum(1 - F.col("e")).alias("A"))
    gap = F.abs((F.col("ne_below") + F.col("ne")) / F.col("E") - (F.col("na_below") + F.col("na")) / F.col("A"))
    return curve.crossJoin(F.broadcast(totals)).agg(F.max(gap).alias("ks"), F.max("E").alias("n_expected"), F.max("A").alias("n_actual"))  # one row


def _ks_of(h: DataFrame) -> DataFrame:
    curve = cumulative(h, "value", {"ne": F.col("ne"), "na": F.col("na")}, ["feature"], low=None, high=None)
    totals = h.groupBy(F.col("feature").alias("_f")).agg(F.sum("ne").alias("E"), F.sum("na").alias("A"))
    gap = F.abs((F.col("ne_below") + F.col("ne")) / F.col("E") - (F.col("na_below") + F.col("na")) / F.col("A"))
    out = curve.join(F.broadcast(totals), F.col("feature") == F.col("_f"))  # a row a column
    out = out.groupBy("feature").agg(F.max(gap).alias("ks"), F.max("E").alias("n_expected"), F.max("A").alias("n_actual"))
    return out.select("feature", "ks", ks_pvalue(F.col("ks"), F.col("n_expected"), F.col("n_actual")).alias("ks_pvalue"), "n_expected", "n_actual")


def ks_by_feature(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """feature, ks, ks_pvalue, n_expected, n_actual of numeric columns in one job."""
    return _ks_of(both_sides(expected, actual, columns))


def ks_test(expected: DataFrame, actual: DataFrame, column: str) -> dict:
    row = ks_two_samples(expected, actual, column).first()
    tail = ks_tail(row["ks"], row["n_expected"], row["n_actual"])
    return {"ks": row["ks"], "p_value": tail, "significant": tail < 0.05}


def reference_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std, min, max, median, q25, q75."""
    long = unpivoted(df, columns)
    q = quantiles(long, "value", [0.25, 0.5, 0.75], ["feature"])
    plain = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return plain.join(q, "feature", "left").select("feature", "mean", "std", "min", "max", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str], limit: float = 0.1) -> DataFrame:
    """feature, psi, ks, ks_pvalue, level, mean_change_pct: stable below the limit, warning below 2.5 limits, else critical."""
    h = both_sides(reference, current, columns)
    gaps = _ks_of(h).select(F.col("feature").alias("_f"), "ks", "ks_pvalue")
    joined = _psi_of(h, 10).join(F.broadcast(gaps), F.col("feature") == F.col("_f"))  # a row a column
    level = F.when(F.col("psi") < limit, "stable").when(F.col("psi") < 2.5 * limit, "warning").otherwise("critical")
    change = F.when(F.col("mean_expected") != 0, (F.col("mean_actual") - F.col("mean_expected")) / F.col("mean_expected") * 100)
    return joined.select("feature", "psi", "ks", "ks_pvalue", level.alias("level"), change.alias("mean_change_pct"))


def overall_level(report: DataFrame) -> DataFrame:
    """n_features by level and the worst level, in one row."""
    count = lambda x: F.count_if(F.col("level") == x)
    worst = F.when(count("critical") > 0, "critical").when(count("warning") > 0, "warning").otherwise("stable")
    return report.agg(F.count(F.lit(1)).alias("n_features"), count("critical").alias("critical"), count("warning").alias("warning"), count("stable").alias("stable"), worst.alias("overall"))
