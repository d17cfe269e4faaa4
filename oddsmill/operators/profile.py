"""Data profiles: one job for all columns, long tables out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import chi2_tail, t_two_sided
from .curves import quantiles
from .stability import unpivoted


def numeric_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in leave_out]


def validation(df: DataFrame, columns: list[str] | None = None, weight: str | None = None, most_missing: float = 0.2, fail_missing: float = 0.5) -> DataFrame:
    """feature, missing_rate, n_unique, zero_variance, min, max, mean, std, p01, p99, status (PASS, WARN, FAIL)."""
    columns = columns or numeric_columns(df)
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p"), w.alias("_w")).select("p.feature", "p.value", "_w")
    out = long.groupBy("feature").agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("missing_rate"),
        F.count_distinct("value").alias("n_unique"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    ends = quantiles(long, "value", [0.01, 0.99], ["feature"])
    out = out.join(ends, "feature", "left").select("feature", "missing_rate", "n_unique", "min", "max", "mean", "std", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p99"))
    zero = F.col("n_unique") <= 1
    status = F.when((F.col("missing_rate") > fail_missing) | zero, "FAIL").when(F.col("missing_rate") > most_missing, "WARN").otherwise("PASS")
    return out.withColumn("zero_variance", zero).withColumn("status", status)


def univariate_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, missing, n_unique, mean, std, min, q25, median, q75, max, skewness, kurtosis (both bias-corrected)."""
    n = F.count("value").cast("double")
    skew = F.when((n > 2) & (F.var_pop("value") > 0), F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & (F.var_pop("value") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("value") + 6))
    long = unpivoted(df, columns)
    plain = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_distinct("value").alias("n_unique"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), skew.alias("skewness"), kurt.alias("kurtosis"),
    )
    q = quantiles(long, "value", [0.25, 0.5, 0.75], ["feature"])
    quarters = [F.col("q")[i].alias(name) for i, name in enumerate(("q25", "median", "q75"))]
    return plain.join(q, "feature", "left").select("feature", "n", "missing", "n_unique", "mean", "std", "min", *quarters, "max", "skewness", "kurtosis")


def univariate_categorical(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """feature, rank, value, n, share: the ``top`` values of each column, ties by value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    n = df.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.value").agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy(F.col("feature").alias("_f")).agg(F.sum("n").alias("_all"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), F.asc_nulls_last("value")))).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("feature") == F.col("_f")).select("feature", "rank", "value", "n", (F.col("n") / F.col("_all")).alias("share"))


def event_rates(df: DataFrame, column: str, label: str) -> DataFrame:
    """value, n, events, event_rate, NULL value included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(label).alias("n"), F.sum(label).alias("events"), F.avg(label).alias("event_rate"))


def bivariate_numeric(df: DataFrame, columns: list[str], label: str, least: int = 10) -> DataFrame:
    """feature, n, correlation, mean_0, mean_1, mean_difference, t (pooled), df; features with too few rows are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p"), F.col(label).cast("double").alias("y")).select("p.feature", "p.value", "y").where("value is not null and y is not null")
    of = lambda k: F.when(F.col("y") == k, F.col("value"))
    g = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.corr("value", "y").alias("correlation"), F.avg(of(0)).alias("mean_0"), F.avg(of(1)).alias("mean_1"),
        F.count(of(0)).alias("_n0"), F.count(of(1)).alias("_n1"), F.var_samp(of(0)).alias("_v0"), F.var_samp(of(1)).alias("_v1"),
    ).where(F.col("n") >= least)
    pooled = ((F.col("_n0") - 1) * F.col("_v0") + (F.col("_n1") - 1) * F.col("_v1")) / (F.col("n") - 2)
    t = F.when(pooled > 0, (F.col("mean_1") - F.col("mean_0")) / F.sqrt(pooled * (1 / F.col("_n0") + 1 / F.col("_n1"))))
    return g.select("feature", "n", "correlation", "mean_0", "mean_1", (F.col("mean_1") - F.col("mean_0")).alias("mean_difference"), t.alias("t"), (F.col("n") - 2).alias("df"))


def with_p_values(table: DataFrame) -> list[dict]:
    """Rows of ``bivariate_numeric`` (one a feature) with the two-sided p of t, strongest correlation first."""
    rows = [r.asDict() for r in table.collect()]
    for r in rows:
        r["p_value"] = None if r["t"] is None else t_two_sided(r["t"], r["df"])
    return sorted(rows, key=lambda r: (-abs(r["correlation"] or 0), r["feature"]))


def chi_squared(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, n, statistic, df, cramers_v of categorical columns against the label; 2 x 2 tables get Yates' correction."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    cells = df.select(F.explode(pairs).alias("p"), F.col(label).alias("y")).where("y is not null and p.value is not null").groupBy("p.feature", "p.value", "y").agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("feature", "y").agg(F.sum("o").alias("c"))
    shape = rows.groupBy("feature").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("n_rows")).join(cols.groupBy("feature").agg(F.count(F.lit(1)).alias("n_cols")), "feature")
    full = rows.join(cols, "feature").join(shape, "feature").join(cells, ["feature", "value", "y"], "left")  # table of values x classes
    e = F.col("r") * F.col("c") / F.col("n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    yates = F.when((F.col("n_rows") == 2) & (F.col("n_cols") == 2), F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))).otherwise(gap)
    out = full.groupBy("feature").agg(F.max("n").alias("n"), F.sum(yates * yates / e).alias("statistic"), ((F.max("n_rows") - 1) * (F.max("n_cols") - 1)).alias("df"), (F.least(F.max("n_rows"), F.max("n_cols")) - 1).alias("_k"))
    return out.withColumn("cramers_v", F.when(F.col("_k") > 0, F.sqrt(F.col("statistic") / (F.col("n") * F.col("_k"))))).drop("_k")


def chi_squared_p(statistic: float, df: int) -> float:
    return chi2_tail(statistic, df) if df else math.nan


def correlated_pairs(df: DataFrame, columns: list[str], limit: float = 0.9) -> DataFrame:
    """a, b, correlation of all pairs of the stated columns at or over the limit, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(entries).alias("e")).select("e.*").where(F.abs("correlation") >= limit)


def key_skew(df: DataFrame, key: str) -> DataFrame:
    """n_keys, most, mean, skew_ratio of rows by key, in one row."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("most"), F.avg("n").alias("mean"), (F.max("n") / F.avg("n")).alias("skew_ratio"))


def salted_sums(df: DataFrame, key: str, value: str, salts: int = 8, salt_by: str | None = None) -> DataFrame:
    """key, n, total by two aggregations, the first over (key, salt); the salt is a hash of the row, so reruns agree."""
    salt = F.pmod(F.xxhash64(salt_by or value), F.lit(salts))
    first = df.groupBy(key, salt.alias("_salt")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_t"))
    return first.groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_t").alias("total"))


def data_hash(df: DataFrame) -> DataFrame:
    """rows and an order-insensitive hash of all of them, in one row."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"))
