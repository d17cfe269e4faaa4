"""Categorical encoders.  NULL is a category of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def frequencies(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """(category, share): weighted share of rows."""
    w = F.col(weight) if weight else F.lit(1)
    n = df.groupBy(_category(column).alias("category")).agg(F.sum(w).alias("_w"))
    total = n.agg(F.sum("_w").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("category", (F.col("_w") / F.col("_all")).alias("share"))  # one row


def target_means(df: DataFrame, column: str, target: str, smoothing: float = 1.0, least: float = 1, weight: str | None = None) -> DataFrame:
    """(category, n, value): (n * mean + s * global) / (n + s); the global mean below ``least`` rows."""
    w = F.when(F.col(target).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    g = df.groupBy(_category(column).alias("category")).agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("n"), F.coalesce(F.sum(w * F.col(target)), F.lit(0.0)).alias("_s"))
    total = g.agg((F.sum("_s") / F.sum("n")).alias("_mean"))
    value = F.when(F.col("n") >= least, (F.col("_s") + smoothing * F.col("_mean")) / (F.col("n") + smoothing)).otherwise(F.col("_mean"))
    return g.crossJoin(F.broadcast(total)).select("category", "n", value.alias("value"))  # one row


def rare_map(df: DataFrame, column: str, threshold: float, name: str = "RARE", weight: str | None = None) -> DataFrame:
    """(category, label): categories whose share is below the threshold are named ``name``."""
    return frequencies(df, column, weight).select("category", F.when(F.col("share") < threshold, name).otherwise(F.col("category")).alias("label"))


def apply_map(df: DataFrame, column: str, mapping: DataFrame, value: str, out: str, unseen=None) -> DataFrame:
    """Join a mapping fitted before; categories it lacks get ``unseen``."""
    m = mapping.select(F.col("category").alias("_c"), F.col(value).alias("_v"))
    joined = df.withColumn("_key", _category(column)).join(m, F.col("_key") == F.col("_c"), "left")
    filled = F.col("_v") if unseen is None else F.coalesce("_v", F.lit(unseen))
    return joined.withColumn(out, filled).drop("_key", "_c", "_v")


def frequency_encoded(df: DataFrame, column: str, out: str | None = None, weight: str | None = None) -> DataFrame:
    return apply_map(df, column, frequencies(df, column, weight), "share", out or f"{column}_freq", 0.0)


def target_encoded(df: DataFrame, column: str, target: str, out: str | None = None, **how) -> DataFrame:
    return apply_map(df, column, target_means(df, column, target, **how), "value", out or f"{column}_target")


def rare_grouped(df: DataFrame, column: str, threshold: float, name: str = "RARE", out: str | None = None) -> DataFrame:
    return apply_map(df, column, rare_map(df, column, threshold, name), "label", out or f"{column}_grouped", name)


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column for each of the stated categories; other values have all zero."""
    return df.select("*", *[(_category(column) == c).cast("int").alias(f"{column}_{c}") for c in categories])


def mapping_json(mapping: DataFrame, value: str) -> DataFrame:
    """One row: the mapping as a JSON object."""
    entries = F.array_sort(F.collect_list(F.struct("category", value)))
    return mapping.agg(F.to_json(F.map_from_entries(entries)).alias("json"))
