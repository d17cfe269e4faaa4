"""Compression of binned rows to weighted groups, and what undoes or checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CompressionError(ValueError):
    """Counts or events of the compressed rows differ from the original's."""


def compress(df: DataFrame, keys: list[str], label: str, segments: list[str] | None = None) -> DataFrame:
    """keys, segments, sample_weight, event_weight, event_rate: every group of equal bins as one row."""
    out = df.groupBy(*keys, *(segments or [])).agg(F.count(F.lit(1)).alias("sample_weight"), F.coalesce(F.sum(label), F.lit(0)).cast("double").alias("event_weight"))
    return out.withColumn("event_rate", F.col("event_weight") / F.col("sample_weight"))


def verification(df: DataFrame, compressed: DataFrame, label: str) -> DataFrame:
    """One row: rows and events of both sides, compression ratio, per cent saved, whether they agree."""
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(label), F.lit(0)).cast("double").alias("events"))
    b = compressed.agg(F.coalesce(F.sum("sample_weight"), F.lit(0)).alias("weight"), F.coalesce(F.sum("event_weight"), F.lit(0.0)).alias("event_weight"), F.count(F.lit(1)).alias("groups"))
    ok = (F.col("rows") == F.col("weight")) & (F.col("events") == F.col("event_weight"))
    saved = F.when(F.col("rows") > 0, 100 * (1 - F.col("groups") / F.col("rows")))
    return a.crossJoin(b).select("*", (F.col("rows") / F.nullif(F.col("groups"), F.lit(0))).alias("ratio"), saved.alias("saved_pct"), ok.alias("exact"))  # one row each


def verify(df: DataFrame, compressed: DataFrame, label: str) -> None:
    row = verification(df, compressed, label).first()
    if not row["exact"]:
        raise CompressionError(f"rows {row['rows']} and {row['weight']}, events {row['events']} and {row['event_weight']}")


def weighted_labels(compressed: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Two weighted rows a group, label 1 and 0: a model fitted on them has the likelihood of the original rows."""
    pair = F.array(F.struct(F.lit(1).alias("y"), F.col("event_weight").alias("w")), F.struct(F.lit(0).alias("y"), (F.col("sample_weight") - F.col("event_weight")).alias("w")))
    out = compressed.withColumn("_p", F.explode(pair)).where("_p.w > 0")
    return out.withColumn(label, F.col("_p.y")).withColumn(weight, F.col("_p.w").cast("double")).drop("_p")


def expand(compressed: DataFrame, label: str = "label") -> DataFrame:
    """As many rows as the weights say, event_weight of them with label 1."""
    rows = compressed.where("sample_weight > 0").withColumn("_i", F.explode(F.expr("sequence(1L, cast(sample_weight as bigint))")))
    return rows.withColumn(label, (F.col("_i") <= F.col("event_weight")).cast("int")).drop("_i", "sample_weight", "event_weight", "event_rate")


def sufficient_histogram(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, value, n, events): what exploration needs of every column, in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p"), F.col(label).alias("_y"))
    return long.groupBy("p.feature", "p.value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("events"))


def hybrid(df: DataFrame, key: str, label: str, top: int = 10, tail: str = "OTHER") -> DataFrame:
    """Groups of the ``top`` most frequent keys (ties by key); all other keys are one group named ``tail``."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("events"))
    first = n.orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(top).select(F.col(key).alias("_k"), F.lit(True).alias("_top"))
    named = n.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("_k")), "left")  # at most ``top`` rows
    return named.groupBy(F.when(F.col("_top"), F.col(key).cast("string")).otherwise(F.lit(tail)).alias(key)).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
