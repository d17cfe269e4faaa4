"""What a plan will cost and what a run took."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

#: Bytes a partition should hold, and the most partitions asked for.
PARTITION_BYTES, MOST_PARTITIONS = 128 << 20, 100_000


def session(name: str = "oddsmill", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skewed joins split, UTC."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return builder.config(map=fixed | {k: str(v) for k, v in conf.items()}).getOrCreate()


def partitions_for(size: int) -> int:
    return max(1, min(MOST_PARTITIONS, -(-size // PARTITION_BYTES)))


def facts(df: DataFrame) -> dict[str, int]:
    """Counts of what matters in the physical plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    kinds = {"exchanges": r"(?<!Broadcast)Exchange ", "broadcasts": r"BroadcastExchange", "sorts": r"\bSort\b", "python": r"Python|Pandas|Arrow", "cartesian": r"CartesianProduct", "scans": r"FileScan"}
    return {name: len(re.findall(pattern, text)) for name, pattern in kinds.items()}


def hints(df: DataFrame, seconds: float | None = None) -> list[str]:
    """Words on what may hold a plan back."""
    f, out = facts(df), []
    if f["cartesian"]:
        out.append("a cartesian product")
    if f["exchanges"] > 20:
        out.append("more than 20 exchanges")
    if f["python"]:
        out.append("Python in the plan")
    if seconds is not None and seconds > 300:
        out.append("more than 300 seconds")
    return out


def timed(df: DataFrame) -> float:
    """Seconds to compute all rows, keeping none."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
