"""Monitoring of scores and performance by batch, alerts as an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classification import metrics
from .curves import quantiles
from .ranking import auc_table


def batch_performance(df: DataFrame, batch: str, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    """batch, n_samples, n_positive, n_predicted_positive, actual_rate, predicted_rate, precision, recall, f1, auc."""
    m = metrics(df, label, p, threshold, by=[batch])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    cells = m.select(
        F.col(batch), n.cast("long").alias("n_samples"), (F.col("tp") + F.col("fn")).cast("long").alias("n_positive"), (F.col("tp") + F.col("fp")).cast("long").alias("n_predicted_positive"),
        F.col("prevalence").alias("actual_rate"), F.col("detection_prevalence").alias("predicted_rate"), "precision", "recall", "f1",
    )
    area = auc_table(df, label, p, by=[batch]).select(F.col(batch).alias("_b"), "auc")
    return cells.join(area, F.col(batch).eqNullSafe(F.col("_b")), "left").drop("_b")


#: Relative fall from the baseline that raises an alert.  Fixed values.
LIMITS = {"auc": 0.05, "precision": 0.1, "recall": 0.1, "f1": 0.1}


def health(current: DataFrame, baseline: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """metric, baseline, current, fall, level (ok, alert, critical over two limits) from two one-row tables."""
    limits = limits or LIMITS
    both = current.select(*[F.col(m).alias(f"c_{m}") for m in limits]).crossJoin(baseline.select(*[F.col(m).alias(f"b_{m}") for m in limits]))  # one row each
    entry = lambda m, x: F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("baseline"), F.col(f"c_{m}").alias("current"), F.lit(float(x)).alias("limit"))
    out = both.select(F.explode(F.array(*[entry(m, x) for m, x in limits.items()])).alias("e")).select("e.*")
    out = out.withColumn("fall", F.when(F.col("baseline") != 0, (F.col("baseline") - F.col("current")) / F.col("baseline")))
    return out.withColumn("level", F.when(F.col("fall") > 2 * F.col("limit"), "critical").when(F.col("fall") > F.col("limit"), "alert").otherwise("ok"))


def prediction_statistics(df: DataFrame, score: str, by: list[str] | None = None, low: float = 300, high: float = 850) -> DataFrame:
    """n, mean, median, std (population), min, max, q25, q75, out_of_range, out_of_range_pct."""
    by = by or []
    out = F.count_if((F.col(score) < low) | (F.col(score) > high))
    plain = df.groupBy(*by).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"),
        out.alias("out_of_range"), (100 * out / F.count(score)).alias("out_of_range_pct"),
    )
    q = quantiles(df, score, [0.25, 0.5, 0.75], by)
    joined = _beside(plain, q, by)
    return joined.select(*by, "n", "mean", F.col("q")[1].alias("median"), "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "out_of_range", "out_of_range_pct")


def _beside(plain: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """Statistics with the quantiles of the same groups."""
    if not by:
        return plain.join(q, F.lit(True), "left")  # one row each
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return plain.join(q.select(*[F.col(c).alias(f"_q_{c}") for c in by], "q"), on, "left")


def anomalies(df: DataFrame, score: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles by ``threshold`` ranges, or beyond ``threshold`` population deviations of the mean."""
    if method == "iqr":
        a, b = F.col("q")[0], F.col("q")[1]
        bounds = quantiles(df, score, [0.25, 0.75]).select((a - threshold * (b - a)).alias("_lo"), (b + threshold * (b - a)).alias("_hi"))
    elif method == "zscore":
        bounds = df.agg((F.avg(score) - threshold * F.stddev_pop(score)).alias("_lo"), (F.avg(score) + threshold * F.stddev_pop(score)).alias("_hi"))
    else:
        raise ValueError(f"unknown method: {method}")
    return df.crossJoin(F.broadcast(bounds)).where((F.col(score) < F.col("_lo")) | (F.col(score) > F.col("_hi"))).drop("_lo", "_hi")  # one row


def alert_id(*columns: str):
    return F.substring(F.md5(F.concat_ws("|", *columns)), 1, 12)


def alert_state(events: DataFrame, key: str = "alert_id", time: str = "ts") -> DataFrame:
    """Each alert as its latest event left it."""
    rest = [c for c in events.columns if c != key]
    latest = events.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("e"))
    return latest.select(key, "e.*")


def alert_summary(state: DataFrame, severity: str = "severity", status: str = "status") -> DataFrame:
    """severity, n, n_active."""
    return state.groupBy(severity).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == "active").alias("n_active"))


def histogram_metrics(df: DataFrame, name: str, value: str) -> DataFrame:
    """name, count, sum, mean, median, min, max, p50, p95, p99: counters, gauges and timers alike."""
    plain = df.groupBy(name).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    joined = _beside(plain, quantiles(df, value, [0.5, 0.95, 0.99], [name]), [name])
    q = F.col("q")
    return joined.select(name, "count", "sum", "mean", q[0].alias("median"), "min", "max", q[0].alias("p50"), q[1].alias("p95"), q[2].alias("p99"))


def prometheus(histograms: DataFrame, name: str, prefix: str = "oddsmill") -> DataFrame:
    """One text line per series: count, sum and quantiles."""
    label = F.concat(F.lit('{name="'), F.col(name), F.lit('"}'))
    quantile = lambda q, c: F.concat(F.lit(f'{prefix}_value{{name="'), F.col(name), F.lit(f'",quantile="{q}"}} '), F.round(c, 6).cast("string"))
    lines = F.array(F.concat(F.lit(f"{prefix}_count"), label, F.lit(" "), F.col("count").cast("string")), quantile("0.5", "p50"), quantile("0.95", "p95"), quantile("0.99", "p99"))
    return histograms.select(F.explode(lines).alias("line"))


# Alerts are a log of events; what an alert is follows from its latest event.

ALERT_EVENT = "alert_id string, ts timestamp, severity string, status string, title string, source string, notes string"
SEVERITIES = ("info", "warning", "critical")


def created(alerts: DataFrame) -> DataFrame:
    """Events that open alerts, from (ts, severity, title, source); the id follows from them."""
    known = F.col("severity").isin(*SEVERITIES)
    return alerts.select(
        alert_id("ts", "title", "source").alias("alert_id"), "ts", F.when(known, F.col("severity")).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce("severity", F.lit("null"))))).alias("severity"),
        F.lit("active").alias("status"), "title", "source", F.lit(None).cast("string").alias("notes"),
    )


def changed(log: DataFrame, alert: str, status: str, when: str, notes: str | None = None) -> DataFrame:
    """The event that sets an alert to ``acknowledged`` or ``resolved``; none where the alert is unknown or resolved already."""
    if status not in ("acknowledged", "resolved"):
        raise ValueError(f"unknown status: {status}")
    now = alert_state(log).where((F.col("alert_id") == alert) & (F.col("status") != "resolved"))
    return now.select("alert_id", F.lit(when).cast("timestamp").alias("ts"), "severity", F.lit(status).alias("status"), "title", "source", F.lit(notes).cast("string").alias("notes"))


def active_alerts(log: DataFrame, severity: str | None = None) -> DataFrame:
    """Alerts that nobody has resolved, worst and latest first."""
    state = alert_state(log).where("status <> 'resolved'")
    if severity:
        state = state.where(F.col("severity") == severity)
    return state.orderBy(F.array_position(F.array(*map(F.lit, reversed(SEVERITIES))), F.col("severity")), F.desc("ts"), "alert_id")


# Counters only grow and are summed; of a gauge the latest value counts.


def counters(samples: DataFrame, name: str, value: str, labels: list[str] | None = None) -> DataFrame:
    """name, labels, total."""
    labels = labels or []
    grows = F.when(F.col(value) >= 0, F.col(value)).otherwise(F.raise_error(F.lit("a counter does not fall")))
    return samples.where(F.col(value).isNotNull()).groupBy(name, *labels).agg(F.sum(grows).alias("total"))


def gauges(samples: DataFrame, name: str, value: str, time: str, labels: list[str] | None = None) -> DataFrame:
    """name, labels, value: the latest one, the greatest of those of one moment."""
    labels = labels or []
    latest = F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    return samples.where(F.col(value).isNotNull()).groupBy(name, *labels).agg(latest.alias("_m")).select(name, *labels, F.col("_m.v").alias("value"))


def exposition(table: DataFrame, kind: str, name: str, value: str, labels: list[str] | None = None, prefix: str = "oddsmill") -> DataFrame:
    """Lines of the text format of counters or gauges: one a series."""
    pairs = [F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in [name, *(labels or [])]]
    return table.select(F.concat(F.lit(f"{prefix}_{kind}{{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))


#: Metrics that a scoring service reports, with their kinds and units.  Fixed values.
STANDARD_METRICS = {
    "predictions_total": ("counter", "predictions"), "prediction_latency": ("histogram", "milliseconds"), "prediction_errors": ("counter", "errors"),
    "model_auc": ("gauge", "score"), "feature_drift_psi": ("gauge", "psi"), "approval_rate": ("gauge", "ratio"),
}


def drift_history(reports: DataFrame, time: str = "ts") -> DataFrame:
    """One row a report: its time, and its features by level."""
    level = lambda x: F.count_if(F.col("level") == x).alias(x)
    return reports.groupBy(time).agg(F.count(F.lit(1)).alias("n_features"), level("critical"), level("warning"), level("stable"))
