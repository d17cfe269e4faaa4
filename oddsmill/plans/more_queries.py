"""Registered queries of logs, alerts, counters, thresholds, cuts and reports, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning, classification, governance, monitoring, ranking, stability, temporal
from ..sources import reports
from .queries import APPS, SQL, _drift_sql, _fine, _quantile_bins_sql, _sides, apps, query, rounded, table

# --- thresholds ------------------------------------------------------------------------------------


def _threshold_sql(score: str) -> str:
    return SQL["optimal_threshold_f1"].replace("CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END", score).replace("DESC, threshold", "DESC NULLS LAST, threshold")


@query(SQL["ks_statistic"].replace("round(tpr - fpr, 6) AS ks, p AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr", "p AS threshold, round(tpr - fpr, 6) AS score"))
def optimal_threshold_youden(spark, sf_dir):
    return rounded(ranking.best_youden(apps(spark, sf_dir), "y", "p"))


@query(_threshold_sql("CASE WHEN tp + fp = 0 THEN NULL ELSE tp / CAST(tp + fp AS DOUBLE) END"))
def optimal_threshold_precision(spark, sf_dir):
    return rounded(classification.best_threshold(apps(spark, sf_dir), "y", "p", "precision"))


@query(_threshold_sql("CASE WHEN tp + fn = 0 THEN NULL ELSE tp / CAST(tp + fn AS DOUBLE) END"))
def optimal_threshold_recall(spark, sf_dir):
    return rounded(classification.best_threshold(apps(spark, sf_dir), "y", "p", "recall"))


# --- drift and bins --------------------------------------------------------------------------------


@query(f"WITH {_drift_sql(['l_quantity', 'l_discount', 'l_extendedprice'])} SELECT feature, round(ks, 6) AS ks, round(ks_pvalue, 6) AS ks_pvalue FROM drift")
def ks_all_features(spark, sf_dir):
    return rounded(stability.ks_by_feature(*_sides(spark, sf_dir), ["l_quantity", "l_discount", "l_extendedprice"]).select("feature", "ks", "ks_pvalue"))


@query()
def best_bins(spark, sf_dir):
    return rounded(binning.best_bins(binning.bin_table(_fine(spark, sf_dir, bins=20), ["bin"], "y")))


@query(f"""WITH {_quantile_bins_sql('l_extendedprice')}, q AS (SELECT list_sort(q) AS q FROM e), i AS (SELECT unnest(range(0, len(q) + 1)) AS i, q FROM q)
SELECT CAST(i AS INT) AS bin, round(CASE WHEN i > 0 THEN q[i] END, 6) AS lo, round(CASE WHEN i < len(q) THEN q[i + 1] END, 6) AS hi FROM i""")
def bin_intervals(spark, sf_dir):
    a = apps(spark, sf_dir)
    return rounded(binning.bin_info(a, "l_extendedprice", binning.edges(a, "l_extendedprice", 10)).drop("label"))


@query(f"""WITH {APPS}, t AS (SELECT l_linestatus AS bin, sum(y) AS events, sum(1 - y) AS non_events FROM apps GROUP BY 1),
w AS (SELECT bin, ln(((non_events + 1e-4) / (sum(non_events) OVER () + 1e-4)) / ((events + 1e-4) / (sum(events) OVER () + 1e-4))) AS woe FROM t)
SELECT bin AS l_linestatus, round(woe, 6) AS woe, count(*) AS n FROM apps JOIN w ON apps.l_linestatus = w.bin GROUP BY 1, 2""")
def woe_import(spark, sf_dir):
    a = apps(spark, sf_dir)
    text = binning.woe_json(binning.woe_table(binning.bin_table(a, ["l_linestatus"], "y")), "l_linestatus").first()["json"]
    read = binning.woe_from_json(spark, text, "l_linestatus")
    return rounded(binning.encode_woe(a, "l_linestatus", read, "woe").groupBy("l_linestatus", "woe").agg(F.count(F.lit(1)).alias("n")))


_YEARLY = f"""{APPS}, g AS (SELECT yr, CAST(l_quantity AS INT) AS q, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM apps GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY yr ORDER BY q) AS k FROM g)"""


@query(f"WITH {_YEARLY} SELECT yr, q, n, events, round(events / CAST(n AS DOUBLE), 6) AS event_rate FROM r WHERE k <= 8")
def first_bins_by_snapshot(spark, sf_dir):
    drift = temporal.bin_drift(apps(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("int")), "yr", "q", "y")
    return rounded(reports.first_bins(drift, "yr", "q", 8).select("yr", "q", "n", "events", "event_rate"))


# --- alerts, counters, gauges ----------------------------------------------------------------------

_OPENED = "SELECT substr(md5(concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), 'user ' || user_id, event_type)), 1, 12) AS alert_id, ts, CASE WHEN value > 300 THEN 'critical' WHEN value > 150 THEN 'warning' ELSE 'info' END AS severity, user_id, event_type, event_id FROM events WHERE value > 100"


def _alerts(spark, sf_dir):
    """Every event over 100 opens an alert; every third is resolved an hour later, every fifth acknowledged a minute later."""
    e = table(spark, sf_dir, "events").where("value > 100").withColumn("ts", F.date_trunc("second", "ts"))
    severity = F.when(F.col("value") > 300, "critical").when(F.col("value") > 150, "warning").otherwise("info")
    opened = monitoring.created(e.select("ts", severity.alias("severity"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), F.col("event_type").alias("source")))
    key = F.substring("title", 7, 20).cast("long")
    later = lambda n, status, gap: opened.where(key % n == 0).select("alert_id", (F.col("ts") + F.expr(f"INTERVAL {gap}")).alias("ts"), "severity", F.lit(status).alias("status"), "title", "source", "notes")
    return opened.unionByName(later(3, "resolved", "1 HOUR")).unionByName(later(5, "acknowledged", "1 MINUTE"))


@query("""WITH a AS (SELECT event_id, event_type AS source, CASE WHEN value > 300 THEN 'critical' WHEN value > 150 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 5 = 0 THEN 'acknowledged' ELSE 'active' END AS status FROM events WHERE value > 100)
SELECT source, severity, status, count(*) AS n FROM a GROUP BY 1, 2, 3""")
def alert_lifecycle(spark, sf_dir):
    return monitoring.alert_state(_alerts(spark, sf_dir)).groupBy("source", "severity", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'event ' || event_id AS title, CASE WHEN event_id % 5 = 0 THEN 'acknowledged' ELSE 'active' END AS status FROM events WHERE value > 300 AND event_id % 3 <> 0""")
def active_critical_alerts(spark, sf_dir):
    return monitoring.active_alerts(_alerts(spark, sf_dir), "critical").select("title", "status")


@query("SELECT event_type, user_id % 4 AS shard, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def metric_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 4)
    return monitoring.counters(e, "event_type", "value", ["shard"]).withColumn("total", F.round("total", 4))


@query("SELECT event_type, max_by(value, (ts, value)) AS value FROM events GROUP BY 1")
def metric_gauges(spark, sf_dir):
    return monitoring.gauges(table(spark, sf_dir, "events"), "event_type", "value", "ts")


@query("""SELECT 'oddsmill_events{event_type="' || event_type || '",shard="' || user_id % 4 || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 4""")
def exposition_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("shard"), F.lit(1).cast("long").alias("one"))
    return monitoring.exposition(monitoring.counters(e, "event_type", "one", ["shard"]), "events", "event_type", "total", ["shard"])


_HISTORY = "WITH d AS (SELECT CAST(ts AS DATE) AS ts, user_id AS feature, avg(value) AS psi FROM events GROUP BY 1, 2), l AS (SELECT ts, CASE WHEN psi < 80 THEN 'stable' WHEN psi < 120 THEN 'warning' ELSE 'critical' END AS level FROM d)"


@query(f"{_HISTORY} SELECT ts, count(*) AS n_features, CAST(sum(CASE WHEN level = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical, CAST(sum(CASE WHEN level = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning, CAST(sum(CASE WHEN level = 'stable' THEN 1 ELSE 0 END) AS BIGINT) AS stable FROM l GROUP BY ts")
def drift_history(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("ts"), "user_id").agg(F.avg("value").alias("psi"))
    return monitoring.drift_history(daily.withColumn("level", F.when(F.col("psi") < 80, "stable").when(F.col("psi") < 120, "warning").otherwise("critical")))


# --- logs of runs and of actions -------------------------------------------------------------------


def _log(spark, sf_dir):
    """Orders as runs: created as they stand, every fourth failing a day later, every seventh deleted."""
    o = table(spark, sf_dir, "orders")
    event = lambda d, field, value, gap="0 DAY": d.select(
        F.lit("run").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderdate") + F.expr(f"INTERVAL {gap}")).alias("ts"), F.lit(field).alias("field"), value.cast("string").alias("value")
    )
    out = event(o, "status", F.lit("created")).unionByName(event(o, "user_id", F.col("o_custkey")))
    return out.unionByName(event(o.where("o_orderkey % 4 = 0"), "status", F.lit("failed"), "1 DAY")).unionByName(event(o.where("o_orderkey % 7 = 0"), "deleted", F.lit("true"), "2 DAY"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'created' END AS status, CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderkey % 7 <> 0""")
def run_log(spark, sf_dir):
    return governance.runs_of(_log(spark, sf_dir), ("status", "user_id"))
