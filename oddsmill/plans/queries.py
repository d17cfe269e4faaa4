"""The registered queries over the test tables, each with the SQL that says the same.

Floating-point results are rounded to six places on both sides, so that the
order of summation does not show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import binning, calibration, classification, compression, encoding, evaluation, governance, models, monitoring, profile, ranking, scorecard, stability, temporal, trends
from ..sources import io
from .recipes import Plan, Recipe, build_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


# --- the scored applications: a line item stands for an application --------------------------------

_P = "round(1.0 / (1.0 + exp(-((l_quantity - 25.5) / 15.0 + (l_discount - 0.05) * 8.0))), 4)"
APPS = f"""apps AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
         l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {_P} AS p,
         CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS d0,
         CAST(extract(year FROM l_shipdate) AS INT) AS yr
  FROM lineitem
)"""


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    z = (F.col("l_quantity") - 25.5) / 15.0 + (F.col("l_discount") - 0.05) * 8.0
    return li.select(
        "*", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(1.0 / (1.0 + F.exp(-z)), 4).alias("p"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("d0"), F.year("l_shipdate").alias("yr"),
    )


# curve of distinct p, as the ranking queries need it
CURVE = f"""{APPS}, g AS (
  SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM apps GROUP BY p
), c AS (
  SELECT p, pos, neg, coalesce(sum(pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
         coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
         sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
  FROM g
)"""


@query(f"WITH {CURVE} SELECT round(sum(pos * (nb + neg / 2.0)) / (max(tp) * max(tn)), 6) AS auc, round(2 * sum(pos * (nb + neg / 2.0)) / (max(tp) * max(tn)) - 1, 6) AS gini, round(2 * sum(pos * (nb + neg / 2.0)) / (max(tp) * max(tn)) - 1, 6) AS accuracy_ratio FROM c")
def auc_gini(spark, sf_dir):
    return rounded(ranking.auc_table(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {CURVE}, r AS (SELECT p, (tp - pb) / CAST(tp AS DOUBLE) AS tpr, (tn - nb) / CAST(tn AS DOUBLE) AS fpr FROM c)
SELECT round(tpr - fpr, 6) AS ks, p AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r ORDER BY tpr - fpr DESC, p DESC LIMIT 1""")
def ks_statistic(spark, sf_dir):
    return rounded(ranking.ks_table(apps(spark, sf_dir), "y", "p"))


@query(f"WITH {CURVE} SELECT p AS threshold, round((tp - pb) / CAST(tp AS DOUBLE), 6) AS tpr, round((tn - nb) / CAST(tn AS DOUBLE), 6) AS fpr FROM c")
def roc_curve(spark, sf_dir):
    return rounded(ranking.roc_points(apps(spark, sf_dir), "y", "p"))


_TOP = "least(greatest((top_n - (tp + tn - pb - nb - pos - neg)) / CAST(pos + neg AS DOUBLE), 0), 1)"


@query(f"""WITH {CURVE}, k AS (SELECT share, greatest(floor((SELECT max(tp + tn) FROM c) * share), 1) AS top_n FROM (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) AS v(share))
SELECT share, CAST(top_n AS BIGINT) AS top_n, round(sum({_TOP} * pos), 6) AS captured, round(sum({_TOP} * pos) / top_n / (max(tp) / CAST(max(tp + tn) AS DOUBLE)), 6) AS lift
FROM c CROSS JOIN k GROUP BY share, top_n""")
def lift_at_k(spark, sf_dir):
    return rounded(ranking.lift_at(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {CURVE}, k AS (SELECT CAST(i AS INT) AS bin, CAST(i * ((SELECT max(tp + tn) FROM c) // 10) AS BIGINT) AS top_n FROM range(1, 11) AS v(i))
SELECT bin, top_n, round(sum({_TOP} * pos), 6) AS captured, round(top_n / CAST(max(tp + tn) AS DOUBLE), 6) AS population, round(sum({_TOP} * pos) / max(tp), 6) AS gain
FROM c CROSS JOIN k GROUP BY bin, top_n""")
def gains_curve(spark, sf_dir):
    return rounded(ranking.gains_curve(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {CURVE}, k AS (SELECT CAST(i AS INT) AS bin, CASE WHEN i = 10 THEN (SELECT max(tp + tn) FROM c) ELSE i * ((SELECT max(tp + tn) FROM c) // 10) END AS top_n FROM range(0, 11) AS v(i)),
e AS (SELECT bin, CAST(top_n AS BIGINT) AS top_n, sum({_TOP} * pos) AS cap, max(tp) / CAST(max(tp + tn) AS DOUBLE) AS base FROM c CROSS JOIN k GROUP BY bin, top_n),
d AS (SELECT bin, top_n - lag(top_n) OVER (ORDER BY bin) AS n, cap - lag(cap) OVER (ORDER BY bin) AS x, base FROM e)
SELECT bin, n AS rows, round(x, 6) AS positives, round(x / n, 6) AS rate, round(x / n / base, 6) AS lift FROM d WHERE bin > 0""")
def lift_curve(spark, sf_dir):
    return rounded(ranking.lift_curve(apps(spark, sf_dir), "y", "p"))


@query(f"WITH {CURVE} SELECT round((tp + tn - pb - nb) / CAST(tp + tn AS DOUBLE), 6) AS population, round((tp - pb) / CAST(tp AS DOUBLE), 6) AS captured FROM c UNION ALL SELECT CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)")
def cap_curve(spark, sf_dir):
    return rounded(ranking.cap_curve(apps(spark, sf_dir), "y", "p"))


@query(f"WITH {CURVE} SELECT round(greatest(1 - min(tn - nb + pb) / CAST(least(max(tp), max(tn)) AS DOUBLE), 0), 6) AS h_measure FROM c")
def h_measure(spark, sf_dir):
    return rounded(ranking.h_measure(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {CURVE}, a AS (SELECT sum(pos * (nb + neg / 2.0)) / (max(tp) * max(tn)) AS auc, greatest(1 - min(tn - nb + pb) / CAST(least(max(tp), max(tn)) AS DOUBLE), 0) AS h FROM c),
r AS (SELECT p, (tp - pb) / CAST(tp AS DOUBLE) - (tn - nb) / CAST(tn AS DOUBLE) AS gap FROM c ORDER BY gap DESC, p DESC LIMIT 1),
k AS (SELECT share, greatest(floor((SELECT max(tp + tn) FROM c) * share), 1) AS top_n FROM (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) AS v(share)),
l AS (SELECT share, sum({_TOP} * pos) / top_n / (max(tp) / CAST(max(tp + tn) AS DOUBLE)) AS lift FROM c CROSS JOIN k GROUP BY share, top_n)
SELECT round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, round(2 * auc - 1, 6) AS accuracy_ratio, round(gap, 6) AS ks, p AS ks_threshold,
round((SELECT lift FROM l WHERE share = 0.1), 6) AS lift_10, round((SELECT lift FROM l WHERE share = 0.2), 6) AS lift_20, round(h, 6) AS h_measure FROM a CROSS JOIN r""")
def ranking_summary(spark, sf_dir):
    return rounded(ranking.ranking_summary(apps(spark, sf_dir), "y", "p"))


_CELLS = f"""{APPS}, m AS (
  SELECT CAST(sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
         CAST(sum(CASE WHEN y = 0 AND p < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, CAST(sum(CASE WHEN y = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM apps
)"""


@query(f"""WITH {_CELLS} SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
 round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
 round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f_beta, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
 round(((tp + tn) / (tp + fp + tn + fn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn))) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn))), 6) AS kappa,
 round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, round(tn / (tn + fn), 6) AS npv, round(tp / (tp + fp) + tn / (tn + fn) - 1, 6) AS markedness,
 round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS informedness, round(tp * tn / (fp * fn), 6) AS diagnostic_odds_ratio, round((tp / (tp + fn)) / (fp / (fp + tn)), 6) AS lr_positive,
 round((fn / (fn + tp)) / (tn / (tn + fp)), 6) AS lr_negative, round((tp + fn) / (tp + fp + tn + fn), 6) AS prevalence, round(tp / (tp + fp + tn + fn), 6) AS detection_rate,
 round((tp + fp) / (tp + fp + tn + fn), 6) AS detection_prevalence FROM m""")
def classification_metrics(spark, sf_dir):
    return rounded(classification.metrics(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {_CELLS} SELECT 0 AS class, round(tn / (tn + fn), 6) AS precision, round(tn / (tn + fp), 6) AS recall, round(2 * tn / (2 * tn + fn + fp), 6) AS f1, tn + fp AS support FROM m
UNION ALL SELECT 1, round(tp / (tp + fp), 6), round(tp / (tp + fn), 6), round(2 * tp / (2 * tp + fp + fn), 6), tp + fn FROM m""")
def per_class_metrics(spark, sf_dir):
    return rounded(classification.per_class(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {APPS}, t AS (SELECT i, CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) AS v(i)),
b AS (SELECT CAST(floor(p * 100 + 1e-9) AS INT) AS cell, sum(y) AS pos, sum(1 - y) AS neg FROM apps GROUP BY 1),
s AS (SELECT threshold, sum(CASE WHEN cell >= i THEN pos ELSE 0 END) AS tp, sum(CASE WHEN cell >= i THEN neg ELSE 0 END) AS fp, sum(CASE WHEN cell < i THEN pos ELSE 0 END) AS fn FROM b CROSS JOIN t GROUP BY threshold),
f AS (SELECT threshold, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END AS score FROM s)
SELECT round(threshold, 6) AS threshold, round(score, 6) AS score FROM f ORDER BY round(score, 9) DESC, threshold LIMIT 1""")
def optimal_threshold_f1(spark, sf_dir):
    return rounded(classification.best_threshold(apps(spark, sf_dir), "y", "p", "f1"))


@query(f"WITH {APPS} SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM apps")
def brier_log_loss(spark, sf_dir):
    return rounded(calibration.brier_and_log_loss(apps(spark, sf_dir), "y", "p"))


_CAL = f"{APPS}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM apps GROUP BY 1)"


@query(f"WITH {_CAL} SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM b")
def calibration_curve(spark, sf_dir):
    return rounded(calibration.calibration_curve(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {APPS}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM apps),
b AS (SELECT CAST(len(list_filter(list_distinct(q), lambda x: p > x)) AS INT) AS bin, p, y FROM apps CROSS JOIN e)
SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM b GROUP BY bin""")
def calibration_curve_quantile(spark, sf_dir):
    return rounded(calibration.calibration_curve(apps(spark, sf_dir), "y", "p", strategy="quantile"))


@query(f"WITH {_CAL} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece, round(max(abs(mean_p - rate)), 6) AS mce FROM b")
def calibration_errors(spark, sf_dir):
    return rounded(calibration.calibration_errors(apps(spark, sf_dir), "y", "p"))


@query(f"""WITH {_CAL} SELECT round(sum((n * rate - n * mean_p) * (n * rate - n * mean_p) / (n * mean_p) + (n * rate - n * mean_p) * (n * rate - n * mean_p) / (n - n * mean_p)), 4) AS statistic,
greatest(count(*) - 2, 1) AS df FROM b""")
def hosmer_lemeshow(spark, sf_dir):
    return rounded(calibration.hosmer_lemeshow_statistic(apps(spark, sf_dir), "y", "p"), 4)


@query()
def calibration_slope_intercept(spark, sf_dir):
    slope, intercept = calibration.slope_intercept(apps(spark, sf_dir), "y", "p")
    return rounded(spark.createDataFrame([(slope, intercept)], "slope double, intercept double"))


@query()
def intercept_calibration(spark, sf_dir):
    a = apps(spark, sf_dir)
    target = a.agg(F.avg("y")).first()[0]
    shift = calibration.intercept_shift(a, "p", target)
    return rounded(a.agg(F.avg(calibration.shifted(F.col("p"), shift)).alias("mean_p"), F.avg("y").alias("target"), F.lit(shift).alias("shift")))


_FACTOR = "(20.0 / ln(2.0))"


@query(f"""WITH {APPS}, s AS (SELECT 600.0 - {_FACTOR} * ln(50.0) - {_FACTOR} * ln(p / (1 - p)) AS score, p FROM apps)
SELECT CAST(floor(score / 20) AS BIGINT) AS band, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(1 / (1 + exp(-((600.0 - {_FACTOR} * ln(50.0) - score) / {_FACTOR})))), 6) AS mean_p FROM s GROUP BY 1""")
def pdo_scores(spark, sf_dir):
    s = apps(spark, sf_dir).select(calibration.score_of(F.col("p")).alias("score"))
    g = s.groupBy(F.floor(F.col("score") / 20).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(calibration.probability_of(F.col("score"))).alias("mean_p"))
    return g.select("band", "n", F.round("mean_score", 4).alias("mean_score"), F.round("mean_p", 6).alias("mean_p"))


@query(f"""WITH b AS (SELECT CAST(i AS INT) AS band, CAST(500 + i * 20 AS BIGINT) AS lower, CAST(500 + (i + 1) * 20 AS BIGINT) AS upper, CAST(510 + i * 20 AS DOUBLE) AS mid FROM range(0, 10) AS v(i)),
p AS (SELECT *, 1 / (1 + exp(-((600.0 - {_FACTOR} * ln(50.0) - mid) / {_FACTOR}))) AS dp FROM b)
SELECT band, lower, upper, mid, round((1 - dp) / dp, 6) AS odds, round(dp, 6) AS default_probability FROM p""")
def score_bands(spark, sf_dir):
    return rounded(calibration.score_bands(spark))


# --- binning ---------------------------------------------------------------------------------------

_Q10 = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def _quantile_bins_sql(column: str) -> str:
    return f"""{APPS}, e AS (SELECT list_distinct(quantile_cont({column}, {_Q10})) AS q FROM apps),
f AS (SELECT CAST(len(list_filter(q, lambda x: {column} > x)) AS INT) AS bin, y, yr FROM apps CROSS JOIN e WHERE {column} IS NOT NULL),
t AS (SELECT bin, count(*) AS n, sum(y) AS events, sum(1 - y) AS non_events FROM f GROUP BY bin)"""


def _fine(spark, sf_dir, column="l_extendedprice", method="quantile", bins=10):
    a = apps(spark, sf_dir).where(F.col(column).isNotNull())
    return binning.assign(a, column, binning.edges(a, column, bins, method))


@query(f"WITH {_quantile_bins_sql('l_extendedprice')} SELECT bin, n, CAST(events AS BIGINT) AS events, CAST(non_events AS BIGINT) AS non_events FROM t")
def fine_bins_quantile(spark, sf_dir):
    return binning.bin_table(_fine(spark, sf_dir), ["bin"], "y")


@query(f"""WITH {APPS}, e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 8 AS w FROM apps)
SELECT CAST(len(list_filter(range(1, 8), lambda k: l_extendedprice > lo + k * w)) AS INT) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, CAST(sum(1 - y) AS BIGINT) AS non_events FROM apps CROSS JOIN e GROUP BY 1""")
def fine_bins_width(spark, sf_dir):
    return binning.bin_table(_fine(spark, sf_dir, method="width", bins=8), ["bin"], "y")


@query(f"""WITH {APPS} SELECT CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 25 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, CAST(sum(1 - y) AS BIGINT) AS non_events FROM apps GROUP BY 1""")
def fine_bins_custom(spark, sf_dir):
    a = apps(spark, sf_dir)
    return binning.bin_table(binning.assign(a, "l_quantity", binning.edges(a, "l_quantity", 0, "custom", [10, 25, 40])), ["bin"], "y")


@query("""WITH c AS (SELECT CASE WHEN p_type = 'nothing' THEN NULL ELSE p_brand END AS v FROM part), n AS (SELECT v, count(*) AS n FROM c GROUP BY v),
k AS (SELECT v FROM n WHERE n >= floor((SELECT count(*) FROM c) * 0.04) AND v IS NOT NULL)
SELECT CASE WHEN c.v IS NULL THEN '__MISSING__' WHEN k.v IS NULL THEN '__OTHER__' ELSE c.v END AS bin, count(*) AS n FROM c LEFT JOIN k ON c.v = k.v GROUP BY 1""")
def fine_bins_categorical(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("v"))
    return binning.categorical(part, "v", 0.04).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_WOE = """w AS (SELECT bin, n, events, non_events, (events + 1e-4) / (sum(events) OVER () + 1e-4) AS e, (non_events + 1e-4) / (sum(non_events) OVER () + 1e-4) AS g FROM t)"""


@query(f"""WITH {_quantile_bins_sql('l_extendedprice')}, {_WOE}
SELECT bin, n, CAST(events AS BIGINT) AS events, CAST(non_events AS BIGINT) AS non_events, round(events / CAST(n AS DOUBLE), 6) AS event_rate, round(ln(g / e), 6) AS woe, round((g - e) * ln(g / e), 6) AS iv_part FROM w""")
def woe_table(spark, sf_dir):
    return rounded(binning.woe_table(binning.bin_table(_fine(spark, sf_dir), ["bin"], "y")))


@query(f"""WITH {APPS}, l AS (SELECT 'l_linestatus' AS feature, l_linestatus AS bin, y FROM apps UNION ALL SELECT 'yr', CAST(yr AS VARCHAR), y FROM apps UNION ALL SELECT 'd0', CAST(CASE WHEN d0 > 0.05 THEN 1 WHEN d0 IS NOT NULL THEN 0 END AS VARCHAR), y FROM apps),
t AS (SELECT feature, bin, count(*) AS n, sum(y) AS events, sum(1 - y) AS non_events FROM l GROUP BY feature, bin),
w AS (SELECT feature, bin, (events + 1e-4) / (sum(events) OVER (PARTITION BY feature) + 1e-4) AS e, (non_events + 1e-4) / (sum(non_events) OVER (PARTITION BY feature) + 1e-4) AS g FROM t),
s AS (SELECT feature, count(*) AS n_bins, sum((g - e) * ln(g / e)) AS iv FROM w GROUP BY feature)
SELECT feature, n_bins, round(iv, 6) AS iv, CASE WHEN iv < 0.02 THEN 'Not Predictive' WHEN iv < 0.1 THEN 'Weak' WHEN iv < 0.3 THEN 'Medium' WHEN iv < 0.5 THEN 'Strong' ELSE 'Suspicious' END AS strength FROM s""")
def iv_summary(spark, sf_dir):
    a = apps(spark, sf_dir).withColumn("d0", (F.col("d0") > 0.05).cast("int"))
    return rounded(binning.iv_summary(binning.woe_table(binning.multi_bin_table(a, ["l_linestatus", "yr", "d0"], "y"), ["feature"]), ["feature"]))


@query(f"""WITH {APPS}, t AS (SELECT l_linestatus AS bin, count(*) AS n, sum(y) AS events, sum(1 - y) AS non_events FROM apps GROUP BY 1), {_WOE}
SELECT l_linestatus, round(ln(g / e), 6) AS l_linestatus_woe, count(*) AS n FROM apps JOIN w ON apps.l_linestatus = w.bin GROUP BY 1, 2""")
def woe_encoding(spark, sf_dir):
    a = apps(spark, sf_dir)
    woe = binning.woe_table(binning.bin_table(a, ["l_linestatus"], "y"))
    return rounded(binning.encode_woe(a, "l_linestatus", woe).groupBy("l_linestatus", "l_linestatus_woe").agg(F.count(F.lit(1)).alias("n")))


@query()
def woe_json(spark, sf_dir):
    return binning.woe_json(binning.woe_table(binning.bin_table(apps(spark, sf_dir), ["l_linestatus"], "y")), "l_linestatus")


@query()
def monotone_bins(spark, sf_dir):
    return rounded(binning.monotone_bins(binning.bin_table(_fine(spark, sf_dir, bins=20), ["bin"], "y")))


@query()
def coarse_bins(spark, sf_dir):
    return binning.coarse_bins(binning.bin_table(_fine(spark, sf_dir, bins=40), ["bin"], "y"))


@query()
def optimal_bins(spark, sf_dir):
    return rounded(binning.optimal_bins(binning.bin_table(_fine(spark, sf_dir, bins=20), ["bin"], "y")))


@query()
def auto_bins(spark, sf_dir):
    return rounded(binning.auto_bins(apps(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y", least_iv=0.0))


@query()
def tree_bins(spark, sf_dir):
    a = apps(spark, sf_dir)
    found = binning.tree_bins(a, "l_extendedprice", "y")
    return binning.bin_table(binning.assign(a, "l_extendedprice", binning.edges(a, "l_extendedprice", 0, "custom", found)), ["bin"], "y")


# --- compression -----------------------------------------------------------------------------------


@query(f"WITH {APPS} SELECT l_linestatus, yr, CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS INT) AS qbin, count(*) AS sample_weight, CAST(sum(y) AS DOUBLE) AS event_weight, round(avg(y), 6) AS event_rate FROM apps GROUP BY 1, 2, 3")
def compression_exact(spark, sf_dir):
    a = apps(spark, sf_dir).withColumn("qbin", (F.col("l_quantity") > 25).cast("int"))
    return rounded(compression.compress(a, ["l_linestatus", "yr", "qbin"], "y"))


@query(f"""WITH {APPS}, g AS (SELECT l_linestatus, yr, count(*) AS w, sum(y) AS e FROM apps GROUP BY 1, 2), a AS (SELECT count(*) AS rows, CAST(sum(y) AS DOUBLE) AS events FROM apps), b AS (SELECT CAST(sum(w) AS BIGINT) AS weight, CAST(sum(e) AS DOUBLE) AS event_weight, count(*) AS groups FROM g)
SELECT rows, events, weight, event_weight, groups, round(rows / CAST(groups AS DOUBLE), 6) AS ratio, round(100 * (1 - groups / CAST(rows AS DOUBLE)), 6) AS saved_pct, rows = weight AND events = event_weight AS exact FROM a CROSS JOIN b""")
def compression_verification(spark, sf_dir):
    a = apps(spark, sf_dir)
    return rounded(compression.verification(a, compression.compress(a, ["l_linestatus", "yr"], "y"), "y"))


@query(f"WITH {APPS} SELECT l_linestatus, yr, y AS label, count(*) AS n FROM apps GROUP BY 1, 2, 3")
def compression_expanded(spark, sf_dir):
    rows = compression.expand(compression.compress(apps(spark, sf_dir), ["l_linestatus", "yr"], "y"))
    return rows.groupBy("l_linestatus", "yr", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {APPS} SELECT l_linestatus, yr, y AS label, CAST(count(*) AS DOUBLE) AS weight FROM apps GROUP BY 1, 2, 3")
def compression_weighted_labels(spark, sf_dir):
    return compression.weighted_labels(compression.compress(apps(spark, sf_dir), ["l_linestatus", "yr"], "y")).select("l_linestatus", "yr", "label", "weight")


@query(f"WITH {APPS} SELECT 'l_linestatus' AS feature, l_linestatus AS value, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM apps GROUP BY 2 UNION ALL SELECT 'yr', CAST(yr AS VARCHAR), count(*), CAST(sum(y) AS BIGINT) FROM apps GROUP BY 2")
def sufficient_histogram(spark, sf_dir):
    return compression.sufficient_histogram(apps(spark, sf_dir), ["l_linestatus", "yr"], "y")


@query(f"""WITH {APPS}, n AS (SELECT l_suppkey AS k, count(*) AS n, sum(y) AS events FROM apps GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS rn FROM n)
SELECT CASE WHEN rn <= 10 THEN CAST(k AS VARCHAR) ELSE 'OTHER' END AS l_suppkey, CAST(sum(n) AS BIGINT) AS n, CAST(sum(events) AS BIGINT) AS events FROM r GROUP BY 1""")
def compression_hybrid(spark, sf_dir):
    return compression.hybrid(apps(spark, sf_dir), "l_suppkey", "y")


# --- encoders --------------------------------------------------------------------------------------


@query("SELECT c_mktsegment AS category, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 6) AS share FROM customer GROUP BY 1")
def frequency_encoding(spark, sf_dir):
    return rounded(encoding.frequencies(table(spark, sf_dir, "customer"), "c_mktsegment"))


@query("SELECT c_mktsegment AS category, round(sum(c_acctbal + 1000) / (SELECT sum(c_acctbal + 1000) FROM customer), 6) AS share FROM customer GROUP BY 1")
def frequency_encoding_weighted(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("w", F.col("c_acctbal") + 1000)
    return rounded(encoding.frequencies(c, "c_mktsegment", "w"))


@query("""WITH o AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
m AS (SELECT avg(y) AS g FROM o) SELECT coalesce(k, '__MISSING__') AS category, CAST(count(*) AS DOUBLE) AS n, round((sum(y) + 10 * max(g)) / (count(*) + 10), 6) AS value FROM o CROSS JOIN m GROUP BY 1""")
def target_mean_encoding(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")).alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(encoding.target_means(o, "k", "y", smoothing=10))


@query("""WITH s AS (SELECT p_type, count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) AS share FROM part GROUP BY 1), k AS (SELECT p_type, CASE WHEN share < 0.165 THEN 'RARE' ELSE p_type END AS g FROM s)
SELECT g AS p_type_grouped, count(*) AS n FROM part JOIN k ON part.p_type = k.p_type GROUP BY 1""")
def rare_grouping(spark, sf_dir):
    return encoding.rare_grouped(table(spark, sf_dir, "part"), "p_type", 0.165).groupBy("p_type_grouped").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM orders")
def one_hot(spark, sf_dir):
    d = encoding.one_hot(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"])
    return d.agg(*[F.sum(f"o_orderstatus_{c}").alias(c.lower()) for c in "FOP"])


# --- recipes ---------------------------------------------------------------------------------------

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _summed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, values and sums of feature columns: what a comparison of millions of rows needs."""
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns], *[F.sum(c).alias(f"sum_{c}") for c in columns]), 4)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_discount, 0), 4) AS r_nan, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_discount END, 4) AS r_zero,
round(l_extendedprice - l_quantity, 6) AS diff, round(l_quantity * l_discount * l_tax, 6) AS prod, round(ln(1 + l_quantity), 6) AS lg, round(sqrt(l_extendedprice), 6) AS rt,
round(CASE WHEN l_quantity < 5 THEN 5 WHEN l_quantity > 40 THEN 40 ELSE l_quantity END, 6) AS cl FROM lineitem""")
def recipe_scalars(spark, sf_dir):
    pair = ("l_extendedprice", "l_discount")
    plan = Plan((
        Recipe("r_nan", "ratio", pair), Recipe("r_zero", "ratio", pair, divide_by_zero="zero"), Recipe("diff", "difference", ("l_extendedprice", "l_quantity")),
        Recipe("prod", "product", ("l_quantity", "l_discount", "l_tax")), Recipe("lg", "log", ("l_quantity",)), Recipe("rt", "sqrt", ("l_extendedprice",)),
        Recipe("cl", "clip", ("l_quantity",), params={"lower": 5.0, "upper": 40.0}),
    ))
    out = build_features(table(spark, sf_dir, "lineitem").select(*_KEYS, "l_extendedprice", "l_discount", "l_quantity", "l_tax"), plan)
    near = {"r_nan": 4, "r_zero": 4}
    return out.select(*_KEYS, *[F.round(r.name, near.get(r.name, 6)).alias(r.name) for r in plan.recipes])


@query("""WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem)
SELECT CAST(greatest(least(ceil((l_quantity - lo) / w) - 1, 9), 0) AS INT) AS qbin, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS cbin, count(*) AS n FROM lineitem CROSS JOIN e GROUP BY 1, 2""")
def recipe_bins(spark, sf_dir):
    plan = Plan((Recipe("qbin", "bin", ("l_quantity",), params={"bins": 10}), Recipe("cbin", "bin", ("l_quantity",), params={"bins": [0, 20, 40, 60]})))
    return build_features(table(spark, sf_dir, "lineitem"), plan).groupBy("qbin", "cbin").agg(F.count(F.lit(1)).alias("n"))


_EVENT_AGGS = """max(value) AS mx, min(value) AS mn, round(avg(value), 6) AS av, round(quantile_cont(value, 0.5), 6) AS md, round(stddev_samp(value), 6) AS sd, round(sum(value), 4) AS sm, count(value) AS ct, arg_min(value, ts) AS fi, arg_max(value, ts) AS la, round(max(value) - min(value), 6) AS rg"""


def _aggregations(window: str | None) -> tuple[Recipe, ...]:
    names = {"mx": "max", "mn": "min", "av": "mean", "md": "median", "sd": "std", "sm": "sum", "ct": "count", "fi": "first", "la": "last", "rg": "range"}
    return tuple(Recipe(k, op, ("value",), window) for k, op in names.items())


def _event_features(spark, sf_dir, window):
    out = build_features(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), Plan(_aggregations(window), ("user_id",), "ts"))
    names = [r.name for r in _aggregations(window)]
    first = out.groupBy("user_id").agg(*[F.first(n).alias(n) for n in names])
    return first.select("user_id", *[(F.round(n, 4) if n == "sm" else F.round(n, 6) if n in ("av", "md", "sd", "rg") else F.col(n)).alias(n) for n in names])


@query(f"SELECT user_id, {_EVENT_AGGS} FROM events GROUP BY user_id")
def recipe_group_aggregations(spark, sf_dir):
    return _event_features(spark, sf_dir, None)


@query("""WITH d AS (SELECT DISTINCT o_custkey FROM orders), w AS (SELECT * FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 12 MONTH)
SELECT d.o_custkey AS o_custkey, max(o_totalprice) AS mx, CASE WHEN count(o_totalprice) = 0 THEN NULL ELSE count(o_totalprice) END AS ct FROM d LEFT JOIN w ON d.o_custkey = w.o_custkey GROUP BY 1""")
def recipe_time_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    plan = Plan((Recipe("mx", "max", ("o_totalprice",), "last_12_months"), Recipe("ct", "count", ("o_totalprice",), "last_12_months")), ("o_custkey",), "o_orderdate")
    return build_features(o, plan).groupBy("o_custkey").agg(F.first("mx").alias("mx"), F.first("ct").alias("ct"))


@query("SELECT count(*) AS n, count(*) AS n_mx, count(*) AS n_av, round(sum(m), 4) AS sum_mx, round(sum(a), 4) AS sum_av FROM lineitem CROSS JOIN (SELECT max(l_quantity) AS m, avg(l_tax) AS a FROM lineitem)")
def recipe_global_aggregation(spark, sf_dir):
    plan = Plan((Recipe("mx", "worst", ("l_quantity",)), Recipe("av", "mean", ("l_tax",))))
    return _summed(build_features(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax"), plan), ["mx", "av"])


@query(f"""WITH {APPS}, g AS (SELECT yr AS gy, quantile_cont(d0, 0.5) AS m FROM apps GROUP BY yr), a AS (SELECT avg(d0) AS a FROM apps)
SELECT yr, CAST(sum(CASE WHEN d0 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(sum(coalesce(d0, 0)), 4) AS zero, round(sum(coalesce(d0, a)), 4) AS mean, round(sum(coalesce(d0, m)), 4) AS median, round(sum(coalesce(d0, 0.5)), 4) AS const
FROM apps JOIN g ON yr = gy CROSS JOIN a GROUP BY yr""")
def recipe_missing_values(spark, sf_dir):
    one = lambda name, how, **more: Recipe(name, "product", ("d0",), missing=how, **more)
    plan = Plan((one("zero", "zero", flag_missing=True), one("mean", "mean"), one("median", "median", scope="group"), one("const", "constant", missing_value=0.5)), ("yr",))
    out = build_features(apps(spark, sf_dir).select("yr", "d0"), plan)
    return rounded(out.groupBy("yr").agg(F.sum("d0__is_missing").alias("missing"), *[F.sum(c).alias(c) for c in ("zero", "mean", "median", "const")]), 4)


@query("""WITH a AS (SELECT l_extendedprice * (1 - l_discount) AS net, l_quantity FROM lineitem) SELECT count(*) AS n, count(*) AS n_unit, count(*) AS n_unit_log, round(sum(net / l_quantity), 4) AS sum_unit, round(sum(ln(1 + net / l_quantity)), 4) AS sum_unit_log FROM a""")
def recipe_dependencies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_quantity")
    plan = Plan.from_dict({"recipes": [{"name": "unit_log", "operation": "log", "source_cols": ["unit"]}, {"name": "unit", "operation": "ratio", "source_cols": ["net", "l_quantity"]}]})
    return _summed(build_features(li, plan), ["unit", "unit_log"])


# --- trends ----------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_W3 = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_W6 = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
PANEL = trends.Panel(("user_id",), ("ts", "event_id"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")


@query(f"SELECT event_id, round(value - lag(value) {_W}, 6) AS delta, round((value - lag(value) {_W}) / nullif(lag(value) {_W}, 0), 6) AS pct FROM events")
def trend_delta(spark, sf_dir):
    return rounded(_events(spark, sf_dir).select("event_id", trends.delta(PANEL, "value").alias("delta"), trends.pct_change(PANEL, "value").alias("pct")))


@query(f"SELECT event_id, round(value - avg(value) {_W3}, 6) AS momentum, round(max(value) {_W6} - min(value) {_W6}, 6) AS value_range FROM events")
def trend_momentum_range(spark, sf_dir):
    return rounded(_events(spark, sf_dir).select("event_id", trends.momentum(PANEL, "value").alias("momentum"), trends.value_range(PANEL, "value").alias("value_range")))


@query(f"SELECT event_id, round(stddev_samp(value) {_W6}, 5) AS std, round(stddev_samp(value) {_W6} / (avg(value) {_W6} + 1e-8), 5) AS cv FROM events")
def trend_volatility(spark, sf_dir):
    return rounded(_events(spark, sf_dir).select("event_id", trends.volatility(PANEL, "value").alias("std"), trends.volatility(PANEL, "value", kind="cv").alias("cv")), 5)


@query(f"WITH r AS (SELECT event_id, user_id, ts, value, CAST(row_number() {_W} AS DOUBLE) AS rn FROM events) SELECT event_id, round(regr_slope(value, rn) {_W6}, 5) AS slope FROM r")
def trend_slope(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("_n", trends.row_numbers(PANEL))
    return rounded(e.select("event_id", trends.slope(PANEL, "value").alias("slope")), 5)


@query(f"WITH r AS (SELECT event_id, value, list(value) {_W6} AS a FROM events) SELECT event_id, round(CASE WHEN len(a) >= 2 THEN (len(list_filter(a, lambda x: x < value)) + 1) / CAST(len(a) AS DOUBLE) END, 6) AS rank_pct FROM r")
def trend_rolling_rank(spark, sf_dir):
    return rounded(_events(spark, sf_dir).select("event_id", trends.rolling_rank(PANEL, "value").alias("rank_pct")))


@query(f"SELECT event_id, round(avg(value) {_W3}, 6) AS mean3, round(sum(value) {_W6}, 4) AS sum6, max(value) {_W6} AS max6 FROM events")
def trend_rolling_aggregates(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(trends.rolling(PANEL, "value", 3, "mean"), 6).alias("mean3"), F.round(trends.rolling(PANEL, "value", 6, "sum"), 4).alias("sum6"), trends.rolling(PANEL, "value", 6, "max").alias("max6"))


@query(f"WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN value END AS v FROM events) SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM v")
def trend_forward_fill(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "click", F.col("value")))
    return e.select("event_id", trends.forward_fill(PANEL, "v").alias("filled"))


@query("""WITH m AS (SELECT o_custkey, CAST(extract(year FROM o_orderdate) * 12 + extract(month FROM o_orderdate) AS INT) AS mo, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2)
SELECT o_custkey, mo, round(sum(t) OVER (PARTITION BY o_custkey ORDER BY mo RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS total6 FROM m""")
def trend_month_window(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("mo")).agg(F.sum("o_totalprice").alias("t"))
    total = F.sum("t").over(trends.months(trends.Panel(("o_custkey",), ("mo",)), "mo", 6))
    return m.select("o_custkey", (F.year("mo") * 12 + F.month("mo")).alias("mo"), F.round(total, 4).alias("total6"))


# --- profiles --------------------------------------------------------------------------------------

_LONG = "l AS (SELECT 'l_quantity' AS feature, l_quantity AS value, y FROM apps UNION ALL SELECT 'l_tax', l_tax, y FROM apps UNION ALL SELECT 'd0', d0, y FROM apps)"
_FEATURES = ["l_quantity", "l_tax", "d0"]


@query(f"""WITH {APPS}, {_LONG}, s AS (SELECT feature, count(*) AS n, count(value) AS k, count(DISTINCT value) AS n_unique, min(value) AS mn, max(value) AS mx, avg(value) AS av, stddev_samp(value) AS sd, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM l GROUP BY feature)
SELECT feature, round((n - k) / CAST(n AS DOUBLE), 5) AS missing_rate, n_unique, mn AS min, mx AS max, round(av, 5) AS mean, round(sd, 5) AS std, round(p01, 5) AS p01, round(p99, 5) AS p99, n_unique <= 1 AS zero_variance,
CASE WHEN (n - k) / CAST(n AS DOUBLE) > 0.5 OR n_unique <= 1 THEN 'FAIL' WHEN (n - k) / CAST(n AS DOUBLE) > 0.05 THEN 'WARN' ELSE 'PASS' END AS status FROM s""")
def feature_validation(spark, sf_dir):
    return rounded(profile.validation(apps(spark, sf_dir), _FEATURES, most_missing=0.05), 5)


@query(f"""WITH {APPS}, {_LONG} SELECT feature, count(value) AS n, count(*) - count(value) AS missing, count(DISTINCT value) AS n_unique, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75, max(value) AS max FROM l GROUP BY feature""")
def univariate_numeric(spark, sf_dir):
    return rounded(profile.univariate_numeric(apps(spark, sf_dir), _FEATURES).drop("skewness", "kurtosis"), 5)


@query(f"""WITH {APPS}, {_LONG}, m AS (SELECT feature, CAST(count(value) AS DOUBLE) AS n, avg(value) AS mu FROM l GROUP BY feature),
c AS (SELECT l.feature AS feature, max(n) AS n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4 FROM l JOIN m ON l.feature = m.feature WHERE value IS NOT NULL GROUP BY l.feature)
SELECT feature, round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 5) AS skewness, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 5) AS kurtosis FROM c""")
def univariate_shape(spark, sf_dir):
    return rounded(profile.univariate_numeric(apps(spark, sf_dir), _FEATURES).select("feature", "skewness", "kurtosis"), 5)


@query("""WITH l AS (SELECT 'p_type' AS feature, p_type AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part), n AS (SELECT feature, value, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY feature) AS total FROM n)
SELECT feature, CAST(rank AS INT) AS rank, value, n, round(n / CAST(total AS DOUBLE), 6) AS share FROM r WHERE rank <= 5""")
def univariate_categorical(spark, sf_dir):
    return rounded(profile.univariate_categorical(table(spark, sf_dir, "part"), ["p_type", "p_brand"]))


@query(f"WITH {APPS} SELECT d0 AS value, count(y) AS n, CAST(sum(y) AS BIGINT) AS events, round(avg(y), 6) AS event_rate FROM apps GROUP BY d0")
def event_rate_by_value(spark, sf_dir):
    return rounded(profile.event_rates(apps(spark, sf_dir), "d0", "y"))


@query(f"""WITH {APPS}, {_LONG}, s AS (SELECT feature, count(value) AS n, corr(value, y) AS c, avg(CASE WHEN y = 0 THEN value END) AS m0, avg(CASE WHEN y = 1 THEN value END) AS m1, count(CASE WHEN y = 0 THEN value END) AS n0, count(CASE WHEN y = 1 THEN value END) AS n1,
var_samp(CASE WHEN y = 0 THEN value END) AS v0, var_samp(CASE WHEN y = 1 THEN value END) AS v1 FROM l WHERE value IS NOT NULL GROUP BY feature)
SELECT feature, n, round(c, 6) AS correlation, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(m1 - m0, 6) AS mean_difference, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n - 2) * (1.0 / n0 + 1.0 / n1)), 5) AS t, n - 2 AS df FROM s""")
def bivariate_numeric(spark, sf_dir):
    out = profile.bivariate_numeric(apps(spark, sf_dir), _FEATURES, "y")
    return rounded(out.withColumn("t", F.round("t", 5)))


@query(f"""WITH {APPS}, l AS (SELECT 'l_linestatus' AS feature, l_linestatus AS value, y FROM apps UNION ALL SELECT 'yr', CAST(yr AS VARCHAR), y FROM apps), o AS (SELECT feature, value, y, count(*) AS o FROM l GROUP BY 1, 2, 3),
r AS (SELECT feature, value, sum(o) AS r FROM o GROUP BY 1, 2), c AS (SELECT feature, y, sum(o) AS c FROM o GROUP BY 1, 2), n AS (SELECT feature, sum(r) AS n, count(*) AS nr FROM r GROUP BY 1), k AS (SELECT feature, count(*) AS nc FROM c GROUP BY 1),
f AS (SELECT r.feature AS feature, n, nr, nc, abs(coalesce(o, 0) - r * c / CAST(n AS DOUBLE)) AS gap, r * c / CAST(n AS DOUBLE) AS e FROM r JOIN c ON r.feature = c.feature JOIN n ON r.feature = n.feature JOIN k ON r.feature = k.feature LEFT JOIN o ON o.feature = r.feature AND o.value = r.value AND o.y = c.y),
s AS (SELECT feature, CAST(max(n) AS BIGINT) AS n, sum(pow(CASE WHEN nr = 2 AND nc = 2 THEN greatest(gap - 0.5, 0) ELSE gap END, 2) / e) AS x, (max(nr) - 1) * (max(nc) - 1) AS df, least(max(nr), max(nc)) - 1 AS k FROM f GROUP BY feature)
SELECT feature, n, round(x, 4) AS statistic, df, round(sqrt(x / (n * k)), 6) AS cramers_v FROM s""")
def chi_squared(spark, sf_dir):
    return rounded(profile.chi_squared(apps(spark, sf_dir), ["l_linestatus", "yr"], "y").withColumn("statistic", F.round("statistic", 4)))


@query("WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS n_keys, max(n) AS most, round(avg(n), 6) AS mean, round(max(n) / avg(n), 6) AS skew_ratio FROM n")
def key_skew(spark, sf_dir):
    return rounded(profile.key_skew(table(spark, sf_dir, "lineitem"), "l_suppkey"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1")
def salted_aggregation(spark, sf_dir):
    return rounded(profile.salted_sums(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", salt_by="l_orderkey"), 4)


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem HAVING abs(corr(l_quantity, l_extendedprice)) >= 0.05 UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem HAVING abs(corr(l_quantity, l_tax)) >= 0.05 UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem HAVING abs(corr(l_extendedprice, l_tax)) >= 0.05")
def correlated_pairs(spark, sf_dir):
    return rounded(profile.correlated_pairs(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 0.05))


# --- stability -------------------------------------------------------------------------------------

_CUT = "2000-01-01"
_SIDES = f"{APPS}, ex AS (SELECT * FROM apps WHERE l_shipdate < TIMESTAMP '{_CUT}'), ac AS (SELECT * FROM apps WHERE l_shipdate >= TIMESTAMP '{_CUT}')"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = apps(spark, sf_dir)
    cut = F.lit(_CUT).cast("timestamp")
    return a.where(F.col("l_shipdate") < cut), a.where(F.col("l_shipdate") >= cut)


_PSI_STATUS = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'critical' END"
_PSI = "k AS (SELECT coalesce(e.b, a.b) AS b, coalesce(e.s, 1e-4) AS e, coalesce(a.s, 1e-4) AS a FROM e FULL JOIN a ON e.b = a.b)"


@query(f"""WITH {_SIDES}, q AS (SELECT list_distinct(quantile_cont(l_extendedprice, {_Q10})) AS q FROM ex),
e AS (SELECT len(list_filter(q, lambda x: l_extendedprice > x)) AS b, count(*) / CAST((SELECT count(*) FROM ex) AS DOUBLE) AS s FROM ex CROSS JOIN q GROUP BY 1), a AS (SELECT len(list_filter(q, lambda x: l_extendedprice > x)) AS b, count(*) / CAST((SELECT count(*) FROM ac) AS DOUBLE) AS s FROM ac CROSS JOIN q GROUP BY 1), {_PSI},
r AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM k) SELECT round(psi, 6) AS psi, {_PSI_STATUS} AS status FROM r""")
def psi_quantile(spark, sf_dir):
    return rounded(stability.psi_numeric(*_sides(spark, sf_dir), "l_extendedprice"))


@query(f"""WITH {_SIDES}, q AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM ex),
e AS (SELECT greatest(least(ceil((l_extendedprice - lo) / w) - 1, 9), 0) AS b, count(*) / CAST((SELECT count(*) FROM ex) AS DOUBLE) AS s FROM ex CROSS JOIN q GROUP BY 1), a AS (SELECT greatest(least(ceil((l_extendedprice - lo) / w) - 1, 9), 0) AS b, count(*) / CAST((SELECT count(*) FROM ac) AS DOUBLE) AS s FROM ac CROSS JOIN q GROUP BY 1), {_PSI},
r AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM k) SELECT round(psi, 6) AS psi, {_PSI_STATUS} AS status FROM r""")
def psi_equal_width(spark, sf_dir):
    return rounded(stability.psi_numeric(*_sides(spark, sf_dir), "l_extendedprice", method="width"))


@query(f"""WITH {_SIDES}, q AS (SELECT list_distinct(quantile_cont(l_extendedprice, {_Q10})) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM ex), i AS (SELECT * FROM ac CROSS JOIN q WHERE l_extendedprice BETWEEN lo AND hi),
e AS (SELECT len(list_filter(q, lambda x: l_extendedprice > x)) AS b, count(*) / CAST((SELECT count(*) FROM ex) AS DOUBLE) AS s FROM ex CROSS JOIN q GROUP BY 1), a AS (SELECT len(list_filter(q, lambda x: l_extendedprice > x)) AS b, count(*) / CAST((SELECT count(*) FROM i) AS DOUBLE) AS s FROM i GROUP BY 1), {_PSI},
r AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM k) SELECT round(psi, 6) AS psi, {_PSI_STATUS} AS status FROM r""")
def psi_in_range(spark, sf_dir):
    return rounded(stability.psi_numeric(*_sides(spark, sf_dir), "l_extendedprice", keep_outside=False))


@query(f"""WITH {_SIDES}, e AS (SELECT l_returnflag AS b, count(*) / CAST((SELECT count(*) FROM ex) AS DOUBLE) AS s FROM ex GROUP BY 1), a AS (SELECT l_returnflag AS b, count(*) / CAST((SELECT count(*) FROM ac) AS DOUBLE) AS s FROM ac GROUP BY 1), {_PSI}
SELECT b AS l_returnflag, round(e, 6) AS expected, round(a, 6) AS actual, round((a - e) * ln(a / e), 6) AS psi FROM k""")
def psi_categorical_breakdown(spark, sf_dir):
    return rounded(stability.psi_breakdown(*_sides(spark, sf_dir), "l_returnflag"))


def _psi_sql(column: str) -> str:
    q = f"(SELECT list_distinct(quantile_cont({column}, {_Q10})) FROM ex)"
    side = lambda t: f"(SELECT len(list_filter({q}, lambda x: {column} > x)) AS b, count(*) / CAST((SELECT count(*) FROM {t}) AS DOUBLE) AS s FROM {t} GROUP BY 1)"
    return f"SELECT '{column}' AS feature, sum((coalesce(a.s, 1e-4) - coalesce(e.s, 1e-4)) * ln(coalesce(a.s, 1e-4) / coalesce(e.s, 1e-4))) AS psi FROM {side('ex')} e FULL JOIN {side('ac')} a ON e.b = a.b"


@query(f"WITH {_SIDES}, r AS ({_psi_sql('l_quantity')} UNION ALL {_psi_sql('l_tax')} UNION ALL {_psi_sql('l_extendedprice')}) SELECT feature, round(psi, 6) AS psi, {_PSI_STATUS} AS status FROM r")
def psi_all_features(spark, sf_dir):
    return rounded(stability.psi_all(*_sides(spark, sf_dir), ["l_quantity", "l_tax", "l_extendedprice"]))


_KS_SUM = "least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * x * x))), 0), 1)"


def _drift_sql(columns: list[str]) -> str:
    """feature, psi, ks, ks_pvalue, level, mean_change_pct of the two sides."""
    psi = " UNION ALL ".join(_psi_sql(c) for c in columns)
    mean = " UNION ALL ".join(f"SELECT '{c}' AS feature, (SELECT avg({c}) FROM ex) AS r, (SELECT avg({c}) FROM ac) AS z" for c in columns)
    both = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, {e} AS e FROM {side}" for c in columns for side, e in (("ex", 1), ("ac", 0)))
    return f"""{_SIDES}, r AS ({psi}), m AS ({mean}), b AS ({both}), g AS (SELECT feature, v, sum(e) AS ne, sum(1 - e) AS na FROM b GROUP BY feature, v),
c AS (SELECT feature, sum(ne) OVER w AS ce, sum(na) OVER w AS ca, sum(ne) OVER (PARTITION BY feature) AS te, sum(na) OVER (PARTITION BY feature) AS ta FROM g WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT feature, max(abs(ce / CAST(te AS DOUBLE) - ca / CAST(ta AS DOUBLE))) AS ks, sqrt(max(te) * max(ta) / CAST(max(te) + max(ta) AS DOUBLE)) AS n FROM c GROUP BY feature),
x AS (SELECT feature, ks, (n + 0.12 + 0.11 / n) * ks AS x FROM s),
drift AS (SELECT r.feature AS feature, psi, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE {_KS_SUM} END AS ks_pvalue, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'critical' END AS level, (z - m.r) / m.r * 100 AS mean_change_pct
FROM r JOIN m ON r.feature = m.feature JOIN x ON r.feature = x.feature)"""


@query(f"WITH {_drift_sql(['l_quantity', 'l_tax'])} SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(ks_pvalue, 6) AS ks_pvalue, level, round(mean_change_pct, 6) AS mean_change_pct FROM drift")
def drift_report(spark, sf_dir):
    return rounded(stability.drift_report(*_sides(spark, sf_dir), ["l_quantity", "l_tax"]))


@query(f"""WITH {_drift_sql(['l_quantity', 'l_tax', 'l_extendedprice'])}, n AS (SELECT count(*) AS n_features, CAST(sum(CASE WHEN level = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
CAST(sum(CASE WHEN level = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning, CAST(sum(CASE WHEN level = 'stable' THEN 1 ELSE 0 END) AS BIGINT) AS stable FROM drift)
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'stable' END AS overall FROM n""")
def drift_overall(spark, sf_dir):
    return stability.overall_level(stability.drift_report(*_sides(spark, sf_dir), ["l_quantity", "l_tax", "l_extendedprice"]))


@query(f"""WITH {_SIDES}, e AS (SELECT l_linestatus AS b, avg(y) AS s FROM ex GROUP BY 1), a AS (SELECT l_linestatus AS b, avg(y) AS s FROM ac GROUP BY 1), {_PSI}
SELECT b AS l_linestatus, round(e, 6) AS expected, round(a, 6) AS actual, round((a - e) * ln(a / e), 6) AS csi FROM k""")
def csi(spark, sf_dir):
    return rounded(stability.csi(*_sides(spark, sf_dir), "l_linestatus", "y"))


@query(f"""WITH {_SIDES}, b AS (SELECT l_extendedprice AS v, 1 AS e FROM ex UNION ALL SELECT l_extendedprice, 0 FROM ac), g AS (SELECT v, sum(e) AS ne, sum(1 - e) AS na FROM b GROUP BY v),
c AS (SELECT sum(ne) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ce, sum(na) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ca, sum(ne) OVER () AS te, sum(na) OVER () AS ta FROM g)
SELECT round(max(abs(ce / CAST(te AS DOUBLE) - ca / CAST(ta AS DOUBLE))), 6) AS ks, CAST(max(te) AS BIGINT) AS n_expected, CAST(max(ta) AS BIGINT) AS n_actual FROM c""")
def ks_two_samples(spark, sf_dir):
    return rounded(stability.ks_two_samples(*_sides(spark, sf_dir), "l_extendedprice"))


@query(f"""WITH {APPS}, {_LONG} SELECT feature, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.75), 5) AS q75 FROM l GROUP BY feature""")
def reference_statistics(spark, sf_dir):
    return rounded(stability.reference_statistics(apps(spark, sf_dir), _FEATURES), 5)


# --- snapshots -------------------------------------------------------------------------------------

_DRIFT = f"""{APPS}, g AS (SELECT yr, l_linestatus, count(*) AS n, sum(y) AS events FROM apps GROUP BY 1, 2),
d AS (SELECT *, events / CAST(n AS DOUBLE) AS p, n / CAST(sum(n) OVER (PARTITION BY yr) AS DOUBLE) AS share FROM g)"""


@query(f"""WITH {_DRIFT} SELECT yr, l_linestatus, n, CAST(events AS BIGINT) AS events, round(p, 6) AS event_rate, round(share, 6) AS share,
round(greatest((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 0), 6) AS ci_low, round(least((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 1), 6) AS ci_high FROM d""")
def temporal_bin_drift(spark, sf_dir):
    return rounded(temporal.bin_drift(apps(spark, sf_dir), "yr", "l_linestatus", "y"))


@query(f"WITH {_DRIFT} SELECT d.yr AS yr, d.l_linestatus AS l_linestatus, round(d.p - b.p, 6) AS rate_delta, round(d.share - b.share, 6) AS share_delta FROM d JOIN d b ON d.l_linestatus = b.l_linestatus WHERE b.yr = (SELECT min(yr) FROM d)")
def temporal_bin_delta(spark, sf_dir):
    return rounded(temporal.bin_delta(apps(spark, sf_dir), "yr", "l_linestatus", "y"))


@query(f"""WITH {_DRIFT}, b AS (SELECT l_linestatus, share FROM d WHERE yr = 1995) SELECT yr, round(sum((d.share - b.share) * ln(d.share / b.share)), 6) AS psi FROM d JOIN b ON d.l_linestatus = b.l_linestatus GROUP BY yr""")
def temporal_psi(spark, sf_dir):
    return rounded(temporal.psi_by_snapshot(apps(spark, sf_dir), "yr", "l_linestatus", 1995))


_SNAP = f"""{APPS}, g AS (SELECT yr, l_extendedprice AS s, sum(y) AS pos, sum(1 - y) AS neg FROM apps GROUP BY 1, 2),
c AS (SELECT yr, s, pos, neg, coalesce(sum(pos) OVER (PARTITION BY yr ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(neg) OVER (PARTITION BY yr ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(pos) OVER (PARTITION BY yr) AS tp, sum(neg) OVER (PARTITION BY yr) AS tn FROM g)"""


@query(f"""WITH {_SNAP}, a AS (SELECT yr, count(*) AS n, avg(CASE WHEN l_extendedprice >= 50000 THEN 1 ELSE 0 END) AS ap, avg(y) AS br FROM apps GROUP BY 1),
k AS (SELECT yr, sum(least(greatest((greatest(floor((tp + tn) / 10), 1) - pb - nb) / CAST(pos + neg AS DOUBLE), 0), 1) * pos) / max(tp) AS c10, sum(least(greatest((greatest(floor((tp + tn) / 5), 1) - pb - nb) / CAST(pos + neg AS DOUBLE), 0), 1) * pos) / max(tp) AS c20 FROM c GROUP BY yr)
SELECT a.yr AS yr, n, round(ap, 6) AS approval_rate, round(br, 6) AS bad_rate, round(c10, 6) AS capture_10, round(c20, 6) AS capture_20 FROM a JOIN k ON a.yr = k.yr""")
def temporal_stability(spark, sf_dir):
    return rounded(temporal.stability_by_snapshot(apps(spark, sf_dir), "yr", "l_extendedprice", "y", 50000))


@query(f"WITH {_SNAP} SELECT yr, round(greatest(max((pb + pos) / CAST(tp AS DOUBLE) - (nb + neg) / CAST(tn AS DOUBLE)), 0), 6) AS ks FROM c GROUP BY yr")
def temporal_ks(spark, sf_dir):
    return rounded(temporal.ks_by_snapshot(apps(spark, sf_dir), "yr", "l_extendedprice", "y"))


@query(f"WITH {APPS} SELECT yr, CAST(greatest(least(floor(l_quantity / 5.0), 9), 0) AS INT) AS bin, count(*) AS n, CAST(sum(1 - y) AS BIGINT) AS goods, CAST(sum(y) AS BIGINT) AS bads FROM apps GROUP BY 1, 2")
def score_histogram(spark, sf_dir):
    return temporal.score_histogram(apps(spark, sf_dir), "l_quantity", "y", 0, 50, 10, ["yr"])


# --- monitoring ------------------------------------------------------------------------------------


@query(f"""WITH {APPS}, m AS (SELECT yr, count(*) AS n, sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS fn FROM apps GROUP BY yr),
g AS (SELECT yr, p, sum(y) AS pos, sum(1 - y) AS neg FROM apps GROUP BY 1, 2), c AS (SELECT yr, pos, neg, coalesce(sum(neg) OVER (PARTITION BY yr ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g), a AS (SELECT yr, sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY yr)
SELECT m.yr AS yr, n AS n_samples, CAST(tp + fn AS BIGINT) AS n_positive, CAST(tp + fp AS BIGINT) AS n_predicted_positive, round((tp + fn) / CAST(n AS DOUBLE), 6) AS actual_rate, round((tp + fp) / CAST(n AS DOUBLE), 6) AS predicted_rate, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(auc, 6) AS auc FROM m JOIN a ON m.yr = a.yr""")
def performance_by_batch(spark, sf_dir):
    return rounded(monitoring.batch_performance(apps(spark, sf_dir), "yr", "y", "p"))


def _batch_sql() -> str:
    """``performance_by_batch`` before its rounding."""
    return SQL["performance_by_batch"].replace(_P, "@p").replace("round(", "(").replace(", 6)", ")").replace("@p", _P)


@query(f"""WITH per AS ({_batch_sql()}), m AS (SELECT * FROM (VALUES ('auc', CAST(0.05 AS DOUBLE)), ('precision', CAST(0.1 AS DOUBLE)), ('recall', CAST(0.1 AS DOUBLE)), ('f1', CAST(0.1 AS DOUBLE))) AS v(metric, "limit")),
v AS (SELECT yr, unnest([{{'metric': 'auc', 'value': auc}}, {{'metric': 'precision', 'value': precision}}, {{'metric': 'recall', 'value': recall}}, {{'metric': 'f1', 'value': f1}}]) AS e FROM per),
x AS (SELECT m.metric AS metric, b.e.value AS baseline, c.e.value AS current, "limit", (b.e.value - c.e.value) / b.e.value AS fall FROM m JOIN v b ON b.e.metric = m.metric AND b.yr = 1995 JOIN v c ON c.e.metric = m.metric AND c.yr = 2000)
SELECT metric, round(baseline, 6) AS baseline, round(current, 6) AS current, "limit", round(fall, 6) AS fall, CASE WHEN fall > 2 * "limit" THEN 'critical' WHEN fall > "limit" THEN 'alert' ELSE 'ok' END AS level FROM x""")
def performance_health(spark, sf_dir):
    per = monitoring.batch_performance(apps(spark, sf_dir), "yr", "y", "p")
    return rounded(monitoring.health(per.where("yr = 2000"), per.where("yr = 1995")))


@query("""WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q, event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS mn, max(value) AS mx, sum(CASE WHEN value < 10 OR value > 300 THEN 1 ELSE 0 END) AS o FROM events GROUP BY event_type)
SELECT event_type, n, round(m, 6) AS mean, round(q[2], 6) AS median, round(sd, 6) AS std, mn AS min, mx AS max, round(q[1], 6) AS q25, round(q[3], 6) AS q75, CAST(o AS BIGINT) AS out_of_range, round(100 * o / CAST(n AS DOUBLE), 6) AS out_of_range_pct FROM q""")
def prediction_statistics(spark, sf_dir):
    return rounded(monitoring.prediction_statistics(table(spark, sf_dir, "events"), "value", ["event_type"], 10, 300))


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events CROSS JOIN q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def anomalies_iqr(spark, sf_dir):
    return monitoring.anomalies(table(spark, sf_dir, "events").select("event_id", "value"), "value")


@query("WITH q AS (SELECT avg(value) AS a, stddev_pop(value) AS b FROM events) SELECT event_id, value FROM events CROSS JOIN q WHERE abs(value - a) > 2.5 * b")
def anomalies_zscore(spark, sf_dir):
    return monitoring.anomalies(table(spark, sf_dir, "events").select("event_id", "value"), "value", "zscore", 2.5)


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_type AS severity, count(*) AS n, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_active FROM r WHERE rn = 1 GROUP BY 1""")
def alert_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("alert_id"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("severity"), F.when(F.col("user_id") % 3 == 0, "active").otherwise("resolved").alias("status"))
    return monitoring.alert_summary(monitoring.alert_state(e))


@query("""WITH q AS (SELECT event_type, count(value) AS n, sum(value) AS s, avg(value) AS m, min(value) AS mn, max(value) AS mx, quantile_cont(value, [0.5, 0.95, 0.99]) AS q FROM events GROUP BY 1)
SELECT event_type, n AS count, round(s, 4) AS sum, round(m, 6) AS mean, round(q[1], 6) AS median, mn AS min, mx AS max, round(q[1], 6) AS p50, round(q[2], 6) AS p95, round(q[3], 6) AS p99 FROM q""")
def metric_histograms(spark, sf_dir):
    h = monitoring.histogram_metrics(table(spark, sf_dir, "events"), "event_type", "value")
    return rounded(h.withColumn("sum", F.round("sum", 4)))


@query(f"""WITH h AS ({SQL['metric_histograms']}), l AS (SELECT unnest(['oddsmill_count{{name="' || event_type || '"}} ' || CAST(count AS VARCHAR), 'oddsmill_value{{name="' || event_type || '",quantile="0.5"}} ' || CAST(p50 AS VARCHAR),
'oddsmill_value{{name="' || event_type || '",quantile="0.95"}} ' || CAST(p95 AS VARCHAR), 'oddsmill_value{{name="' || event_type || '",quantile="0.99"}} ' || CAST(p99 AS VARCHAR)]) AS line FROM h) SELECT line FROM l""")
def prometheus_lines(spark, sf_dir):
    return monitoring.prometheus(monitoring.histogram_metrics(table(spark, sf_dir, "events"), "event_type", "value"), "event_type")


# --- models ----------------------------------------------------------------------------------------

_MODEL = ["l_quantity", "l_discount", "l_tax"]


def _training(spark, sf_dir) -> DataFrame:
    return apps(spark, sf_dir).withColumn("y", (F.col("l_quantity") * F.col("l_discount") * 2 + F.col("l_tax") * 10 > 2.5).cast("int"))


@query()
def logistic_coefficients(spark, sf_dir):
    return rounded(models.Logistic.fit(_training(spark, sf_dir), _MODEL, "y").table(spark), 2)


@query()
def logistic_on_compressed(spark, sf_dir):
    groups = compression.weighted_labels(compression.compress(_training(spark, sf_dir), _MODEL, "y"), "y", "w")
    return rounded(models.Logistic.fit(groups, _MODEL, "y", "w").table(spark), 2)


_FIXED = models.Logistic(_MODEL, [0.05, 4.0, -2.0], -1.5)
_Z = "(-1.5 + 0.05 * l_quantity + 4.0 * l_discount - 2.0 * l_tax)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-{_Z})), 6) AS p, CASE WHEN 1 / (1 + exp(-{_Z})) >= 0.5 THEN 1 ELSE 0 END AS class FROM lineitem")
def logistic_scoring(spark, sf_dir):
    scored = _FIXED.score(table(spark, sf_dir, "lineitem").select(*_KEYS, *_MODEL))
    return scored.select(*_KEYS, F.round("p", 6).alias("p"), N.predicted_class(F.col("p")).alias("class"))


@query("""WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem), l AS (SELECT 'l_quantity' AS feature, 0.05 * (l_quantity - q) AS phi FROM lineitem CROSS JOIN m UNION ALL SELECT 'l_discount', 4.0 * (l_discount - d) FROM lineitem CROSS JOIN m UNION ALL SELECT 'l_tax', -2.0 * (l_tax - t) FROM lineitem CROSS JOIN m)
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs, abs(round(avg(phi), 6)) AS mean, round(max(phi), 6) AS max FROM l GROUP BY feature""")
def shapley_importance(spark, sf_dir):
    return rounded(_FIXED.contributions(table(spark, sf_dir, "lineitem").select(*_MODEL)).withColumn("mean", F.abs(F.round("mean", 6))))


@query(f"""WITH i AS (SELECT *, [{{'impact': 0.05 * l_quantity, 'feature': 'l_quantity'}}, {{'impact': 4.0 * l_discount, 'feature': 'l_discount'}}, {{'impact': -2.0 * l_tax, 'feature': 'l_tax'}}] AS a FROM lineitem)
SELECT feature AS worst, count(*) AS n FROM (SELECT list_sort(a)[1].feature AS feature FROM i) GROUP BY 1""")
def reason_codes(spark, sf_dir):
    li = _FIXED.score(table(spark, sf_dir, "lineitem").select(*_MODEL))
    out = models.reason_codes(li, dict(zip(_MODEL, _FIXED.coefficients, strict=True)), "p", 2.0)
    return out.groupBy(F.col("reasons")[0]["feature"].alias("worst")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SIDES}, r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER () AS n FROM ac)
SELECT 'accept' AS _source, y, count(*) AS n FROM ex GROUP BY y UNION ALL SELECT 'reject', CASE WHEN rn <= floor(n * 0.3) THEN 1 ELSE 0 END AS y, count(*) FROM r GROUP BY 2""")
def reject_parceling(spark, sf_dir):
    accepts, rejects = _sides(spark, sf_dir)
    return models.parceled(accepts, rejects.drop("y"), "l_extendedprice", "y", 0.3, _KEYS).groupBy("_source", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SIDES}, b AS (SELECT (SELECT min(l_extendedprice) FROM ex) AS la, (SELECT max(l_extendedprice) FROM ex) AS ha, (SELECT avg(l_extendedprice) FROM ex) AS ma, (SELECT min(l_extendedprice) FROM ac) AS lr, (SELECT max(l_extendedprice) FROM ac) AS hr, (SELECT avg(l_extendedprice) FROM ac) AS mr)
SELECT round((least(ha, hr) - greatest(la, lr)) / (greatest(ha, hr) - least(la, lr)), 6) AS overlap_ratio, round(ma - mr, 4) AS mean_separation FROM b""")
def reject_overlap(spark, sf_dir):
    out = models.overlap(*_sides(spark, sf_dir), "l_extendedprice")
    return rounded(out.withColumn("mean_separation", F.round("mean_separation", 4)))


@query()
def reject_reweighting(spark, sf_dir):
    out = models.reweighted(_training(spark, sf_dir).withColumn("accepted", (F.col("l_quantity") + F.col("l_tax") * 200 > 25).cast("int")), "accepted", ["l_discount", "l_tax"])
    return rounded(out.groupBy("accepted").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("lo"), F.max("weight").alias("hi")), 2)


@query(f"WITH {APPS} SELECT 'l_quantity' AS feature, round(abs(corr(l_quantity, y)), 6) AS importance FROM apps UNION ALL SELECT 'l_discount', round(abs(corr(l_discount, y)), 6) FROM apps UNION ALL SELECT 'l_tax', round(abs(corr(l_tax, y)), 6) FROM apps")
def correlation_importance(spark, sf_dir):
    return rounded(models.correlation_importance(apps(spark, sf_dir), _MODEL, "y"))


_TRAINING = "t AS (SELECT *, CASE WHEN l_quantity * l_discount * 2 + l_tax * 10 > 2.5 THEN 1 ELSE 0 END AS y FROM lineitem)"


def _auc_sql(score: str) -> str:
    """The area under the curve of a score of ``t`` and its label."""
    return f"""(SELECT sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
FROM (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM (SELECT round({score}, 12) AS s, y FROM t) GROUP BY s)))"""


def _dropped(f: str) -> str:
    return _Z.replace(f, f"(SELECT avg({f}) FROM t)")


_DROPS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {_auc_sql(f'1 / (1 + exp(-{_Z}))')} - {_auc_sql(f'1 / (1 + exp(-{_dropped(f)}))')} AS importance" for f in _MODEL)


@query(f"WITH {_TRAINING}, d AS ({_DROPS}) SELECT feature, round(importance, 6) AS importance FROM d")
def drop_column_importance(spark, sf_dir):
    return rounded(models.drop_column_importance(_training(spark, sf_dir), _FIXED, "y"))


@query()
def permutation_importance(spark, sf_dir):
    return rounded(models.permutation_importance(_training(spark, sf_dir), _FIXED, "y", _KEYS, repeats=1))


@query(f"""WITH {_TRAINING}, d AS ({_DROPS}), c AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, abs(corr({f}, y)) AS importance FROM t" for f in _MODEL)}),
r AS (SELECT feature, rank() OVER (ORDER BY importance DESC) AS k FROM d UNION ALL SELECT feature, rank() OVER (ORDER BY importance DESC) FROM c) SELECT feature, round(1 / avg(k), 6) AS consensus FROM r GROUP BY feature""")
def consensus_importance(spark, sf_dir):
    t = _training(spark, sf_dir)
    return rounded(models.consensus([models.correlation_importance(t, _MODEL, "y"), models.drop_column_importance(t, _FIXED, "y")]))


@query()
def random_forest_importance(spark, sf_dir):
    return rounded(models.tree_importance(spark, models.forest(_training(spark, sf_dir), _MODEL, "y", trees=10), _MODEL), 3)


@query()
def boosted_trees_auc(spark, sf_dir):
    t = _training(spark, sf_dir)
    return rounded(ranking.auc_table(models.tree_score(models.boosted(t, _MODEL, "y", rounds=5), t, _MODEL, "q"), "y", "q"), 3)


@query()
def feature_selection(spark, sf_dir):
    c = compression.weighted_labels(compression.compress(_training(spark, sf_dir).withColumn("noise", F.pmod(F.col("l_orderkey"), F.lit(3)).cast("double")), ["l_quantity", "l_discount", "noise"], "y"), "y", "w")
    trail = models.select_features(c, ["l_quantity", "l_discount", "noise"], "y", ["l_quantity", "l_discount", "noise"], folds=2, weight="w", most=2)
    return rounded(spark.createDataFrame([(i, list(s), v) for i, (s, v) in enumerate(trail)], "step int, features array<string>, auc double"), 2)


# --- governance and sources ------------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("created_at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
def run_registry_latest(spark, sf_dir):
    return governance.list_runs(_runs(spark, sf_dir), status="F", limit=20)


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)), b AS (SELECT * FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders))
SELECT 'status' AS field, a.o_orderstatus AS a, b.o_orderstatus AS b, a.o_orderstatus = b.o_orderstatus AS same FROM a CROSS JOIN b UNION ALL SELECT 'user_id', CAST(a.o_custkey AS VARCHAR), CAST(b.o_custkey AS VARCHAR), a.o_custkey = b.o_custkey FROM a CROSS JOIN b""")
def run_comparison(spark, sf_dir):
    runs = _runs(spark, sf_dir).drop("created_at")
    ends = runs.agg(F.min(F.col("run_id").cast("long")), F.max(F.col("run_id").cast("long"))).first()
    return governance.compare_runs(runs, str(ends[0]), str(ends[1]))


_LINKS = """links AS (SELECT 'order:' || o_orderkey AS child, 'customer:' || o_custkey AS parent FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""


@query(f"""WITH RECURSIVE {_LINKS}, up AS (SELECT 'order:' || min(o_orderkey) AS artifact, 0 AS depth FROM orders UNION SELECT parent, depth + 1 FROM links JOIN up ON child = artifact WHERE depth < 20)
SELECT artifact, CAST(min(depth) AS INT) AS depth FROM up GROUP BY artifact""")
def artifact_lineage(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    link = lambda t, a, x, b, y: table(spark, sf_dir, t).select(name(a, x).alias("child"), name(b, y).alias("parent"))
    parts = [
        link("orders", "order", "o_orderkey", "customer", "o_custkey"), link("customer", "customer", "c_custkey", "nation", "c_nationkey"), link("nation", "nation", "n_nationkey", "region", "n_regionkey"),
        link("lineitem", "order", "l_orderkey", "part", "l_partkey"), link("lineitem", "part", "l_partkey", "supplier", "l_suppkey"), link("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    ]
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return governance.lineage(reduce(DataFrame.unionByName, parts), f"order:{first}")


@query()
def data_hash(spark, sf_dir):
    return profile.data_hash(table(spark, sf_dir, "orders"))


@query()
def train_test_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(governance.split_of(["o_orderkey"]).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1")
def time_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(governance.time_split("o_orderdate", "2000-01-01").alias("part")).agg(F.count(F.lit(1)).alias("n"))


# --- whole cards and reports -----------------------------------------------------------------------


@query()
def scorecard_pipeline(spark, sf_dir):
    t = _training(spark, sf_dir)
    card = scorecard.Scorecard.fit(t, _MODEL, "y")
    scored = card.score(t.select(*_MODEL, "y")).withColumn("band", F.floor(F.col("score") / 50))
    return rounded(scored.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("bad_rate")), 3)


@query(f"""WITH {CURVE}, {_CAL.replace(APPS + ',', '').strip()}, {_CELLS.replace(APPS + ',', '').strip()},
a AS (SELECT sum(pos * (nb + neg / 2.0)) / (max(tp) * max(tn)) AS auc, max((tp - pb) / CAST(tp AS DOUBLE) - (tn - nb) / CAST(tn AS DOUBLE)) AS ks, greatest(1 - min(tn - nb + pb) / CAST(least(max(tp), max(tn)) AS DOUBLE), 0) AS h FROM c),
s AS (SELECT avg((p - y) * (p - y)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS ll FROM apps), e AS (SELECT sum(n * abs(mean_p - rate)) / sum(n) AS ece, max(abs(mean_p - rate)) AS mce FROM b),
r AS (SELECT 'auc' AS metric, auc AS value FROM a UNION ALL SELECT 'gini', 2 * auc - 1 FROM a UNION ALL SELECT 'ks', ks FROM a UNION ALL SELECT 'h_measure', h FROM a UNION ALL SELECT 'accuracy', (tp + tn) / (tp + fp + tn + fn) FROM m UNION ALL SELECT 'precision', tp / (tp + fp) FROM m
UNION ALL SELECT 'recall', tp / (tp + fn) FROM m UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM m UNION ALL SELECT 'mcc', (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) FROM m
UNION ALL SELECT 'brier', brier FROM s UNION ALL SELECT 'log_loss', ll FROM s UNION ALL SELECT 'ece', ece FROM e UNION ALL SELECT 'mce', mce FROM e)
SELECT metric, round(value, 6) AS value, CASE WHEN metric = 'auc' THEN CASE WHEN value >= 0.9 THEN 'excellent' WHEN value >= 0.8 THEN 'good' WHEN value >= 0.7 THEN 'fair' WHEN value >= 0.6 THEN 'poor' ELSE 'very poor' END
WHEN metric = 'gini' THEN CASE WHEN value >= 0.6 THEN 'strong' WHEN value >= 0.4 THEN 'moderate' WHEN value >= 0.2 THEN 'weak' ELSE 'very poor' END
WHEN metric = 'ks' THEN CASE WHEN value >= 0.4 THEN 'strong' WHEN value >= 0.3 THEN 'moderate' WHEN value >= 0.2 THEN 'weak' ELSE 'very poor' END
WHEN metric = 'brier' THEN CASE WHEN value < 0.1 THEN 'good' WHEN value < 0.2 THEN 'fair' ELSE 'poor' END END AS grade FROM r""")
def evaluation_report(spark, sf_dir):
    return rounded(evaluation.evaluation_report(apps(spark, sf_dir), "y", "p"))


def _compared_sql(name: str, score: str) -> str:
    curve = f"(SELECT s, pos, neg, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb FROM (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM (SELECT round({score}, 12) AS s, y FROM t) GROUP BY s) WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    return f"""SELECT '{name}' AS model, a.auc AS auc, 2 * a.auc - 1 AS gini, a.ks AS ks, (SELECT avg(({score} - y) * ({score} - y)) FROM t) AS brier
FROM (SELECT sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, max((1 - pb / (SELECT sum(y) FROM t)) - (1 - nb / (SELECT sum(1 - y) FROM t))) AS ks FROM {curve}) a"""


@query(f"WITH {_TRAINING}, m AS ({_compared_sql('linear', f'1 / (1 + exp(-{_Z}))')} UNION ALL {_compared_sql('other', 'l_discount * 10')}) SELECT model, round(auc, 6) AS auc, round(gini, 6) AS gini, round(ks, 6) AS ks, round(brier, 6) AS brier FROM m")
def model_comparison(spark, sf_dir):
    a = _FIXED.score(_training(spark, sf_dir), "linear").withColumn("linear", F.round("linear", 12)).withColumn("other", F.round(F.col("l_discount") * 10, 12))
    return rounded(evaluation.compare_models(a, "y", ["linear", "other"]))


@query(f"""WITH {APPS}, e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8])) AS q FROM apps)
SELECT CAST(len(list_filter(q, lambda x: l_extendedprice > x)) AS INT) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(avg(y), 6) AS event_rate FROM apps CROSS JOIN e GROUP BY 1""")
def score_bands_observed(spark, sf_dir):
    a = apps(spark, sf_dir)
    t = binning.bin_table(stability.with_quantile_bin(a, stability.quantile_edges(a, "l_extendedprice", 5), "l_extendedprice"), ["bin"], "y")
    return rounded(t.select("bin", "n", "events", (F.col("events") / F.col("n")).alias("event_rate")))


@query(f"""WITH {_SIDES}, q AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8])) AS q FROM ex),
e AS (SELECT CAST(len(list_filter(q, lambda x: l_extendedprice > x)) AS INT) AS b, avg(y) AS s FROM ex CROSS JOIN q GROUP BY 1), a AS (SELECT CAST(len(list_filter(q, lambda x: l_extendedprice > x)) AS INT) AS b, avg(y) AS s FROM ac CROSS JOIN q GROUP BY 1), {_PSI}
SELECT b AS bin, round(e, 6) AS expected, round(a, 6) AS actual, round((a - e) * ln(a / e), 6) AS csi FROM k""")
def csi_by_score(spark, sf_dir):
    ex, ac = _sides(spark, sf_dir)
    cut = stability.quantile_edges(ex, "l_extendedprice", 5)
    place = lambda d: stability.with_quantile_bin(d, cut, "l_extendedprice").select("bin", "y")
    return rounded(stability.csi(place(ex), place(ac), "bin", "y"))


@query(f"""WITH i AS (SELECT l_orderkey, 1 / (1 + exp(-{_Z})) AS p, [{{'impact': 0.05 * l_quantity, 'feature': 'l_quantity', 'code': 'RC01'}}, {{'impact': 4.0 * l_discount, 'feature': 'l_discount', 'code': 'RC02'}}, {{'impact': -2.0 * l_tax, 'feature': 'l_tax', 'code': 'RC03'}}] AS a FROM lineitem)
SELECT l_orderkey, '{{"application":' || CAST(l_orderkey AS VARCHAR) || ',"score":' || CAST(round(p, 6) AS VARCHAR) || ',"codes":["' || array_to_string(list_transform(list_sort(a), lambda r: r.code), '","') || '"]}}' AS notice FROM i""")
def adverse_notices(spark, sf_dir):
    li = _FIXED.score(table(spark, sf_dir, "lineitem").select(*_KEYS, *_MODEL))
    out = models.reason_codes(li, dict(zip(_MODEL, _FIXED.coefficients, strict=True)), "p", 2.0, {f: f"RC{i:02d}" for i, f in enumerate(_MODEL, 1)})
    return models.adverse_notice(out, "l_orderkey", "p")


@query("SELECT 'not_null:o_custkey' AS \"check\", CAST(0 AS BIGINT) AS n_bad, true AS ok UNION ALL SELECT 'type:o_orderkey', 0, true UNION ALL SELECT 'type:o_totalprice', 0, true")
def source_contract(spark, sf_dir):
    return io.contract(table(spark, sf_dir, "orders"), {"o_orderkey": "bigint", "o_totalprice": "double"}, ["o_custkey"])
