"""Micro-fixtures with answers by hand, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.functions import numeric as N
from oddsmill.operators import binning, calibration, classification, compression, encoding, governance, models, profile, ranking, stability, temporal, trends
from oddsmill.operators.curves import cumulative
from oddsmill.plans.recipes import Plan, Recipe, build_features, in_window, lineage, ordered, registry


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(1)
    rows = [(int(rnd.random() < p), round(p, 2)) for p in (rnd.betavariate(2, 5) for _ in range(800))]
    return spark.createDataFrame(rows, "y int, p double"), rows


def test_auc_ks_by_hand(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert ranking.auc_table(df, "y", "p").first()[:2] == (0.75, 0.5)
    assert ranking.ks_table(df, "y", "p").first()["ks"] == 0.5
    one = spark.createDataFrame([(1, 0.5)], "y int, p double")
    assert ranking.auc_table(one, "y", "p").first()["auc"] is None


def test_auc_by_pairs_and_with_weights(spark, scored):
    df, rows = scored
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(ranking.auc_table(df, "y", "p").first()["auc"] - want) < 1e-12
    packed = df.groupBy("y", "p").agg(F.count(F.lit(1)).alias("w"))
    assert abs(ranking.auc_table(packed, "y", "p", "w").first()["auc"] - want) < 1e-12


def test_cumulative_over_any_bounds(spark):
    rnd = random.Random(2)
    values = [rnd.choice([-5.0, -1.5, 0.0, 3.0, 1e6]) for _ in range(100)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = {r.v: r.n_below for r in cumulative(df, "v", {"n": F.lit(1)}, low=None, high=None, buckets=7).collect()}
    assert out == {v: sum(1 for x in values if x is not None and x < v) for v in set(values) - {None}}


def test_encoders_by_hand(spark):
    df = spark.createDataFrame(list(zip("ABCABCAADD", [1, 0, 1, 1, 0, 0, 1, 1, 0, 1])), "c string, y int")
    freq = {r.category: r.share for r in encoding.frequencies(df, "c").collect()}
    assert freq == {"A": 0.4, "B": 0.2, "C": 0.2, "D": 0.2}
    means = {r.category: round(r.value, 6) for r in encoding.target_means(df, "c", "y").collect()}
    assert means["A"] == 0.92 and means["B"] == 0.2
    rare = {r.category: r.label for r in encoding.rare_map(df, "c", 0.25).collect()}
    assert rare == {"A": "A", "B": "RARE", "C": "RARE", "D": "RARE"}
    odd = df.unionByName(spark.createDataFrame([(None, 1)], "c string, y int"))
    assert odd.count() == encoding.frequency_encoded(odd, "c").where("c_freq > 0").count()


def test_trends_by_hand(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 12.0, 0.0])], "g string, t int, v double")
    panel = trends.Panel(("g",), ("t",))
    out = df.withColumn("_n", trends.row_numbers(panel)).select("t", trends.delta(panel, "v").alias("d"), trends.pct_change(panel, "v").alias("c"), trends.slope(panel, "v", 3).alias("s"), trends.rolling_rank(panel, "v", 3).alias("r")).orderBy("t").collect()
    assert [r.d for r in out] == [None, 2, -12] and [r.s for r in out] == [None, 2, -5]
    assert out[0].r is None and out[1].r == 1 and abs(out[2].r - 1 / 3) < 1e-12
    with pytest.raises(ValueError):
        trends.delta(trends.Panel(("g",), ()), "v")


def test_ratio_policies_and_labels(spark):
    row = spark.range(1).select(*[N.safe_ratio(F.lit(5.0), F.lit(0.0), p, 7).alias(p) for p in ("nan", "zero", "constant")], N.iv_strength(F.lit(0.2)).alias("iv"), N.psi_status(F.lit(0.3)).alias("psi"), N.log_of(F.lit(-2.0)).alias("log")).first()
    assert tuple(row) == (None, 0.0, 7.0, "Medium", "critical", None)


def test_scaling_by_hand(spark):
    row = spark.range(1).select(calibration.score_of(F.lit(1 / 51)).alias("a"), calibration.score_of(F.lit(1 / 101)).alias("b"), calibration.probability_of(F.lit(600.0)).alias("p")).first()
    assert abs(row.a - 600) < 1e-9 and abs(row.b - 620) < 1e-9 and abs(row.p - 1 / 51) < 1e-12


def test_compression_round_trip(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 1), (None, 0)], "k string, y int")
    c = compression.compress(df, ["k"], "y")
    assert {r.k: (r.sample_weight, r.event_weight) for r in c.collect()} == {"a": (3, 1.0), "b": (1, 1.0), None: (1, 0.0)}
    compression.verify(df, c, "y")
    with pytest.raises(compression.CompressionError):
        compression.verify(df, c.where("k = 'a'"), "y")
    back = sorted((r.k or "", r.label) for r in compression.expand(c).collect())
    assert back == sorted((r.k or "", r.y) for r in df.collect())


def test_psi_of_itself_is_zero_and_missing_sides_count(spark):
    a = spark.createDataFrame([(x,) for x in "aabbc"] + [(None,)], "k string")
    assert stability.psi(a, a, "k").first()["psi"] == 0
    b = spark.createDataFrame([("d",)] * 5, "k string")
    want = sum((x - e) * math.log(x / e) for e, x in [(2 / 6, 1e-4), (2 / 6, 1e-4), (1 / 6, 1e-4), (1 / 6, 1e-4), (1e-4, 1.0)])
    assert abs(stability.psi(a, b, "k").first()["psi"] - want) < 1e-9


def _pav(bins, up):
    out = []
    for n, e in bins:
        out.append([n, e])
        while len(out) > 1 and (out[-2][1] * out[-1][0] > out[-1][1] * out[-2][0] if up else out[-2][1] * out[-1][0] < out[-1][1] * out[-2][0]):
            n, e = out.pop()
            out[-1][0] += n
            out[-1][1] += e
    return [tuple(x) for x in out]


@pytest.mark.parametrize("direction", ["up", "down"])
def test_monotone_bins(spark, direction):
    rnd = random.Random(7)
    for bins in ([(rnd.randint(5, 50), 0) for _ in range(12)], [(10, 5)]):
        bins = [(n, rnd.randint(0, n)) for n, _ in bins]
        df = spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(bins)], "bin int, n long, events long")
        out = [(r.n, r.events) for r in binning.monotone_bins(df, direction=direction).orderBy("bin").collect()]
        assert out == _pav(bins, direction == "up")


def test_coarse_and_optimal_bins(spark):
    rnd = random.Random(8)
    bins = [(i, n := rnd.randint(10, 60), rnd.randint(0, n)) for i in range(15)]
    df = spark.createDataFrame(bins, "bin int, n long, events long")
    coarse = binning.coarse_bins(df, least_rows=100, least_share=0.0)
    sizes = {r.coarse: r.s for r in coarse.groupBy("coarse").agg(F.sum("n").alias("s")).collect()}
    assert min(sizes.values()) >= 100 and sorted(sizes) == list(range(len(sizes))) and sum(sizes.values()) == sum(n for _, n, _ in bins)
    best = binning.optimal_bins(df, most=3).orderBy("bin").collect()
    assert len(best) <= 3 and sum(r.n for r in best) == sum(n for _, n, _ in bins)
    rates = [r.event_rate for r in best]
    assert rates in (sorted(rates), sorted(rates, reverse=True))


def test_tree_bins_find_the_step(spark):
    df = spark.createDataFrame([(float(i), int(i > 70)) for i in range(100)], "x double, y int")
    assert binning.tree_bins(df, "x", "y", most=2) and abs(binning.tree_bins(df, "x", "y", most=2)[0] - 70) < 2


def test_calibration_fits(spark, scored):
    df, rows = scored
    slope, intercept = calibration.slope_intercept(df, "y", "p")
    assert 0.5 < slope < 1.6 and abs(intercept) < 0.7
    shift = calibration.intercept_shift(df, "p", 0.4)
    assert abs(df.agg(F.avg(calibration.shifted(F.col("p"), shift))).first()[0] - 0.4) < 1e-9
    assert abs(calibration.intercept_shift(df, "p", 0.9999) - 5) < 1e-3
    assert calibration.hosmer_lemeshow(df, "y", "p")["p_value"] > 0.001


def test_tails():
    assert abs(N.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(N.chi2_tail(18.307, 10) - 0.05) < 1e-5 and N.chi2_tail(0, 3) == 1
    assert abs(N.t_two_sided(2.228139, 10) - 0.05) < 1e-6 and abs(N.ks_tail(0.207, 1000, 1000)) < 1e-15


def test_classification_edges(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8)], "y int, p double")
    row = classification.metrics(df, "y", "p").first()
    assert row.recall == 1 and row.specificity == 0 and row.diagnostic_odds_ratio is None
    assert classification.best_threshold(df, "y", "p").first()["score"] == 1


def test_recipes_order_cycles_and_lineage(spark):
    rs = (Recipe("c", "difference", ("b", "x")), Recipe("b", "ratio", ("x", "y")))
    assert [r.name for r in ordered(rs)] == ["b", "c"]
    with pytest.raises(ValueError, match="a -> b -> a"):
        ordered((Recipe("a", "log", ("b",)), Recipe("b", "log", ("a",))))
    assert lineage(rs, "c")["inputs"][0]["inputs"][0] == {"name": "x", "inputs": []}
    assert registry(spark, Plan(rs)).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        build_features(spark.range(1), Plan((Recipe("z", "cosh", ("id",)),)))
    df = spark.createDataFrame([(4.0, 2.0), (None, 1.0)], "x double, y double")
    out = build_features(df, Plan((*rs, Recipe("f", "product", ("x",), missing="mean", flag_missing=True)))).collect()
    assert out[0].c == -2 and out[1].f == 4 and out[1]["x__is_missing"] == 1


def test_window_is_relative_to_the_latest_row(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-01-31 12:00:00', timestamp'2024-03-30 00:00:00', timestamp'2024-04-30 00:00:00')) AS t")
    assert in_window(df, "t", "last_1_months").count() == 2 and in_window(df, "t", "all").count() == 3


def test_models(spark):
    rnd = random.Random(3)
    rows = [(x := rnd.gauss(0, 1), z := rnd.gauss(0, 1), int(rnd.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * x - z)))), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, z double, y int, i int")
    m = models.Logistic.fit(df, ["x", "z"], "y")
    assert abs(m.intercept - 0.5) < 0.25 and abs(m.coefficients[0] - 1.5) < 0.3 and abs(m.coefficients[1] + 1) < 0.3
    trail = models.select_features(df, ["x", "z"], "y", ["i"], folds=2)
    assert trail[-1][0] == ("x", "z")
    r = models.reason_codes(df.limit(1).withColumn("s", F.lit(0.1)), {"x": 1.0, "z": -1.0}, "s", 0.5, {"x": "RC01"}).first()
    assert len(r.reasons) == 2 and r.reasons[0].impact <= r.reasons[1].impact


def test_parceling_with_ties_takes_exactly_the_share(spark):
    rejects = spark.createDataFrame([(i, float(i // 4)) for i in range(20)], "i int, s double")
    accepts = spark.createDataFrame([(100, 9.0, 0)], "i int, s double, y int")
    out = models.parceled(accepts, rejects, "s", "y", 0.3, ["i"]).where("_source = 'reject'").collect()
    assert sorted(r.i for r in out if r.y) == [0, 1, 2, 3, 4, 5] and len(out) == 20


def test_governance_and_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert profile.data_hash(df).first() == profile.data_hash(df.orderBy(F.desc("id"))).first()
    runs = spark.createDataFrame([("r1", "x"), ("r2", "y")], "run_id string, v string")
    assert governance.compare_runs(runs, "r1", "r2").first()["same"] is False
    assert profile.numeric_columns(df) == ["id"]
    skew = spark.createDataFrame([(1,)] * 1000 + [(2,)] * 10 + [(3,)] * 10, "k int")
    assert abs(profile.key_skew(skew, "k").first()["skew_ratio"] - 1000 / 340) < 1e-9


def test_wilson(spark):
    lo, hi = N.wilson(F.lit(10.0), F.lit(100.0))
    row = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert abs(row.lo - 0.0552) < 1e-4 and abs(row.hi - 0.1744) < 1e-4


def test_temporal_ks_is_not_negative(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 1.0, 1), ("b", 2.0, 0)], "s string, x double, y int")
    assert {r.s: r.ks for r in temporal.ks_by_snapshot(df, "s", "x", "y").collect()} == {"a": 0.0, "b": 1.0}


def test_scorecard_from_rows_to_points(spark):
    from oddsmill.operators.evaluation import evaluation_report
    from oddsmill.operators.scorecard import Scorecard

    rnd = random.Random(5)
    rows = [(x := rnd.gauss(0, 1), rnd.gauss(0, 1), int(rnd.random() < 1 / (1 + math.exp(-2 * x)))) for _ in range(3000)]
    df = spark.createDataFrame([*rows, (None, None, 1)], "x double, noise double, y int")
    card = Scorecard.fit(df, ["x", "noise"], "y", pdo=40)
    assert card.bins[0].feature == "x" and card.bins[0].iv > 0.5 and len(card.bins[0].woe) <= 5
    scored = card.score(df)
    auc = ranking.auc_table(scored.where("x is not null"), "y", "p").first()["auc"]
    assert auc > 0.8 and scored.where("score is null").count() == 0
    assert {r.metric: r.grade for r in evaluation_report(scored, "y", "p").collect()}["auc"] in ("good", "excellent")
    assert '"pdo": 40' in card.spec()
    with pytest.raises(ValueError):
        Scorecard.fit(df.withColumn("one", F.lit(1.0)), ["one"], "y")


def test_plan_facts(spark):
    from oddsmill.plans import execution

    df = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()
    assert execution.facts(df)["exchanges"] >= 1 and execution.hints(df) == [] and execution.timed(df) > 0
    assert execution.partitions_for(0) == 1 and execution.partitions_for(1 << 30) == 8
