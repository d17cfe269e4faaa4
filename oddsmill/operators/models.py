"""Scorecard models on Spark ML, and what is read off them."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import sigmoid
from .ranking import auc_table


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


class Logistic:
    """A fitted logistic scorecard: an intercept and a coefficient a feature."""

    def __init__(self, features: list[str], coefficients: list[float], intercept: float):
        self.features, self.coefficients, self.intercept = features, coefficients, intercept

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, weight: str | None = None, penalty: float = 0.0, l1_share: float = 0.0, rounds: int = 200) -> Logistic:
        """Unpenalised unless asked; ``weight`` takes compressed rows."""
        how = {"weightCol": weight} if weight else {}
        lr = LogisticRegression(featuresCol="_features", labelCol=label, regParam=penalty, elasticNetParam=l1_share, standardization=penalty == 0, maxIter=rounds, tol=1e-9, **how)
        model = lr.fit(_assembled(df, features))
        return cls(features, [float(c) for c in model.coefficients], float(model.intercept))

    def z(self) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients, strict=True):
            out = out + F.lit(c) * F.col(f)
        return out

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """A plain expression, so scoring stays inside generated code."""
        return df.withColumn(out, sigmoid(self.z()))

    def table(self, spark) -> DataFrame:
        """feature, coefficient, by falling size."""
        rows = sorted(zip(self.features, self.coefficients, strict=True), key=lambda r: (-abs(r[1]), r[0]))
        return spark.createDataFrame([(f, c) for f, c in rows], "feature string, coefficient double")

    def contributions(self, df: DataFrame) -> DataFrame:
        """feature, mean_abs, mean, max of coefficient * (x - mean x), the exact Shapley values of a linear model."""
        means = df.agg(*[F.avg(f).alias(f"_m{i}") for i, f in enumerate(self.features)])
        joined = df.crossJoin(F.broadcast(means))  # one row
        phi = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(c) * (F.col(f) - F.col(f"_m{i}"))).alias("phi")) for i, (f, c) in enumerate(zip(self.features, self.coefficients, strict=True))])
        long = joined.select(F.explode(phi).alias("e")).select("e.*")
        return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"), F.max("phi").alias("max"))


def forest(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42):
    return RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(_assembled(df, features))


def boosted(df: DataFrame, features: list[str], label: str, rounds: int = 50, depth: int = 3, rate: float = 0.1, seed: int = 42):
    """Gradient boosted trees; they stand for all boosting libraries."""
    return GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(_assembled(df, features))


def tree_score(model, df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    return model.transform(_assembled(df, features)).withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def tree_importance(spark, model, features: list[str]) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "feature string, importance double")


REASONS_OTHER = "RC99"


def reason_codes(df: DataFrame, coefficients: dict[str, float], score: str, threshold: float, codes: dict[str, str] | None = None, most: int = 4) -> DataFrame:
    """``df`` with ``reasons``, array of (feature, impact, code): for scores below the threshold the lowest impacts first, else the highest."""
    entry = lambda f, c: F.struct((F.lit(float(c)) * F.col(f)).alias("impact"), F.lit(f).alias("feature"), F.lit((codes or {}).get(f, REASONS_OTHER)).alias("code"))
    low = F.array_sort(F.array(*[entry(f, c) for f, c in coefficients.items()]))
    chosen = F.when(F.col(score) < threshold, F.slice(low, 1, most)).otherwise(F.slice(F.reverse(low), 1, most))
    return df.withColumn("reasons", chosen)


def adverse_notice(df: DataFrame, key: str, score: str) -> DataFrame:
    """key, notice: a JSON text of the decision's score and reasons."""
    return df.select(key, F.to_json(F.struct(F.col(key).alias("application"), F.round(score, 6).alias("score"), F.transform("reasons", lambda r: r["code"]).alias("codes"))).alias("notice"))


def parceled(accepts: DataFrame, rejects: DataFrame, score: str, label: str, bad_rate: float, tie: list[str]) -> DataFrame:
    """Accepts and rejects with ``_source``; the int(n * bad_rate) lowest-scored rejects are bad.

    The cut is found on the curve of distinct scores; only rows tied at the cut are ranked.
    """
    from .curves import cumulative

    curve = cumulative(rejects, score, {"n": F.lit(1)}, low=None, high=None)
    total = rejects.where(F.col(score).isNotNull()).agg(F.floor(F.count(F.lit(1)) * bad_rate).alias("_k"))
    cut = curve.crossJoin(F.broadcast(total)).where((F.col("n_below") < F.col("_k")) & (F.col("n_below") + F.col("n") >= F.col("_k"))).select(F.col(score).alias("_cut"), (F.col("_k") - F.col("n_below")).alias("_left"))  # one row
    edge = total.join(cut, F.lit(True), "left")
    marked = rejects.crossJoin(F.broadcast(edge))
    at = marked.where(F.col(score) == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy(score).orderBy(*tie))).withColumn(label, (F.col("_r") <= F.col("_left")).cast("int")).drop("_r")
    off = marked.where(~(F.coalesce(F.col(score) == F.col("_cut"), F.lit(False)))).withColumn(label, F.coalesce(F.col(score) < F.col("_cut"), F.lit(False)).cast("int"))
    inferred = at.unionByName(off).drop("_k", "_cut", "_left").withColumn("_source", F.lit("reject"))
    return accepts.withColumn("_source", F.lit("accept")).unionByName(inferred, allowMissingColumns=True)


def overlap(accepts: DataFrame, rejects: DataFrame, score: str) -> DataFrame:
    """overlap_ratio of the two score ranges and mean_separation, in one row."""
    side = lambda d, n: d.agg(F.min(score).alias(f"lo_{n}"), F.max(score).alias(f"hi_{n}"), F.avg(score).alias(f"mean_{n}"))
    both = side(accepts, "a").crossJoin(side(rejects, "r"))  # one row each
    shared = F.greatest(F.least("hi_a", "hi_r") - F.greatest("lo_a", "lo_r"), F.lit(0.0))
    span = F.greatest("hi_a", "hi_r") - F.least("lo_a", "lo_r")
    return both.select(F.when(span > 0, shared / span).otherwise(F.lit(0.0)).alias("overlap_ratio"), (F.col("mean_a") - F.col("mean_r")).alias("mean_separation"))


def inverse_propensity(p: Column, low: float = 0.1, high: float = 10.0) -> Column:
    return F.least(F.greatest(1 / (p + 0.001), F.lit(low)), F.lit(high))


def reweighted(df: DataFrame, accepted: str, features: list[str]) -> DataFrame:
    """``df`` with ``propensity`` of being accepted and ``weight``."""
    scored = Logistic.fit(df, features, accepted).score(df, "propensity")
    return scored.withColumn("weight", inverse_propensity(F.col("propensity")))


def correlation_importance(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, importance: the size of the correlation with the label."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(label).cast("double")).alias(f"c{i}") for i, f in enumerate(features)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"c{i}")).alias("importance")) for i, f in enumerate(features)])).alias("e")).select("e.*")


def drop_column_importance(df: DataFrame, model: Logistic, label: str, places: int = 12) -> DataFrame:
    """feature, importance: the fall in AUC when a feature is replaced by its mean.

    Probabilities are rounded to ``places``, so that rows whose sums differ by the order of summation only tie.
    """
    spark = df.sparkSession
    means = df.agg(*[F.avg(f).alias(f) for f in model.features]).first()
    area = lambda rows: auc_table(model.score(rows).withColumn("p", F.round("p", places)), label, "p").first()["auc"]
    base = area(df)
    rows = [(f, base - area(df.withColumn(f, F.lit(means[f])))) for f in model.features]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(df: DataFrame, model: Logistic, label: str, keys: list[str], repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, importance: the mean fall in AUC when a feature's values change rows.

    Values move along a ring ordered by a hash of the seed and ``keys``, columns that tell rows apart and say nothing of
    their values.  Rings lie within hash buckets of about a thousand rows, so a column keeps its distribution without a
    global sort.  Values only order rows of equal keys, so that reruns agree.
    """
    base = auc_table(model.score(df), label, "p").first()["auc"]
    buckets = max(1, df.count() // 1000)
    rows = []
    for f in model.features:
        falls = []
        for k in range(repeats):
            key = F.xxhash64(F.lit(seed + k), *[F.col(x) for x in keys])
            ring = Window.partitionBy(F.pmod(key, F.lit(buckets))).orderBy(F.xxhash64(key), *keys, *model.features, label)
            value = F.struct(F.col(f).alias("x"))  # a missing value moves like any other
            moved = F.coalesce(F.lead(value).over(ring), F.first(value).over(ring))["x"]
            falls.append(base - auc_table(model.score(df.withColumn(f, moved)), label, "p").first()["auc"])
        rows.append((f, sum(falls) / len(falls)))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def consensus(tables: list[DataFrame], method: str = "rank_average") -> DataFrame:
    """feature, consensus over tables of (feature, importance); a feature a table lacks has none there."""
    scored = None
    for i, t in enumerate(tables):
        if method == "rank_average":
            own = t.select("feature", F.rank().over(Window.orderBy(F.desc("importance"))).cast("double").alias(f"s{i}"))
        else:
            over = Window.partitionBy()
            span = F.max("importance").over(over) - F.min("importance").over(over)
            own = t.select("feature", F.when(span > 0, (F.col("importance") - F.min("importance").over(over)) / span).otherwise(F.lit(0.0)).alias(f"s{i}"))
        scored = own if scored is None else scored.join(own, "feature", "full_outer")
    cols = [F.col(f"s{i}") for i in range(len(tables))]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    known = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    mean = total / known
    return scored.select("feature", (1 / mean if method == "rank_average" else mean).alias("consensus"))


def fold_of(df: DataFrame, keys: list[str], folds: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(folds))


def cv_auc(df: DataFrame, features: list[str], label: str, keys: list[str], folds: int = 3, weight: str | None = None) -> float:
    """Mean AUC over hash folds."""
    marked = df.withColumn("_fold", fold_of(df, keys, folds))
    scores = []
    for k in range(folds):
        model = Logistic.fit(marked.where(F.col("_fold") != k), features, label, weight)
        scores.append(auc_table(model.score(marked.where(F.col("_fold") == k)), label, "p", weight).first()["auc"])
    known = [s for s in scores if s is not None]
    return sum(known) / len(known) if known else float("nan")


def select_features(df: DataFrame, features: list[str], label: str, keys: list[str], method: str = "forward", most: int | None = None, least_gain: float = 0.001, folds: int = 3, weight: str | None = None) -> list[tuple[tuple[str, ...], float]]:
    """Subsets tried and kept on the way, best last, with their cross-validated AUC: forward, backward, stepwise or exhaustive."""
    score = lambda subset: cv_auc(df, list(subset), label, keys, folds, weight)
    most = most or len(features)
    if method == "exhaustive":
        tried = [(s, score(s)) for k in range(1, most + 1) for s in combinations(features, k)]
        return sorted(tried, key=lambda r: r[1])
    if method == "backward":
        now = tuple(features)
        trail = [(now, score(now))]
        while len(now) > 1:
            now, best = max((((s := tuple(f for f in now if f != g)), score(s)) for g in now), key=lambda r: r[1])
            trail.append((now, best))
        return sorted(trail, key=lambda r: r[1])
    now, best, trail = (), 0.5, []
    while len(now) < most:
        options = [((*now, f), score((*now, f))) for f in features if f not in now]
        if not options:
            break
        subset, value = max(options, key=lambda r: r[1])
        if value - best < least_gain:
            break
        now, best = subset, value
        trail.append((now, best))
        if method == "stepwise" and len(now) > 2:
            fewer, without = max((((s := tuple(f for f in now if f != g)), score(s)) for g in now[:-1]), key=lambda r: r[1])
            if without > best:
                now, best = fewer, without
                trail.append((now, best))
    return trail
