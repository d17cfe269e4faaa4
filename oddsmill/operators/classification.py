"""Metrics of a fixed cut, from four conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import cumulative


def confusion(df: DataFrame, label: str, p: str, threshold: float = 0.5, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn as doubles; rows without label or probability are left out."""
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    y, hit = F.col(label) == 1, F.col(p) >= threshold
    cell = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    known = df.where(F.col(label).isNotNull() & F.col(p).isNotNull())
    return known.groupBy(*(by or [])).agg(cell(y & hit).alias("tp"), cell(~y & hit).alias("fp"), cell(~y & ~hit).alias("tn"), cell(y & ~hit).alias("fn"))


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def derived(cells: DataFrame, beta: float = 2.0) -> DataFrame:
    """The cells with the metrics derived from them; 0/0 is 0, an infinite ratio NULL."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    tpr, tnr, ppv, npv = _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp), _ratio(tn, tn + fn)
    fpr, fnr, b2 = _ratio(fp, fp + tn), _ratio(fn, fn + tp), beta * beta
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    chance = _ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    accuracy = _ratio(tp + tn, n)
    metrics = {
        "accuracy": accuracy, "balanced_accuracy": (tpr + tnr) / 2, "precision": ppv, "recall": tpr, "specificity": tnr,
        "f1": _ratio(2 * ppv * tpr, ppv + tpr), "f_beta": _ratio((1 + b2) * ppv * tpr, b2 * ppv + tpr),
        "mcc": _ratio(tp * tn - fp * fn, root), "kappa": _ratio(accuracy - chance, 1 - chance),
        "fpr": fpr, "fnr": fnr, "npv": npv, "markedness": ppv + npv - 1, "informedness": tpr + tnr - 1,
        "diagnostic_odds_ratio": _ratio(tp * tn, fp * fn, None), "lr_positive": _ratio(tpr, fpr, None), "lr_negative": _ratio(fnr, tnr, None),
        "prevalence": _ratio(tp + fn, n), "detection_rate": _ratio(tp, n), "detection_prevalence": _ratio(tp + fp, n),
    }
    return cells.select("*", *[c.alias(k) for k, c in metrics.items()])


def metrics(df: DataFrame, label: str, p: str, threshold: float = 0.5, weight: str | None = None, by: list[str] | None = None, beta: float = 2.0) -> DataFrame:
    return derived(confusion(df, label, p, threshold, weight, by), beta)


def per_class(df: DataFrame, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    """class, precision, recall, f1, support for classes 0 and 1."""
    c = confusion(df, label, p, threshold)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))

    def row(cls: int, hit: Column, wrong: Column, missed: Column) -> Column:
        prec, rec = _ratio(hit, hit + wrong), _ratio(hit, hit + missed)
        return F.struct(F.lit(cls).alias("class"), prec.alias("precision"), rec.alias("recall"), _ratio(2 * prec * rec, prec + rec).alias("f1"), (hit + missed).alias("support"))

    return c.select(F.explode(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))).alias("r")).select("r.*")


def best_threshold(df: DataFrame, label: str, p: str, metric: str = "f1", steps: int = 100) -> DataFrame:
    """threshold, score: the first of the grid 1/steps .. (steps-1)/steps with the greatest f1, precision or recall.

    Cells at every grid point follow from one cumulative pass over distinct probabilities.
    """
    y = F.col(label)
    cell = F.least(F.floor(F.col(p) * steps + 1e-9), F.lit(steps)).cast("int")
    known = df.where(y.isNotNull() & F.col(p).isNotNull()).withColumn("_cell", cell)
    grid = df.sparkSession.range(1, steps).select(F.col("id").cast("int").alias("_cell"))
    both = known.select("_cell", y.cast("long").alias("pos"), (1 - y).cast("long").alias("neg")).unionByName(grid.select("_cell", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")))
    curve = cumulative(both, "_cell", {"pos": F.col("pos"), "neg": F.col("neg")}, low=0, high=steps)
    totals = both.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    c = curve.where(F.col("_cell").between(1, steps - 1)).crossJoin(F.broadcast(totals))  # one row
    cells = c.select((F.col("_cell") / steps).alias("threshold"), (F.col("all_pos") - F.col("pos_below")).cast("double").alias("tp"), (F.col("all_neg") - F.col("neg_below")).cast("double").alias("fp"), F.col("neg_below").cast("double").alias("tn"), F.col("pos_below").cast("double").alias("fn"))
    scored = derived(cells).select("threshold", F.col(metric).alias("score"))
    return scored.agg(F.max(F.struct("score", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.score").alias("score"))
