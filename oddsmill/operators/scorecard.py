"""The whole scorecard: bins, weights of evidence, a model on compressed rows, points.

What is gathered while fitting is a bin table of a few rows a feature; rows
are only ever counted by groups of bins.  Scoring is one expression.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_of
from .binning import auto_bins, prebin_edges
from .calibration import score_of
from .compression import compress, verify, weighted_labels
from .models import Logistic


@dataclass(frozen=True)
class FeatureBins:
    """Cuts between the final bins, and the weight of each; ``missing`` is the weight of NULL."""

    feature: str
    cuts: list[float]
    woe: list[float]
    iv: float
    missing: float = 0.0

    def bin(self) -> Column:
        return bin_of(F.col(self.feature).cast("double"), self.cuts)

    def weight(self) -> Column:
        return reduce(lambda c, i: c.when(self.bin() == i, F.lit(self.woe[i])), range(1, len(self.woe)), F.when(self.bin() == 0, F.lit(self.woe[0]))).otherwise(F.lit(self.missing))


@dataclass(frozen=True)
class Scorecard:
    bins: list[FeatureBins]
    model: Logistic
    scale: dict

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, most_bins: int = 5, least_iv: float = 0.02, **scale) -> Scorecard:
        """Features of too little information are left out; an empty selection is an error."""
        table: dict[str, list] = {}
        for r in auto_bins(df, features, label, most=most_bins, least_iv=least_iv).collect():
            table.setdefault(r["feature"], []).append(r)
        if not table:
            raise ValueError("no feature carries enough information")
        cuts = {r["_f"]: r["_edges"] or [] for r in prebin_edges(df.where(F.col(label).isNotNull()), sorted(table)).collect()}  # a row a feature
        chosen = []
        for f in sorted(table, key=lambda f: (-table[f][0]["iv"], f)):
            found = cuts[f]
            rows = sorted(table[f], key=lambda r: r["lo"])
            chosen.append(FeatureBins(f, [found[r["lo"] - 1] for r in rows[1:]], [r["woe"] for r in rows], rows[0]["iv"]))
        names = [f"{b.feature}_bin" for b in chosen]
        binned = df.where(F.col(label).isNotNull()).select(F.col(label), *[b.bin().alias(n) for b, n in zip(chosen, names, strict=True)])
        groups = compress(binned, names, label)
        verify(binned, groups, label)
        weights = {b.feature: b.woe for b in chosen}
        look_up = lambda b, n: F.coalesce(F.get(F.array(*map(F.lit, weights[b.feature])), F.col(n)), F.lit(b.missing)).alias(f"{b.feature}_woe")
        rows = weighted_labels(groups.select(*[look_up(b, n) for b, n in zip(chosen, names, strict=True)], "sample_weight", "event_weight"), "_y", "_w")
        model = Logistic.fit(rows, [f"{b.feature}_woe" for b in chosen], "_y", "_w")
        return cls(chosen, model, scale)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with a weight a feature, ``p`` and ``score``."""
        woe = df.select("*", *[b.weight().alias(f"{b.feature}_woe") for b in self.bins])
        return self.model.score(woe).withColumn("score", score_of(F.col("p"), **self.scale))

    def spec(self) -> str:
        """The card as JSON."""
        parts = [{"feature": b.feature, "cuts": b.cuts, "woe": b.woe, "iv": b.iv, "missing": b.missing, "coefficient": c} for b, c in zip(self.bins, self.model.coefficients, strict=True)]
        return json.dumps({"intercept": self.model.intercept, "features": parts, "scale": {"pdo": 20, "base_score": 600, "base_odds": 50} | self.scale}, sort_keys=True)

    @classmethod
    def from_spec(cls, text: str) -> Scorecard:
        """The card that ``spec`` wrote: it scores as that one does."""
        d = json.loads(text)
        bins = [FeatureBins(f["feature"], f["cuts"], f["woe"], f["iv"], f.get("missing", 0.0)) for f in d["features"]]
        model = Logistic([f"{b.feature}_woe" for b in bins], [f["coefficient"] for f in d["features"]], d["intercept"])
        return cls(bins, model, d["scale"])
