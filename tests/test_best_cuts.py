import itertools
import random

import pytest

from oddsmill.functions.numeric import interval_label
from oddsmill.operators import binning as B


def brute(bins, most, least_share, trend):
    rows, best = sum(n for n, _ in bins), None
    for k in range(min(most, len(bins))):
        for cuts in itertools.combinations(range(1, len(bins)), k):
            ends = [0, *cuts, len(bins)]
            parts = [(sum(n for n, _ in bins[a:b]), sum(e for _, e in bins[a:b])) for a, b in zip(ends, ends[1:])]
            rates = [e / n if n else None for n, e in parts]
            if any(not n or n < rows * least_share for n, _ in parts):
                continue
            up, down = (all(x < y for x, y in zip(rates, rates[1:])), all(x > y for x, y in zip(rates, rates[1:])))
            if trend == "any" or (up if trend == "up" else down if trend == "down" else up or down):
                value = B.information(bins, list(cuts))
                best = value if best is None else max(best, value)
    return best


@pytest.mark.parametrize("trend", ["auto", "up", "down", "any"])
def test_cuts_are_the_best_of_all(trend):
    rnd = random.Random(5)
    for _ in range(30):
        bins = [(n, rnd.randint(0, n)) for n in (rnd.randint(1, 60) for _ in range(rnd.randint(1, 9)))]
        most, share = rnd.randint(1, 5), rnd.choice([0.0, 0.05, 0.2])
        want, cuts = brute(bins, most, share, trend), B.best_cuts(bins, most, share, trend)
        assert len(cuts) < most and abs(B.information(bins, cuts) - want) < 1e-9


def test_no_bins_and_one():
    assert B.best_cuts([]) == [] and B.best_cuts([(10, 3)]) == []


def test_best_bins_of_several_features(spark):
    rows = [("f", i, 100, 5 * i) for i in range(8)] + [("g", i, 10, 5) for i in range(3)] + [("g", None, 7, 1)]
    out = B.best_bins(spark.createDataFrame(rows, "feature string, bin int, n long, events long"), by=["feature"]).orderBy("feature", "bin").collect()
    assert [r.feature for r in out].count("f") == 5 and [(r.lo, r.hi, r.n) for r in out if r.feature == "g"] == [(0, 2, 30)]


def test_labels():
    assert [interval_label([1.0, 2.5], i) for i in range(3)] == ["(-inf, 1]", "(1, 2.5]", "(2.5, inf)"] and interval_label([], 0) == "(-inf, inf)"
