"""Permutation importance against a real permutation."""

import math
import random

import pytest

from oddsmill.operators import models
from oddsmill.plans import queries as Q


def auc(scored):
    """By mean ranks, ties shared."""
    scored, below, total = sorted(scored), 0, 0.0
    at = 0
    while at < len(scored):
        end = at
        while end < len(scored) and scored[end][0] == scored[at][0]:
            end += 1
        pos = sum(y for _, y in scored[at:end])
        total += pos * (below + (end - at - pos) / 2)
        below += end - at - pos
        at = end
    return total / (below * (len(scored) - below))


def real_falls(rows, seed):
    score = lambda xs: 1 / (1 + math.exp(-(Q._FIXED.intercept + sum(c * x for c, x in zip(Q._FIXED.coefficients, xs, strict=True)))))
    base, out = auc([(score(r[:3]), r[3]) for r in rows]), {}
    for i, f in enumerate(Q._MODEL):
        values = [r[i] for r in rows]
        random.Random(seed).shuffle(values)
        out[f] = base - auc([(score([*r[:i], v, *r[i + 1 : 3]]), r[3]) for r, v in zip(rows, values, strict=True)])
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_falls_are_those_of_a_real_permutation(spark, size):
    df = Q._training(spark, f"/root/testdata/{size}")
    rows = [tuple(r) for r in df.select(*Q._MODEL, "y").collect()]
    want = real_falls(rows, 1)
    got = {r.feature: r.importance for r in models.permutation_importance(df, Q._FIXED, "y", Q._KEYS, repeats=1).collect()}
    assert all(abs(got[f] - want[f]) < 0.03 for f in want), (got, want)


def test_equal_rows_hand_each_other_nothing(spark):
    df = spark.createDataFrame([(i, float(i % 2), i % 2) for i in range(4000)], "i long, x double, y int")
    fall = models.permutation_importance(df, models.Logistic(["x"], [1.0], 0.0), "y", ["i"], repeats=1).first().importance
    assert abs(fall - 0.5) < 0.05
