"""Column builders for numbers, probabilities and labels.  All are native expressions; NULL in, NULL out unless said."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are clipped this far from 0 and 1 before a logit.
CLIP = 1e-10


def safe_ratio(num: Column, den: Column, policy: str = "nan", constant: float = 0.0) -> Column:
    """num / den; a zero denominator gives NULL ("nan"), 0 ("zero") or ``constant`` ("constant")."""
    default = {"nan": F.lit(None).cast("double"), "zero": F.lit(0.0), "constant": F.lit(float(constant))}[policy]
    return F.when(den.isNull() | num.isNull(), F.lit(None).cast("double")).when(den != 0, num / den).otherwise(default)


def product(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)


def log_of(x: Column, add_one: bool = True) -> Column:
    """ln(1 + x) or ln(x); NULL where undefined."""
    y = x + 1 if add_one else x
    return F.when(y > 0, F.ln(y))


def sqrt_of(x: Column) -> Column:
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    out = x
    if lower is not None:
        out = F.when(out < lower, F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(upper)).otherwise(out)
    return out


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of right-closed bins of equal width; the lowest edge belongs to bin 0."""
    width = (high - low) / bins
    index = F.when(width > 0, F.ceil((x - low) / width) - 1).otherwise(F.lit(0))
    return F.when(x.isNotNull(), F.greatest(F.least(index, F.lit(bins - 1)), F.lit(0)).cast("int"))


def bin_of(x: Column, edges: list[float]) -> Column:
    """Number of inner edges below x: bins are (lo, hi], open to both infinities."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), reduce(lambda a, b: a + b, ((x > F.lit(float(e))).cast("int") for e in edges)))


def bin_of_array(x: Column, edges: Column) -> Column:
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: x > e)))


def clip_probability(p: Column, eps: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = CLIP) -> Column:
    q = clip_probability(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def predicted_class(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def label(value: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first bound that value is below."""
    out = None
    for bound, name in bounds:
        out = F.when(value < bound, name) if out is None else out.when(value < bound, name)
    return out.otherwise(otherwise)


# Strength of information value, drift of a population, quality of ranking metrics.
IV_STRENGTH = ([(0.02, "Not Predictive"), (0.1, "Weak"), (0.3, "Medium"), (0.5, "Strong")], "Suspicious")
PSI_STATUS = ([(0.1, "stable"), (0.25, "warning")], "critical")
AUC_GRADE = ([(0.6, "poor"), (0.7, "fair"), (0.8, "good"), (0.9, "very good")], "excellent")


def iv_strength(iv: Column) -> Column:
    return label(iv, *IV_STRENGTH)


def psi_status(psi: Column) -> Column:
    return label(psi, *PSI_STATUS)


def psi_term(actual: Column, expected: Column) -> Column:
    return (actual - expected) * F.ln(actual / expected)


def wilson(events: Column, count: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a rate, within [0, 1]."""
    p = events / count
    d = 1 + z * z / count
    mid = (p + z * z / (2 * count)) / d
    half = z * F.sqrt(p * (1 - p) / count + z * z / (4 * count * count)) / d
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), by the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a)))
    b = h + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * math.exp(-h + a * math.log(h) - math.lgamma(a))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the regularised incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(1 - x, b, a) / b


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def ks_tail(statistic: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided tail of the two-sample Kolmogorov-Smirnov statistic."""
    n = math.sqrt(n1 * n2 / (n1 + n2))
    x = (n + 0.12 + 0.11 / n) * statistic
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_pvalue(statistic: Column, n1: Column, n2: Column) -> Column:
    """``ks_tail`` as a column."""
    n = F.sqrt(n1 * n2 / (n1 + n2))
    x = (n + 0.12 + 0.11 / n) * statistic
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2 * terms, F.lit(0.0)), F.lit(1.0)))


def interval_label(bounds: list[float], i: int, digits: int = 4) -> str:
    """Name of bin ``i`` of bins (lo, hi] open to both ends."""
    text = lambda v: f"{v:.{digits}g}"
    if not bounds:
        return "(-inf, inf)"
    lo = "-inf" if i == 0 else text(bounds[i - 1])
    hi = "inf" if i == len(bounds) else text(bounds[i])
    return f"({lo}, {hi}{')' if hi == 'inf' else ']'}"
