"""Trends of panels: windows of rows within a group, ordered by time and tie-breakers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Panel:
    """Where rows belong and how they follow each other; ``order`` should leave no ties."""

    group: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def rows(self) -> WindowSpec:
        if not self.order:
            raise ValueError("a trend needs an order")
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-(n - 1), 0)


def delta(panel: Panel, x: str, periods: int = 1) -> Column:
    return F.col(x) - F.lag(x, periods).over(panel.rows)


def pct_change(panel: Panel, x: str, periods: int = 1) -> Column:
    """Change over the earlier value; NULL if that is zero."""
    before = F.lag(x, periods).over(panel.rows)
    return F.when(before != 0, (F.col(x) - before) / before)


def momentum(panel: Panel, x: str, window: int = 3) -> Column:
    return F.col(x) - F.avg(x).over(panel.last(window))


def volatility(panel: Panel, x: str, window: int = 6, kind: str = "std") -> Column:
    std = F.stddev_samp(x).over(panel.last(window))
    return std if kind == "std" else std / (F.avg(x).over(panel.last(window)) + 1e-8)


def slope(panel: Panel, x: str, window: int = 6) -> Column:
    """Least-squares slope per row over the last rows; NULL with fewer than two values."""
    return F.regr_slope(F.col(x).cast("double"), F.col("_n")).over(panel.last(window))


def row_numbers(panel: Panel) -> Column:
    """What ``slope`` regresses on; select it as ``_n`` first."""
    return F.row_number().over(panel.rows).cast("double")


def rolling_rank(panel: Panel, x: str, window: int = 6, pct: bool = True) -> Column:
    """(values in the window below this one + 1), over their number if ``pct``; NULL with fewer than two."""
    values = F.collect_list(x).over(panel.last(window))  # at most ``window`` values
    rank = F.size(F.filter(values, lambda v: v < F.col(x))) + 1
    return F.when((F.size(values) >= 2) & F.col(x).isNotNull(), rank / F.size(values) if pct else rank.cast("double"))


def value_range(panel: Panel, x: str, window: int = 6) -> Column:
    return F.max(x).over(panel.last(window)) - F.min(x).over(panel.last(window))


def rolling(panel: Panel, x: str, window: int, operation: str = "mean") -> Column:
    from ..plans.recipes import AGGREGATIONS

    return AGGREGATIONS[operation](F.col(x), None, panel.last(window))


def forward_fill(panel: Panel, x: str) -> Column:
    return F.last(x, ignorenulls=True).over(panel.rows.rowsBetween(Window.unboundedPreceding, 0))


def months(panel: Panel, time: str, n: int) -> WindowSpec:
    """The last n calendar months, by month number rather than by rows."""
    month = F.year(time) * 12 + F.month(time)
    return Window.partitionBy(*panel.group).orderBy(month).rangeBetween(-(n - 1), 0)
