"""Declarative feature recipes: parsed, ordered by their dependencies, turned into one plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import numeric as N
from ..operators.curves import quantiles


def _over(c: Column, w: WindowSpec | None) -> Column:
    return c.over(w) if w is not None else c


# name -> (value, order column or None, window or None) -> Column
AGGREGATIONS: dict[str, Callable[[Column, Column | None, WindowSpec | None], Column]] = {
    "max": lambda x, t, w: _over(F.max(x), w),
    "worst": lambda x, t, w: _over(F.max(x), w),
    "min": lambda x, t, w: _over(F.min(x), w),
    "mean": lambda x, t, w: _over(F.avg(x), w),
    "median": lambda x, t, w: _over(F.percentile(x, 0.5), w),
    "std": lambda x, t, w: _over(F.stddev_samp(x), w),
    "sum": lambda x, t, w: _over(F.sum(x), w),
    "count": lambda x, t, w: _over(F.count(x), w),
    "range": lambda x, t, w: _over(F.max(x), w) - _over(F.min(x), w),
    "first": lambda x, t, w: _over(F.min_by(x, F.when(x.isNotNull(), t)), w),
    "last": lambda x, t, w: _over(F.max_by(x, F.when(x.isNotNull(), t)), w),
}


@dataclass(frozen=True)
class Recipe:
    """One feature.  ``missing`` is keep, zero, mean, median, constant or flag; ``flag`` adds ``<column>__is_missing``, made before imputation."""

    name: str
    operation: str
    columns: tuple[str, ...]
    window: str | None = None
    params: dict = field(default_factory=dict)
    missing: str = "keep"
    missing_value: float | None = None
    scope: str = "global"
    flag_missing: bool = False
    divide_by_zero: str = "nan"
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    recipes: tuple[Recipe, ...]
    group: tuple[str, ...] = ()
    time: str | None = None

    @classmethod
    def from_dict(cls, config: dict) -> Plan:
        recipes = []
        for r in config.get("recipes", config.get("features", [])):
            known = {k: v for k, v in r.items() if k in Recipe.__dataclass_fields__}
            known["columns"] = tuple(r.get("columns", r.get("source_cols", ())))
            known["depends_on"] = tuple(r.get("depends_on", ()))
            recipes.append(Recipe(**known))
        return cls(tuple(recipes), tuple(config.get("group", config.get("group_cols", ()))), config.get("time", config.get("time_col")))


def ordered(recipes: tuple[Recipe, ...]) -> list[Recipe]:
    """Recipes after what they depend on (named, or read as a column); a cycle is an error that names its path."""
    by_name = {r.name: r for r in recipes}
    out: list[Recipe] = []
    done: set[str] = set()

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError("cycle: " + " -> ".join([*path[path.index(name) :], name]))
        if name in done or name not in by_name:
            return
        r = by_name[name]
        for d in (*r.depends_on, *r.columns):
            if d != name:
                visit(d, (*path, name))
        done.add(name)
        out.append(r)

    for r in recipes:
        visit(r.name, ())
    return out


def lineage(recipes: tuple[Recipe, ...], name: str) -> dict:
    """The tree of what a feature is made from."""
    by_name = {r.name: r for r in recipes}
    r = by_name.get(name)
    return {"name": name, "inputs": [lineage(recipes, d) for d in dict.fromkeys((*r.columns, *r.depends_on)) if d != name] if r else []}


def registry(spark, plan: Plan) -> DataFrame:
    rows = [(r.name, r.operation, list(r.columns), r.window, r.missing, r.divide_by_zero, list(r.depends_on)) for r in ordered(plan.recipes)]
    return spark.createDataFrame(rows, "feature string, operation string, columns array<string>, window string, missing string, divide_by_zero string, depends_on array<string>")


def window_months(window: str | None) -> int | None:
    """Months of ``last_3_months``, ``6`` and the like; None for ``all`` or nothing."""
    digits = re.search(r"\d+", window or "")
    return int(digits[0]) if digits else None


def in_window(df: DataFrame, time: str, window: str | None) -> DataFrame:
    """Rows no older than the months before the latest row of all."""
    n = window_months(window)
    if n is None:
        return df
    latest = df.agg(F.max(time).alias("_latest"))
    return df.crossJoin(F.broadcast(latest)).where(F.col(time) >= F.col("_latest") - F.expr(f"interval {n} months")).drop("_latest")  # one row


def aggregated(source: DataFrame, keys: list[str], operation: str, x: str, t: Column | None, out: str) -> DataFrame:
    """keys and one aggregate; medians come from the cumulative curve, so a large group is never held in one task."""
    if operation == "median":
        return quantiles(source, x, [0.5], keys).select(*keys, F.col("q")[0].alias(out))
    return source.groupBy(*keys).agg(AGGREGATIONS[operation](F.col(x), t, None).alias(out))


def _same(keys, prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys), F.lit(True))


def _filled(df: DataFrame, r: Recipe, plan: Plan) -> tuple[DataFrame, list[Column]]:
    """Inputs of a recipe with missing values handled; statistics are joined, never collected."""
    x = [F.col(c) for c in r.columns]
    if r.flag_missing or r.missing == "flag":
        df = df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}__is_missing") for c in r.columns if f"{c}__is_missing" not in df.columns])
    if r.missing in ("keep", "flag"):
        return df, x
    if r.missing in ("zero", "constant"):
        value = F.lit(0.0 if r.missing == "zero" else float(r.missing_value or 0))
        return df, [F.coalesce(c.cast("double"), value) for c in x]
    keys = list(plan.group) if r.scope == "group" else []
    for i, c in enumerate(r.columns):
        source = df.select(*[F.col(k).alias(f"_k{i}{k}") for k in keys], F.col(c).alias("_x"))
        stats = aggregated(source, [f"_k{i}{k}" for k in keys], r.missing, "_x", None, f"_s{i}")
        df = df.join(stats, _same(keys, f"_k{i}"), "left") if keys else df.join(F.broadcast(stats), F.lit(True), "left")  # one row
    return df, [F.coalesce(c.cast("double"), F.col(f"_s{i}")) for i, c in enumerate(x)]


def _scalar(r: Recipe, x: list[Column]) -> Column:
    p = r.params
    match r.operation:
        case "ratio":
            if len(x) != 2:
                raise ValueError(f"{r.name}: a ratio takes two columns")
            return N.safe_ratio(x[0], x[1], r.divide_by_zero, p.get("constant", 0.0))
        case "difference":
            if len(x) != 2:
                raise ValueError(f"{r.name}: a difference takes two columns")
            return x[0] - x[1]
        case "product":
            return N.product(x)
        case "log":
            return N.log_of(x[0], p.get("add_one", True))
        case "sqrt":
            return N.sqrt_of(x[0])
        case "clip":
            return N.clip(x[0], p.get("lower"), p.get("upper"))
        case "bin" if not isinstance(p.get("bins", 10), int):
            return N.bin_of(x[0], list(p["bins"])[1:-1])
    raise ValueError(f"unknown operation: {r.operation}")


def _runs(recipes: list[Recipe]) -> list[list[Recipe]]:
    """Neighbouring aggregations over the same window that need nothing of each other, together; the rest alone."""
    out: list[list[Recipe]] = []
    for r in recipes:
        plain = r.operation in AGGREGATIONS and r.missing == "keep" and not r.flag_missing
        last = out[-1] if out else []
        joins = plain and last and last[0].operation in AGGREGATIONS and last[0].missing == "keep" and not last[0].flag_missing and last[0].window == r.window
        if joins and not {*r.columns, *r.depends_on} & {x.name for x in last}:
            last.append(r)
        else:
            out.append([r])
    return out


def _aggregates(df: DataFrame, run: list[Recipe], inputs: list[Column], plan: Plan) -> DataFrame:
    """``df`` with the features of a run: one aggregation of all of them, one join."""
    t = F.col(plan.time) if plan.time else None
    if t is None and (needy := [r.name for r in run if r.operation in ("first", "last")]):
        raise ValueError(f"{needy[0]}: first and last need a time column")
    keys = [f"_g{g}" for g in plan.group]
    source = df.select(*[F.col(g).alias(f"_g{g}") for g in plan.group], *([t] if plan.time else []), *[x.alias(f"_x{i}") for i, x in enumerate(inputs)])
    if run[0].window and plan.time:
        source = in_window(source, plan.time, run[0].window)
    exprs = [AGGREGATIONS[r.operation](F.col(f"_x{i}"), t, None).alias(r.name) for i, r in enumerate(run) if r.operation != "median"]
    agg = source.groupBy(*keys).agg(*exprs) if exprs else None
    for i, r in enumerate(run):
        if r.operation == "median":
            m = aggregated(source, keys, "median", f"_x{i}", t, r.name)
            if agg is None:
                agg = m
            else:
                renamed = m.select(*[F.col(k).alias(f"_m{k}") for k in keys], r.name)
                agg = agg.join(renamed, _same(keys, "_m"), "left").drop(*[f"_m{k}" for k in keys])
    return df.join(agg, _same(plan.group, "_g"), "left") if plan.group else df.join(F.broadcast(agg), F.lit(True), "left")  # one row


def build_features(df: DataFrame, plan: Plan) -> DataFrame:
    """``df`` with a column for each recipe.

    Aggregations over all time of a group are joined back by its keys; with a
    window only rows in it count, and groups without any get NULL.
    """
    for run in _runs(ordered(plan.recipes)):
        before = df.columns
        r = run[0]
        df, x = _filled(df, r, plan)
        if r.operation in AGGREGATIONS:
            df = _aggregates(df, run, [x[0], *(F.col(o.columns[0]) for o in run[1:])], plan)
        elif r.operation == "bin" and isinstance(r.params.get("bins", 10), int):
            bins = r.params.get("bins", 10)
            ends = df.agg(F.min(x[0]).alias("_lo"), F.max(x[0]).alias("_hi"))
            df = df.crossJoin(F.broadcast(ends)).withColumn(r.name, N.equal_width_bin(x[0], F.col("_lo"), F.col("_hi"), bins))  # one row
        else:
            df = df.withColumn(r.name, _scalar(r, x))
        flags = [c for c in df.columns if c.endswith("__is_missing") and c not in before]
        df = df.select(*before, *flags, *[o.name for o in run])
    return df


def aggregation(df: DataFrame, name: str, column: str, operation: str, group: list[str], months: int | None = None, time: str | None = None) -> DataFrame:
    window = f"last_{months}_months" if months else None
    return build_features(df, Plan((Recipe(name, operation, (column,), window),), tuple(group), time))


def ratio(df: DataFrame, name: str, numerator: str, denominator: str, divide_by_zero: str = "nan") -> DataFrame:
    return build_features(df, Plan((Recipe(name, "ratio", (numerator, denominator), divide_by_zero=divide_by_zero),)))
