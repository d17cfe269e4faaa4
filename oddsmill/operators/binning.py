"""Binning, weight of evidence, information value.

Everything after the first pass works on bin tables of a few dozen rows a
feature; merges are folds over the sorted bins, run inside the plan.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import bin_of_array, interval_label, iv_strength
from .curves import quantiles
from .stability import quantile_edges

EPSILON = 1e-4
MISSING, OTHER = "__MISSING__", "__OTHER__"


def edges(df: DataFrame, column: str, bins: int, method: str = "quantile", custom: list[float] | None = None) -> DataFrame:
    """One row ``_edges``: ascending inner edges; bins are (lo, hi] and open to both ends."""
    known = df.where(F.col(column).isNotNull())
    if method == "custom":
        return df.sparkSession.createDataFrame([(sorted(set(map(float, custom or []))),)], "_edges array<double>")
    if method == "quantile":
        return quantile_edges(known, column, bins)
    if method == "width":
        lo, width = F.min(column), (F.max(column) - F.min(column)) / bins
        return known.agg(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: lo + k * width).alias("_edges"))
    raise ValueError(f"unknown method: {method}")


def assign(df: DataFrame, column: str, found: DataFrame, out: str = "bin") -> DataFrame:
    """Add the bin number; NULL values have none."""
    return df.crossJoin(F.broadcast(found)).withColumn(out, bin_of_array(F.col(column), F.col("_edges"))).drop("_edges")  # one row


def categorical(df: DataFrame, column: str, least_share: float = 0.05, out: str = "bin") -> DataFrame:
    """Categories of at least int(n * least_share) rows keep their name; the rest and NULL get fixed ones."""
    n = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    kept = n.crossJoin(F.broadcast(total)).where((F.col("_n") >= F.floor(F.col("_all") * least_share)) & F.col("_v").isNotNull()).select("_v")  # one row
    joined = df.join(kept, F.col(column) == F.col("_v"), "left")
    return joined.withColumn(out, F.when(F.col(column).isNull(), MISSING).when(F.col("_v").isNull(), OTHER).otherwise(F.col(column))).drop("_v")


def bin_table(df: DataFrame, keys: list[str], label: str, weight: str | None = None) -> DataFrame:
    """keys, n, events, non_events over rows with a label; NULL keys are a bin."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    return df.where(y.isNotNull()).groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * y).alias("events"), F.sum(w * (1 - y)).alias("non_events"))


def woe_table(table: DataFrame, by: list[str] | None = None, eps: float = EPSILON) -> DataFrame:
    """A bin table with event_rate, woe and iv_part; ``by`` names the feature columns, if there are several."""
    over = Window.partitionBy(*(by or []))
    e = (F.col("events") + eps) / (F.sum("events").over(over) + eps)
    g = (F.col("non_events") + eps) / (F.sum("non_events").over(over) + eps)
    woe = F.ln(g / e)
    return table.select("*", (F.col("events") / F.col("n")).alias("event_rate"), woe.alias("woe"), ((g - e) * woe).alias("iv_part"))


def iv_summary(woe: DataFrame, by: list[str]) -> DataFrame:
    """by, n_bins, iv, strength."""
    out = woe.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bins"), F.sum("iv_part").alias("iv"))
    return out.withColumn("strength", iv_strength(F.col("iv")))


def encode_woe(df: DataFrame, key: str, woe: DataFrame, out: str | None = None, unseen: float = 0.0) -> DataFrame:
    """Join the weight of each bin; unseen bins get ``unseen``."""
    m = woe.select(F.col(key).alias("_k"), F.col("woe").alias("_w"))
    joined = df.join(m, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn(out or f"{key}_woe", F.coalesce("_w", F.lit(unseen))).drop("_k", "_w")


def multi_bin_table(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, bin, n, events, non_events) of several categorical columns in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin")) for c in columns])
    long = df.select(F.explode(pairs).alias("p"), F.col(label).alias("_y")).select("p.feature", "p.bin", "_y")
    return bin_table(long, ["feature", "bin"], "_y")


def woe_json(woe: DataFrame, key: str) -> DataFrame:
    """One row: the mapping as JSON with iv, strength, n_bins and epsilon."""
    entry = F.struct(F.coalesce(F.col(key).cast("string"), F.lit(MISSING)).alias("key"), F.round("woe", 10).alias("value"))
    out = woe.agg(F.array_sort(F.collect_list(entry)).alias("e"), F.sum("iv_part").alias("iv"), F.count(F.lit(1)).alias("n_bins"))
    spec = F.struct(F.map_from_entries("e").alias("mapping"), F.round("iv", 10).alias("iv"), iv_strength(F.col("iv")).alias("predictive_power"), "n_bins", F.lit(EPSILON).alias("epsilon"))
    return out.select(F.to_json(spec).alias("json"))


_BIN = "struct<lo:int,hi:int,n:bigint,events:bigint>"


def _sorted_bins(table: DataFrame, key: str, by: list[str]) -> DataFrame:
    one = F.struct(F.col(key).cast("int").alias("lo"), F.col(key).cast("int").alias("hi"), F.col("n").cast("long").alias("n"), F.col("events").cast("long").alias("events"))
    return table.where(F.col(key).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("bins"))  # bins of a feature, a few dozen


def _pooled(direction: str) -> str:
    """SQL text of a fold that pools neighbours until rates go one way (pool adjacent violators)."""
    worse = {"up": "l.events * x.n > x.events * l.n", "down": "l.events * x.n < x.events * l.n"}[direction]
    # the stack is folded back as long as its last element violates; a stack of k bins needs at most k steps
    step = (
        "(acc, b) -> aggregate(sequence(0, size(acc)), named_struct('s', acc, 'x', b), (st, i) -> "
        f"transform(array(named_struct('s', st.s, 'x', st.x, 'l', if(size(st.s) > 0, st.s[size(st.s) - 1], null))), q -> "
        f"if(size(q.s) > 0 and exists(array(named_struct('l', q.l, 'x', q.x)), z -> {worse.replace('l.', 'z.l.').replace('x.', 'z.x.')}), "
        "named_struct('s', slice(q.s, 1, size(q.s) - 1), 'x', named_struct('lo', q.l.lo, 'hi', q.x.hi, 'n', q.l.n + q.x.n, 'events', q.l.events + q.x.events)), "
        "named_struct('s', q.s, 'x', q.x)))[0], st -> concat(st.s, array(st.x)))"
    )
    return f"aggregate(bins, cast(array() as array<{_BIN}>), {step})"


def monotone_bins(table: DataFrame, key: str = "bin", by: list[str] | None = None, direction: str = "auto") -> DataFrame:
    """(by, bin, lo, hi, n, events, event_rate): neighbours pooled until event rates go one way.

    ``auto`` takes the direction with fewer violations between neighbours, down when they tie.
    """
    by = by or []
    up = "size(filter(sequence(1, size(bins) - 1), i -> bins[i].events * bins[i - 1].n < bins[i - 1].events * bins[i].n))"
    down = "size(filter(sequence(1, size(bins) - 1), i -> bins[i].events * bins[i - 1].n > bins[i - 1].events * bins[i].n))"
    s = _sorted_bins(table, key, by)
    choice = {"up": F.lit(True), "down": F.lit(False), "auto": F.expr(f"if(size(bins) < 2, true, {up} < {down})")}[direction]
    pooled = s.withColumn("_up", choice).withColumn("merged", F.when(F.col("_up"), F.expr(_pooled("up"))).otherwise(F.expr(_pooled("down"))))
    return _flat(pooled, by)


def _flat(merged: DataFrame, by: list[str]) -> DataFrame:
    out = merged.select(*by, F.posexplode("merged").alias("bin", "m"))
    return out.select(*by, "bin", "m.lo", "m.hi", "m.n", "m.events", (F.col("m.events") / F.col("m.n")).alias("event_rate"))


def coarse_bins(table: DataFrame, key: str = "bin", by: list[str] | None = None, least_rows: int = 30, least_share: float = 0.05) -> DataFrame:
    """(by, fine, coarse, n, events): bins in the order of their rates are joined until each has enough rows.

    Enough is max(least_rows, int(least_share * all)); what is left over joins the last.
    """
    by = by or []
    one = F.struct((F.col("events") / F.col("n")).alias("rate"), F.col(key).alias("fine"), F.col("n").cast("long").alias("n"), F.col("events").cast("long").alias("events"))
    s = table.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("bins"), F.sum("n").alias("all"))
    s = s.withColumn("need", F.greatest(F.lit(least_rows), F.floor(F.col("all") * least_share)).cast("long"))
    fold = (
        "aggregate(bins, named_struct('c', 0, 'n', 0L, 'out', cast(array() as array<int>)), "
        "(a, b) -> named_struct('c', if(a.n + b.n >= need, a.c + 1, a.c), 'n', if(a.n + b.n >= need, 0L, a.n + b.n), 'out', concat(a.out, array(a.c))), "
        "a -> if(a.n > 0 and a.c > 0, transform(a.out, x -> least(x, a.c - 1)), a.out))"
    )
    rows = s.withColumn("ids", F.expr(fold)).select(*by, F.explode(F.arrays_zip("bins", "ids")).alias("z"))
    return rows.select(*by, F.col("z.bins.fine").alias("fine"), F.col("z.ids").alias("coarse"), F.col("z.bins.n").alias("n"), F.col("z.bins.events").alias("events"))


def optimal_bins(table: DataFrame, key: str = "bin", by: list[str] | None = None, most: int = 5) -> DataFrame:
    """Monotone bins, then the neighbours whose joining loses least information value are joined until ``most`` are left."""
    by = by or []
    bins = monotone_bins(table, key, by)
    bare = bins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "n", "events"))).alias("merged"))
    totals = "aggregate(merged, named_struct('e', 0L, 'g', 0L), (a, b) -> named_struct('e', a.e + b.events, 'g', a.g + b.n - b.events))"
    bare = bare.withColumn("t", F.expr(totals))
    part = lambda e, n: f"((({n}) - ({e}) + {EPSILON}) / (t.g + {EPSILON}) - (({e}) + {EPSILON}) / (t.e + {EPSILON})) * ln(((({n}) - ({e}) + {EPSILON}) / (t.g + {EPSILON})) / ((({e}) + {EPSILON}) / (t.e + {EPSILON})))"
    loss = f"{part('m[i].events', 'm[i].n')} + {part('m[i - 1].events', 'm[i - 1].n')} - ({part('m[i].events + m[i - 1].events', 'm[i].n + m[i - 1].n')})"
    least = f"array_min(transform(sequence(1, size(m) - 1), i -> named_struct('loss', {loss}, 'i', i))).i"
    join = (
        f"transform(array(named_struct('m', m, 'i', {least})), q -> concat(slice(q.m, 1, q.i - 1), array(named_struct('lo', q.m[q.i - 1].lo, 'hi', q.m[q.i].hi, "
        "'n', q.m[q.i - 1].n + q.m[q.i].n, 'events', q.m[q.i - 1].events + q.m[q.i].events)), slice(q.m, q.i + 2, size(q.m))))[0]"
    )
    fold = f"aggregate(sequence(1, size(merged)), merged, (m, k) -> if(size(m) <= {most}, m, {join}))"
    return _flat(bare.withColumn("merged", F.expr(fold)).drop("t"), by)


def prebin_edges(df: DataFrame, columns: list[str], prebins: int = 20) -> DataFrame:
    """(_f, _edges): the distinct inner quantiles of numeric columns, in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.feature", "p.value").where("value is not null")
    inner = [k / prebins for k in range(1, prebins)]
    return quantiles(long, "value", inner, ["feature"]).select(F.col("feature").alias("_f"), F.array_sort(F.array_distinct("q")).alias("_edges"))


def auto_bins(df: DataFrame, columns: list[str], label: str, prebins: int = 20, most: int = 5, least_iv: float = 0.02) -> DataFrame:
    """(feature, bin, lo, hi, n, events, non_events, event_rate, woe, iv_part, iv): optimal bins of all numeric columns in one job.

    lo and hi number the quantile prebins; features below ``least_iv`` are left out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.where(F.col(label).isNotNull()).select(F.explode(pairs).alias("p"), F.col(label).alias("_y")).select("p.feature", "p.value", "_y").where("value is not null")
    # how often each value comes with each outcome: edges and bins both follow from it
    long = long.groupBy("feature", "value", "_y").agg(F.count(F.lit(1)).alias("_n"))
    inner = [k / prebins for k in range(1, prebins)]
    cut = quantiles(long, "value", inner, ["feature"], weight="_n").select(F.col("feature").alias("_f"), F.array_sort(F.array_distinct("q")).alias("_edges"))
    # what is broadcast is a row of edges a column
    binned = long.join(F.broadcast(cut), F.col("feature") == F.col("_f")).withColumn("bin", bin_of_array(F.col("value"), F.col("_edges")))
    found = optimal_bins(bin_table(binned, ["feature", "bin"], "_y", "_n"), "bin", ["feature"], most).withColumn("non_events", F.col("n") - F.col("events"))
    woe = woe_table(found.drop("event_rate"), ["feature"])
    return woe.withColumn("iv", F.sum("iv_part").over(Window.partitionBy("feature"))).where(F.col("iv") >= least_iv)


def tree_bins(df: DataFrame, column: str, label: str, most: int = 5, least_share: float = 0.05, prebins: int = 64) -> list[float]:
    """Inner edges of a best-first Gini tree of at most ``most`` leaves over quantile prebins.

    Only the histogram of prebins comes to the driver, a row each.
    """
    cut = edges(df, column, prebins)
    bounds = cut.first()["_edges"] or []
    table = {r["bin"]: (r["n"], r["events"]) for r in bin_table(assign(df, column, cut), ["bin"], label).collect() if r["bin"] is not None}
    keys = sorted(table)
    need = max(1, int(sum(n for n, _ in table.values()) * least_share))

    def total(part: list[int]) -> tuple[int, int]:
        return sum(table[k][0] for k in part), sum(table[k][1] for k in part)

    def impurity(n: int, e: int) -> float:
        return 2 * e * (n - e) / n if n else 0.0

    def split(part: list[int]) -> tuple[float, int] | None:
        n, e = total(part)
        best, n1, e1 = None, 0, 0
        for i, k in enumerate(part[:-1]):
            n1, e1 = n1 + table[k][0], e1 + table[k][1]
            if min(n1, n - n1) >= need:
                gain = impurity(n, e) - impurity(n1, e1) - impurity(n - n1, e - e1)
                if gain > 1e-12 and (best is None or gain > best[0]):
                    best = gain, i + 1
        return best

    leaves = [keys]
    while len(leaves) < most:
        options = [(s[0], -i, s[1]) for i, part in enumerate(leaves) if (s := split(part))]
        if not options:
            break
        _, at, cut_at = max(options)
        part = leaves.pop(-at)
        leaves += [part[:cut_at], part[cut_at:]]
    firsts = sorted(part[0] for part in leaves if part)[1:]
    return [bounds[k - 1] for k in firsts]


def woe_from_json(spark, text: str, key: str) -> DataFrame:
    """The (key, woe) of a mapping that ``woe_json`` wrote, for ``encode_woe``; the missing category is NULL again."""
    spec = json.loads(text)
    rows = [(None if k == MISSING else k, float(v)) for k, v in sorted(spec["mapping"].items())]
    return spark.createDataFrame(rows, f"{key} string, woe double")


def bin_info(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """bin, label, lo, hi: the intervals behind bin numbers; outer ends are NULL."""
    bounds = found.first()["_edges"] or []
    ends = [None, *bounds, None]
    rows = [(i, interval_label(bounds, i), ends[i], ends[i + 1]) for i in range(len(bounds) + 1)]
    return df.sparkSession.createDataFrame(rows, "bin int, label string, lo double, hi double")


def best_cuts(bins: list[tuple[int, int]], most: int = 5, least_share: float = 0.05, trend: str = "auto") -> list[int]:
    """Places where to cut bins of (n, events) so that the information value is greatest.

    At most ``most`` groups of neighbours, each with ``least_share`` of all rows
    or more, event rates going one way (``up``, ``down``, the better of both, or
    any way).  Dynamic programming over (groups, last group), so exact.
    """
    if trend == "auto":
        return max((best_cuts(bins, most, least_share, way) for way in ("up", "down")), key=lambda c: information(bins, c))
    k, rows, events = len(bins), [0], [0]
    for n, e in bins:
        rows.append(rows[-1] + n)
        events.append(events[-1] + e)
    need = rows[-1] * least_share

    def part(a: int, b: int) -> float:
        return _iv_part(rows[b] - rows[a], events[b] - events[a], rows[-1], events[-1])

    def follows(a: int, b: int, c: int) -> bool:
        """Whether rates of groups [a, b) and [b, c) go the right way."""
        before, after = (events[b] - events[a]) * (rows[c] - rows[b]), (events[c] - events[b]) * (rows[b] - rows[a])
        return before < after if trend == "up" else before > after if trend == "down" else True

    best: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}  # value and cuts of all groupings of the first b bins whose last group is [a, b)
    layer = {(0, b): (part(0, b), ()) for b in range(1, k + 1) if rows[b] and rows[b] >= need}
    for _ in range(most):
        for at, found in layer.items():
            if at not in best or found[0] > best[at][0]:
                best[at] = found
        following: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for (a, b), (value, cuts) in layer.items():
            for c in range(b + 1, k + 1):
                n = rows[c] - rows[b]
                if n and n >= need and follows(a, b, c) and ((b, c) not in following or value + part(b, c) > following[b, c][0]):
                    following[b, c] = value + part(b, c), (*cuts, b)
        layer = following
    whole = [found for (_, b), found in best.items() if b == k]
    return list(max(whole, key=lambda x: (x[0], -len(x[1])))[1]) if whole else []


def _iv_part(n: int, e: int, rows: int, events: int) -> float:
    bad, good = (e + EPSILON) / (events + EPSILON), (n - e + EPSILON) / (rows - events + EPSILON)
    return (good - bad) * math.log(good / bad)


def information(bins: list[tuple[int, int]], cuts: list[int]) -> float:
    """Information value of bins of (n, events) grouped at ``cuts``."""
    ends = [0, *cuts, len(bins)]
    rows, events = sum(n for n, _ in bins), sum(e for _, e in bins)
    return sum(_iv_part(sum(n for n, _ in bins[a:b]), sum(e for _, e in bins[a:b]), rows, events) for a, b in zip(ends, ends[1:]))


def best_bins(table: DataFrame, key: str = "bin", by: list[str] | None = None, most: int = 5, least_share: float = 0.05, trend: str = "auto") -> DataFrame:
    """(by, bin, lo, hi, n, events, event_rate): the grouping of ``best_cuts`` of each bin table.

    Bin tables come to the driver: a few dozen rows a feature, whatever the input.
    """
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    groups: dict[tuple, list] = {}
    for r in table.where(F.col(key).isNotNull()).select(*by, key, "n", "events").collect():
        groups.setdefault(tuple(r[c] for c in by), []).append((int(r[key]), int(r["n"]), int(r["events"])))
    rows = []
    for name, bins in groups.items():
        bins.sort()
        ends = [0, *best_cuts([b[1:] for b in bins], most, least_share, trend), len(bins)]
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            n, e = sum(x[1] for x in bins[a:b]), sum(x[2] for x in bins[a:b])
            rows.append((*name, i, bins[a][0], bins[b - 1][0], n, e, e / n if n else None))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "bin int, lo int, hi int, n long, events long, event_rate double"])
    return table.sparkSession.createDataFrame(rows, schema)
