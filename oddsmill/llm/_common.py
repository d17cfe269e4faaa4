"""Helpers shared by the operators: work tables, sizes of Arrow batches, distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the text contracts: blank and the five ASCII controls.  Fixed value.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word is a maximal run of anything else (Java and Python spelling agree).  Fixed value.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of one Arrow batch sent to a Python worker, so that workers stay small.
ARROW_BATCH_BYTES = 2 << 20

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder of its
    own and any other master gets a folder in the warehouse.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if app not in _own_dirs:
            local = spark.sparkContext.master.startswith("local")
            _own_dirs[app] = tempfile.mkdtemp(prefix="work-") if local else spark.conf.get("spark.sql.warehouse.dir")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/work-{app}"


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete work tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_work_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every work table of this application; results not yet read from them are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they need no path of the driver's."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if sc.applicationId in _shipped or not root.is_dir():  # a package inside an archive has been sent already
        return
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Ready a session for Python stages: code sent, Arrow batches bounded by bytes (rows never change, only how they are cut)."""
    ship_code(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if _bytes(now) > most or _bytes(now) <= 0:
        spark.conf.set(key, f"{most}b")


def _bytes(text: str) -> int:
    number = text.rstrip("bBkKmMgG")
    unit = text[len(number) : len(number) + 1].lower()
    return int(number) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit]


def free_name(columns: list[str], name: str | None) -> str | None:
    """What ``with_free_names`` calls a column: its place, which no helper column of an operator is called."""
    if name is None:
        return None
    at = next((i for i, c in enumerate(columns) if c == name), None)
    at = next((i for i, c in enumerate(columns) if c.lower() == name.lower()), None) if at is None else at
    return None if at is None else f"in{at}"


def with_free_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named in0, in1, ..., so that names of the input and of the operator cannot clash."""
    return df.toDF(*[f"in{i}" for i in range(len(df.columns))])


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)))


def buckets_for(rows: int) -> int:
    """Buckets of a two-level prefix: near the root, so neither level grows faster than the root."""
    return max(1, math.isqrt(max(0, rows)))


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str,
    rows: int,
    value: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` (or count) over all rows of the group before this one, from 0.

    The order within a group is (hash bucket of ``order``, ``order``).  Each
    group is cut into about sqrt(rows) hash buckets whose totals are summed
    first, so no task ever holds a whole group: a group with a third of all
    rows costs a window of about sqrt(rows) bucket totals, and each bucket is
    ranked by itself.  ``group`` columns must not be null.  Rows that tie in
    every ``order`` column must be interchangeable.
    """
    n = buckets_for(rows)
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    amount = F.col(value) if value else F.lit(1).cast("long")
    totals = b.groupBy(*group, "_bucket").agg(F.sum(amount).alias("_total"))
    over = Window.orderBy("_bucket") if not group else Window.partitionBy(*group).orderBy("_bucket")
    bases = totals.withColumn("_base", F.coalesce(F.sum("_total").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = bases.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), "_base")
    on = reduce(lambda x, y: x & y, (F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)), F.col("_bucket") == F.col("_b"))
    joined = b.join(bases, on)
    inner = Window.partitionBy(*group, "_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).drop("_bucket", "_b", "_base", *[f"_g{i}" for i in range(len(group))])


def permuted(x: str, n: str, *seeds: str) -> str:
    """SQL text: the image of ``x`` in [0, n) under a keyed pseudorandom permutation of [0, n).

    A four-round Feistel network over the mixed radix a x b with
    a = ceil(sqrt(n)) and b = ceil(n / a), which is a bijection of [0, a*b);
    images of n or more are sent through again (a*b - n < a, so that is rare).
    ``x`` and ``n`` are SQL texts of longs, ``seeds`` of the key.
    """
    a = f"cast(ceil(sqrt(cast(greatest({n}, 1) as double))) as bigint)"
    b = f"((greatest({n}, 1) + {a} - 1) div {a})"
    key = ", ".join(seeds) or "0"

    def once(v: str) -> str:
        state = f"named_struct('l', {v} % {a}, 'r', {v} div {a})"
        step = (
            f"(s, k) -> if(k % 2 = 0, named_struct('l', pmod(s.l + pmod(xxhash64(s.r, k, {key}), {a}), {a}), 'r', s.r), "
            f"named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64(s.l, k, {key}), {b}), {b})))"
        )
        return f"aggregate(array(0, 1, 2, 3), {state}, {step}, s -> s.r * {a} + s.l)"

    return f"aggregate(sequence(1, 64), {once(x)}, (y, i) -> if(y < {n}, y, {once('y')}))"
