"""Reading and writing with a stated schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text"}


def format_of(path: str) -> str:
    for suffix, name in _FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return name
    raise ValueError(f"unknown format: {path}")


def read(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """A table by the suffix of its path; only the columns asked for are read."""
    name = options.pop("format", None) or format_of(path)
    if name == "csv":
        options = {"header": True, "inferSchema": not schema} | options
    reader = spark.read.format(name).options(**options)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    name = options.pop("format", None) or format_of(path)
    if name == "csv":
        options.setdefault("header", True)
    writer = df.write.mode(mode).format(name).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append to a folder of JSON lines."""
    df.write.mode("append").json(path)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def contract(df: DataFrame, required: dict[str, str], not_null: list[str] | None = None) -> DataFrame:
    """check, n_bad, ok: types that differ and nulls where none may be, one job."""
    kinds = dict(df.dtypes)
    wrong = [(f"type:{c}", 0 if kinds.get(c) == t else 1) for c, t in required.items()]
    types = df.sparkSession.createDataFrame(wrong, "check string, n_bad long") if wrong else None
    cols = [c for c in (not_null or []) if c in kinds]
    if cols:
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
        nulls = row.select(F.explode(F.array(*[F.struct(F.lit(f"not_null:{c}").alias("check"), F.col(f"n{i}").alias("n_bad")) for i, c in enumerate(cols)])).alias("e")).select("e.*")
        types = nulls if types is None else types.unionByName(nulls)
    return types.withColumn("ok", F.col("n_bad") == 0)
