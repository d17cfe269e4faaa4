"""Runs, artefacts and splits as tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, config_hash string, data_hash string, user_id string, status string, created_at timestamp, config string"


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def list_runs(runs: DataFrame, status: str | None = None, user: str | None = None, limit: int = 100) -> DataFrame:
    """The latest runs that match."""
    out = runs
    if status:
        out = out.where(F.col("status") == status)
    if user:
        out = out.where(F.col("user_id") == user)
    return out.orderBy(F.desc("created_at"), "run_id").limit(limit)


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """field, a, b, same: two runs field by field."""
    fields = [c for c in runs.columns if c != "run_id"]
    side = lambda i, n: runs.where(F.col("run_id") == i).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(n)) for f in fields])).alias("e")).select("e.*")
    return side(a, "a").join(side(b, "b"), "field").select("field", "a", "b", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def lineage(links: DataFrame, start: str, most: int = 10_000) -> DataFrame:
    """(artifact, depth): everything an artefact is made from, nearest first, over links (child, parent).

    Each round joins the artefacts met last with the links and keeps what was
    not met before, so diamonds are walked once, cycles end and depth is that of
    the chain; ``most`` rounds without an end are an error.
    """
    spark = links.sparkSession
    found = [(start, 0)]
    met, last = {start}, [start]
    for depth in range(1, most + 2):
        rows = links.where(F.col("child").isin(last)).select("parent").distinct().where("parent IS NOT NULL").collect() if last else []
        last = sorted({r["parent"] for r in rows} - met)
        if not last:
            return spark.createDataFrame(found, "artifact string, depth int")
        if depth > most:
            break
        met.update(last)
        found += [(x, depth) for x in last]
    raise RuntimeError(f"lineage of {start} is deeper than {most}")


# Runs, steps and artefacts are logs of events; what a run or an artefact is follows from its events.

EVENT_SCHEMA = "kind string, id string, ts timestamp, field string, value string"


def new_run_id(config: dict, when: str, user: str = "") -> str:
    """Sortable, and the same for the same config, moment and user."""
    stamp = when.replace("-", "").replace(":", "").replace(" ", "T").split(".")[0]
    return f"run_{stamp}_{hashlib.sha256(f'{config_hash(config)}|{when}|{user}'.encode()).hexdigest()[:8]}"


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the paths, lengths and SHA-256s of the files under a path, on any file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha")).orderBy("name", "sha").collect()
    return hashlib.sha256("\n".join(f"{r['name']} {r['length']} {r['sha']}" for r in each).encode()).hexdigest()


def record(spark: SparkSession, path: str, kind: str, key: str, when: str, fields: dict) -> None:
    """Append what became known of a run, a step or an artefact; None takes a field back."""
    rows = [(kind, key, k, None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str)) for k, v in fields.items()]
    log = spark.createDataFrame(rows, "kind string, id string, field string, value string")
    log.select("kind", "id", F.lit(when).cast("timestamp").alias("ts"), "field", "value").write.mode("append").parquet(path)


def recorded(log: DataFrame, kind: str) -> DataFrame:
    """(id, field, value, ts): the latest value of each field; deleted ids are left out."""
    latest = log.where(F.col("kind") == kind).groupBy("id", "field").agg(F.max(F.struct("ts", "value")).alias("e")).select("id", "field", "e.value", "e.ts")
    gone = latest.where("field = 'deleted' AND value = 'true'").select(F.col("id").alias("_id"))
    return latest.join(gone, F.col("id") == F.col("_id"), "left_anti")


def runs_of(log: DataFrame, fields: tuple[str, ...] = ("status", "user_id", "config_hash", "data_hash")) -> DataFrame:
    """run_id, created_at and the fields asked for, one row a run, as ``list_runs`` takes them."""
    now = recorded(log, "run")
    created = log.where("kind = 'run'").groupBy(F.col("id").alias("_id")).agg(F.min("ts").alias("created_at"))
    wide = now.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return wide.join(created, F.col("id") == F.col("_id")).select(F.col("id").alias("run_id"), "created_at", *fields)


def steps_of(log: DataFrame, run: str) -> DataFrame:
    """step, status, started, ended of one run; steps are recorded under "run/step"."""
    own = log.where((F.col("kind") == "step") & F.col("id").startswith(f"{run}/"))
    status = F.max(F.when(F.col("field") == "status", F.struct("ts", "value")))["value"]
    return own.groupBy(F.substring_index("id", "/", -1).alias("step")).agg(status.alias("status"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def register_artifact(spark: SparkSession, path: str, key: str, when: str, run: str, kind: str, file: str, made_from: tuple[str, ...] = ()) -> None:
    record(spark, path, "artifact", key, when, {"run_id": run, "type": kind, "path": file, "hash": file_hash(spark, file), **{f"parent:{p}": p for p in made_from}})


def delete_artifact(spark: SparkSession, path: str, key: str, when: str) -> None:
    record(spark, path, "artifact", key, when, {"deleted": True})


def verify_artifact(spark: SparkSession, log: DataFrame, key: str) -> bool:
    """Whether the files of an artefact are what they were when it was registered."""
    known = {r["field"]: r["value"] for r in recorded(log, "artifact").where(F.col("id") == key).collect()}
    return "path" in known and file_hash(spark, known["path"]) == known["hash"]


def artifact_links(log: DataFrame) -> DataFrame:
    """(child, parent) for ``lineage``."""
    return recorded(log, "artifact").where(F.col("field").startswith("parent:")).select(F.col("id").alias("child"), F.col("value").alias("parent"))


# The audit log is append-only; each entry holds the hash of the one before it, so a change or a gap shows.

AUDIT_SCHEMA = "seq long, ts timestamp, user_id string, action string, resource string, details string, previous string, hash string"


def _entry_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def audit(spark: SparkSession, path: str, when: str, user: str, action: str, resource: str, details: dict | None = None) -> None:
    """Append one entry after the last."""
    try:
        last = spark.read.schema(AUDIT_SCHEMA).parquet(path).agg(F.max(F.struct("seq", "hash")).alias("e")).first()["e"]
    except AnalysisException:  # no log yet
        last = None
    row = [(last["seq"] + 1 if last else 0, user, action, resource, json.dumps(details or {}, sort_keys=True, default=str), last["hash"] if last else "")]
    entry = spark.createDataFrame(row, "seq long, user_id string, action string, resource string, details string, previous string").withColumn("ts", F.lit(when).cast("timestamp"))
    rest = ("seq", "ts", "user_id", "action", "resource", "details", "previous")
    entry.select(*rest, _entry_hash(*rest).alias("hash")).coalesce(1).write.mode("append").parquet(path)


def audit_faults(log: DataFrame) -> DataFrame:
    """seq, fault: entries that were changed, and gaps in the chain."""
    changed = log.where(F.col("hash") != _entry_hash("seq", "ts", "user_id", "action", "resource", "details", "previous")).select("seq", F.lit("changed").alias("fault"))
    before = log.select((F.col("seq") + 1).alias("_s"), F.col("hash").alias("_h"))
    chained = log.where("seq > 0").join(before, F.col("seq") == F.col("_s"), "left")
    return changed.unionByName(chained.where(F.col("_h").isNull() | (F.col("previous") != F.col("_h"))).select("seq", F.lit("gap").alias("fault")))


def split_of(keys: list[str], train: float = 0.7, seed: int = 42) -> Column:
    """train or test by a hash of the keys: the same rows on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1_000_000))
    return F.when(u < int(train * 1_000_000), "train").otherwise("test")


def time_split(time: str, cut: str) -> Column:
    return F.when(F.col(time) < F.lit(cut).cast("timestamp"), "train").otherwise("test")
