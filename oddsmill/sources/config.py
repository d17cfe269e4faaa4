"""Configurations: read from YAML or JSON, checked, written, and turned into sources, recipes and paths."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.recipes import Plan
from . import io

ENGINES = ("spark",)


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)
    columns: tuple[str, ...] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        return io.read(spark, self.path, columns=list(self.columns) or None, format=self.format, **self.options)


@dataclass(frozen=True)
class Config:
    project: str
    sources: tuple[Source, ...]
    engine: str = "spark"
    spark: dict = field(default_factory=dict)
    features: dict = field(default_factory=dict)
    target: str | None = None
    checkpoint_enabled: bool = False
    checkpoint_dir: str | None = None

    def plan(self) -> Plan:
        return Plan.from_dict(self.features)

    def as_dict(self) -> dict:
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        return out | {"sources": [{f.name: list(v) if isinstance(v := getattr(s, f.name), tuple) else v for f in fields(s)} for s in self.sources]}


def problems(raw: dict) -> list[str]:
    """What is wrong with a configuration, in words; none if it is fit to use."""
    out = []
    known = {f.name for f in fields(Config)}
    out += [f"unknown setting: {k}" for k in sorted(set(raw) - known)]
    if not raw.get("project"):
        out.append("project is missing")
    sources = raw.get("sources") or []
    if not sources:
        out.append("at least one source is needed")
    names = [s.get("name") for s in sources]
    out += [f"source {n} is named twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
    for i, s in enumerate(sources):
        out += [f"source {i}: {k} is missing" for k in ("name", "path") if not s.get(k)]
        out += [f"source {i}: unknown setting: {k}" for k in sorted(set(s) - {f.name for f in fields(Source)})]
    if raw.get("engine", "spark") not in ENGINES:
        out.append(f"unknown engine: {raw['engine']}")
    elif not raw.get("spark"):
        out.append("engine spark needs the settings under spark")
    if raw.get("checkpoint_enabled") and not raw.get("checkpoint_dir"):
        out.append("checkpoint_enabled needs checkpoint_dir")
    try:
        Plan.from_dict(raw.get("features") or {})
    except (TypeError, KeyError) as e:
        out.append(f"features: {e}")
    return out


def from_dict(raw: dict) -> Config:
    found = problems(raw)
    if found:
        raise ValueError("; ".join(found))
    sources = tuple(Source(**s | {"columns": tuple(s.get("columns") or ())}) for s in raw["sources"])
    return Config(**raw | {"sources": sources})


def load(path: str) -> Config:
    """A configuration by the suffix of its path: YAML (``yaml`` must be installed) or JSON."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return from_dict(yaml.safe_load(text) or {})
    if path.endswith(".json"):
        return from_dict(json.loads(text))
    raise ValueError(f"unknown format: {path}")


def dump(config: Config, path: str) -> None:
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(config.as_dict(), sort_keys=True)
    else:
        text = json.dumps(config.as_dict(), sort_keys=True, indent=2)
    ensure_dir(os.path.dirname(path) or ".")
    Path(path).write_text(text, encoding="utf-8")


def ensure_dir(path: str) -> str:
    Path(path).mkdir(parents=True, exist_ok=True)
    return path


def resolve_path(path: str, base: str | None = None) -> str:
    """An absolute path; variables and ~ are filled in, URIs are left as they are."""
    path = os.path.expanduser(os.path.expandvars(path))
    return path if "://" in path or os.path.isabs(path) else os.path.abspath(os.path.join(base or os.getcwd(), path))


#: Starting points by level of detail: least first.
TEMPLATES: dict[str, dict[str, dict]] = {
    "basic": {
        "scorecard": {"project": "scorecard", "sources": [{"name": "applications", "path": "applications.parquet"}], "spark": {"spark.sql.adaptive.enabled": "true"}, "target": "default"},
    },
    "panel": {
        "behaviour": {
            "project": "behaviour",
            "sources": [{"name": "months", "path": "months.parquet"}],
            "spark": {"spark.sql.adaptive.enabled": "true"},
            "target": "default",
            "features": {
                "group": ["customer_id"],
                "time": "snapshot_date",
                "recipes": [
                    {"name": "utilisation", "operation": "ratio", "columns": ["balance", "credit_limit"]},
                    {"name": "worst_dpd_12m", "operation": "max", "columns": ["days_past_due"], "window": "last_12_months"},
                ],
            },
        },
    },
}


def templates() -> list[tuple[str, str]]:
    return [(level, name) for level, own in TEMPLATES.items() for name in own]


def template(level: str, name: str) -> Config:
    if (level, name) not in templates():
        raise ValueError(f"no template {level}/{name}")
    return from_dict(TEMPLATES[level][name])
