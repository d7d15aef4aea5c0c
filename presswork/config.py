"""Settings of a build in one place: from arguments, the session's configuration and the environment, in this order."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def env_lines(lines: Iterable[str]) -> dict[str, str]:
    """KEY=value lines; blank ones, comments and lines without a key are left out, double quotes around a value go."""
    out = {}
    for line in map(str.strip, lines):
        key, eq, value = line.partition("=")
        if line.startswith("#") or not eq or not key.strip():
            continue
        value = value.strip()
        out[key.strip()] = value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value
    return out


@dataclass(frozen=True)
class Settings:
    """Names in the environment are PRESSWORK_ and the field in capitals, in the session spark.presswork. and the field."""

    timeout: float = 15.0
    retention_days: int = 90
    article_fetch: bool = False
    summary_mode: str = "extract"
    summary_pool: int = 8
    partitions: int = 8

    @classmethod
    def of(cls, spark: SparkSession | None = None, env: Mapping[str, str] | None = None, **given) -> Settings:
        """A value that isn't of the field's kind counts as not set; so does an empty one."""
        env = os.environ if env is None else env
        made = {}
        for f in fields(cls):
            told = [given.get(f.name), spark.conf.get(f"spark.presswork.{f.name}", None) if spark else None, env.get(f"PRESSWORK_{f.name.upper()}")]
            values = [v for v in (_as(type(f.default), x) for x in told) if v is not None]
            made[f.name] = values[0] if values else f.default
        return cls(**made)


def _as(kind: type, value):
    if value is None or value == "":
        return None
    if kind is bool:
        return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}.get(str(value).strip().lower())
    try:
        made = kind(value)
    except (TypeError, ValueError):
        return None
    return None if kind is float and made - made != 0 else made
