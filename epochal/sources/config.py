"""Configurations: nested dictionaries from JSON or YAML files, addressed by paths, and the datasets that one names.

A handful of small files on the driver; no data goes through here.
"""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.sources import files

#: Settings that were renamed, oldest first.
RENAMED = {"/channel_sampling_groups": "/channel_groups", "/period_length_sec": "/period_length", "/strip_func_str": "/strip_func", "/weights_file_name": "/weights"}


def load(path: str) -> dict:
    """YAML needs the yaml package; JSON doesn't."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: install yaml to read it, or give JSON") from e
    return yaml.safe_load(text)


def get(config: dict, path: str, default: Any = None) -> Any:
    """The value at a path like /build/channels."""
    at: Any = config
    for name in path.strip("/").split("/"):
        if not isinstance(at, dict) or name not in at:
            return default
        at = at[name]
    return at


def put(config: dict, path: str, value: Any) -> dict:
    """A copy with the value at a path; None takes it out."""
    out = copy.deepcopy(config)
    *parents, last = path.strip("/").split("/")
    at = out
    for name in parents:
        at = at.setdefault(name, {})
    if value is None:
        at.pop(last, None)
    else:
        at[last] = value
    return out


def merged(config: dict, overrides: dict[str, Any]) -> dict:
    for path, value in overrides.items():
        config = put(config, path, value)
    return config


def migrated(config: dict) -> dict:
    """Old names become new ones; a setting under both is an error. Period lengths without a unit are seconds."""
    for old, new in RENAMED.items():
        if (value := get(config, old)) is not None:
            if get(config, new) is not None:
                raise ValueError(f"both {old} and {new} are set")
            config = put(put(config, old, None), new, value)
    if get(config, "/period_length") is not None and get(config, "/time_unit") is None:
        config = put(config, "/time_unit", "SECOND")
    return config


def datasets(config: dict, folder: str, only: list[str] | None = None) -> dict[str, dict]:
    """The configuration of each dataset that config names, by id: inline, or a file beside it. Ids that aren't there are an error."""
    named = config.get("datasets") or {config.get("id", "dataset"): config}
    if only is not None and (unknown := set(only) - set(named)):
        raise ValueError(f"no datasets named {sorted(unknown)}; there are {sorted(named)}")
    chosen = {k: v for k, v in named.items() if only is None or k in only}
    return {k: migrated(load(str(Path(folder) / v)) if isinstance(v, str) else v) for k, v in chosen.items()}


def all_splits(spark: SparkSession, configs: dict[str, dict], splits: list[str]) -> DataFrame:
    """The archives of several datasets as one table with columns dataset and split; partitions that aren't asked for aren't read."""
    parts = []
    for name, config in configs.items():
        rows = files.read_archive(spark, config["data_dir"], splits=splits)
        parts.append(rows.withColumn("dataset", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def described(path: str, config: dict) -> None:
    """A description beside an archive, of what it was made with."""
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    target.write_text(json.dumps(config, indent=1, sort_keys=True), encoding="utf-8")
