"""Nested parameters from YAML, and where a result came from."""

from __future__ import annotations

import functools
import os
import subprocess
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.lru_cache
def _loaded(path: str) -> dict[str, Any]:
    import yaml

    said = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(said, dict):
        raise ValueError(f"{path} is not a mapping")
    return said


def load_params(path: str | os.PathLike) -> dict[str, Any]:
    return _loaded(str(path))


def param(dotted: str, params: dict[str, Any]) -> Any:
    """``a.b.c``; a KeyError names the whole path."""
    at: Any = params
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(dotted)
        at = at[part]
    return at


def with_overrides(params: dict[str, Any], overrides: dict[str, Any]) -> dict[str, Any]:
    """A copy with dotted keys replaced; the keys have to exist."""
    out = {k: (dict(v) if isinstance(v, dict) else v) for k, v in params.items()}
    for dotted, value in overrides.items():
        param(dotted, params)
        *path, last = dotted.split(".")
        at = out
        for part in path:
            at[part] = dict(at[part])
            at = at[part]
        at[last] = value
    return out


def data_dir(candidates: list[str | os.PathLike], pattern: str, variable: str | None = None) -> Path:
    """The first folder, the one in the variable first, that holds a file of the pattern at any depth."""
    tried = [*([os.environ[variable]] if variable and os.environ.get(variable) else []), *candidates]
    for folder in map(Path, tried):
        if folder.is_dir() and next(folder.rglob(pattern), None):
            return folder
    raise FileNotFoundError(f"no {pattern} in {', '.join(map(str, tried))}")


def git_commit(repo: str | os.PathLike = ".", short: bool = True) -> str:
    """The commit, with ``-dirty`` if files differ from it; ``unknown`` outside a repository."""
    try:
        run = lambda *a: subprocess.run(["git", "-C", str(repo), *a], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
        return run("rev-parse", *(["--short"] if short else []), "HEAD") + ("-dirty" if run("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def merged_sidecar(path: str | os.PathLike, found: dict[str, Any], commit: str) -> dict[str, Any]:
    """Write ``found`` into a JSON file beside a result, in any store: keys that are there and not in ``found`` stay, nested ones too.

    The whole file is written under another name and put in place at once.
    """
    from pyarrow import fs

    from .archives import located

    import json
    from datetime import UTC, datetime

    def laid(old: Any, new: Any) -> Any:
        return {**old, **{k: laid(old.get(k), v) for k, v in new.items()}} if isinstance(old, dict) and isinstance(new, dict) else new

    store, at = located(str(path))
    there = {}
    if store.get_file_info(at).type == fs.FileType.File:
        with store.open_input_stream(at) as file:
            there = json.loads(file.read())
    said = laid(there, found | {"commit": commit, "written_at": datetime.now(UTC).isoformat(timespec="seconds")})
    store.create_dir(os.path.dirname(at))
    with store.open_output_stream(f"{at}.new") as file:
        file.write(json.dumps(said, indent=1, sort_keys=True, default=str).encode())
    store.move(f"{at}.new", at)
    return said


def with_provenance(df: DataFrame, commit: str, params: dict[str, Any]) -> DataFrame:
    """``df`` with commit, parameters (JSON) and time of writing in every row."""
    import json

    return df.withColumn("commit", F.lit(commit)).withColumn("params", F.lit(json.dumps(params, sort_keys=True, default=str))).withColumn("written_at", F.current_timestamp())
