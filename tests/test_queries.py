"""Every query of the library against its SQL, value by value and type by type."""

from __future__ import annotations

import subprocess
import sys

import pytest
from oracle import connection, difference

import __spark_entry__ as entry
from tessera.plans import registry

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    kinds, ours = dict(df.dtypes), df.toPandas()
    if name not in registry.SQL:
        assert len(ours)
        return
    made = con.execute(registry.SQL[name])
    theirs = {c[0]: str(c[1]) for c in made.description}
    assert difference(ours, made.df()) == ""
    assert {c: KINDS[k] for c, k in kinds.items()} == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """A copy without llm and pipeline still lists all other queries."""
    import shutil
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert said.stdout.strip() == str(len(registry.QUERIES)), said.stderr


SPANNED = [
    "population_rate_smoothed", "two_threshold_events", "compare_event_lists", "event_overlap_summary", "mask_to_intervals", "bridge_and_drop_runs", "poisson_log_posterior", "poisson_decode",
    "decode_error_percentiles", "sample_windows", "running_windows", "rate_in_closed_intervals",
]


@pytest.fixture(scope="module")
def late_dir(spark, sf_dir, tmp_path_factory):
    """The tables with some events ten days after all others."""
    import os

    import pandas as pd

    at = tmp_path_factory.mktemp("late")
    for name in os.listdir(sf_dir):
        if not name.startswith("events"):
            os.symlink(f"{sf_dir}/{name}", at / name)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas()
    more = rows.head(40).copy()
    more["event_id"] += 10_000_000
    more["ts"] = pd.Timestamp("2024-02-10") + pd.to_timedelta(range(0, 40 * 997, 997), unit="s")
    pd.concat([rows, more]).astype({"ts": "datetime64[us]"}).to_parquet(at / "events.parquet")
    return str(at)


@pytest.mark.parametrize("name", SPANNED)
def test_no_day_is_left_out(spark, late_dir, name):
    ours = registry.QUERIES[name](spark, late_dir).toPandas()
    assert difference(ours, connection(late_dir).execute(registry.SQL[name]).df()) == ""
    for column, least in (("day", 40), ("lap", 40), ("i", 24 * 40)):
        if column in ours and name not in ("mask_to_intervals",):
            assert ours[column].max() >= least
