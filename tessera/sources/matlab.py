"""Recordings in MATLAB's HDF5 container (version 7.3). Needs h5py, which is optional.

HDF5 holds MATLAB arrays with their axes reversed; the class of each is an attribute, text is UTF-16 code
units, an empty array is a marked placeholder whose values are its sizes, and cells are references.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..schema import EPOCHS, POSITION, SPIKES, STATES, UNITS


def decode_text(codes: np.ndarray) -> str | list[str]:
    """UTF-16 code units: one text, or one for each row of a character matrix, without blanks at its end."""
    codes = np.atleast_2d(np.asarray(codes, np.uint16))
    rows = [r.tobytes().decode("utf-16-le") for r in codes]
    return rows[0] if len(rows) == 1 else [r.rstrip(" ") for r in rows]


def as_vector(a: Any, name: str) -> np.ndarray:
    """A row or column as a flat vector; ValueError for a real matrix."""
    a = np.asarray(a)
    if a.size and max(a.shape, default=1) != a.size:
        raise ValueError(f"{name} is a matrix of {a.shape}")
    return a.reshape(-1)


def as_intervals(a: Any, name: str) -> np.ndarray:
    """(n, 2); empty arrays give no interval, a single pair may lie either way."""
    a = np.asarray(a, float)
    if not a.size:
        return np.empty((0, 2))
    if a.size == 2:
        return a.reshape(1, 2)
    if a.ndim != 2 or 2 not in a.shape:
        raise ValueError(f"{name} is not a list of intervals: {a.shape}")
    return a if a.shape[1] == 2 else a.T


def as_ids(a: Any, name: str) -> np.ndarray:
    v = as_vector(a, name).astype(float)
    if not np.isfinite(v).all() or (v != np.round(v)).any():
        raise ValueError(f"{name} holds values that are no ids")
    return v.astype(np.int64)


def read_node(node: Any, file: Any) -> Any:
    """A group as a dict, a cell as a list, text as str, an array in MATLAB's own axis order."""
    if hasattr(node, "items") and not hasattr(node, "shape"):
        return {k: read_node(v, file) for k, v in node.items() if not k.startswith("#")}
    kind = node.attrs.get("MATLAB_class", b"")
    kind = kind.decode() if isinstance(kind, bytes) else str(kind)
    if node.attrs.get("MATLAB_empty", 0):
        sizes = tuple(int(n) for n in np.asarray(node).reshape(-1))
        return "" if kind == "char" else [] if kind == "cell" else np.empty(sizes)
    data = np.asarray(node).T
    if kind == "char":
        return decode_text(data)
    if kind == "cell":
        return [read_node(file[r], file) for r in data.reshape(-1)]
    return data.astype(bool) if kind == "logical" else data


def read_file(path: str, name: str) -> dict[str, Any]:
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading this container needs h5py") from e
    with h5py.File(path, "r") as file:
        return read_node(file[name], file)


def recording_tables(spark: SparkSession, session: str, spikes: tuple[Any, Any], units: dict[str, Any], position: tuple[Any, Any, Any], epochs: dict[str, Any], states: dict[str, Any]) -> dict[str, DataFrame]:
    """Tables of one recording from its arrays: (times, ids), kind -> ids, (times, xy, 1-D), epoch -> interval, state -> intervals.

    ValueError where lengths differ or an epoch is not one interval. NaN becomes NULL.
    """
    t, ids = as_vector(spikes[0], "spike times").astype(float), as_ids(spikes[1], "spike ids")
    if len(t) != len(ids):
        raise ValueError(f"{len(t)} spike times and {len(ids)} spike ids")
    at, xy, line = as_vector(position[0], "position times"), np.asarray(position[1], float), as_vector(position[2], "1-D position")
    xy = xy if xy.ndim == 2 and xy.shape[1] == 2 else xy.T
    if not len(at) == len(xy) == len(line):
        raise ValueError("position arrays of different lengths")
    one = {k: as_intervals(v, k) for k, v in epochs.items()}
    if any(len(v) != 1 for v in one.values()):
        raise ValueError("an epoch is one interval")
    number = lambda v: None if not np.isfinite(v) else float(v)
    make = spark.createDataFrame
    return {
        "spikes": make([(session, int(i), float(s)) for i, s in zip(ids, t, strict=True)], SPIKES),
        "units": make([(session, int(i), kind, int(i) // 100) for kind, v in units.items() for i in as_ids(v, kind)], UNITS),
        "position": make([(session, k, float(a), number(p[0]), number(p[1]), number(x)) for k, (a, p, x) in enumerate(zip(at, xy, line, strict=True))], POSITION),
        "epochs": make([(session, k, float(v[0, 0]), float(v[0, 1])) for k, v in one.items()], EPOCHS),
        "states": make([(session, k, float(a), float(b)) for k, v in states.items() for a, b in as_intervals(v, k)], STATES),
    }
