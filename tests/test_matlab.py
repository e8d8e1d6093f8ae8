"""The container's rules on stand-ins for its nodes; no HDF5 library is needed."""

from __future__ import annotations

import numpy as np
import pytest
from tessera.sources import matlab


class Node:
    def __init__(self, data, kind="double", empty=0):
        self.data, self.shape = np.asarray(data), np.shape(data)
        self.attrs = {"MATLAB_class": kind.encode(), "MATLAB_empty": empty}

    def __array__(self, dtype=None, copy=None):
        return self.data if dtype is None else self.data.astype(dtype)


def codes(text):
    return np.frombuffer(text.encode("utf-16-le"), np.uint16)


def test_nodes():
    file = {"a": Node(codes("één").reshape(-1, 1), "char"), "b": Node([[1.0, 2], [3, 4]])}
    assert matlab.read_node(file["a"], file) == "één"
    assert matlab.read_node(file["b"], file).tolist() == [[1, 3], [2, 4]]
    assert matlab.read_node(Node(np.array([[1], [0]]), "logical"), file).tolist() == [[True, False]]
    assert matlab.read_node(Node(np.array([0, 3]), "double", 1), file).shape == (0, 3)
    cell = Node(np.array([["a"], ["b"]], object), "cell")
    assert matlab.read_node(cell, file)[0] == "één"
    assert matlab.read_node({"x": file["b"], "#refs#": file["a"]}, file).keys() == {"x"}
    assert matlab.decode_text(np.stack([codes("ab "), codes("c  ")])) == ["ab", "c"]


def test_shapes():
    assert matlab.as_vector([[1], [2]], "v").tolist() == [1, 2] and matlab.as_vector([[1, 2]], "v").tolist() == [1, 2]
    assert matlab.as_intervals([[1, 2, 3], [4, 5, 6]], "i").tolist() == [[1, 4], [2, 5], [3, 6]]
    assert matlab.as_intervals([], "i").shape == (0, 2) and matlab.as_intervals([[1], [2]], "i").tolist() == [[1, 2]]
    for bad in (lambda: matlab.as_vector(np.ones((2, 2)), "v"), lambda: matlab.as_ids([1.5], "i"), lambda: matlab.as_ids([np.nan], "i"), lambda: matlab.as_intervals(np.ones((3, 3)), "i")):
        with pytest.raises(ValueError):
            bad()


def test_tables(spark):
    good = dict(spikes=([[0.1, 0.2]], [[102.0], [104.0]]), units={"pyr": [102], "int": [104]}, position=([1.0, 2.0], [[0.1, np.nan], [0.3, 0.4]], [0.5, np.nan]), epochs={"PRE": [0, 9]}, states={"REM": [], "NREM": [[1, 2], [3, 4]]})
    t = matlab.recording_tables(spark, "Cedric_01022030", **good)
    assert [r["shank"] for r in t["units"].collect()] == [1, 1] and t["states"].count() == 2
    assert [r["x1d"] for r in t["position"].orderBy("sample").collect()] == [0.5, None]
    for changed in ({"spikes": ([0.1], [102.0, 104.0])}, {"epochs": {"PRE": [[0, 1], [2, 3], [4, 5]]}}, {"position": ([1.0], [[0.1, 0.2]], [0.5, 0.6])}):
        with pytest.raises(ValueError):
            matlab.recording_tables(spark, "s", **(good | changed))
