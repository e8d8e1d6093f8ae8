"""Recursive filters over recordings in chunks, exactly.

A cascade of sections maps its state and a chunk of samples to its state after it: an affine map, whose matrix depends on the
chunk's length alone. Each chunk is run once from zero to find the map's offset; the maps compose from chunk to
chunk, one small row each; then each chunk runs from its true state. There is no halo, and nothing is cut off.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import run_section, steady_state
from ..sources.tables import written


def run_cascade(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output over axis 0, and the state (sections, 2, ...) after it. The last two samples of a section give its state."""
    after = []
    for section, s in zip(sections, state, strict=True):
        y = run_section(section, x, s)
        _, b1, b2, _, a1, a2 = section
        if len(x) > 1:
            after.append(np.array([b1 * x[-1] - a1 * y[-1] + b2 * x[-2] - a2 * y[-2], b2 * x[-1] - a2 * y[-1]]))
        elif len(x):
            after.append(np.array([b1 * x[-1] - a1 * y[-1] + s[1], b2 * x[-1] - a2 * y[-1]]))
        else:
            after.append(s)
        x = y
    return x, np.array(after)


def run_together(sections: np.ndarray, chunks: list, states: list | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(output, flattened state after it) of each chunk; chunks of one length are run side by side."""
    k, out = len(sections), [None] * len(chunks)
    by: dict[int, list[int]] = {}
    for at, x in enumerate(chunks):
        by.setdefault(len(x), []).append(at)
    for own in by.values():
        x = np.stack([np.asarray(chunks[at], float) for at in own], axis=1)
        state = np.zeros((k, 2, len(own))) if states is None else np.stack([np.asarray(states[at], float).reshape(k, 2) for at in own], axis=2)
        y, after = run_cascade(sections, x, state)
        for j, at in enumerate(own):
            out[at] = y[:, j], after[..., j].ravel()
    return out


def transition(sections: np.ndarray) -> np.ndarray:
    """The state after one zero sample, as a matrix over the flattened state."""
    n = 2 * len(sections)
    unit = np.eye(n).reshape(len(sections), 2, n)
    return run_cascade(sections, np.zeros((1, n)), unit)[1].reshape(n, n)


def resting(sections: np.ndarray) -> np.ndarray:
    """State of each section after a unit step for ever at the cascade's input."""
    scale, out = 1.0, []
    for s in sections:
        out.append(steady_state(s) * scale)
        scale *= s[:3].sum() / s[3:].sum()
    return np.array(out)


def extension(sections: np.ndarray) -> int:
    """Samples of the odd extension at either end."""
    return 3 * (2 * len(sections) + 1)


def _pass(rows: DataFrame, keys: list[str], kinds: str, sections: np.ndarray, name: str) -> DataFrame:
    """One run over chunks (keys, chunk, x ARRAY<DOUBLE>, rest DOUBLE or NULL) in the order of ``chunk``; the first one starts at rest on ``rest``."""
    one = transition(sections)

    def ends(batches):
        for pdf in batches:
            offsets = [after.tolist() for _, after in run_together(sections, list(pdf["x"]), None)]
            yield pdf[[*keys, "chunk", "rest"]].assign(n=[len(x) for x in pdf["x"]], offset=offsets)

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, out = resting(sections).ravel() * pdf["rest"].iloc[0], []
        for n, offset in zip(pdf["n"], pdf["offset"], strict=True):
            out.append(state.tolist())
            state = np.linalg.matrix_power(one, int(n)) @ state + np.asarray(offset)
        return pdf[[*keys, "chunk"]].assign(state=out)

    maps = rows.select(*keys, "chunk", "x", "rest").mapInPandas(ends, f"{kinds}, chunk long, rest double, n long, offset array<double>")
    begun = maps.groupBy(*keys).applyInPandas(states, f"{kinds}, chunk long, state array<double>")

    def run(batches):
        for pdf in batches:
            yield pdf[[*keys, "chunk"]].assign(x=[y.tolist() for y, _ in run_together(sections, list(pdf["x"]), list(pdf["state"]))])

    return written(rows.select(*keys, "chunk", "x").join(begun, [*keys, "chunk"]).mapInPandas(run, f"{kinds}, chunk long, x array<double>"), name)


def zero_phase(samples: DataFrame, keys: list[str], sections: np.ndarray, *, i: str = "i", value: str = "x", chunk: int = 1 << 18) -> DataFrame:
    """keys, i, value: the cascade run forwards, then backwards, over an odd extension of each trace, each run from rest on its first sample.

    samples: one for each i without gaps, two at least (fewer give NULL); NULL samples count as NaN and spoil what follows, as they would
    in one run. Results don't depend on ``chunk`` beyond rounding.
    """
    pad = extension(sections)
    chunk = max(chunk, pad + 1)
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in keys)
    ends = samples.groupBy(*keys).agg(F.min(i).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    at = F.col(i) - F.col("_lo")
    last = F.greatest(F.floor(F.col("_n") / chunk) - 1, F.lit(0))  # the rest joins the last whole chunk, so that an end is never shorter than its extension
    dealt = samples.select(*keys, i, F.col(value).cast("double").alias("_x")).join(ends, keys).withColumn("chunk", F.least(F.floor(at / chunk), last))
    packed = dealt.groupBy(*keys, "chunk", "_n", "_lo").agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col("_x").alias("x")))).alias("s"))
    chunks = written(packed.select(*keys, "chunk", (F.col("chunk") == 0).alias("first"), (F.col("chunk") == F.greatest(F.floor(F.col("_n") / chunk) - 1, F.lit(0))).alias("final"), F.col("s")[0]["i"].alias("begins"), F.transform("s", lambda s: s["x"]).alias("x")), "chunks")

    def extended(batches):
        for pdf in batches:
            rows = []
            for first, final, x in zip(pdf["first"], pdf["final"], pdf["x"], strict=True):
                x = np.array([np.nan if v is None else v for v in x], float)
                p = min(pad, len(x) - 1)
                head = 2 * x[0] - x[p:0:-1] if first and p > 0 else x[:0]
                tail = 2 * x[-1] - x[-2 : -p - 2 : -1] if final and p > 0 else x[:0]
                whole = np.concatenate([head, x, tail])
                rows.append((whole.tolist(), float(whole[0]), len(head), len(tail)))
            yield pdf[[*keys, "chunk", "begins"]].assign(x=[r[0] for r in rows], rest=[r[1] for r in rows], head=[r[2] for r in rows], tail=[r[3] for r in rows])

    wide = written(chunks.mapInPandas(extended, f"{kinds}, chunk long, begins {samples.schema[i].dataType.simpleString()}, x array<double>, rest double, head int, tail int"), "extended")
    forth = _pass(wide, keys, kinds, sections, "forth")
    turned = forth.select(*keys, (-F.col("chunk")).alias("chunk"), F.reverse("x").alias("x"))
    turned = turned.withColumn("rest", F.col("x")[0])
    back = _pass(turned, keys, kinds, sections, "back")
    frame = wide.select(*keys, "chunk", "begins", "head", "tail")
    cut = back.select(*keys, (-F.col("chunk")).alias("chunk"), F.reverse("x").alias("x")).join(frame, [*keys, "chunk"])
    cut = cut.select(*keys, "begins", F.slice("x", F.col("head") + 1, F.size("x") - F.col("head") - F.col("tail")).alias("x"))
    out = cut.select(*keys, "begins", F.posexplode("x").alias("_at", "_v")).select(*keys, (F.col("begins") + F.col("_at")).alias(i), F.col("_v").alias("_v"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return out.withColumn("_c", alone).select(*keys, i, F.when((F.col("_c") > 1) & ~F.isnan("_v"), F.col("_v")).alias(value))
