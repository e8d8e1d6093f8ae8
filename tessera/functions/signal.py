"""Zero-phase Butterworth band-pass filters and envelopes in numpy.

The design is the textbook one: poles of the analog low-pass prototype, low-pass to band-pass, bilinear
transform with prewarped edges, conjugate pairs as second-order sections. Filtering runs forwards and
backwards over an odd extension of the signal, each section starting in its steady state.
"""

from __future__ import annotations

import numpy as np


def band_sections(rate_hz: float, band: tuple[float, float], order: int = 3) -> np.ndarray:
    """Second-order sections (order, 6) of a band-pass; ValueError unless 0 < low < high < Nyquist."""
    low, high = band
    if not 0 < low < high < rate_hz / 2:
        raise ValueError(f"a band has to lie in (0, {rate_hz / 2}) Hz")
    warped = [2 * rate_hz * np.tan(np.pi * f / rate_hz) for f in (low, high)]
    width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
    prototype = [np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    poles = []
    for p in prototype:
        half = p * width / 2
        root = np.sqrt(half**2 - centre2 + 0j)
        poles += [half + root, half - root]
    z = [(2 * rate_hz + p) / (2 * rate_hz - p) for p in poles]
    upper = sorted((p for p in z if p.imag > 1e-12), key=lambda p: abs(p))
    real = sorted(p.real for p in z if abs(p.imag) <= 1e-12)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    sos = np.array([[1.0, 0.0, -1.0, 1.0, a1, a2] for a1, a2 in pairs])  # a zero at 0 Hz and one at Nyquist each
    middle = np.exp(1j * 2 * np.arctan(np.sqrt(centre2) / (2 * rate_hz)))
    gain = np.prod([abs((s[0] + s[1] / middle + s[2] / middle**2) / (s[3] + s[4] / middle + s[5] / middle**2)) for s in sos])
    sos[0, :3] /= gain
    return sos


def run_section(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One section over axis 0, transposed direct form; ``state`` (2, ...) is where it starts."""
    b0, b1, b2, _, a1, a2 = section
    y = np.empty_like(x)
    s1, s2 = state[0].copy(), state[1].copy()
    for k in range(len(x)):
        v = x[k]
        out = b0 * v + s1
        s1 = b1 * v - a1 * out + s2
        s2 = b2 * v - a2 * out
        y[k] = out
    return y


def steady_state(section: np.ndarray) -> np.ndarray:
    """State of a section after a unit step for ever."""
    b0, b1, b2, _, a1, a2 = section
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([gain - b0, b2 - a2 * gain])


def impulse_length(sos: np.ndarray, tail: float = 1e-7) -> int:
    slowest = max(float(np.sqrt(abs(s[5]))) for s in sos)
    return int(np.ceil(np.log(tail) / np.log(min(slowest, 1 - 1e-9))))


def bandpass(x: np.ndarray, rate_hz: float, band: tuple[float, float], order: int = 3) -> np.ndarray:
    """Zero-phase band-pass along axis 0 (time)."""
    sos = band_sections(rate_hz, band, order)
    x = np.asarray(x, float)
    pad = min(len(x) - 1, max(3 * (2 * len(sos) + 1), 0))
    if pad < 1:
        raise ValueError("a filter needs two samples or more")
    ends = 2 * x[0] - x[pad:0:-1], 2 * x[-1] - x[-2 : -pad - 2 : -1]
    y = np.concatenate([ends[0], x, ends[1]])
    for _ in range(2):
        scale = y[0].copy() if y.ndim > 1 else y[0]
        for s in sos:
            zi = steady_state(s)
            begin = np.multiply.outer(zi, scale)
            y = run_section(s, y, begin)
            scale = scale * (s[:3].sum() / s[3:].sum())
        y = y[::-1]
    return y[pad : len(y) - pad]


def analytic_amplitude(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal along axis 0."""
    n = len(x)
    spectrum = np.fft.fft(x, axis=0)
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * keep.reshape(-1, *[1] * (x.ndim - 1)), axis=0))


def band_envelope(x: np.ndarray, rate_hz: float, band: tuple[float, float], order: int = 3) -> np.ndarray:
    return analytic_amplitude(bandpass(x, rate_hz, band, order))


def top_peaks(envelope: np.ndarray, rate_hz: float, n: int, refractory_s: float) -> list[int]:
    """Largest samples at least a refractory time apart, largest first."""
    gap, out = refractory_s * rate_hz, []
    for i in np.argsort(-envelope, kind="stable"):
        if all(abs(int(i) - j) >= gap for j in out):
            out.append(int(i))
            if len(out) == n:
                break
    return out
