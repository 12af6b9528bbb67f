"""Signal processing in NumPy: band-pass, envelope, robust threshold, peaks.

The zero-phase filter is applied as the squared magnitude of a Butterworth band-pass in the frequency domain, over a signal that is
extended by odd reflection at both ends.
"""

from __future__ import annotations

import functools

import numpy as np


#: Samples of a block of the band-pass; its transforms stay in a core's cache.
BLOCK = 2048


@functools.lru_cache(maxsize=32)
def _gain(n: int, rate: int, low: float, high: float, order: int) -> np.ndarray:
    """The filter's gain at the frequencies of a transform of ``n`` samples."""
    half = rate / 2
    lo = min(0.95, max(0.01, low / half))
    hi = min(0.99, max(lo + 0.01, high / half))
    f = np.fft.rfftfreq(n, 1 / rate) / half
    # analogue frequencies by the bilinear map
    w, w1, w2 = (np.tan(np.pi * np.clip(v, 1e-9, 1 - 1e-9) / 2) for v in (f, np.array(lo), np.array(hi)))
    return 1 / (1 + ((w * w - w1 * w2) / (w * (w2 - w1))) ** (2 * order))


@functools.lru_cache(maxsize=32)
def _reach(rate: int, low: float, high: float, order: int) -> int:
    """Samples on either side beyond which the filter's response is under 1e-16, that is rounding; half a block and more where that is too short for it."""
    response = np.abs(np.fft.irfft(_gain(BLOCK, rate, low, high, order), BLOCK))[: BLOCK // 2]
    return int(np.flatnonzero(response > 1e-16)[-1]) + 1


def band_pass(x: np.ndarray, rate: int, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase band-pass; cut-offs are clamped to [0.01, 0.95] and [low + 0.01, 0.99] of half the rate.

    Where the response fades inside the reflection and a quarter of a block, the signal is filtered in overlapping blocks.
    """
    n = min(len(x) - 1, 3 * rate // 100)
    ext = np.concatenate((2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1])) if n > 0 else x
    reach = _reach(rate, low, high, order)
    if reach > min(n, BLOCK // 4) or len(ext) <= BLOCK:
        return np.fft.irfft(np.fft.rfft(ext) * _gain(len(ext), rate, low, high, order), len(ext))[n : n + len(x)]
    step = BLOCK - 2 * reach
    k = -(-len(x) // step)
    padded = np.concatenate((ext[n - reach :], np.zeros(max(0, (k - 1) * step + BLOCK - len(ext) + n - reach))))
    blocks = np.lib.stride_tricks.sliding_window_view(padded, BLOCK)[::step][:k]
    spectrum = np.fft.rfft(blocks)
    spectrum *= _gain(BLOCK, rate, low, high, order)
    y = np.fft.irfft(spectrum, BLOCK)
    return y[:, reach : reach + step].ravel()[: len(x)]


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    spectrum = np.fft.rfft(x)
    spectrum *= -1j
    spectrum[0] = 0
    if n % 2 == 0:
        spectrum[-1] = 0
    turned = np.fft.irfft(spectrum, n)
    turned *= turned
    turned += x * x
    return np.sqrt(turned, out=turned)


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    """Centred mean with a constant divisor (zeros beyond the ends)."""
    n, back = len(x), k // 2
    c = np.concatenate(([0.0], np.cumsum(x)))
    out = np.full(n, c[n])
    ahead = c[k - back :]
    out[: len(ahead)] = ahead
    out[back:] -= c[: max(0, n - back)]
    out /= k
    return out


def median(x: np.ndarray) -> float:
    """As ``np.median`` of numbers without NaN; one rank is selected, which is faster than two."""
    h = len(x) // 2
    p = np.partition(x, h)
    return float(p[h] if len(x) % 2 else (p[:h].max() + p[h]) / 2)


def robust_threshold(x: np.ndarray, k: float = 4.5) -> float:
    m = median(x)
    return m + k * 1.4826 * median(np.abs(x - m))


def peaks(x: np.ndarray, least: float, distance: int) -> np.ndarray:
    """Local maxima of at least ``least``; of two nearer than ``distance`` the taller stays (tallest first, then the later)."""
    at = np.flatnonzero(x[1:-1] >= least) + 1
    at = at[(x[at] >= x[at - 1]) & (x[at] > x[at + 1])]
    alive = np.ones(len(at), bool)
    for k in np.lexsort((at, x[at]))[::-1]:
        if alive[k]:
            lo, hi = np.searchsorted(at, (at[k] - distance + 1, at[k] + distance))
            alive[lo:hi] = False
            alive[k] = True
    return at[alive]


def pulses(x: np.ndarray, rate: int = 16_000, low: float = 2000.0, high: float = 6000.0, rest: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Times (seconds) and heights of the hits in a mono signal; none in less than a tenth of a second."""
    if len(x) < rate // 10:
        return np.zeros(0), np.zeros(0)
    e = moving_average(envelope(band_pass(np.asarray(x, float), rate, low, high)), max(1, rate // 200))
    at = peaks(e, robust_threshold(e), max(1, int(rest * rate)))
    return at / rate, e[at]


def one_pole(x: np.ndarray, rate: int, cutoff: float, high: bool) -> np.ndarray:
    """One-pole filter of the on-device profile, as a scan in blocks (the recurrence is linear)."""
    rc, dt = 1 / (2 * np.pi * cutoff), 1 / rate
    a = rc / (rc + dt) if high else dt / (rc + dt)
    y = np.empty(len(x))
    state, before = 0.0, float(x[0]) if len(x) else 0.0
    for i, v in enumerate(x.tolist()):
        state = a * (state + v - before) if high else state + a * (v - state)
        before = v
        y[i] = state
    return y


def synthetic(seconds: float, hits: list[float], rate: int = 16_000, seed: int = 42) -> np.ndarray:
    """Noise with decaying 3.5 kHz bursts at the given times."""
    x = np.random.default_rng(seed).standard_normal(int(seconds * rate))
    x *= 0.005
    t = np.arange(int(0.02 * rate)) / rate
    burst = 0.8 * np.exp(-t / 0.004) * np.sin(2 * np.pi * 3500 * t)
    for h in hits:
        i = int(h * rate)
        x[i : i + len(burst)] += burst[: max(0, len(x) - i)]
    return x
