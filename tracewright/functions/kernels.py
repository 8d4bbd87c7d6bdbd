"""Numpy helpers that run on Arrow batches inside Spark tasks.

Each works on one batch of equal-length windows, or on one chunk; Spark does
the partitioning, the shuffles and the grouping.
"""

from __future__ import annotations

import numpy as np

from tracewright import constants as C


def welch(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of every row of ``x``: Hann segments of at most 256
    samples, half overlapped, mean removed per segment."""
    n = x.shape[1]
    size = min(256, n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, n - size + 1, size - size // 2)
    power = np.zeros((x.shape[0], size // 2 + 1))
    for s in starts:
        part = x[:, s:s + size]
        part = (part - part.mean(axis=1, keepdims=True)) * window
        power += np.abs(np.fft.rfft(part, axis=1)) ** 2
    power /= len(starts) * fs * np.sum(window ** 2)
    last = size // 2 if size % 2 == 0 else size // 2 + 1
    power[:, 1:last] *= 2
    return np.fft.rfftfreq(size, 1.0 / fs), power


def _band(f: np.ndarray, psd: np.ndarray, low: float, high: float) -> np.ndarray:
    return psd[:, (f >= low) & (f <= high)]


def _area(f: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = f[1] - f[0] if len(f) > 1 else 0.0
    if b.shape[1] < 2:
        return b.sum(axis=1) * step
    return (b.sum(axis=1) - (b[:, 0] + b[:, -1]) / 2) * step


def time_features(x: np.ndarray) -> np.ndarray:
    """Six time features of centred rows, in the fixed order."""
    n = x.shape[1]
    d = np.diff(x, axis=1)
    m2, m3, m4 = (np.mean(x ** p, axis=1) for p in (2, 3, 4))
    with np.errstate(divide="ignore", invalid="ignore"):
        g1 = m3 / m2 ** 1.5
        g2 = m4 / m2 ** 2 - 3.0
    if n > 2:
        g1 = g1 * np.sqrt(n * (n - 1)) / (n - 2)
    if n > 3:
        g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0)
    flat = m2 == 0
    return np.column_stack([
        np.sum(x[:, :-1] * x[:, 1:] < 0, axis=1),
        np.sum((d[:, :-1] > 0) & (d[:, 1:] < 0), axis=1),
        np.sum((d[:, :-1] < 0) & (d[:, 1:] > 0), axis=1),
        np.sqrt(m2), np.where(flat, np.nan, g1), np.where(flat, np.nan, g2),
    ])


def spectral_features(x: np.ndarray, fs: float) -> np.ndarray:
    """Ten spectral features, in the fixed order."""
    f, psd = welch(x, fs)
    wide = _band(f, psd, *C.TOTAL_RANGE)
    total = _area(f, wide)
    if wide.shape[1]:
        peak = f[f >= C.TOTAL_RANGE[0]][np.argmax(wide, axis=1)]
    else:
        peak = np.full(len(x), np.nan)
    bands = [_band(f, psd, *C.BANDS[b]) for b in C.BAND_NAMES]
    means = [b.mean(axis=1) if b.shape[1] else np.zeros(len(x)) for b in bands]
    norms = [_area(f, b) / (total + C.BAND_EPS) for b in bands]
    return np.column_stack([total, peak, *means, *norms])


def all_features(x: np.ndarray, fs: float) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    return np.hstack([time_features(x), spectral_features(x, fs)])


# --- filtering --------------------------------------------------------------

def extend_edges(x: np.ndarray, left: int, right: int, edge: str) -> np.ndarray:
    """Add missing context: odd reflection about the end sample as far as the
    data reaches, zeros beyond; or zeros only."""
    def side(v: np.ndarray, k: int) -> np.ndarray:      # context before v[0], nearest first
        mirrored = 2 * v[0] - v[1:k + 1] if edge == "reflect" else np.empty(0)
        return np.concatenate([mirrored, np.zeros(k - len(mirrored))])
    before = side(x, left)[::-1] if left else np.empty(0)
    after = side(x[::-1], right) if right else np.empty(0)
    return np.concatenate([before, x, after])


def fast_length(n: int) -> int:
    """The smallest length from ``n`` on without prime factors above 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def polyphase(x: np.ndarray, before: int, start: int, count: int, taps: np.ndarray,
              up: int, down: int, spectra: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Centred filter at ``up`` times the input rate, every ``down``-th output kept.

    ``x`` holds ``before`` context samples, then the ``count`` samples whose first
    has absolute index ``start``, then context. Returns the outputs whose time lies
    within those samples. ``spectra`` keeps the transformed taps by length from call to call.
    """
    c = (len(taps) - 1) // 2
    k = np.arange(-(-start * up // down), -(-(start + count) * up // down))
    nearest, phase = np.divmod(k * down, up)
    at = nearest - start + before
    if up == 1:
        size = fast_length(len(x) + len(taps) - 1)
        spectra = {} if spectra is None else spectra
        if size not in spectra:
            spectra[size] = np.fft.rfft(taps, size)
        full = np.fft.irfft(np.fft.rfft(x, size) * spectra[size], size)
        return full[at + c]
    y = np.empty(len(k))
    for r in range(up):
        rows = np.nonzero(phase == r)[0]
        if not len(rows):
            continue
        reach = (r + c) // up                       # samples after the nearest one
        h = taps[r + c - reach * up::up][::-1]      # in input order
        first = at[rows] + reach - len(h) + 1
        y[rows] = np.lib.stride_tricks.sliding_window_view(x, len(h))[first] @ h
    return y


def lowpass_taps(cutoff: float, width: float, rate: float, factor: float = 3.3) -> np.ndarray:
    """Hamming windowed sinc, odd length from the transition width, unit gain at 0."""
    n = int(round(factor / width * rate))
    n += 1 - n % 2
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(2 * cutoff / rate * t) * np.hamming(n)
    return h / h.sum()


def bandpass_taps(low: float, high: float, rate: float) -> np.ndarray:
    """Zero-phase band-pass: transition widths min(max(low/4, 2), low) below and
    min(max(high/4, 2), rate/2 - high) above, cut-offs at their middles."""
    below = min(max(low * 0.25, 2.0), low)
    above = min(max(high * 0.25, 2.0), rate / 2 - high)
    narrow = lowpass_taps(low - below / 2, below, rate)
    wide = lowpass_taps(high + above / 2, above, rate)
    n = max(len(narrow), len(wide))
    centre = lambda h: np.pad(h, (n - len(h)) // 2)
    return centre(wide) - centre(narrow)


def resample_taps(up: int, down: int, zero_crossings: int = 32) -> np.ndarray:
    """Low-pass for a rate change by up/down, gain ``up``."""
    limit = max(up, down)
    n = 2 * zero_crossings * limit + 1
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / limit) * np.hamming(n)
    return h * up / h.sum()


# --- channel quality on one short frame (channels x samples) ----------------

def quantile(v: np.ndarray, q: float) -> np.ndarray:
    """Column quantile at position n*q - 1/2 (0-based), linear in between."""
    return np.quantile(v, q, axis=0, method="hazen")


def best_correlation(frame: np.ndarray, q: float) -> np.ndarray:
    """Per channel the q-quantile of its absolute correlations, own entry counted as 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs(np.corrcoef(frame))
    r = np.atleast_2d(r)
    np.fill_diagonal(r, 0.0)
    return quantile(r, q)


def prediction_correlation(frame: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per channel the correlation with the median of its predictions;
    ``weights`` is (predictions, channels, channels)."""
    predicted = np.median(weights @ frame, axis=0)
    a = frame - frame.mean(axis=1, keepdims=True)
    b = predicted - predicted.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def replace_channels(x: dict[str, np.ndarray], bad: set[str],
                     weights: list[tuple[str, str, float]]) -> dict[str, np.ndarray]:
    """Good channels as they are, bad ones as weighted sums, cut to the shortest of itself and its
    sources; left out without weights or where a source is absent."""
    out = {c: v for c, v in x.items() if c not in bad}
    for c in sorted(bad & set(x)):
        own = [(s, w) for b, s, w in weights if b == c]
        if own and all(s in x for s, _ in own):
            n = min(len(x[c]), *(len(x[s]) for s, _ in own))
            out[c] = sum(w * x[s][:n] for s, w in own)
    return out


def subtract_mean(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Subtract at every instant the mean of the channels that reach it."""
    n = max((len(v) for v in x.values()), default=0)
    total, count = np.zeros(n), np.zeros(n)
    for v in x.values():
        total[:len(v)] += v
        count[:len(v)] += 1
    mean = total / np.maximum(count, 1)
    return {c: v - mean[:len(v)] for c, v in x.items()}


def value_buckets(v: np.ndarray, bits: int = 6) -> np.ndarray:
    """Bucket numbers that grow with the values: sign, power of two and ``bits`` leading bits of the fraction."""
    code = np.ascontiguousarray(v, np.float64).view(np.int64)
    ordered = np.where(code < 0, -(code & np.int64(2 ** 63 - 1)), code)
    return ordered >> np.int64(52 - bits)
