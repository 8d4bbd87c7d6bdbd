"""Native column functions on one window (``array<double>``) and on its PSD.

These are plain higher-order functions: good for ad-hoc columns and for
checking. The bulk path is ``operators.features.window_features``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def _head(x: Column) -> Column:
    return F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))


def _tail(x: Column) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))


def centered(x: Column) -> Column:
    """x minus its mean."""
    return let(_total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))


def zero_crossings(x: Column) -> Column:
    """Neighbouring pairs with a negative product."""
    return F.size(F.filter(F.zip_with(_head(x), _tail(x), lambda a, b: a * b), lambda p: p < 0))


def _extrema(x: Column, keep: Callable[[Column, Column], Column]) -> Column:
    steps = F.zip_with(_head(x), _tail(x), lambda a, b: b - a)
    return let(steps, lambda d: F.size(F.filter(F.zip_with(_head(d), _tail(d), keep), lambda hit: hit)))


def local_maxima(x: Column) -> Column:
    """Strict rises followed by strict falls; plateaus do not count."""
    return _extrema(x, lambda a, b: (a > 0) & (b < 0))


def local_minima(x: Column) -> Column:
    return _extrema(x, lambda a, b: (a < 0) & (b > 0))


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(x))


def _moment(x: Column, power: int) -> Column:
    def step(acc: Column, v: Column) -> Column:
        term = v
        for _ in range(power - 1):
            term = term * v
        return acc + term
    return F.aggregate(x, F.lit(0.0), step) / F.size(x)


def skewness(x: Column) -> Column:
    """Bias-corrected skewness of a centred array; constant input gives NaN."""
    n = F.size(x).cast("double")

    def body(m2: Column) -> Column:
        g1 = F.try_divide(_moment(x, 3), F.pow(m2, 1.5))
        factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
        return F.when(m2 == 0, nan()).when(n > 2, g1 * factor).otherwise(g1)
    return let(_moment(x, 2), body)


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis of a centred array; constant input gives NaN."""
    n = F.size(x).cast("double")

    def body(m2: Column) -> Column:
        g2 = F.try_divide(_moment(x, 4), m2 * m2) - 3.0
        scaled = F.try_divide((n - 1) * ((n + 1) * g2 + 6.0), (n - 2) * (n - 3))
        return F.when(m2 == 0, nan()).when(n > 3, scaled).otherwise(g2)
    return let(_moment(x, 2), body)


def sorted_quantile(ordered: Column, q: float) -> Column:
    """Quantile of a sorted array at position n*q - 1/2 (0-based), linear in between."""
    last = F.size(ordered) - 1
    pos = F.least(F.greatest(F.size(ordered) * F.lit(q) - 0.5, F.lit(0.0)), last.cast("double"))
    low, high = (F.get(ordered, f(pos).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (pos - F.floor(pos))


# --- on a one-sided PSD whose bin k lies at k * step Hz ---------------------

def band(psd: Column, step: Column, low: float, high: float) -> Column:
    """Bins of the closed band [low, high]."""
    if low >= high:
        raise ValueError(f"empty band [{low}, {high}]")
    return F.filter(psd, lambda p, k: (k * step >= low) & (k * step <= high))


def band_power(psd: Column, step: Column, low: float, high: float) -> Column:
    """Trapezoid over the band; one bin counts psd * step, no bin 0."""
    def body(b: Column) -> Column:
        area = (_total(b) - (F.get(b, F.lit(0)) + F.get(b, F.size(b) - 1)) / 2.0) * step
        return (F.when(F.size(b) == 0, F.lit(0.0))
                .when(F.size(b) == 1, F.get(b, F.lit(0)) * step).otherwise(area))
    return let(band(psd, step, low, high), body)


def band_mean(psd: Column, step: Column, low: float, high: float) -> Column:
    """Mean PSD in the band, 0 when it holds no bin."""
    return let(band(psd, step, low, high),
               lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.try_divide(_total(b), F.size(b))))


def peak_frequency(psd: Column, step: Column, low: float, high: float) -> Column:
    """Frequency of the first largest bin in the band, NaN when it holds none."""
    first_bin = F.ceil(F.lit(low) / step)

    def body(b: Column) -> Column:
        at = F.array_position(b, F.array_max(b)) - 1
        return F.when(F.size(b) == 0, nan()).otherwise((at + first_bin) * step)
    return let(band(psd, step, low, high), body)
