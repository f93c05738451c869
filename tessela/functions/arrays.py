"""Scalar kernels over numeric arrays (samples, activations, log-probabilities).

All are column expressions; arithmetic is in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch bins of the activation vector and note names.
CENTS_SPAN, CENTS_START, BIN_COUNT = 7180.0, 1997.3794084376191, 360
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    """Sum of an array from left to right; 0 if empty."""
    return F.aggregate(doubles(a), F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def rms(a: Column) -> Column:
    """Root mean square; null if empty."""
    return F.sqrt(F.try_divide(F.aggregate(doubles(a), F.lit(0.0), lambda acc, x: acc + x * x), F.size(a)))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where body uses it inside a lambda (an
    expression there is computed anew for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def z_normalise(a: Column) -> Column:
    """Values minus mean over population deviation; a deviation of 0 counts as 1e-8."""

    def scaled(x: Column, m: Column) -> Column:
        var = F.try_divide(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)), F.size(x))
        dev = F.when(F.sqrt(var) == 0, F.lit(1e-8)).otherwise(F.sqrt(var))
        return bound(dev, lambda d: F.transform(x, lambda v: (v - m) / d))

    return bound(doubles(a), lambda x: bound(mean(x), lambda m: scaled(x, m)))


def first_argmax(a: Column) -> Column:
    """0-based position of the largest value, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_sum_exp(a: Column) -> Column:
    each = lambda top: F.log(F.aggregate(doubles(a), F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    return bound(F.array_max(doubles(a)), lambda top: top + each(top))


def bin_cents(i: Column, bins: int = BIN_COUNT) -> Column:
    return F.lit(CENTS_SPAN) * i / F.lit(float(bins - 1)) + F.lit(CENTS_START)


def decode_activation(a: Column, bins: int = BIN_COUNT, radius: int = 4, threshold: float = 0.5) -> Column:
    """(freq, confidence): centroid of the bins around the first maximum; freq is -1
    unless the confidence is above the threshold."""
    at = first_argmax(a)
    lo = F.greatest(at - radius, F.lit(0))
    hi = F.least(at + radius, F.size(a) - 1)
    part = F.slice(doubles(a), lo + 1, hi - lo + 1)
    weighted = F.aggregate(
        F.transform(part, lambda x, i: x * bin_cents(i + lo, bins)), F.lit(0.0), lambda acc, x: acc + x
    )
    mass = total(part)
    cents = F.when(mass > 0, weighted / mass).otherwise(bin_cents(at, bins))
    confidence = F.array_max(doubles(a))
    freq = F.when(confidence > threshold, F.lit(10.0) * F.pow(F.lit(2.0), cents / 1200.0)).otherwise(F.lit(-1.0))
    return F.struct(freq.alias("freq"), confidence.alias("confidence"))


def hz_to_midi(freq: Column) -> Column:
    return F.when(freq > 0, F.lit(69.0) + F.lit(12.0) * F.log2(freq / 440.0))


def midi_label(midi: Column) -> Column:
    """Note name and octave of the nearest semitone, halves upwards."""
    near = F.floor(midi + 0.5).cast("int")
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.concat(F.element_at(names, F.pmod(near, F.lit(12)) + 1), (F.floor(near / 12) - 1).cast("string"))


def resample_linear(a: Column, from_rate: Column, to_rate: Column) -> Column:
    """Linear resampling; round(n / ratio) outputs, the last sample held."""
    ratio = from_rate.cast("double") / to_rate
    n = F.size(a)
    count = F.greatest(F.floor(n / ratio + 0.5), F.lit(1)).cast("int")

    def at(i):
        p = i * ratio
        i0 = F.floor(p).cast("int")
        i1 = F.least(i0 + 1, n - 1)
        f = p - i0
        return F.get(doubles(a), i0) * (1 - f) + F.get(doubles(a), i1) * f

    made = F.transform(F.sequence(F.lit(0), count - 1), at)
    return F.when(from_rate == to_rate, doubles(a)).when(n == 0, F.array().cast("array<double>")).otherwise(made)


def hann(n: int) -> Column:
    """Symmetric Hann window of n points."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 - 0.5 * F.cos(F.lit(2.0) * F.pi() * i / F.lit(float(n - 1))))


def round4(x: Column) -> Column:
    """Four decimals, halves towards plus infinity."""
    return F.floor(x * 10000 + 0.5) / 10000.0
