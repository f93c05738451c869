"""Interval joins: pairs of overlapping intervals, and points in intervals, of one key.

Intervals are half-open, [start, end).  An interval belongs to the scale whose bins are at
least as long as it is, so it touches at most two of them; each scale's bins are ``STEP``
times those of the scale below.  An interval is dealt to its bins on its own scale and on
all coarser ones, and two intervals meet on the coarser of their scales, in the bin where
their overlap starts: an equi-join that gives each pair once.

Scale: a key's intervals spread over as many tasks as they span bins, however many the key has;
the number of copies of a row is at most twice the number of scales.  The finest bin is about as long as
most intervals are (a quantile over all of them), so a bin holds about as many intervals
as overlap there.  Bins with many rows on one side are split by AQE.

Null, NaN and infinite bounds and empty intervals overlap nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 64
#: Share of all intervals that the finest bins are long enough for.
SHORT_SHARE = 0.9


def proper(rows: DataFrame, start: str, end: str) -> DataFrame:
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    return rows.filter(~F.isnan(s) & ~F.isnan(e) & (F.abs(s) != math.inf) & (F.abs(e) != math.inf))


def lengths(rows: list[tuple[DataFrame, str, str]]) -> tuple[float, float]:
    """(length of the finest bins, largest length) over all given intervals."""
    each = [proper(f, s, e).select((F.col(e) - F.col(s)).cast("double").alias("n")) for f, s, e in rows]
    every = reduce(DataFrame.unionByName, each).filter("n > 0")
    short, most = every.agg(F.percentile_approx("n", SHORT_SHARE), F.max("n")).first()
    return (short, most) if short else (1.0, 1.0)


def scale_of(n: Column, finest: float, scales: int) -> Column:
    """Number of the first scale whose bins are as long as ``n``."""
    wide = [F.when(n > finest * STEP**i, 1).otherwise(0) for i in range(scales - 1)]
    return reduce(Column.__add__, wide, F.lit(0))


def dealt(rows: DataFrame, start: str, end: str, finest: float, scales: int, own: str) -> DataFrame:
    """A copy of every interval for each bin that it touches on its own and all coarser
    scales: adds ``own`` (its scale), __scale and __bin."""
    widths = F.array(*[F.lit(finest * STEP**i) for i in range(scales)])
    rows = rows.withColumn(own, scale_of(F.col(end) - F.col(start), finest, scales))
    rows = rows.withColumn("__scale", F.explode(F.sequence(F.col(own), F.lit(scales - 1))))
    bin_of = lambda c: F.floor(F.col(c) / F.get(widths, F.col("__scale")))
    return rows.withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))


def renamed(rows: DataFrame, key: list[str], prefix: str) -> DataFrame:
    return rows.select(*key, F.struct(*[c for c in rows.columns if c not in key]).alias(prefix))


def meet(left: DataFrame, right: DataFrame, key: list[str], l: tuple[str, str], r: tuple[str, str], inside: Column) -> DataFrame:
    """Pairs that satisfy ``inside``, over columns l_start, l_end, r_start and r_end: the
    key, and both rows as structs ``l`` and ``r``."""
    finest, most = lengths([(left, *l), (right, *r)])
    scales = 1 + max(0, math.ceil(math.log(most / finest, STEP) - 1e-9))

    def side(rows: DataFrame, names: tuple[str, str], p: str) -> DataFrame:
        held = renamed(proper(rows, *names), key, p).withColumns({f"{p}_start": F.col(f"{p}.{names[0]}").cast("double"), f"{p}_end": F.col(f"{p}.{names[1]}").cast("double")})
        return dealt(held.filter(F.col(f"{p}_end") >= F.col(f"{p}_start")), f"{p}_start", f"{p}_end", finest, scales, f"{p}_own")

    pairs = side(left, l, "l").join(side(right, r, "r"), [*key, "__scale", "__bin"])
    widths = F.array(*[F.lit(finest * STEP**i) for i in range(scales)])
    here = F.floor(F.greatest("l_start", "r_start") / F.get(widths, F.col("__scale"))) == F.col("__bin")
    return pairs.filter((F.greatest("l_own", "r_own") == F.col("__scale")) & here & inside).select(*key, "l", "r")


def overlaps(left: DataFrame, right: DataFrame, key: list[str], l: tuple[str, str], r: tuple[str, str], least: float = 0.0) -> DataFrame:
    """Pairs of intervals (``l`` and ``r`` name the bounds) of equal ``key`` that share more
    than ``least``, measured from either end: l.start + least < r.end and r.start < l.end - least."""
    inside = (F.col("r_end") > F.col("l_start") + least) & (F.col("r_start") < F.col("l_end") - least)
    return meet(left, right, key, l, r, inside & (F.col("l_start") < F.col("l_end")) & (F.col("r_start") < F.col("r_end")))


def points_inside(points: DataFrame, intervals: DataFrame, key: list[str], at: str, bounds: tuple[str, str]) -> DataFrame:
    """Pairs of a point and an interval with start <= point < end."""
    return meet(points, intervals, key, (at, at), bounds, (F.col("l_start") >= F.col("r_start")) & (F.col("l_start") < F.col("r_end")))
