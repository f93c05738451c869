"""As-of interpolation onto a grid, and the score of one curve against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRID, LEAST_LIVE, LEAST_PAIRS = 80, 5, 10
#: Score bands and neutral names for them.
BANDS = [(85, "excellent"), (65, "very good"), (45, "good")]


def grid(durations: DataFrame, n: int = GRID) -> DataFrame:
    """clip_id, g, t: n evenly spaced times from 0 to ``duration``."""
    each = durations.select("clip_id", "duration", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g"))
    return each.select("clip_id", "g", (F.col("g") / F.lit(float(n - 1)) * F.col("duration")).alias("t"))


def as_of(points: DataFrame, times: DataFrame) -> DataFrame:
    """clip_id, g, t, semi: the curve at each time, linear between the last voiced point
    at or before and the first at or after it, held beyond the ends; null for a clip
    without a voiced point.  Points and grid are merged by time and filled from both
    sides: one exchange, no join per pair of rows."""
    voiced = points.filter("semi is not null").select("clip_id", "t", F.lit(None).cast("int").alias("g"), F.struct("t", "semi").alias("p"))
    asked = times.select("clip_id", "t", "g", F.lit(None).cast(voiced.schema["p"].dataType).alias("p"))
    both = voiced.unionByName(asked)
    w = W.partitionBy("clip_id").orderBy("t")
    # RANGE frames take all rows of an equal time, so an exact hit is seen from both sides
    before = F.last("p", True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("p", True).over(w.rangeBetween(W.currentRow, W.unboundedFollowing))
    got = both.withColumn("b", before).withColumn("a", after).filter("g is not null")
    slope = F.when(F.col("a.t") > F.col("b.t"), (F.col("t") - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))).otherwise(0.0)
    lerp = F.col("b.semi") + (F.col("a.semi") - F.col("b.semi")) * slope
    return got.select("clip_id", "g", "t", F.coalesce(lerp, F.col("b.semi"), F.col("a.semi")).alias("semi"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient, 0 where either side does not vary."""
    ok = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).otherwise(0.0)


def label_of(pct: Column) -> Column:
    out = F.lit("try again")
    for least, name in reversed(BANDS):
        out = F.when(pct >= least, name).otherwise(out)
    return out


def match_score(reference: DataFrame, live: DataFrame, n: int = GRID) -> DataFrame:
    """clip_id, pairs, corr, percent, label of each live curve against the reference
    curve of the same clip; clips with too few live points or pairs have null percent."""
    ends = reference.groupBy("clip_id").agg(F.max("t").alias("r")).join(live.groupBy("clip_id").agg(F.max("t").alias("l"), F.count(F.lit(1)).alias("n_live")), "clip_id")
    times = grid(ends.select("clip_id", F.greatest("r", "l").alias("duration")), n)
    a = as_of(reference, times).select("clip_id", "g", F.col("semi").alias("x"))
    b = as_of(live, times).select("clip_id", "g", F.col("semi").alias("y"))
    met = a.join(b, ["clip_id", "g"]).filter("x is not null and y is not null")
    scored = met.groupBy("clip_id").agg(F.count(F.lit(1)).alias("pairs"), correlation(F.col("x"), F.col("y")).alias("corr"))
    out = ends.select("clip_id", "n_live").join(scored, "clip_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    enough = (F.col("n_live") >= LEAST_LIVE) & (F.col("pairs") >= LEAST_PAIRS)
    pct = F.when(enough, F.floor(F.greatest(F.lit(0.0), F.col("corr")) * 100 + 0.5).cast("int"))
    return out.select("clip_id", "pairs", F.when(enough, F.col("corr")).alias("corr"), pct.alias("percent"), F.when(enough, label_of(pct)).alias("label"))
