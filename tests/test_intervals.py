"""Interval joins and word times against loops over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessela.operators import intervals, sequences


def random_intervals(rng, n, longest):
    out = []
    for i in range(n):
        s = rng.choice([rng.uniform(-50, 50), float(rng.randrange(-20, 20))])
        out.append((rng.choice(["a", "b", None]), i, s, s + rng.choice([0.0, 1.0, rng.expovariate(1), rng.uniform(0, longest), -1.0])))
    return out


ODD = [("a", 900, None, 3.0), ("a", 901, float("nan"), 3.0), ("a", 902, 0.0, float("inf")), ("b", 903, 1.0, 1.0)]
COLUMNS = "clip string, i int, s double, e double"


def is_proper(r):
    return r[2] is not None and r[3] is not None and all(abs(x) < float("inf") for x in r[2:])


@pytest.mark.parametrize(("seed", "longest", "least"), [(1, 3, 0.0), (2, 5000, 0.0), (3, 40, 0.25), (4, 0.001, 0.0)])
def test_overlaps_against_all_pairs(spark, seed, longest, least):
    rng = random.Random(seed)
    left, right = random_intervals(rng, 150, longest) + ODD, random_intervals(rng, 120, longest) + ODD
    got = intervals.overlaps(spark.createDataFrame(left, COLUMNS), spark.createDataFrame(right, COLUMNS), ["clip"], ("s", "e"), ("s", "e"), least)
    pairs = [(r.l.i, r.r.i) for r in got.collect()]
    want = [
        (a[1], b[1]) for a in left for b in right
        if a[0] is not None and a[0] == b[0] and is_proper(a) and is_proper(b) and a[2] < a[3] and b[2] < b[3] and b[3] > a[2] + least and b[2] < a[3] - least
    ]
    assert sorted(pairs) == sorted(want) and len(set(pairs)) == len(pairs)


def test_points_against_all_pairs(spark):
    rng = random.Random(9)
    points = [(rng.choice("ab"), i, rng.choice([rng.uniform(-60, 60), float(rng.randrange(-20, 20))])) for i in range(200)] + [("a", 300, None)]
    spans = random_intervals(rng, 150, 30) + ODD
    got = intervals.points_inside(spark.createDataFrame(points, "clip string, i int, t double"), spark.createDataFrame(spans, COLUMNS), ["clip"], "t", ("s", "e"))
    want = [(p[1], b[1]) for p in points for b in spans if p[2] is not None and p[0] == b[0] and is_proper(b) and b[2] <= p[2] < b[3]]
    assert sorted((r.l.i, r.r.i) for r in got.collect()) == sorted(want)


def test_empty_sides(spark):
    none = spark.createDataFrame([], COLUMNS)
    some = spark.createDataFrame([("a", 1, 0.0, 1.0)], COLUMNS)
    for left, right in ((none, some), (some, none), (none, none)):
        assert intervals.overlaps(left, right, ["clip"], ("s", "e"), ("s", "e")).collect() == []


def test_one_clip_spreads_over_tasks(spark):
    """All intervals have one key; a few span everything."""
    rows = spark.range(40_000).select(F.lit("a").alias("clip"), F.col("id").cast("int").alias("i"), (F.col("id") * 1.0).alias("s"), (F.col("id") + F.when(F.col("id") % 10_000 == 0, 1e5).otherwise(1.5)).alias("e"))
    met = intervals.overlaps(rows, rows, ["clip"], ("s", "e"), ("s", "e"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # a short interval meets itself and both neighbours; the long ones meet all after their start
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def loop_times(words, word_letters, token_letters, first, last, frame_seconds):
    """Timed words of one clip, one word after the other."""
    total, total_w = sum(token_letters), sum(word_letters)
    if not total or not total_w:
        return []
    ends = np.cumsum(token_letters)
    out, waiting, at = [], [], 0
    for word, n in zip(words, word_letters, strict=True):
        a, b = at * total / total_w, (at + n) * total / total_w
        at += n
        if not n:
            if out:
                out[-1][0] += " " + word
            else:
                waiting.append(word)
            continue
        hit = [k for k, m in enumerate(token_letters) if m and ends[k] > a + 1e-6 and ends[k] - m < b - 1e-6]
        if not hit:
            return []
        out.append([" ".join([*waiting, word]), first[hit[0]] * frame_seconds, (last[hit[-1]] + 1) * frame_seconds])
        waiting = []
    for x, y in zip(out, out[1:], strict=False):
        if 0 < y[1] - x[2] < 0.8:
            x[2] = y[1]
    for x, y in zip(out, out[1:], strict=False):
        y[1] = max(y[1], x[1])
    return [(i, w, a, max(a, b)) for i, (w, a, b) in enumerate(out)]


def test_word_times_against_a_loop(spark):
    rng = random.Random(6)
    clips = [(0, ["*", "ab", "*", "cd"], [0, 2, 0, 2], [1, 1, 2], [0, 2, 5], [1, 3, 6]), (1, ["a"], [0], [1], [0], [0]), (2, ["a"], [3], [0, 0], [0, 1], [0, 1])]
    for c in range(3, 60):
        n, m = rng.randrange(1, 9), rng.randrange(1, 12)
        first = [rng.randrange(0, 40) for _ in range(m)] if c % 3 == 0 else sorted(rng.randrange(0, 60) for _ in range(m))
        clips.append((c, [rng.choice("abcdef") * 2 for _ in range(n)], [rng.choice([0, 1, 2, 5]) for _ in range(n)], [rng.choice([0, 1, 2, 4]) for _ in range(m)], first, [x + rng.randrange(0, 5) for x in first]))
    spans = spark.createDataFrame([(c, k, f, z, n) for c, _, _, ls, fs, zs in clips for k, (n, f, z) in enumerate(zip(ls, fs, zs, strict=True))], "clip_id int, k int, first int, last int, letters int")
    passages = spark.createDataFrame([x[:3] for x in clips], "clip_id int, words array<string>, word_letters array<int>")
    got = {}
    for r in sequences.word_times(spans, passages, 0.1).orderBy("clip_id", "i").collect():
        got.setdefault(r.clip_id, []).append((r.i, r.word, round(r.t_start, 9), round(r.t_end, 9)))
    want = {x[0]: [(i, w, round(a, 9), round(b, 9)) for i, w, a, b in loop_times(*x[1:], 0.1)] for x in clips}
    assert got == {c: w for c, w in want.items() if w} and 0 < len(got) < len(clips)


def test_active_word(spark):
    timed = spark.createDataFrame([(1, 0, "a", 0.0, 1.0), (1, 1, "b", 1.0, 2.0), (2, 0, "c", 0.0, 9.0)], "clip_id int, i int, word string, t_start double, t_end double")
    heads = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "clip_id int, t double")
    assert sorted((r.clip_id, r.t, r.word) for r in sequences.active_word(timed, heads).collect()) == [(1, 1.0, "b"), (2, 3.0, "c")]
