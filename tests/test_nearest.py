"""Exact best matches against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessela.functions.similarity import Texts, edit_distances
from tessela.operators import nearest, retrieval
from tessela.scratch import written


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def ratio(a, b):
    n = len(a) + len(b)
    return (n - lev(a, b)) / n if n else 1.0


def all_pairs(queries, passages, k):
    out = {}
    for q, text in queries:
        if text is not None:
            scored = sorted(((-ratio(text, p), g, i) for g, i, p in passages if p is not None))
            for rank, (s, g, i) in enumerate(scored[:k]):
                out[q, rank] = (g, i, round(-s, 9))
    return out


def damaged(rng, t, share):
    return "".join(rng.choice("abcdxyz ") if rng.random() < share else c for c in t)


def texts(rng, n, short=3, long=60):
    return [" ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(short, long))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_against_all_pairs(spark, k):
    rng = random.Random(k)
    pool = texts(rng, 60) + ["", "a", "ab", "é漢🙂", None, "aaaa" * 20, "aaaa" * 22, "same text here", "same text here"]
    passages = [(i // 5, i % 5, p) for i, p in enumerate(pool)]
    asked = [damaged(rng, p, s) for p in pool[:12] for s in (0.02, 0.2)] + texts(rng, 4) + ["", None, "b", "same text here", "aaaa" * 21, "é漢"]
    queries = list(enumerate(asked))
    p = spark.createDataFrame(passages, "grp long, pos long, joined string").withColumn("bucket", F.lit("x"))
    q = spark.createDataFrame(queries, "query_id long, text string").withColumn("t", F.lit("x"))
    found, _ = nearest.nearest(q, p, k, ["grp", "pos"])
    assert {(r.query_id, r["rank"]): (r.grp, r.pos, round(r.score, 9)) for r in found.collect()} == all_pairs(queries, passages, k)


def test_far_fewer_pairs_are_compared(spark):
    """Near copies raise the floor: most pairs are never compared, and their number follows
    the matches, not the product of both sides."""
    rng = random.Random(8)
    pool = texts(rng, 400, 20, 60)
    passages = [(i // 10, i % 10, p) for i, p in enumerate(pool)]
    queries = [(i, damaged(rng, pool[i * 7], 0.03)) for i in range(50)]
    found, counts = nearest.nearest(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(passages, "grp long, pos long, joined string"), 1, ["grp", "pos"])
    assert {(r.query_id, r.grp, r.pos) for r in found.collect()} == {(i, i * 7 // 10, i * 7 % 10) for i in range(50)}
    assert sum(counts) < 0.03 * len(queries) * len(passages)


def test_search_with_ties_and_small_corpora(spark):
    passages = spark.createDataFrame([(1, i, "t", x) for i, x in enumerate(["abc", "abd", "abc", "xyz"])], "grp long, pos long, display string, joined string")
    got = retrieval.search(spark.createDataFrame([(1, "abc"), (2, "")], "query_id long, text string"), passages, 9).collect()
    rows = {(r.query_id, r["rank"]): (r.pos, round(r.score, 6)) for r in got}
    assert [rows[1, i] for i in range(4)] == [(0, 1.0), (2, 1.0), (1, round(5 / 6, 6)), (3, 0.5)]
    assert [rows[2, i] for i in range(4)] == [(i, 0.0) for i in range(4)] and len(rows) == 8
    assert retrieval.search(spark.createDataFrame([(1, "abc")], "query_id long, text string"), passages.limit(0), 3).collect() == []


def test_numbered_grams():
    assert len(set(nearest.numbered_grams("aaaaa").tolist())) == 3
    assert set(nearest.numbered_grams("aaaa")) <= set(nearest.numbered_grams("aaaaa"))
    assert len(nearest.numbered_grams("ab")) == 0


def test_edit_distances_of_many_pairs():
    rng = random.Random(2)
    for letters in ("ab", "abcdefghijklé漢🙂"):
        a = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 63, 64, 65, 129, 200)]
        b = ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(12)] + ["", a[-1][:-3], a[4]]
        ai, bi = map(np.ravel, np.meshgrid(np.arange(len(a)), np.arange(len(b))))
        assert edit_distances(Texts(a), Texts(b), ai, bi).tolist() == [lev(a[i], b[j]) for i, j in zip(ai, bi)]


def test_unrelated_texts_give_no_row_for_each_pair(spark, monkeypatch):
    """Buckets that are met whole give back each query's best of a block; their pairs were
    written as rows before."""
    kept = {}

    def noted(df, label):
        out = written(df, label)
        kept[label] = kept.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(nearest, "written", noted)
    rng = random.Random(6)
    passages, queries = [(0, i, t) for i, t in enumerate(texts(rng, 300, 10, 14))], list(enumerate(texts(rng, 20, 10, 14)))
    found, counts = nearest.nearest(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(passages, "grp long, pos long, joined string"), 2, ["grp", "pos"])
    assert {(r.query_id, r["rank"]): (r.grp, r.pos, round(r.score, 9)) for r in found.collect()} == all_pairs(queries, passages, 2)
    assert sum(counts[1:]) > 4_000 and kept["possible-pairs"] + kept["block-scores"] < 1_000
