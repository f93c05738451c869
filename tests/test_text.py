"""Text, similarity, retrieval, sequences and judging against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessela.functions import similarity as sim
from tessela.functions import text
from tessela.operators import judge, retrieval, sequences
from tessela.sources import assets

words = st.text(alphabet="abc", max_size=9)


def dp(q, t, free):
    rows = [[0 if free else j for j in range(len(t) + 1)]]
    for i, c in enumerate(q, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != d)))
        rows.append(row)
    return min(rows[-1]) if free else rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_distances(a, b):
    assert sim.fit_distance(a, b) == dp(a, b, True)
    assert sequences.edit_distance(a, b) == dp(a, b, False)
    assert (sim.fragment(a, b) == 1) == (a in b)
    lcs = (len(a) + len(b) - indel(a, b)) // 2
    assert sim.lcs_length(a, b) == lcs


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] if c == d else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


def test_ratio_and_friends(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, sim.ratio(a, b), a="", b="") == 1.0 and one(spark, sim.ratio(a, b), a="abc", b="xyz") == 0.5
    assert one(spark, sim.partial_ratio(a, b), a="bcd", b="abcde") == 1.0 and one(spark, sim.partial_ratio(a, b), a="", b="abc") == 0.0
    assert one(spark, sim.short_query_boost(a, b, F.lit("ab")), a="ab", b="abxxxxxxxxx") == 1.0
    assert one(spark, sim.suffix_prefix_score(a, b), a="x one two", b="one two") == 1.0 and one(spark, sim.suffix_prefix_score(a, b), a="x", b="one two") == 0.0
    assert one(spark, sim.grams(a, 3), a="ab") == [] and sorted(one(spark, sim.grams(a, 2), a="abab")) == ["ab", "ba"]
    assert one(spark, sim.is_confusion(a, b), a="قل", b="كل") and not one(spark, sim.is_confusion(a, b), a="قل", b="قلا")


def test_normalisers(spark):
    a = F.col("a")
    assert one(spark, text.normalise(a), a="﻿أَحْمَدُ  ةى ـ\nx") == "احمد هي x"
    assert one(spark, text.judge_normalise(a), a="مؤمن xأ ئـb") == "مومن ا ي"
    assert one(spark, text.phonetic_fold(a), a="ظذ ص") == "ذز س"
    assert one(spark, text.letter_count(a), a="ab ابج") == 3
    lead = " ".join(text.PREAMBLE)
    strip = lambda s, g, p: one(spark, text.without_preamble(a, F.lit(g), F.lit(p)), a=s)
    assert strip(lead + " x", 2, 1) == "x" and strip(lead, 2, 1) is None and strip(lead + " x", 9, 1) is None and strip(lead + " x", 2, 2) is None


def test_word_ends(spark):
    tokens = lambda *t: F.array(*[F.lit(x) for x in t])
    m = text.WORD_MARK
    assert one(spark, text.piece_word_ends(tokens(m + "a", "b", m, "c", m + "d")), a=1) == [2, 4, 5]
    assert one(spark, text.bar_word_ends(tokens("a", "b", "|", "c")), a=1) == [2, 4]


def corpus(spark, groups):
    rows = [(g, p, t, t, None) for g, texts in groups.items() for p, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "grp long, pos long, display string, joined string, short string")


def test_best_match(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 7))) for _ in range(n))
    groups = {g: [say(rng.randrange(5, 9)) for _ in range(5)] for g in range(1, 5)}
    c = corpus(spark, groups)
    asked = [(1, groups[2][3]), (2, " ".join(groups[3][1:3])), (3, groups[4][2][4:-2]), (4, "  "), (5, " ".join(groups[1][:2]))]
    got = {r.query_id: r for r in retrieval.best_match(spark.createDataFrame(asked, "query_id int, text string"), c).collect()}
    assert (got[1].grp, got[1].pos, got[1].pos_end, got[1].score) == (2, 4, None, 1.0)
    # a late span gives way to the group's beginning where that scores well enough
    assert (got[2].grp, got[2].pos, got[2].pos_end) == (3, 1, 3) and 0.5 <= got[2].score < 1
    assert (got[3].grp, got[3].pos) == (4, 3) and got[3].frag_fit == 1.0
    assert 4 not in got and (got[5].grp, got[5].pos, got[5].pos_end) == (1, 1, 2)
    shown = retrieval.span_display(retrieval.best_match(spark.createDataFrame(asked[1:2], "query_id int, text string"), c), c).first()
    assert shown.display == " ".join(groups[3][:3])


def test_retrieve_with_hint(spark):
    c = corpus(spark, {1: ["aa bb cc", "dd ee ff", "gg hh ii"], 2: ["jj kk", "ll mm"]})
    hints = spark.createDataFrame([(1, 1, 1), (2, 1, 3)], "query_id int, grp long, pos long")
    bonus = {(r.query_id, r.grp, r.pos): r.bonus for r in retrieval.hint_bonuses(hints, c).collect()}
    assert bonus == {(1, 1, 2): 0.22, (1, 1, 3): 0.12, (2, 2, 1): 0.22, (2, 2, 2): 0.12}
    q = spark.createDataFrame([(1, "dd ee fg")], "query_id int, text string")
    best = retrieval.match_passage(q, c, hints).first()
    assert (best.grp, best.pos, best.score) == (1, 2, 1.0)


def test_running_best_compares_with_the_rounded_best(spark):
    rows = [(1, 1, 2, 1, 2, "a", 0.50004, 0.5), (1, 1, 3, 1, 3, "b", 0.50001, 0.5)]
    df = spark.createDataFrame(rows, "query_id int, grp long, size int, pos long, pos_end long, joined string, score double, raw double")
    assert retrieval.running_best(df).first().joined == "b"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=4), st.integers(1, 9), st.integers(0, 99))
def test_forced_alignment(target, n, seed):
    lp = np.log(np.random.default_rng(seed).dirichlet(np.ones(4), n))
    got = sequences.forced_alignment(lp, target, 3)
    need = len(target) + sum(a == b for a, b in zip(target, target[1:], strict=False))
    assert (got is None) == (n < need)
    if got:
        first, last, mean = got
        assert all(0 <= a <= b < n for a, b in zip(first, last, strict=True)) and all(b < a for b, a in zip(last, first[1:], strict=False)) and mean <= 0


def test_greedy_decoding(spark):
    hot = lambda i: [1.0 if k == i else 0.0 for k in range(4)]
    rows = [(1, t, hot(i)) for t, i in enumerate([0, 0, 3, 0, 1, 1, 3, 2])] + [(2, 0, hot(3))]
    ids = sequences.greedy_ids(spark.createDataFrame(rows, "clip_id int, t int, lp array<double>"), 3)
    assert {r.clip_id: r.ids for r in ids.collect()} == {1: [0, 0, 1, 2], 2: []}
    vocab = spark.createDataFrame([(0, "▁a"), (1, "<unk>"), (2, "b")], "id int, token string")
    assert {r.clip_id: r.text for r in sequences.ids_to_text(ids, vocab).collect()} == {1: "a ab", 2: ""}


def test_shares_over_runs():
    assert list(sequences.shares(2, [1, 1, 1, 1])) == [1, 1, 1, 1] and list(sequences.shares(7, [1, 1, 1])) == [3, 2, 2]
    assert sequences.words_over_runs(["a", "b"], [(0.0, 1.0)], 9.0) == [("a", 0.0, 0.5), ("b", 0.5, 1.0)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.lists(st.floats(0, 9), min_size=1, max_size=12), st.sampled_from([2000, 7, 20]))
def test_shares_equal_a_round_robin(n, durations, steps):
    total = sum(durations) or 1.0
    counts = [max(1, int(np.floor(n * d / total + 0.5))) for d in durations]
    gap = n - sum(counts)
    for i in range(steps):
        k, way = i % len(counts), np.sign(gap)
        if way > 0 or way < 0 and counts[k] > 1:
            counts[k] += way
            gap -= way
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sequences, "MOST_STEPS", steps)
        assert list(sequences.shares(n, durations)) == counts


def test_words_over_runs_cover_words():
    got = sequences.words_over_runs(list("abcde"), [(0.0, 1.0), (2.0, 6.0)], 9.0)
    assert [w for w, _, _ in got] == list("abcde") and got[0] == ("a", 0.0, 1.0) and got[-1] == ("e", 5.0, 6.0)
    assert sequences.words_over_runs(["a"], [], 1.0) == []


def test_stitching_and_bytes():
    assert sequences.stitch(["a b c d", "c d e", " ", "zz"]) == "a b c d e zz"
    assert sequences.decode_bytes(["Ġx", "Ã©", "<|end|>"]) == " xé"


def test_stamped_segments(spark):
    rows = [(1, 0, "a", None, 30.0), (2, 0, "", 1.0, 0.0), (2, 1, "a", None, 0.0), (2, 2, "", 2.0, 0.0), (2, 3, "b", None, 0.0), (3, 0, "x", None, 0.0), (3, 1, "", 4.0, 0.0), (3, 2, "y", None, 0.0)]
    got = sequences.stamped_segments(spark.createDataFrame(rows, "clip_id int, i int, token string, seconds double, t_offset double")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "a", 30.0, 60.0), (2, 0, "a", 1.0, 2.0), (2, 1, "b", 2.0, 7.0), (3, 0, "y", 4.0, 9.0)]


def best_score(e, h, bounds):
    """Affine-gap optimum by exhaustive memoised search."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j, state):
        if i == len(e) and j == len(h):
            return 0.0
        options = []
        if i < len(e) and j < len(h):
            options.append(judge.word_score(e[i], h[j]) + go(i + 1, j + 1, "M"))
        if i < len(e) and state != "Y":
            opening = -1.5 if i + 1 in bounds and j else -3.0
            options.append((-0.5 if state == "X" else opening) + go(i + 1, j, "X"))
        if j < len(h) and state != "X":
            options.append((-0.5 if state == "Y" else -3.0) + go(i, j + 1, "Y"))
        return max(options, default=float("-inf"))

    return go(0, 0, "M")


SOUNDS = st.lists(st.sampled_from(["aaaa", "aaab", "xyz", "q"]), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(SOUNDS, SOUNDS, st.sets(st.integers(1, 5), max_size=2))
def test_alignment_is_optimal(e, h, bounds):
    steps = judge.align(e, h, bounds)
    total, state, heard = 0.0, "M", 0
    for a, b in steps:
        kind = "M" if a is not None and b is not None else "X" if b is None else "Y"
        opening = -1.5 if kind == "X" and a + 1 in bounds and heard else -3.0
        total += judge.word_score(e[a], h[b]) if kind == "M" else -0.5 if kind == state else opening
        state, heard = kind, heard + (b is not None)
    assert abs(total - best_score(tuple(e), tuple(h), frozenset(bounds))) < 1e-9
    assert [a for a, _ in steps if a is not None] == list(range(len(e))) and [b for _, b in steps if b is not None] == list(range(len(h)))


def test_judge(spark):
    e = "قل هو الله احد الله الصمد".split()
    rows = [(1, e, "قل هو الله احد".split(), None, None), (2, e, e, [0.9] * 6, [4]), (3, e, ["كل", *e[1:], "زيد"], None, None), (4, [], None, None, None)]
    tries = spark.createDataFrame(rows, "attempt_id int, expected array<string>, heard array<string>, confidences array<double>, boundaries array<int>")
    steps = judge.judge(tries)
    ops = {}
    for r in steps.orderBy("attempt_id", "step").collect():
        ops.setdefault(r.attempt_id, []).append(r.operation)
    assert ops[1] == ["match"] * 4 + ["unattempted"] * 2 and ops[2] == ["match"] * 6 and ops[3] == ["substitution"] + ["match"] * 5 + ["insertion"]
    got = {r.attempt_id: r for r in judge.totals(steps, tries).collect()}
    assert got[1].score_percent == 100.0 and got[2].overall_percent == 100.0 and got[3].insertions == 1 and got[3].correct == 6
    assert got[4].attempted == 0 and got[4].score_percent is None and got[4].overall_percent is None


def test_assets(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"0": "a", "1": "b"}')
    (tmp_path / "t.json").write_text('{"1:2:3": [4, 5]}')
    assert {tuple(r) for r in assets.vocabulary(spark, str(tmp_path / "v.json")).collect()} == {(0, "a"), (1, "b")}
    assert tuple(assets.token_table(spark, str(tmp_path / "t.json")).first()) == (1, 2, 3, [4, 5])
