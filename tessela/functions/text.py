"""Text normalisation, words and passages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's patterns see it.
SPACE = r"[\t-\r    -     　﻿]+"
#: Marks that normalisation drops, and letters it folds.
MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭـ]"
JUDGE_MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭ]"
FOLD_FROM, FOLD_TO = "أإآٱةى", "ااااهي"
JUDGE_FROM, JUDGE_TO = "آأإٱؤئىة", "ااااوييه"
PHONETIC_FROM, PHONETIC_TO = "صضطظقءغثذ", "سدتذكاخسز"
LETTER = r"[ء-يٱ-ۓ]"
#: The opening formula that first passages of most groups repeat.
PREAMBLE = ["بسم", "الله", "الرحمن", "الرحيم"]
PREAMBLE_KEPT_IN = (1, 9)
WORD_MARK = "▁"


def tidy(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalise(c: Column) -> Column:
    """Marks dropped, letter variants folded, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, "﻿", ""), MARKS, "")
    return tidy(F.translate(bare, FOLD_FROM, FOLD_TO))


def judge_normalise(c: Column) -> Column:
    """The stricter form for judging: more folding, other scripts dropped."""
    bare = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), JUDGE_MARKS, ""), JUDGE_FROM, JUDGE_TO)
    only = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "ـ", ""), SPACE, " "), "[^؀-ۿ ]", "")
    return tidy(only)


def phonetic_fold(c: Column) -> Column:
    return F.translate(judge_normalise(c), PHONETIC_FROM, PHONETIC_TO)


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LETTER))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def no_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def without_preamble(joined: Column, grp: Column, pos: Column, preamble: list[str] | None = None) -> Column:
    """The passage without its opening formula, or null where it has none to drop:
    only first passages of groups other than 1 and 9, with more words than that."""
    lead = preamble or PREAMBLE
    ws, n = words(joined), len(lead)
    starts = F.slice(ws, 1, n) == F.array(*[F.lit(w) for w in lead])
    ok = (pos == 1) & ~grp.isin(*PREAMBLE_KEPT_IN) & (F.size(ws) > n) & starts
    return F.when(ok, F.array_join(F.slice(ws, n + 1, F.greatest(F.size(ws) - n, F.lit(0))), " "))


def piece_word_ends(tokens: Column) -> Column:
    """Ends (token counts) of words in tokens that mark word starts; strictly rising."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(False).alias("open"), F.lit(0).alias("i"))

    def step(acc, token):
        opens = F.startswith(token, F.lit(WORD_MARK))
        closed = F.when(opens & acc["open"], F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"])
        return F.struct(closed.alias("ends"), F.when(opens, token != WORD_MARK).otherwise(F.lit(True)).alias("open"), (acc["i"] + 1).alias("i"))

    done = F.aggregate(tokens, start, step, lambda a: F.when(a["open"], F.concat(a["ends"], F.array(a["i"]))).otherwise(a["ends"]))
    return F.filter(done, lambda e, i: (i == 0) | (e > F.get(done, i - 1)))


def bar_word_ends(tokens: Column) -> Column:
    """Ends (token counts) of words in tokens separated by bars."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(True).alias("fresh"), F.lit(1).alias("i"))

    def step(acc, token):
        bar = token == "|"
        held = F.slice(acc["ends"], 1, F.greatest(F.size(acc["ends"]) - 1, F.lit(0)))
        ends = F.when(bar, acc["ends"]).when(acc["fresh"], F.concat(acc["ends"], F.array(acc["i"]))).otherwise(F.concat(held, F.array(acc["i"])))
        return F.struct(ends.alias("ends"), bar.alias("fresh"), (acc["i"] + 1).alias("i"))

    return F.aggregate(tokens, start, step, lambda a: a["ends"])
