"""Judging a recited attempt word by word against the expected words.

Attempts are rows (attempt_id, expected, heard, confidences, boundaries); each row is
aligned on its own inside an Arrow batch, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import CONFUSIONS, lcs_partial_ratio, lcs_ratio
from ..functions.text import judge_normalise, phonetic_fold

#: Alignment scores and verdict thresholds by confidence of the recogniser.
MATCH, OPEN, EXTEND, FUZZY = 2.0, -3.0, -0.5, 0.7
VERDICTS = ("correct", "likely_correct", "uncertain", "likely_wrong")
THRESHOLDS = [(0.8, (0.9, 0.75, 0.6, 0.45)), (0.5, (0.85, 0.7, 0.55, 0.4)), (None, (0.8, 0.65, 0.5, 0.35))]
COVERAGE = 80
NEAR = 1e-9

#: States of an aligned position, and how far each moves along (expected, heard).
PAIR, DROP, EXTRA = 0, 1, 2
MOVES = np.array([[1, 1], [1, 0], [0, 1]])

_confusable = {frozenset(p) for p in CONFUSIONS}


def word_score(a: str, b: str) -> float:
    if a == b:
        return MATCH
    r = lcs_ratio(a, b)
    return MATCH * r - 1 if r > FUZZY else -1.0


def score_table(expected: list[str], heard: list[str]) -> np.ndarray:
    """word_score of every expected with every heard word; each pair of different words
    is compared once."""
    rows, at = np.unique(np.array(expected, dtype=object), return_inverse=True)
    cols, to = np.unique(np.array(heard, dtype=object), return_inverse=True)
    return np.array([[word_score(a, b) for b in cols] for a in rows], float).reshape(len(rows), len(cols))[np.ix_(at, to)]


def first_best(options: np.ndarray) -> np.ndarray:
    """Along the first axis, the first option that is best up to rounding."""
    return np.argmax(options >= options.max(0) - NEAR, axis=0)


def similar_words(expected: list[str], heard: list[str]) -> Callable[[int], np.ndarray]:
    """Row by row what ``score_table`` holds, without the table: words are compared only
    where the letters that both have allow a score above the least."""
    rows, at = np.unique(np.array(expected, dtype=object), return_inverse=True)
    cols, to = np.unique(np.array(heard, dtype=object), return_inverse=True)
    letters = {c: k for k, c in enumerate(sorted(set("".join(cols))))}
    counts, sizes = np.zeros((len(cols), len(letters)), np.int16), np.array([len(c) for c in cols])
    for k, word in enumerate(cols):
        for c in word:
            counts[k, letters[c]] += 1
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def found(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.zeros(len(letters), np.int16)
        for c in rows[k]:
            if c in letters:
                own[letters[c]] += 1
        shared, both = np.minimum(counts, own).sum(1), sizes + len(rows[k])
        near = np.flatnonzero((2 * shared > FUZZY * both - NEAR) | (both == 0))
        return near, np.array([word_score(rows[k], cols[x]) for x in near], float)

    def row(i: int) -> np.ndarray:
        k = at[i]
        if k not in known:
            known[k] = found(k)
        out = np.full(len(cols), -1.0)
        out[known[k][0]] = known[k][1]
        return out[to]

    return row


class Aligner:
    """Rows of the alignment table of m expected and n heard words.  A row holds the best
    score of each state at each position; ``came`` the state before it."""

    def __init__(self, m: int, words: Callable[[int], np.ndarray], boundaries: set[int]):
        self.m, self.words, self.boundaries = m, words, boundaries

    def row(self, i: int, above: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row i over columns 0..n, from the row above.  A gap in the expected words is a
        running maximum along the row."""
        here, came = np.full((3, n + 1), -np.inf), np.zeros((3, n + 1), np.int8)
        if i:
            here[PAIR, 1:] = above.max(0)[:n] + self.words(i - 1)[:n]
            came[PAIR, 1:] = first_best(above[:, : n + 1])[:n]
            gaps = np.stack([above[DROP, : n + 1] + EXTEND, above[PAIR, : n + 1] + (OPEN / 2 if i in self.boundaries else OPEN)])
            if i == 1:  # before the first word a gap opens at full price
                gaps[1, 0] = OPEN
            here[DROP] = gaps.max(0)
            came[DROP] = np.where(first_best(gaps) == 0, DROP, PAIR)
        else:
            here[PAIR, 0] = 0.0
        # extra[j] is the best paired[k], k < j, with a gap from k to j
        cost = EXTEND * np.arange(n + 1)
        here[EXTRA, 1:] = np.maximum.accumulate(here[PAIR, :-1] + OPEN - cost[:-1]) + cost[:-1]
        with np.errstate(invalid="ignore"):
            longer = here[EXTRA, 1:-1] + EXTEND >= here[EXTRA, 2:] - NEAR
        came[EXTRA, 2:] = np.where(longer & np.isfinite(here[EXTRA, 1:-1]), EXTRA, PAIR)
        return here, came

    def rows(self, low: int, above: np.ndarray | None, high: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i in range(low + 1, high + 1):
            above, came = self.row(i, above, n)
            yield i, above, came

    def path(self, low: int, above: np.ndarray | None, high: int, j: int, state: int, steps: list) -> tuple[int, int]:
        """Appends the steps, last first, that lead from row ``high``, column j and ``state`` up
        to row ``low``, and returns column and state there.  Above ``LEAF`` rows only the
        rows at ``PARTS`` cuts are kept; each part is filled again when its path is wanted, no
        wider than the path needs."""
        if high - low <= LEAF:
            came = {i: c for i, _, c in self.rows(low, above, high, j)}
            i = high
            while i > low and (i or j):
                down, right = MOVES[state]
                before = int(came[i][state, j])
                steps.append((i - 1 if down else None, j - 1 if right else None))
                i, j, state = i - int(down), j - int(right), before
            return j, state
        size = -(-(high - low) // PARTS)
        cuts, kept = range(low + size, high, size), {low: above}
        for i, here, _ in self.rows(low, above, cuts[-1], j):
            if (i - low) % size == 0:
                kept[i] = here
        for first, last in zip([*reversed(cuts), low], [high, *reversed(cuts)], strict=True):
            start = kept.pop(first)
            j, state = self.path(first, start if start is None else start[:, : j + 1], last, j, state, steps)
        return j, state


#: Cells up to which all word scores are in one table; rows filled with their origins kept;
#: parts that longer stretches of rows are cut into.
TABLE_CELLS, LEAF, PARTS = 4_000_000, 256, 16


def align(expected: list[str], heard: list[str], boundaries: set[int] = frozenset()) -> list[tuple[int | None, int | None]]:
    """(expected index, heard index) steps of the best affine-gap alignment.  A gap in
    the heard words opens at half price where a passage ends; paired states win ties,
    then gaps in the heard words; the two kinds of gap never follow each other.

    Memory grows with the rows' length, not with the table: see ``Aligner.path``."""
    m, n = len(expected), len(heard)
    if not m or not n:
        return [(i, None) for i in range(m)] + [(None, j) for j in range(n)]
    if m * n <= TABLE_CELLS:
        table = score_table(expected, heard)
        words = table.__getitem__
    else:
        words = similar_words(expected, heard)
    own = Aligner(m, words, set(boundaries))
    # the state that the best path ends in is seen at the end of the last row
    for _, last, _ in own.rows(-1, None, m, n):
        pass
    steps: list[tuple[int | None, int | None]] = []
    own.path(-1, None, m, n, int(first_best(last)[n]), steps)
    return steps[::-1]


def is_confused(a: str, b: str) -> bool:
    different = {frozenset(p) for p in zip(a, b, strict=False) if p[0] != p[1]}
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 and different <= _confusable


#: How a verdict is shown; others are apparent errors.
SHOWN = {"correct": "correct", "likely_correct": "correct", "uncertain": "uncertain"}


def verdicts(pairs: pd.DataFrame) -> pd.DataFrame:
    """status and confidence of substituted words: rows (expected, heard, expected_phone,
    heard_phone, sure), ``sure`` null where the recogniser gave none."""
    best = np.array([max(lcs_ratio(a, b), lcs_partial_ratio(a, b)) for a, b in zip(pairs.expected, pairs.heard, strict=True)], float)
    sure = pairs.sure.astype(float).fillna(1.0).to_numpy()
    band = np.select([sure >= least for least, _ in THRESHOLDS if least is not None], range(len(THRESHOLDS) - 1), len(THRESHOLDS) - 1)
    reached = best[:, None] >= np.array([limits for _, limits in THRESHOLDS])[band]
    confused = [is_confused(a, b) for a, b in zip(pairs.expected, pairs.heard, strict=True)]
    reached[:, VERDICTS.index("likely_correct")] |= np.array(confused, bool)
    status = np.where(reached.any(1), np.array(VERDICTS, object)[reached.argmax(1)], "wrong")
    same, sounds = (pairs.expected == pairs.heard).to_numpy(), (pairs.expected_phone == pairs.heard_phone).to_numpy()
    return pd.DataFrame(
        {"status": np.select([same, sounds], ["correct", "likely_correct"], status), "confidence": np.select([same, sounds], [1.0, 0.85], best)}
    )


STEPS = "attempt_id {key}, step int, expected_index int, recognized_index int, expected string, observed string, operation string, judgment string"


STEP_COLUMNS = [c.split()[0] for c in STEPS.split(", ")]


def judged_steps(expected, heard, confidences, boundaries) -> pd.DataFrame:
    """STEPS of one attempt without its id.  Words are dicts raw, norm, phone."""
    path = align([w["norm"] for w in expected], [w["norm"] for w in heard], set(boundaries))
    at = pd.DataFrame(path, columns=["expected_index", "recognized_index"], dtype="Int32")
    pick = lambda words, index, form: [None if pd.isna(i) else words[i][form] for i in index]
    x, y = (pd.DataFrame({f: pick(ws, i, f) for f in ("raw", "norm", "phone")}, dtype=object) for ws, i in ((expected, at.expected_index), (heard, at.recognized_index)))
    has_x, has_y = at.expected_index.notna().to_numpy(), at.recognized_index.notna().to_numpy()
    both = has_x & has_y
    match = both & (x.norm == y.norm).to_numpy()
    swapped = np.flatnonzero(both & ~match)
    known = [] if confidences is None else list(confidences)
    sure = [known[j] if j < len(known) else None for j in at.recognized_index[swapped]]
    found = verdicts(pd.DataFrame({
        "expected": x.norm[swapped].to_list(), "heard": y.norm[swapped].to_list(),
        "expected_phone": x.phone[swapped].to_list(), "heard_phone": y.phone[swapped].to_list(), "sure": pd.Series(sure, dtype=float),
    }))
    judged = np.full(len(at), "apparent-error", object)
    judged[swapped] = found.status.map(SHOWN).fillna("apparent-error").to_numpy(object)
    judged[match] = "correct"
    # what comes after the last attempted word was not tried
    tried = np.flatnonzero(both)
    late = has_x & ~has_y & (np.arange(len(at)) > (tried[-1] if len(tried) else -1))
    judged[late] = "unattempted"
    operation = np.select([match, both, late, has_x], ["match", "substitution", "unattempted", "omission"], "insertion")
    out = at.assign(step=np.arange(len(at)), expected=x.raw, observed=y.raw, operation=operation, judgment=judged)
    return out[STEP_COLUMNS[1:]]


def with_forms(column: str):
    """Words with their normalised and phonetic forms."""
    ws = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.transform(ws, lambda w: F.struct(w.alias("raw"), judge_normalise(w).alias("norm"), phonetic_fold(w).alias("phone")))


def judge(attempts: DataFrame) -> DataFrame:
    """STEPS rows of each attempt."""
    ready = attempts.select("attempt_id", with_forms("expected").alias("e"), with_forms("heard").alias("h"), "confidences", "boundaries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                steps = judged_steps(list(r.e), list(r.h), r.confidences, () if r.boundaries is None else r.boundaries)
                yield steps.assign(attempt_id=r.attempt_id, step=steps.step.astype("Int32"))[STEP_COLUMNS]

    return ready.mapInPandas(run, STEPS.format(key=dict(attempts.dtypes)["attempt_id"]))


def totals(steps: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per attempt: counts, coverage, score (null below 80 % coverage) and the
    overall share of correct words."""
    is_ = lambda c, v: F.sum((F.col(c) == v).cast("int"))
    counted = steps.groupBy("attempt_id").agg(
        is_("judgment", "correct").alias("correct"), is_("judgment", "uncertain").alias("uncertain"),
        F.sum(((F.col("judgment") == "apparent-error") & (F.col("operation") != "insertion")).cast("int")).alias("apparent_errors"),
        is_("operation", "insertion").alias("insertions"),
    )
    rows = attempts.select("attempt_id", F.greatest(F.size("expected"), F.lit(0)).alias("n_expected")).join(counted, "attempt_id", "left")
    rows = rows.fillna(0, ["correct", "uncertain", "apparent_errors", "insertions"])
    decided = F.col("correct") + F.col("apparent_errors")
    tried = decided + F.col("uncertain")
    coverage = F.when(tried > 0, decided / F.nullif(tried, F.lit(0)) * 100).otherwise(0.0)
    score = F.when((tried > 0) & (coverage >= COVERAGE), F.try_divide(F.lit(100) * F.col("correct"), decided + F.col("insertions")))
    overall = F.try_divide(F.lit(100) * F.col("correct"), F.col("n_expected") + F.col("insertions"))
    return rows.select(
        "attempt_id", tried.alias("attempted"), "correct", "apparent_errors", "uncertain", "insertions",
        coverage.alias("coverage_percent"), score.alias("score_percent"), overall.alias("overall_percent"),
    )
