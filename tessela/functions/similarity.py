"""String similarity: expressions on ``levenshtein``, Arrow batches elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that are easily confused, as pairs.
CONFUSIONS = ["قك", "صس", "ضد", "طت", "ظذ", "هة", "عا", "حه", "غخ", "ثس", "ذز", "عأ"]


def ratio(a: Column, b: Column) -> Column:
    """(la + lb - edit distance) / (la + lb); 1 for two empty strings.  A substitution
    costs 1, so disjoint strings of equal length score 0.5."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - F.levenshtein(a, b)) / F.nullif(n, F.lit(0)))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string with a window of the longer; 0 if one is empty."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    starts = F.sequence(F.lit(1), F.length(long) - F.length(short) + 1)
    best = F.array_max(F.transform(starts, lambda i: ratio(short, F.substr(long, i, F.length(short)))))
    return F.when(F.length(short) == 0, F.lit(0.0)).otherwise(best)


def grams(s: Column, n: int) -> Column:
    """Distinct n-grams of a short string; ``gram_sets`` takes long texts."""
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))
    return F.when(F.length(s) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


#: Bits of a code point.
POINT_BITS = 21


def packed_grams(s: str) -> np.ndarray:
    """Sorted distinct bigrams and trigrams of a text as integers without collisions:
    trigrams are three code points side by side, bigrams two of them, negated."""
    c = codes(s).astype(np.int64)
    two = (c[:-1] << POINT_BITS) | c[1:]
    three = (two[:-1] << POINT_BITS) | c[2:]
    return np.unique(np.concatenate([-1 - two, three]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def gram_sets(s: pd.Series) -> pd.Series:
    """``packed_grams`` of texts of any length, in Arrow batches; none for null."""
    return pd.Series([packed_grams(t) if t is not None else [] for t in s])


#: Bits of a word of the distance table, pairs advanced together, words of them at most.
WORD, PAIRS, STATE = 64, 8_192, 1 << 18


class Texts:
    """Texts as letters in one array."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.concatenate([np.empty(0, np.int64), *[codes(t).astype(np.int64) for t in texts]])

    def bags(self, bins: int = 64) -> np.ndarray:
        """How many letters of each text fall into each of ``bins`` classes."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return np.bincount(owner * bins + self.letters % bins, minlength=bins * len(self.sizes)).reshape(-1, bins)


def edit_distances(a: Texts, b: Texts, ai: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs (``ai``, ``bi``) of texts of ``a`` and ``b``."""
    out = np.maximum(a.sizes[ai], b.sizes[bi])
    alphabet, inverse = np.unique(np.concatenate([a.letters, b.letters]), return_inverse=True)
    own, other, words = inverse[: len(a.letters)], inverse[len(a.letters) :], -(-a.sizes[ai] // WORD)
    order = np.lexsort((-b.sizes[bi], words))
    order = order[(a.sizes[ai][order] > 0) & (b.sizes[bi][order] > 0)]
    at = 0
    while at < len(order):
        n = int(words[order[at]])
        end = min(at + max(1, min(PAIRS, STATE // n)), int(np.searchsorted(words[order], n, "right")))
        chunk = order[at:end]
        out[chunk] = advanced(a, b, ai[chunk], bi[chunk], own, other, len(alphabet), n)
        at = end
    return out


def advanced(a: Texts, b: Texts, ai: np.ndarray, bi: np.ndarray, own: np.ndarray, other: np.ndarray, letters: int, words: int) -> np.ndarray:
    """Distances of pairs whose first texts fill ``words`` words and whose second texts are
    ordered from the longest on.  The columns of the distance tables are kept as bits and
    advance together (Myers, with Hyyrö's carries between the words); a step holds only
    the pairs whose second text goes on."""
    asked, place = np.unique(ai, return_inverse=True)
    one, top = np.uint64(1), np.uint64(WORD - 1)
    # row 0 is for letters that the first text does not have
    rows, known, at = np.zeros(len(asked) * letters, np.int64), [np.zeros((words, 1), np.uint64)], 1
    for q, i in enumerate(asked):
        text = own[a.starts[i] : a.starts[i] + a.sizes[i]]
        have, which = np.unique(text, return_inverse=True)
        bits = np.zeros((words, len(have)), np.uint64)
        n = np.arange(len(text))
        np.bitwise_or.at(bits, (n // WORD, which), one << (n % WORD).astype(np.uint64))
        rows[q * letters + have] = np.arange(at, at + len(have))
        known.append(bits)
        at += len(have)
    places, base, starts, sizes = np.concatenate(known, axis=1), place * letters, b.starts[bi], b.sizes[bi]
    n, out, last = len(ai), a.sizes[ai].copy(), ((a.sizes[ai] - 1) % WORD).astype(np.uint64)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    buffers = [np.empty(n, np.uint64) for _ in range(4)]
    for j, k in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0]), "left")):
        row = rows[base[:k] + other[starts[:k] + j]]
        rise, fall = one, None
        x, h, v, t = (f[:k] for f in buffers)
        for w in range(words):
            p, q, e = up[w, :k], down[w, :k], places[w][row]
            np.bitwise_or(e, q, out=v)
            if fall is not None:
                e |= fall
            np.bitwise_and(e, p, out=x)
            x += p
            x ^= p
            x |= e
            np.bitwise_or(x, p, out=h)
            np.invert(h, out=h)
            h |= q
            x &= p
            if w == words - 1:
                out[:k] += ((h >> last[:k]) & one).view(np.int64)
                out[:k] -= ((x >> last[:k]) & one).view(np.int64)
            else:
                next_rise, next_fall = h >> top, x >> top
            h <<= one
            h |= rise
            x <<= one
            if fall is not None:
                x |= fall
            np.bitwise_or(v, h, out=t)
            np.invert(t, out=t)
            np.bitwise_or(x, t, out=p)
            np.bitwise_and(h, v, out=q)
            if w < words - 1:
                rise, fall = next_rise, next_fall
    return out


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def short_query_boost(query: Column, candidate: Column, first_word: Column) -> Column:
    """Best ratio of a short query with the candidate's beginning or its first word."""
    lead = F.substr(candidate, F.lit(1), F.length(query) + 6)
    word = F.when(F.coalesce(first_word, F.lit("")) != "", ratio(query, first_word)).otherwise(0.0)
    return F.when(F.coalesce(candidate, F.lit("")) == "", F.lit(0.0)).otherwise(F.greatest(ratio(query, lead), word))


def suffix_prefix_score(text: Column, passage: Column) -> Column:
    """Best ratio of the text without 1 to min(words / 2, 4) leading words and as many
    words of the passage's beginning."""
    t, v = F.split(text, " "), F.split(passage, " ")
    trims = F.sequence(F.lit(1), F.greatest(F.least(F.floor(F.size(t) / 2).cast("int"), F.lit(4)), F.lit(1)))

    def score(k):
        rest = F.size(t) - k
        return ratio(F.array_join(F.slice(t, k + 1, rest), " "), F.array_join(F.slice(v, F.lit(1), F.least(rest, F.size(v))), " "))

    return F.when((F.size(t) < 2) | (F.size(v) < 2), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.array_max(F.transform(trims, score))))


def is_confusion(a: Column, b: Column) -> Column:
    """Equal length, one differing letter, and that pair is a known confusion."""
    pairs = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y)), lambda p: F.substr(p, F.lit(1), F.lit(1)) != F.substr(p, F.lit(2), F.lit(1)))
    known = F.array(*[F.lit(x) for c in CONFUSIONS for x in (c, c[::-1])])
    return F.when(F.length(a) != F.length(b), F.lit(False)).otherwise((F.size(pairs) == 1) & F.coalesce(F.array_contains(known, F.get(pairs, F.lit(0))), F.lit(False)))


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def fit_distance(query: str, text: str) -> int:
    """Least edit distance of the query from any substring of the text.  A row of the
    table is one vector step: insertions are a running minimum."""
    q, t = codes(query), codes(text)
    at = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(q, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(best - at) + at
    return int(row.min())


def lcs_length(a: str, b: str) -> int:
    x, y = codes(a), codes(b)
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == c)))
    return int(row[-1])


def lcs_ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def lcs_partial_ratio(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    return max(lcs_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def fragment(query: str | None, text: str | None) -> float:
    """1 - fit distance / query length, at least 0; 1 for an empty query."""
    if not query:
        return 1.0
    if query in (text or ""):
        return 1.0
    return max(0.0, 1 - fit_distance(query, text or "") / len(query))


@F.pandas_udf(T.DoubleType())
def fragment_score(query: pd.Series, text: pd.Series) -> pd.Series:
    """Null where the text is null: rows to leave out are passed as null."""
    return pd.Series([None if pd.isna(t) else fragment(q, t) for q, t in zip(query, text, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def lcs_partial_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")
