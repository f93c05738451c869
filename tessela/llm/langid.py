"""Language spans of mixed-language text.

Words are maximal runs of letters.  The script of a word (by code point range) leaves
only the languages that write in it; a word's score for each of those is the sum of
its character-trigram log-likelihoods; Viterbi with a penalty for every switch then
labels the words, and equal neighbours form spans.  A document's language is the one
with most letters; the score is that language's share of the letters.

Models are trained on at most about ``per_lang`` documents of each language (by hash
of doc_id), never on held-out ones.  Scoring is one narrow pass in blocks of
``BLOCK`` characters (a longer text is a block of its own): arrays of one block are
all a worker holds.

Defined cases: a null text or one without a letter is ``und`` with score 0; of
languages with equally many letters the alphabetically first wins; a script that no
language was seen to use leaves all languages; repeated rows are labelled alike; with
nothing to learn from everything is ``und``; an empty table gives no rows; only
``doc_id``, ``text`` and, for learning, ``lang`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

PER_LANG = 1500
BUCKETS = 1 << 18
SWITCH = 12.0
BLOCK = 2_000_000
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: First code points of ranges of scripts; what lies between two starts
#: belongs to the earlier one.
SCRIPT_STARTS = np.array([
    0x0000,  # Latin and its extensions
    0x0370,  # Greek
    0x0400,  # Cyrillic
    0x0530,  # Armenian
    0x0590,  # Hebrew
    0x0600,  # Arabic
    0x0900,  # Devanagari
    0x0980,  # other Indic scripts
    0x0E00,  # Thai and Lao
    0x1000,  # other South-East Asian scripts, Georgian, Ethiopic
    0x1100,  # Hangul letters
    0x1200,  # further scripts
    0x1E00,  # Latin extended additional
    0x1F00,  # Greek extended
    0x2000,  # symbols and others
    0x3040,  # kana
    0x3130,  # Hangul compatibility letters
    0x3400,  # Han
    0xA000,  # further scripts
    0xAC00,  # Hangul syllables
    0xD7B0,  # further scripts
    0xF900,  # Han compatibility
    0xFB00,  # presentation forms
])
#: Ranges that hold the same script as an earlier one.
SAME_SCRIPT = {12: 0, 13: 1, 16: 10, 19: 10, 21: 17}

_letters: list[np.ndarray] = []


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages, float32 log-likelihoods
    scripts: np.ndarray  # scripts x languages, bool


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def script_of(points: np.ndarray) -> np.ndarray:
    alias = np.arange(len(SCRIPT_STARTS))
    for k, v in SAME_SCRIPT.items():
        alias[k] = v
    return alias[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]


def lowered(text: str) -> str:
    """Lower case, character by character where one would become several."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind a space, and where each text starts."""
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return points, np.concatenate([[0], np.cumsum(sizes)])


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of letters, bucket of the trigram around each, first letters of words)."""
    letter = letter_table()[points]
    at = np.flatnonzero(letter)
    c = np.where(letter, points, 32).astype(np.uint64)
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)
    first = np.flatnonzero(~letter[at - 1]) if len(at) else at
    return at, bucket, first


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word of each text; ``starts`` bounds the texts' words.
    All texts of a block advance together, the longest first."""
    n_words, n_langs = scores.shape
    labels = np.zeros(n_words, np.int64)
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], starts[:-1][order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    came = np.zeros((n_words, n_langs), np.uint16)
    own = np.arange(n_langs, dtype=np.uint16)
    if longest:
        value = scores[begin[: active[0]]].astype(np.float64)
        finals = np.zeros((active[0], n_langs))
        for t in range(1, longest):
            k = active[t]
            if k < len(value):
                finals[k : len(value)] = value[k:]
                value = value[:k]
            best = value.argmax(1)
            jump = value[np.arange(k), best][:, None] - penalty
            word = begin[:k] + t
            came[word] = np.where(value >= jump, own, best[:, None].astype(np.uint16))
            value = np.maximum(value, jump) + scores[word]
        finals[: len(value)] = value
        state = finals.argmax(1)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            word = begin[:k] + t
            labels[word] = state[:k]
            if t:
                state[:k] = came[word, state[:k]]
    return labels


def label_words(model: LanguageModel, texts: list[str], penalty: float = SWITCH):
    """For a block of texts: (language of each word, its letters, its offset in the
    block, words before each text, text starts)."""
    points, text_starts = code_points([lowered(t) for t in texts])
    at, bucket, first = grams(points)
    if not len(first):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, np.zeros(len(texts) + 1, np.int64), text_starts
    letters = np.diff(np.append(first, len(at)))
    scores = np.stack([np.add.reduceat(model.table[:, j][bucket], first) for j in range(len(model.langs))], 1)
    fits = model.scripts[script_of(points[at[first]])]
    fits |= ~fits.any(1, keepdims=True)
    scores = np.where(fits, scores - scores.max(1, keepdims=True), -1e4)
    begins = at[first]
    word_starts = np.searchsorted(begins, text_starts)
    return viterbi(scores, word_starts, penalty), letters, begins, word_starts, text_starts


def spans(model: LanguageModel, text: str, penalty: float = SWITCH) -> list[tuple[int, int, str]]:
    """(start, end, language) over the words of a text; code points, end exclusive."""
    labels, letters, begins, _, starts = label_words(model, [text], penalty)
    out: list[tuple[int, int, str]] = []
    for lab, n, b in zip(labels, letters, begins, strict=True):
        s, lang = int(b - starts[0] - 1), model.langs[lab]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], s + int(n), lang)
        else:
            out.append((s, s + int(n), lang))
    return out


def predict(model: LanguageModel, texts: list[str]) -> list[tuple[str, float]]:
    if not model.langs:
        return [(UNKNOWN, 0.0)] * len(texts)
    labels, letters, _, word_starts, _ = label_words(model, texts)
    n = len(model.langs)
    owner = np.repeat(np.arange(len(texts)), np.diff(word_starts))
    mass = np.bincount(owner * n + labels, weights=letters, minlength=len(texts) * n).reshape(-1, n)
    total, best = mass.sum(1), mass.argmax(1)
    return [(model.langs[b], float(m[b] / s)) if s else (UNKNOWN, 0.0) for b, m, s in zip(best, mass, total, strict=True)]


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """Trigram models of every non-null ``lang`` among rows that are not held out.  One
    pass counts the languages' rows, one counts the trigrams and scripts of the sampled
    rows where they lie; at most a row for each language and bucket reaches the driver."""
    learn = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    table = np.zeros((BUCKETS, len(langs)), np.float32)
    scripts = np.zeros((len(SCRIPT_STARTS), len(langs)), bool)
    if not langs:
        return LanguageModel(langs, table, scripts)
    number = {lang: j for j, lang in enumerate(langs)}
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = learn.filter(chance < F.element_at(share, F.col("lang"))).select("lang", "text")
    width = BUCKETS + len(SCRIPT_STARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points, _ = code_points([lowered(text.as_py())])
                at, bucket, _ = grams(points)
                each = met.setdefault(lang, np.zeros(width, np.int64))
                np.add.at(each, bucket, 1)
                np.add.at(each, BUCKETS + script_of(points[at]), 1)
        for lang, each in met.items():
            used = np.flatnonzero(each)
            yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(each[used])], ["j", "bucket", "n"])

    summed = sample.mapInArrow(run, "j int, bucket int, n long").groupBy("j", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), width))
    counts[summed.j, summed.bucket] = summed.n
    for j in range(len(langs)):
        letters, used = counts[j, :BUCKETS], counts[j, BUCKETS:]
        table[:, j] = np.log((letters + 0.05) / (letters.sum() + 0.05 * BUCKETS))
        scripts[:, j] = used >= max(1.0, 0.005 * used.sum())
    return LanguageModel(langs, table, scripts)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of SCHEMA for ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            block: list[str] = []
            size, found = 0, []
            for value in batch.column(2):
                block.append(value.as_py() or "")
                size += len(block[-1])
                if size >= BLOCK:
                    found.extend(predict(m, block))
                    block, size = [], 0
            found.extend(predict(m, block))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)
