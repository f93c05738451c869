"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on toxic and one on ordinary labelled
text.  A window is compressed with each; the difference of the two lengths is its gain.
Windows are the words of a text (lower-cased runs of letters) and, around every word that
gains, the stretch of ``AROUND`` words on either side.  The toxic dictionary is trained on
the words that toxic texts use at least ``LIFT`` times as often as ordinary ones, in the
order of the texts; both share a base trained on ordinary text, so that ordinary windows
cost the same in either and the gain is quiet where nothing is wrong.

The thresholds are calibrated on labelled rows that neither dictionary has seen: they are
``QUANTILES`` of the largest gains of ordinary texts.  How many windows of a text gain at
least each threshold feeds a logistic curve fitted on the same rows.

Fitting uses at most ``per_class`` labelled rows of each class (those of the smallest
hash of doc_id), one text of at most ``LEARN_CHARS`` characters each: that bounds what
reaches the driver.  The class shares are counted over all labelled rows.  Words repeat,
so a worker keeps gains of at most ``CACHE`` words.  Scoring is a narrow pass over whole
texts.

Defined cases: null, empty and letterless texts have no window and get the score of a
text without gains; null labels are not learned from; repeated rows are scored alike;
of several texts with one doc_id one is learned from; with no labelled rows of either
class every score is the share of toxic labels (0 if there are none); an empty table gives
no rows; only ``doc_id`` and ``text`` of documents are read, and ``reject`` keeps other
columns whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

PER_CLASS = 4000
THRESHOLD = 0.3
#: Calibrated thresholds: quantiles of the largest gains of ordinary texts.
QUANTILES = (0.3, 0.6, 0.8, 0.95, 0.99)
#: Rate in toxic over rate in ordinary texts from which a word trains the toxic dictionary.
LIFT = 100.0
#: Words on either side of a gaining word that make a longer window.
AROUND = 4
LEARN_CHARS = 20_000
CACHE = 200_000
BASE_BYTES, TOXIC_BYTES, LEVEL = 32_768, 16_384, 9
#: Bytes after each window, also in both dictionaries: the compressor looks for no
#: match in the last bytes of its input.
TAIL = b"0123456789~!@#$%^&*()_+=[]{};:<>"
WINDOW = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # intercept first
    thresholds: tuple[int, ...] = ()  # of words, then of longer windows


_scorers: dict[int, "Scorer"] = {}


def windows(text: str | None) -> list[str]:
    return WINDOW.findall((text or "").lower())


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS
        )

        def compressor(content: bytes):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return z.ZstdCompressor(dict_data=d, compression_params=params)

        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.gains: dict[str, int] = {}

    def gain(self, window: str) -> int:
        got = self.gains.get(window)
        if got is None:
            if len(self.gains) >= CACHE:
                self.gains.clear()
            raw = f" {window} ".encode() + TAIL
            got = self.gains[window] = len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw))
        return got

    def gains_of(self, text: str | None) -> tuple[list[int], list[int]]:
        """Positive gains of words, and the gains of the longer windows around them."""
        words, get = windows(text), self.gains.get
        found, wide, reached = [], [], 0
        for i, w in enumerate(words):
            g = get(w)
            if g is None:
                g = self.gain(w)
            if g > 0:
                found.append(g)
                if i >= reached:  # windows do not overlap in their centres
                    raw = f" {' '.join(words[max(0, i - AROUND) : i + AROUND + 1])} ".encode() + TAIL
                    wide.append(len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw)))
                    reached = i + AROUND + 1
        return found, wide


def features(gains: tuple[list[int], list[int]], thresholds: tuple[int, ...]) -> np.ndarray:
    """Counts of windows that gain at least each threshold, and the largest gains."""
    half = len(thresholds) // 2
    out = []
    for found, least in zip(gains, (thresholds[:half], thresholds[half:]), strict=True):
        counts = np.array([sum(g >= t for g in found) for t in least], dtype=float)
        out += [np.log1p(counts), np.minimum(counts, 2.0), [float(max(found, default=0))]]
    return np.concatenate(out)


def calibrated(ordinary: list[tuple[list[int], list[int]]]) -> tuple[int, ...]:
    """Thresholds from the gains of ordinary texts: rising, at least 1."""
    out: list[int] = []
    for kind in (0, 1):
        largest = [max(g[kind], default=0) for g in ordinary] or [0]
        least = 1
        for q in QUANTILES:
            least = max(least, int(np.ceil(np.quantile(largest, q))))
            out.append(least)
            least += 1
    return tuple(out)


def scorer(model: ToxicityModel) -> Scorer:
    key = zlib.crc32(model.toxic, zlib.crc32(model.ordinary))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model.ordinary, model.toxic)
    return _scorers[key]


def train_dictionary(size: int, samples: list[bytes], **how) -> bytes:
    """zstandard's trainer; with too little text for it, the text itself."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, **how).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary dictionary, toxic dictionary)."""
    kept = [windows(t) for t in ordinary]
    known = Counter(w for ws in kept for w in set(ws))
    seen = Counter(w for t in toxic for w in set(windows(t)))
    least = 3 if len(toxic) >= 100 else 1
    rate = lambda w: (seen[w] / len(toxic)) / ((known[w] + 0.1) / len(ordinary))
    telling = lambda t: [f" {w} ".encode() for w in sorted(set(windows(t))) if seen[w] >= least and rate(w) >= LIFT]
    base = train_dictionary(BASE_BYTES, [" ".join(ws).encode() for ws in kept if ws], k=24, d=6)
    special = train_dictionary(TOXIC_BYTES, [w for t in toxic for w in telling(t)], k=24, d=6)
    return base + TAIL, base + special + TAIL


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method, intercept first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Learns from labelled rows that are not held out."""
    learn = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).filter("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    share = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    n1, n0 = share.get(1, 0), share.get(0, 0)
    prior = n1 / max(1, n0 + n1)
    flat = ToxicityModel(b"", b"", np.array([np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))]))
    if not n1 or not n0:
        return flat
    pick = lambda c: learn.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    ids = pick(1).unionByName(pick(0)).select("doc_id", "toxic")
    short = docs.select("doc_id", "text").filter(F.length("text") <= LEARN_CHARS)
    one = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted((r["h"], r["toxic"], r["text"]) for r in one.select("toxic", "text", F.xxhash64("text").alias("h")).collect())
    # copies of one text fall on one side
    first = [r for r in rows if r[0] % 3]
    second = [r for r in rows if not r[0] % 3]
    if not any(r[1] for r in first) or all(r[1] for r in first) or not second:
        return flat
    ordinary, toxic = train_dictionaries([r[2] for r in first if r[1]], [r[2] for r in first if not r[1]])
    own = Scorer(ordinary, toxic)
    gains = [own.gains_of(r[2]) for r in second]
    thresholds = calibrated([g for g, r in zip(gains, second, strict=True) if not r[1]])
    x = np.array([features(g, thresholds) for g in gains])
    y = np.array([float(r[1]) for r in second])
    m1, m0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    weight = np.where(y == 1, n1 / m1, n0 / m0)
    return ToxicityModel(ordinary, toxic, fit_logistic(x, y, weight * len(y) / weight.sum()), thresholds)


def probability(model: ToxicityModel, own: Scorer | None, text: str | None) -> float:
    z = model.weights[0] + (features(own.gains_of(text), model.thresholds) @ model.weights[1:] if own else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score_column(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The toxicity of a text column as an Arrow-batched expression."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        own = scorer(m) if len(m.weights) > 1 else None
        for texts in batches:
            yield pd.Series([probability(m, own, t) for t in texts], dtype="float64")

    return score(F.col(text))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = docs.select("doc_id", score_column(docs, model).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def reject(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows predicted toxic, columns as they were."""
    return docs.filter(score_column(docs, model) < THRESHOLD)
