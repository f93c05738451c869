"""Decoding token sequences and placing words in time.

Sequential algorithms run per clip as grouped maps, so clips spread over executors and a
task holds one clip.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import first_argmax
from ..functions.text import WORD_MARK, normalise
from .intervals import overlaps, points_inside

ACCEPT_MEAN, GAP_FILLED = -6.0, 0.8
#: Letters that a word and a token share at least.
TOUCH = 1e-6
NOTHING = -1e30


def greedy_ids(frames: DataFrame, blank: int) -> DataFrame:
    """clip_id, ids: best id of each (clip_id, t, lp) frame, adjacent repeats collapsed,
    blanks dropped; a blank between two equal ids keeps both."""
    best = frames.select("clip_id", "t", first_argmax(F.col("lp")).alias("id"))
    w = W.partitionBy("clip_id").orderBy("t")
    kept = best.withColumn("before", F.lag("id").over(w)).filter((F.col("id") != F.coalesce("before", F.lit(-1))) & (F.col("id") != blank))
    got = kept.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("x"))
    every = frames.select("clip_id").distinct().join(got, "clip_id", "left")
    return every.select("clip_id", F.coalesce(F.col("x.id"), F.array().cast("array<int>")).alias("ids"))


def ids_to_text(decoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """clip_id, text: tokens of (id, token) joined, word marks as spaces, normalised."""
    each = decoded.select("clip_id", F.posexplode_outer("ids").alias("i", "id")).join(vocab, "id", "left")
    token = F.when(F.coalesce("token", F.lit("")).isin("", "<unk>", "<blank>"), "").otherwise(F.col("token"))
    got = each.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", token.alias("token")))).alias("x"))
    return got.select("clip_id", normalise(F.replace(F.array_join("x.token", ""), F.lit(WORD_MARK), F.lit(" "))).alias("text"))


#: Bytes of steps back that are held at once.
BACK_BYTES = 32 << 20


class Trellis:
    """States blank, t1, blank, t2, ... over frames; only those that a whole path can pass.

    A frame goes at most two states on, so frame t has states up to 2 t + 1, and from lower
    ones than ``low(t)`` the end is out of reach.  These bounds move together: what a state in
    them follows is in them too, and the scores are those of the whole table."""

    def __init__(self, lp: np.ndarray, target: list[int], blank: int):
        self.n, self.size = len(lp), 2 * len(target) + 1
        self.wide = lp.astype(np.float64)
        top = self.wide.max(1)
        self.norm = (top + np.log(np.exp(self.wide - top[:, None]).sum(1))).astype(np.float32).astype(np.float64)
        self.label = np.full(self.size, blank)
        self.label[1::2] = target
        self.skip = np.zeros(self.size, bool)
        self.skip[3::2] = self.label[3::2] != self.label[1:-2:2]

    def low(self, t: int) -> int:
        return max(0, self.size - 2 - 2 * (self.n - 1 - t))

    def high(self, t: int) -> int:
        return min(self.size, 2 * t + 2)

    def width(self) -> int:
        return min(self.size, 2 * (self.n - self.size // 2) + 2)

    def emit(self, t: int, states) -> np.ndarray:
        return self.wide[t, self.label[states]] - self.norm[t]

    def start(self) -> np.ndarray:
        return self.emit(0, slice(self.low(0), self.high(0))).astype(np.float32)

    def step(self, t: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of frame t from those of the one before, and the steps back."""
        low, high, before = self.low(t), self.high(t), self.low(t - 1)
        held = np.full(high - low + 2, NOTHING, np.float32)
        first = max(low - 2, before)
        part = score[first - before : high - before]
        held[first - low + 2 : first - low + 2 + len(part)] = part
        best, back = held[2:].copy(), np.zeros(high - low, np.uint8)
        take = held[1:-1] > best
        best[take], back[take] = held[1:-1][take], 1
        take = self.skip[low:high] & (held[:-2] > best)
        best[take], back[take] = held[:-2][take], 2
        made = (best.astype(np.float64) + self.emit(t, slice(low, high))).astype(np.float32)
        return np.where(best <= NOTHING / 2, np.float32(NOTHING), made), back

    def path(self) -> np.ndarray | None:
        """The state of every frame.  Scores at cuts are kept, and the steps back of a part are
        made when the path comes to it."""
        part = max(BACK_BYTES // self.width(), int(self.n**0.5), 1)
        kept, score = {}, self.start()
        for t in range(1, self.n):
            if (t - 1) % part == 0:
                kept[t - 1] = score
            score, _ = self.step(t, score)
        ends = np.full(2, NOTHING, np.float32)
        for i, state in enumerate((self.size - 1, self.size - 2)):
            if state < self.high(self.n - 1):
                ends[i] = score[state - self.low(self.n - 1)]
        if ends.max() <= NOTHING / 2:
            return None
        path = np.empty(self.n, np.int64)
        path[-1] = self.size - 1 - int(ends.argmax())
        for cut in sorted(kept, reverse=True):
            last, score, backs = min(cut + part, self.n - 1), kept[cut], []
            for t in range(cut + 1, last + 1):
                score, back = self.step(t, score)
                backs.append(back)
            for t in range(last, cut, -1):
                path[t - 1] = path[t] - backs[t - cut - 1][path[t] - self.low(t)]
        return path


def forced_alignment(lp: np.ndarray, target: list[int], blank: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(first frame, last frame, mean best log-probability) of each target token along
    the best path through blank, t1, blank, t2, ..., or None without a path.  Scores are
    single precision; staying wins ties, then the nearer state; a tie at the end goes to
    the last blank.  Memory grows with the frames and the targets, not with their product."""
    n = len(lp)
    if not target or n < len(target):
        return None
    trellis = Trellis(lp, target, blank)
    path = trellis.path()
    if path is None:
        return None
    # states never fall along the path, so a token's frames are one stretch of it
    own = 2 * np.arange(len(target)) + 1
    first, last = np.searchsorted(path, own, "left"), np.searchsorted(path, own, "right") - 1
    if (last < first).any():
        return None
    on_path = pd.Series(trellis.emit(np.arange(n), path)).groupby(path).max()
    return first, last, float(on_path[own].mean())


def align_tokens(frames: DataFrame, targets: DataFrame, blank: int) -> DataFrame:
    """clip_id, k, id, first, last, mean_lp, accepted for each token of (clip_id, ids).  A
    clip's ids travel once, not with each frame."""
    kind = dict(frames.dtypes)["clip_id"]

    def one(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        cols = ["clip_id", "k", "id", "first", "last", "mean_lp", "accepted"]
        if rows.empty or asked.empty:
            return pd.DataFrame(columns=cols)
        r = rows.sort_values("t")
        ids = [int(x) for x in asked.ids.iloc[0]]
        got = forced_alignment(np.stack(r.lp.to_list()), ids, blank)
        if got is None:
            return pd.DataFrame(columns=cols)
        a, b, m = got
        return pd.DataFrame({"clip_id": r.clip_id.iloc[0], "k": range(len(ids)), "id": ids, "first": a, "last": b, "mean_lp": m, "accepted": m > ACCEPT_MEAN}, columns=cols)

    schema = f"clip_id {kind}, k int, id int, first int, last int, mean_lp double, accepted boolean"
    # new names, as the targets may come from the frames
    known = lambda rows, *more: rows.filter("clip_id is not null").select(F.col("clip_id").alias("clip_id"), *more).groupBy("clip_id")
    return known(frames, "t", "lp").cogroup(known(targets, "ids")).applyInPandas(one, schema)


TIMED = "clip_id {key}, i int, word string, t_start double, t_end double"


def token_ranges(spans: DataFrame) -> DataFrame:
    """Adds t_from and t_to, a token's range of letters in its clip, to (clip_id, k,
    letters, ...)."""
    w = W.partitionBy("clip_id").orderBy("k")
    rows = spans.withColumn("t_to", F.sum("letters").over(w))
    return rows.withColumn("t_from", F.col("t_to") - F.col("letters"))


def word_ranges(passages: DataFrame, totals: DataFrame) -> DataFrame:
    """clip_id, n, word, size, place, w_from, w_to of (clip_id, words, word_letters): a word's
    range of letters, scaled to the token letters in ``totals``.  Words without letters
    have an empty range and the place of the word before them (after, for the first)."""
    each = passages.select("clip_id", F.posexplode(F.arrays_zip("words", "word_letters")).alias("n", "x"))
    each = each.select("clip_id", "n", F.col("x.words").alias("word"), F.col("x.word_letters").alias("size"))
    w = W.partitionBy("clip_id").orderBy("n")
    each = each.withColumns({"after": F.sum("size").over(w), "place": F.greatest(F.sum((F.col("size") > 0).cast("int")).over(w), F.lit(1)) - 1})
    every = each.groupBy("clip_id").agg(F.sum("size").alias("all_words")).filter("all_words > 0").join(totals.filter("all_tokens > 0"), "clip_id")
    scale = lambda c: c * F.col("all_tokens") / F.col("all_words")
    ranges = {"w_from": scale(F.col("after") - F.col("size")), "w_to": scale(F.col("after"))}
    return each.join(every, "clip_id").withColumns(ranges).select("clip_id", "n", "word", "size", "place", "w_from", "w_to")


def word_times(spans: DataFrame, passages: DataFrame, frame_seconds: float) -> DataFrame:
    """TIMED rows.  ``spans`` is (clip_id, k, first, last, letters), ``passages``
    (clip_id, words, word_letters).

    A word takes the tokens that touch its letter range (an interval join); words without
    letters join a neighbour.  Short gaps are closed, then starts and ends
    never fall.  A clip in which a word meets no token has no rows."""
    tokens = token_ranges(spans)
    words = word_ranges(passages, spans.groupBy("clip_id").agg(F.sum("letters").alias("all_tokens")))
    real = words.filter("size > 0").select("clip_id", "place", "w_from", "w_to")
    met = overlaps(real, tokens.select("clip_id", "k", "first", "last", "t_from", "t_to"), ["clip_id"], ("w_from", "w_to"), ("t_from", "t_to"), TOUCH)
    first, last = F.min_by("r.first", "r.k"), F.max_by("r.last", "r.k")
    placed = met.groupBy("clip_id", F.col("l.place").alias("place")).agg((first * frame_seconds).alias("s"), ((last + 1) * frame_seconds).alias("e"))
    held = words.groupBy("clip_id", "place").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("x"))
    rows = held.join(placed, ["clip_id", "place"], "left")
    w = W.partitionBy("clip_id").orderBy("place")
    gap = F.lead("s").over(w) - F.col("e")
    rows = rows.withColumn("closed", F.when((gap > 0) & (gap < GAP_FILLED), F.lead("s").over(w)).otherwise(F.col("e")))
    rows = rows.withColumns({"t_start": F.max("s").over(w), "missing": F.max(F.col("s").isNull()).over(W.partitionBy("clip_id"))}).filter("not missing")
    return rows.select("clip_id", F.col("place").cast("int").alias("i"), F.array_join("x.word", " ").alias("word"), "t_start", F.greatest("t_start", "closed").alias("t_end"))


#: Fixed value: steps of the round robin that evens shares out.
MOST_STEPS = 2000


def shares(n_words: int, durations: list[float]) -> np.ndarray:
    """Words of each run in proportion to its duration, at least one, then evened out
    round robin; the number of steps is bounded, so a deficit may remain.

    Closed form: of r full rounds each run gets r words more, or loses as many as it has
    above one; the round that is left over reaches the first runs only."""
    length = np.asarray(durations, float)
    counts = np.maximum(1, np.floor(n_words * length / (length.sum() or 1.0) + 0.5)).astype(int)
    k, gap = len(counts), n_words - int(counts.sum())
    if gap >= 0:
        rounds, more = divmod(min(gap, MOST_STEPS), k)
        return counts + rounds + (np.arange(k) < more)
    most = MOST_STEPS // k
    removed = lambda r: np.minimum(counts - 1, r).sum()
    rounds = int(np.searchsorted([removed(r) for r in range(1, min(most, counts.max()) + 1)], -gap, "right"))
    over = np.flatnonzero(counts - 1 > rounds)
    if rounds == most:
        over = over[over < MOST_STEPS - rounds * k]
    out = counts - np.minimum(counts - 1, rounds)
    out[over[: -gap - removed(rounds)]] -= 1
    return out


def words_over_runs(words: list[str], runs: list[tuple[float, float]], end: float) -> list[tuple[str, float, float]]:
    """Timed words: those of a run share its time evenly, those without a run stand at
    the end."""
    if not words or not runs:
        return []
    start, stop = np.array(runs, float).T
    counts = shares(len(words), stop - start)
    run = np.repeat(np.arange(len(runs)), counts)[: len(words)]
    nth = np.arange(len(run)) - (np.cumsum(counts) - counts)[run]
    piece = ((stop - start) / counts)[run]
    times = np.full((len(words), 2), float(end))
    times[: len(run), 0] = start[run] + piece * nth
    times[: len(run), 1] = start[run] + piece * (nth + 1)
    return [(w, float(a), float(b)) for w, (a, b) in zip(words, times, strict=True)]


def pause_times(run_summary: DataFrame, passages: DataFrame) -> DataFrame:
    """TIMED rows by sharing (clip_id, words, duration) over (clip_id, run, t_start, t_end)."""
    kind = dict(run_summary.dtypes)["clip_id"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("run")
        got = words_over_runs(list(r.words.iloc[0]), list(zip(r.t_start, r.t_end, strict=True)), float(r.duration.iloc[0]))
        return pd.DataFrame([(r.clip_id.iloc[0], i, *x) for i, x in enumerate(got)], columns=["clip_id", "i", "word", "t_start", "t_end"])

    return run_summary.join(passages, "clip_id").groupBy("clip_id").applyInPandas(one, TIMED.format(key=kind))


def segment_words(segments: DataFrame, words: Column) -> DataFrame:
    """clip_id, seg, i, word, t_start, t_end: a segment's words share its time evenly, at
    least 0.05 s in all."""
    rows = segments.select("clip_id", "seg", "t_start", "t_end", words.alias("ws")).select("*", F.posexplode("ws").alias("i", "word"))
    span, n = F.greatest(F.lit(0.05), F.col("t_end") - F.col("t_start")), F.size("ws")
    return rows.select("clip_id", "seg", "i", "word", (F.col("t_start") + span * F.col("i") / n).alias("t_start"), (F.col("t_start") + span * (F.col("i") + 1) / n).alias("t_end"))


def active_word(timed: DataFrame, heads: DataFrame) -> DataFrame:
    """The words that the playheads (clip_id, t) stand in: t_start <= t < t_end.  Columns of
    both, by an interval join."""
    met = points_inside(heads, timed, ["clip_id"], "t", ("t_start", "t_end"))
    return met.select("clip_id", *(F.col(f"l.{c}") for c in heads.columns if c != "clip_id"), *(F.col(f"r.{c}") for c in timed.columns if c != "clip_id"))


#: Limits of the overlap of two transcripts.
CLOSE, MOST_OVERLAP, AGREEING = 0.8, 30, 0.6


def edit_distance(a: str, b: str) -> int:
    """Columns of the table as two integers, the places where it rises and falls by one."""
    if not a:
        return len(b)
    every, last, at = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    rises, falls, distance = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        across = (((same & rises) + rises) ^ rises) | same
        up, down = (falls | ~(across | rises)) & every, rises & across
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        rises, falls = (down | ~(same | falls | up)) & every, up & (same | falls)
    return distance


@lru_cache(maxsize=1 << 18)
def close(a: str, b: str) -> bool:
    return a == b or (len(a) + len(b) - edit_distance(a, b)) / (len(a) + len(b)) >= CLOSE


@lru_cache(maxsize=1 << 18)
def letter_bits(w: str) -> int:
    """The letters of a word as bits, its second a as another than its first (several may share
    one bit)."""
    out, seen = 0, {}
    for c in w:
        seen[c] = seen.get(c, 0) + 1
        out |= 1 << ((ord(c) + 27 * seen[c]) & 63)
    return out


def agreement(before: list[str], after: list[str]) -> np.ndarray:
    """``close`` for all pairs of words.  Distances are computed only where the lengths, and the
    letters that one of both has alone, leave room."""
    bits = [np.array([letter_bits(w) for w in words], np.uint64) for words in (before, after)]
    size = [np.array([len(w) for w in words]) for words in (before, after)]
    x, y, a, b = bits[0][:, None], bits[1][None, :], size[0][:, None], size[1][None, :]
    least = np.maximum(np.abs(a - b), np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)))
    agree = (a + b - least) / (a + b) >= CLOSE
    for i, j in zip(*np.nonzero(agree), strict=True):
        agree[i, j] = close(before[i], after[j])
    return agree


def overlap_of(before: list[str], after: list[str]) -> int:
    """Words that the end of one transcript and the start of the next share: the overlap
    with most agreeing words, of equal ones the longest.  The overlap of k words is the
    k-th diagonal, from the lower left corner, of the table of word agreement."""
    size = min(len(before), len(after), MOST_OVERLAP)
    if not size:
        return 0
    agree = agreement(before[-size:], after[:size])
    length = np.arange(1, size + 1)
    same = np.array([np.trace(agree, k - size) for k in length])
    fits = same >= np.ceil(length * AGREEING)
    return int(length[fits][np.lexsort((length[fits], same[fits]))[-1]]) if fits.any() else 0


def stitch(chunks: list[str]) -> str:
    """Transcripts joined where the end of one and the start of the next agree on most
    words."""
    merged: list[str] = []
    for new in (c.split() for c in chunks):
        merged += new[overlap_of(merged[-MOST_OVERLAP:], new) :]
    return " ".join(merged)


def stitched(chunks: DataFrame) -> DataFrame:
    """clip_id, text of (clip_id, chunk_no, text)."""
    kind = dict(chunks.dtypes)["clip_id"]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in rows.sort_values("chunk_no").text if isinstance(t, str)]
        return pd.DataFrame([(*key, stitch(texts))], columns=["clip_id", "text"])

    return chunks.groupBy("clip_id").applyInPandas(one, f"clip_id {kind}, text string")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable bytes stand for
    themselves, the others take code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def decode_bytes(tokens: list[str]) -> str:
    """Text of byte-level tokens; tokens that open with ``<|`` are skipped."""
    table = byte_alphabet()
    raw = bytes(table[c] for t in tokens if not t.startswith("<|") for c in t if c in table)
    return raw.decode("utf-8", errors="replace")


@F.pandas_udf(T.StringType())
def byte_text(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else decode_bytes(list(t)) for t in tokens], dtype="object")


#: Seconds of a chunk, and of the text after its last time stamp.
CHUNK_SECONDS, TRAILING_SECONDS = 30.0, 5.0


def stamped_segments(tokens: DataFrame, chunk: float = CHUNK_SECONDS) -> DataFrame:
    """clip_id, seg, text, t_start, t_end: the text between consecutive time stamps.
    ``tokens`` is (clip_id, i, token, seconds, t_offset); a time stamp has seconds, a byte-
    level token has null.  Text before the first stamp is dropped, trailing text lasts up
    to 5 s, and a clip without stamps is one segment as long as the chunk."""
    w = W.partitionBy("clip_id").orderBy("i")
    parts = tokens.withColumn("part", F.count("seconds").over(w))
    word = F.when(F.col("seconds").isNull(), F.struct("i", "token"))
    held = parts.groupBy("clip_id", "part").agg(
        F.max("seconds").alias("start"), F.array_sort(F.collect_list(word)).alias("x"), F.max("t_offset").alias("t_offset")
    )
    order = W.partitionBy("clip_id").orderBy("part")
    told = held.select(
        "clip_id", "part", "start", "t_offset", F.trim(byte_text("x.token")).alias("text"),
        F.lead("start").over(order).alias("next"), F.max("part").over(W.partitionBy("clip_id")).alias("stamps"),
    )
    kept = told.filter((F.col("text") != "") & ((F.col("part") > 0) | (F.col("stamps") == 0)))
    end = F.when(F.col("stamps") == 0, F.lit(chunk)).otherwise(F.coalesce("next", F.least(F.lit(chunk), F.col("start") + TRAILING_SECONDS)))
    return kept.select(
        "clip_id", (F.row_number().over(order) - 1).alias("seg"), "text",
        (F.col("t_offset") + F.coalesce("start", F.lit(0.0))).alias("t_start"), (F.col("t_offset") + end).alias("t_end"),
    )
