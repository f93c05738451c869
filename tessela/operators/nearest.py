"""Exact best matches by edit-distance ratio over an index of q-grams and lengths.

``ratio`` of two texts of a and b characters at distance d is (a + b - d) / (a + b), so a
query that already has k matches of at least t only needs texts with d <= (1 - t)(a + b).
Two lower bounds of d come without computing it: the difference of the lengths, and,
because an edit touches at most Q grams of Q characters, (max(a, b) - Q + 1 - shared) / Q
where ``shared`` counts equal grams (a gram's nth occurrence is a gram of its own).

Seeds give a first t: passages that share a query's rarest grams, and some of its length.
Rounds then go outwards from the query's length.  A round takes the length buckets that can
still hold a match of t; where t asks for at least T > 0 shared grams, only passages
with one of the query's n - T + 1 rarest grams are met (all others share fewer than T), else all of the
bucket: a block of its passages meets a team of queries in one task, which rules pairs out by their
lengths and letters (the larger text's letters that the other lacks each cost an edit), compares the others together
and gives back only each query's k best, so these pairs are never rows.
Pairs whose bounds leave room are compared, t rises, and a
query ends when no bucket is left that reaches t.  No pair that could be among the k best is dropped, ties
included.

Scale: postings join on (bucket, gram), rarest grams first; neighbouring buckets
share a shelf of ``BLOCK`` passages or more, whose blocks of about so many meet teams of about ``TEAM`` queries.  A query's state is
k rows and t.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import POINT_BITS, WORD, Texts, codes, edit_distances
from ..scratch import drop_table, written

Q = 3
#: Texts of one length bucket differ by at most this factor.
GROWTH = 1.1
#: Farthest bucket of each round, counted from the query's own.
ROUNDS = [1, 4, 1_000]
BLOCK, TEAM = 1_000, 64
#: Seeds compared for each wanted match; grams of more passages than SEED_DF make no seeds.
SEEDS, SEED_DF, SEED_GRAMS = 4, 1_000, 24
SLACK = 1e-9


def numbered_grams(s: str) -> np.ndarray:
    """64-bit codes of a text's grams; equal grams of a text are told apart by their
    number."""
    c = codes(s).astype(np.int64)
    if len(c) < Q:
        return np.empty(0, np.int64)
    g = (c[:-2] << (2 * POINT_BITS)) | (c[1:-1] << POINT_BITS) | c[2:]
    g.sort()
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    nth = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    mixed = g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def gram_codes(s: pd.Series) -> pd.Series:
    return pd.Series([numbered_grams(t) for t in s])


def bucket_of(n: Column) -> Column:
    return F.floor(F.log(n + 1) / math.log(GROWTH)).cast("int")


def least_length(bucket: Column) -> Column:
    return F.ceil(F.pow(F.lit(GROWTH), bucket) - 1 - SLACK)


def most_length(bucket: Column) -> Column:
    return F.ceil(F.pow(F.lit(GROWTH), bucket + 1) - 1 - SLACK) - 1


def indexed(passages: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, p_text, p_n, bucket, shelf, block, p_grams) of passages with a text, written."""
    n = F.length("p_text")
    rows = passages.select(*key, F.col(text).alias("p_text")).filter("p_text is not null")
    rows = written(rows.select("*", n.alias("p_n"), bucket_of(n).alias("bucket"), gram_codes("p_text").alias("p_grams")), "passage-grams")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are buckets
    shelves = sizes.withColumn("shelf", F.floor((F.sum("n").over(W.orderBy("bucket")) - F.col("n")) / BLOCK))
    shelves = shelves.withColumn("blocks", F.ceil(F.sum("n").over(W.partitionBy("shelf")) / BLOCK)).drop("n")
    return rows.join(F.broadcast(shelves), "bucket").withColumn("block", F.pmod(F.hash(*key), "blocks")).drop("blocks")


def asked_grams(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, gram, df, place): a query's grams from the rarest on, counted from 1."""
    df = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    grams = asked.select("query_id", F.explode("q_grams").alias("gram")).join(df, "gram", "left").fillna(0, ["df"])
    return grams.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("df", "gram")))


def allowed(t: Column, n: Column) -> Column:
    """Largest distance with which a pair of ``n`` characters reaches ratio ``t``."""
    return F.floor((1 - t) * n + SLACK)


def compared(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``pairs`` (query_id, key, q_text, q_n, p_text, p_n, t) with their ratio, if it reaches
    t; t is at least 0, which all do."""
    names = ["query_id", *key]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            (ai, a), (bi, b) = pd.factorize(frame["q_text"]), pd.factorize(frame["p_text"])
            found, ok = ratios(Texts(list(a)), Texts(list(b)), ai, bi, frame["t"].to_numpy())
            yield frame.loc[ok, names].assign(score=found[ok])

    # so many tasks even where the texts are few bytes: their number of pairs counts
    rows = pairs.select(*names, "q_text", "p_text", "t").repartition(shuffles(pairs), *names)
    return rows.mapInPandas(score, T.StructType([*(pairs.schema[c] for c in names), T.StructField("score", T.DoubleType())]))


def ratios(a: Texts, b: Texts, ai: np.ndarray, bi: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of the pairs, and which of them reach t."""
    n, d = a.sizes[ai] + b.sizes[bi], edit_distances(a, b, ai, bi)
    return np.where(n == 0, 1.0, (n - d) / np.maximum(n, 1)), d <= np.floor((1 - t) * n + SLACK)


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def possible(pairs: DataFrame) -> DataFrame:
    """The pairs whose bounds leave room for t."""
    shared = F.size(F.array_intersect("q_grams", "p_grams")) + F.size("q_grams") - F.size(F.array_distinct("q_grams"))
    by_grams = F.ceil((F.greatest("q_n", "p_n") - (Q - 1) - shared) / Q)
    return pairs.filter(F.greatest(F.abs(F.col("q_n") - F.col("p_n")), by_grams) <= allowed(F.col("t"), F.col("q_n") + F.col("p_n")))


def ranked(scores: DataFrame, key: list[str], k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), *key)
    once = scores.groupBy("query_id", *key).agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def with_floor(asked: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``asked`` with t: the k-th best score so far, 0 with fewer."""
    floors = best.filter(F.col("rank") == k - 1).select("query_id", F.col("score").alias("t"))
    return asked.join(floors, "query_id", "left").fillna(0.0, ["t"])


def seeds(asked: DataFrame, index: DataFrame, postings: DataFrame, grams: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query_id, key) of passages that are likely to be near."""
    rare = grams.filter((F.col("df") > 0) & (F.col("df") <= SEED_DF) & (F.col("place") <= SEED_GRAMS))
    hits = rare.select("query_id", "gram").join(postings, "gram").groupBy("query_id", *key).agg(F.count(F.lit(1)).alias("hits"))
    order = W.partitionBy("query_id").orderBy(F.desc("hits"), *key)
    alike = hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SEEDS * k).select("query_id", *key)
    some = index.select("bucket", *key).withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy(*key))).filter(F.col("r") <= k)
    of_length = asked.select("query_id", bucket_of(F.col("q_n")).alias("bucket")).join(some, "bucket").select("query_id", *key)
    return alike.unionByName(of_length).distinct()


def open_buckets(asked: DataFrame, nearest: int, farthest: int, last: int) -> DataFrame:
    """``asked`` (with t) for each bucket of the round that can hold a match of t, and
    ``least``, the shared grams that this asks for at least."""
    own, t, a = bucket_of(F.col("q_n")), F.col("t"), F.col("q_n")
    rows = asked.withColumn("bucket", F.explode(F.sequence(F.greatest(own - farthest, F.lit(0)), F.least(own + farthest, F.greatest(own, F.lit(last))))))
    rows = rows.filter(F.abs(F.col("bucket") - own) >= nearest).withColumns({"lo": least_length(F.col("bucket")), "hi": most_length(F.col("bucket"))})
    # the length of the bucket that is nearest to the query's
    fit = F.least(F.greatest(a, F.col("lo")), F.col("hi"))
    rows = rows.filter(F.abs(a - fit) <= allowed(t, a + fit))
    needed = lambda b: F.greatest(a, b) - (Q - 1) - Q * ((1 - t) * (a + b) + SLACK)
    return rows.withColumn("least", F.ceil(F.least(needed(F.col("lo")), needed(F.col("hi")), needed(fit))).cast("int")).drop("lo", "hi")


def teamed(asked: DataFrame) -> DataFrame:
    """``asked`` with team: queries that fill like numbers of words meet blocks together."""
    rows = asked.withColumn("team", F.ceil(F.log2(F.greatest(F.ceil(F.col("q_n") / WORD), F.lit(1)))))
    sizes = rows.groupBy("team").agg(F.ceil(F.count(F.lit(1)) / TEAM).alias("teams"))
    return rows.join(F.broadcast(sizes), "team").withColumn("team", F.col("team") + 64 * F.pmod(F.hash("query_id"), "teams")).drop("teams")


def strict_pairs(opened: DataFrame, index: DataFrame, postings: DataFrame, grams: DataFrame, key: list[str]) -> DataFrame:
    """The pairs of a round that share one of the query's rarest grams, where they must."""
    strict = opened.filter("least > 0").select("query_id", "bucket", "t", (F.size("q_grams") - F.col("least") + 1).alias("prefix"))
    first = strict.join(grams.filter("df > 0"), "query_id").filter(F.col("place") <= F.col("prefix")).select("query_id", "bucket", "gram", "t")
    met = first.join(postings, ["bucket", "gram"]).select("query_id", *key, "t").distinct()
    some = met.join(index, key).join(opened.select("query_id", "q_text", "q_n", "q_grams").distinct(), "query_id")
    return some.select("query_id", *key, "q_text", "q_n", "q_grams", "p_text", "p_n", "p_grams", "t")


def block_scores(opened: DataFrame, index: DataFrame, key: list[str], k: int) -> DataFrame:
    """query_id, key, score of each query's k best (and their equals) of a block, of the
    buckets that are met whole; and rows without a score that count the pairs compared."""
    meet, p_meet = ["shelf", "block", "team"], ["p_shelf", "p_block", "p_team"]
    whole = opened.filter("least <= 0").join(F.broadcast(index.select("bucket", "shelf").distinct()), "bucket")
    whole = whole.groupBy("query_id", "shelf", "team").agg(F.first("q_text").alias("q_text"), F.first("t").alias("t"), F.collect_set("bucket").alias("buckets"))
    asks = whole.join(index.select("shelf", "block").distinct(), "shelf").select(*meet, "query_id", "q_text", "t", "buckets")
    rows = index.join(whole.select("shelf", "team").distinct(), "shelf").select(*[F.col(c).alias(f"p_{c}") for c in meet], *key, "p_text", F.col("bucket").alias("p_bucket"))
    asks, rows = asks.repartition(shuffles(opened), *meet), rows.repartition(shuffles(opened), *p_meet)
    names = ["query_id", *key]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = Texts(left["q_text"].tolist()), Texts(right["p_text"].tolist())
        a_bags, b_bags, t, in_bucket, ai, bi = a.bags(), b.bags(), left["t"].to_numpy(), right["p_bucket"].to_numpy(), [], []
        for i in range(len(left)):
            common, longer = np.minimum(a_bags[i], b_bags).sum(axis=1), np.maximum(a.sizes[i], b.sizes)
            open_here = np.isin(in_bucket, left["buckets"].iloc[i])
            room = np.flatnonzero(open_here & (longer - common <= np.floor((1 - t[i]) * (a.sizes[i] + b.sizes) + SLACK)))
            ai.append(np.full(len(room), i))
            bi.append(room)
        ai, bi = np.concatenate(ai), np.concatenate(bi)
        scores, ok = ratios(a, b, ai, bi, t[ai])
        kept = np.zeros(len(ai), bool)
        for part in np.split(np.arange(len(ai)), np.flatnonzero(np.diff(ai)) + 1):
            own = scores[part]
            floor = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -1.0
            kept[part] = (own >= floor) & ok[part]
        found = right[key].iloc[bi[kept]].reset_index(drop=True)
        found.insert(0, "query_id", left["query_id"].to_numpy()[ai[kept]])
        found["score"], found["pairs"] = scores[kept], 0
        count = left[["query_id"]].head(1).join(right[key].head(1)).assign(score=None, pairs=len(ai))
        return pd.concat([found, count.astype({"score": float})])[[*names, "score", "pairs"]]

    types = [*(opened.schema[c] if c in opened.columns else index.schema[c] for c in names), T.StructField("score", T.DoubleType()), T.StructField("pairs", T.LongType())]
    return asks.groupBy(*meet).cogroup(rows.groupBy(*p_meet)).applyInPandas(compare, T.StructType(types))


def nearest(queries: DataFrame, passages: DataFrame, k: int, key: list[str], text: str = "joined") -> tuple[DataFrame, list[int]]:
    """The k best passages of each query (query_id, text): query_id, key, score and rank, by
    (score, key); and the number of compared pairs, seeds first, then of each round.

    Texts that are null are never compared; query ids and keys are unique; an empty query
    scores 0 with everything; fewer than k passages are all ranked."""
    index = written(indexed(passages, key, text), "passage-index")
    postings = index.select(*key, "bucket", F.explode("p_grams").alias("gram"))
    asked = queries.select("query_id", F.col("text").alias("q_text")).filter("q_text is not null")
    asked = written(asked.select("*", F.length("q_text").alias("q_n"), gram_codes("q_text").alias("q_grams")), "query-texts")
    texts, asked = asked, written(teamed(asked), "query-grams")
    drop_table(texts)
    grams = written(asked_grams(asked, postings), "asked-grams")
    last = index.agg(F.max("bucket")).first()[0] or 0
    first = seeds(asked, index, postings, grams, key, k).join(asked.withColumn("t", F.lit(0.0)), "query_id").join(index, key)
    scores = written(compared(first, key), "seed-scores")
    counts = [scores.count()]
    best = written(ranked(scores, key, k), "best-matches")
    for nearest_bucket, farthest in zip([0, *(r + 1 for r in ROUNDS)], ROUNDS, strict=False):
        opened = written(open_buckets(with_floor(asked, best, k), nearest_bucket, farthest, last), "open-buckets")
        pairs = written(possible(strict_pairs(opened, index, postings, grams, key)).drop("q_grams", "p_grams"), "possible-pairs")
        blocks = written(block_scores(opened, index, key, k), "block-scores")
        counts.append(pairs.count() + (blocks.agg(F.sum("pairs")).first()[0] or 0))
        if counts[-1]:
            made = compared(pairs, key).unionByName(blocks.filter("score is not null").select("query_id", *key, "score"))
            before, best = best, written(ranked(best.select("query_id", *key, "score").unionByName(made), key, k), "best-matches")
            drop_table(before)
        for done in (opened, pairs, blocks):
            drop_table(done)
    for done in (index, asked, grams, scores):
        drop_table(done)
    return best, counts
