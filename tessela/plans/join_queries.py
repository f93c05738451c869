"""Registered queries of the index search and the interval joins, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, nearest, retrieval, sequences
from . import fixtures as fx
from .queries import LOSS, digest, query, r6, s6
from .text_queries import ASCII_SQL, ratio_sql

@query(rf"""WITH q AS (SELECT item_id AS query_id, regexp_replace({ASCII_SQL}, '{LOSS}', '\1', 'g') AS q FROM benchmark
        UNION ALL SELECT item_id + 1000000, substr({ASCII_SQL}, 1, 60) FROM benchmark),
    p AS (SELECT conv_id AS grp, turn AS pos, {ASCII_SQL} AS p FROM conversations UNION ALL SELECT -1 - item_id, 0, {ASCII_SQL} FROM benchmark),
    s AS (SELECT query_id, grp, pos, {ratio_sql('q', 'p')} AS score FROM q, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, grp, pos) - 1 AS k FROM s)
    SELECT query_id, grp, pos, {s6('score')} AS score, CAST(k AS INTEGER) AS rank FROM r WHERE k < 4""")
def nearest_turns(spark, sf_dir):
    """Damaged and cut passages among all turns and passages: the four nearest."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    items, turns = fx.load(spark, sf_dir, "benchmark"), fx.load(spark, sf_dir, "conversations")
    damaged = items.select(F.col("item_id").alias("query_id"), F.regexp_replace(plain, LOSS, "$1").alias("text"))
    cut = items.select((F.col("item_id") + 1_000_000).alias("query_id"), F.substring(plain, 1, 60).alias("text"))
    corpus = turns.select(F.col("conv_id").alias("grp"), F.col("turn").cast("long").alias("pos"), plain.alias("joined"))
    corpus = corpus.unionByName(items.select((-1 - F.col("item_id")).alias("grp"), F.lit(0).cast("long").alias("pos"), plain.alias("joined")))
    found, _ = nearest.nearest(damaged.unionByName(cut), corpus, 4, ["grp", "pos"])
    return found.select("query_id", "grp", "pos", r6("score").alias("score"), "rank")


WINDOWS = """ev AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + value * 1200000000.0 AS e FROM events)"""


def windows(spark, sf_dir, kind):
    """Events of a kind as intervals of 20 minutes for each unit of value."""
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = fx.load(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return rows.select("user_id", "event_id", s.alias("s"), (s + F.col("value") * 1_200_000_000.0).alias("e"))


@query(f"""WITH {WINDOWS} SELECT a.user_id, a.event_id AS purchase, b.event_id AS error FROM ev a JOIN ev b
    ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e""")
def overlapping_windows(spark, sf_dir):
    met = intervals.overlaps(windows(spark, sf_dir, "purchase"), windows(spark, sf_dir, "error"), ["user_id"], ("s", "e"), ("s", "e"))
    return met.select("user_id", F.col("l.event_id").alias("purchase"), F.col("r.event_id").alias("error"))


@query(f"""WITH {WINDOWS} SELECT a.user_id, a.event_id AS click, b.event_id AS purchase FROM ev a JOIN ev b
    ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.s >= b.s AND a.s < b.e""")
def clicks_in_windows(spark, sf_dir):
    met = intervals.points_inside(windows(spark, sf_dir, "click"), windows(spark, sf_dir, "purchase"), ["user_id"], "s", ("s", "e"))
    return met.select("user_id", F.col("l.event_id").alias("click"), F.col("r.event_id").alias("purchase"))


@query(f"""WITH t AS (SELECT item_id, list_filter(string_split({ASCII_SQL}, ' '), lambda w: w <> '') AS ws FROM benchmark),
    w AS (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS n FROM t),
    z AS (SELECT *, length(regexp_replace(word, '[^A-Za-z]', '', 'g')) AS size FROM w),
    c AS (SELECT *, sum(size) OVER (PARTITION BY item_id ORDER BY n) AS after, sum(size) OVER (PARTITION BY item_id) AS total,
                 greatest(count(*) FILTER (size > 0) OVER (PARTITION BY item_id ORDER BY n), 1) - 1 AS place FROM z),
    g AS (SELECT *, (after - size) * 3 * ceil(total / 3) / total AS w_from, after * 3 * ceil(total / 3) / total AS w_to FROM c),
    k AS (SELECT item_id, unnest(range(CAST(ceil(any_value(total) / 3) AS BIGINT))) AS k FROM c GROUP BY item_id),
    m AS (SELECT item_id, place, min(k) * 2 * CAST(0.1 AS DOUBLE) AS s, (max(k) * 2 + 1) * CAST(0.1 AS DOUBLE) AS e
          FROM g JOIN k USING (item_id) WHERE size > 0 AND 3 * k + 3 > w_from + 1e-6 AND 3 * k < w_to - 1e-6 GROUP BY item_id, place),
    h AS (SELECT item_id, place, string_agg(word, ' ' ORDER BY n) AS word FROM c GROUP BY item_id, place),
    x AS (SELECT *, lead(s) OVER (PARTITION BY item_id ORDER BY place) AS nx, max(s) OVER (PARTITION BY item_id ORDER BY place) AS st FROM h JOIN m USING (item_id, place))
    SELECT item_id AS clip_id, CAST(place AS INTEGER) AS i, md5(word) AS word, {s6('st')} AS t_start,
           {s6('greatest(st, CASE WHEN nx - e > 0 AND nx - e < 0.8 THEN nx ELSE e END)')} AS t_end FROM x""")
def token_word_times(spark, sf_dir):
    """Passages as words over tokens of three letters, each of which lasts one of two
    frames."""
    words = F.filter(F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), " "), lambda w: w != "")
    sizes = F.transform("words", lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")))
    clips = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clip_id"), words.alias("words")).withColumn("word_letters", sizes)
    total = F.aggregate("word_letters", F.lit(0), lambda a, x: a + x)
    tokens = clips.select("clip_id", F.explode(F.sequence(F.lit(0), F.ceil(total / 3).cast("int") - 1)).alias("k"))
    spans = tokens.select("clip_id", "k", (F.col("k") * 2).alias("first"), (F.col("k") * 2).alias("last"), F.lit(3).alias("letters"))
    got = sequences.word_times(spans, clips, 0.1)
    return got.select("clip_id", "i", digest(F.col("word")).alias("word"), r6("t_start").alias("t_start"), r6("t_end").alias("t_end"))


WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '[\t-\r ]+'), lambda w: w <> '')"


@query(rf"""WITH b AS (SELECT item_id // 5 AS grp, item_id % 5 + 1 AS pos, item_id, {ASCII_SQL} AS text FROM benchmark),
    q AS (SELECT item_id AS query_id, regexp_replace(text, '{LOSS}', '\1', 'g') AS q FROM b),
    s AS (SELECT grp, pos, size, list(text) OVER w AS l, list(pos) OVER w AS p FROM b, unnest(range(1, 4)) AS u(size)
          WINDOW w AS (PARTITION BY grp, size ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    t AS (SELECT grp, pos, p[size] AS pos_end, size, array_to_string(list_slice(l, 1, size), ' ') AS t FROM s WHERE len(l) >= size),
    m AS (SELECT *, {WORDS_SQL.format('q')} AS qw, {WORDS_SQL.format('t')} AS tw FROM q, t),
    h AS (SELECT *, array_to_string(list_slice(qw, 1, least(len(qw), len(tw))), ' ') AS qh, array_to_string(list_slice(tw, 1, least(len(qw), len(tw))), ' ') AS th FROM m),
    r AS (SELECT query_id, grp, pos, pos_end, size, greatest({ratio_sql('q', 't')}, {ratio_sql('qh', 'th')}) AS score FROM h)
    SELECT query_id, grp, pos, pos_end, {s6('score')} AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size > 1, grp, pos, size) AS k FROM r) WHERE k = 1""")
def matched_passages(spark, sf_dir):
    """Damaged passages among single passages and spans, by the whole text and by as many
    leading words."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    corpus = fx.benchmark_corpus(spark, sf_dir).withColumns({c: plain(c) for c in ("display", "joined")})
    asked = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace(plain("text"), LOSS, "$1").alias("text"))
    return retrieval.match_passage(asked, corpus).select("query_id", "grp", "pos", "pos_end", r6("score").alias("score"))
