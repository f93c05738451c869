"""Registered queries of the time-series and text operators, with their DuckDB SQL.

Floating results are rounded by floor(x * 1e6 + 0.5) / 1e6 on both sides.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, pitch, similarity, text
from ..operators import curve, framing, judge, retrieval, scoring, sequences
from ..scratch import scratch
from ..streaming import live
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Doubles from here on have no fraction.
WHOLE = 2.0**53


def r6(c: Column | str) -> Column:
    """Six decimals.  Spark's floor is a long, so values without a fraction (and NaN) are kept.
    The array holds the value, so that it is computed once."""
    x = (F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5
    whole = F.transform(F.array(x), lambda v: F.when(F.abs(v) < WHOLE, F.floor(v).cast("double")).otherwise(v))
    return F.get(whole, F.lit(0)) / 1e6


def s6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


POINTS = """pts AS (
    SELECT user_id AS clip_id, event_id AS seq, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t,
           value AS freq, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS rms
    FROM events)"""
GATED = f"""{POINTS}, rk AS (
    SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY rms) AS k, count(*) OVER (PARTITION BY clip_id) AS n FROM pts),
loud AS (SELECT clip_id, max(rms) AS ref FROM rk WHERE k = floor(n * 0.85) + 1 GROUP BY clip_id),
gated AS (
    SELECT clip_id, t, seq, CASE WHEN freq > 0 AND rms >= ref * 0.28 THEN 69 + 12 * log2(freq / 440) END AS semitone
    FROM pts JOIN loud USING (clip_id))"""
#: The sequential fold: rows are taken one by one, the left neighbour as it was left.
CURVE = f"""{GATED}, num AS (
    SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t, seq) AS i, lead(semitone) OVER (PARTITION BY clip_id ORDER BY t, seq) AS nxt,
           count(*) OVER (PARTITION BY clip_id) AS n FROM gated),
fold AS (
    SELECT clip_id, t, seq, i, semitone FROM num WHERE i = 1
    UNION ALL
    SELECT m.clip_id, m.t, m.seq, m.i,
           CASE WHEN m.i < m.n AND abs(m.semitone - CASE WHEN f.semitone IS NOT NULL AND m.nxt IS NOT NULL THEN (f.semitone + m.nxt) / 2
                ELSE coalesce(f.semitone, m.nxt) END) > 9 THEN NULL ELSE m.semitone END
    FROM fold f JOIN num m ON m.clip_id = f.clip_id AND m.i = f.i + 1),
curve AS (SELECT clip_id, t, seq, semitone FROM fold)"""
RUNS = f"""{CURVE}, isl AS (
    SELECT *, sum(CASE WHEN semitone IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY t, seq) AS island FROM curve),
big AS (SELECT *, count(*) OVER (PARTITION BY clip_id, island) AS n FROM isl WHERE semitone IS NOT NULL),
runs AS (
    SELECT clip_id, CAST(dense_rank() OVER (PARTITION BY clip_id ORDER BY island) - 1 AS INTEGER) AS run,
           CAST(row_number() OVER (PARTITION BY clip_id, island ORDER BY t, seq) - 1 AS INTEGER) AS i, t, semitone
    FROM big WHERE n > 3)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.clean_curve(fx.pitch_points(spark, sf_dir))


@query(f"WITH RECURSIVE {RUNS} SELECT clip_id, run, min(t) AS t_start, max(t) AS t_end, count(*) AS n, {s6('avg(semitone)')} AS mean_semi FROM runs GROUP BY clip_id, run")
def voiced_runs(spark, sf_dir):
    out = curve.run_summary(curve.runs(cleaned(spark, sf_dir)))
    return out.select("clip_id", "run", "t_start", "t_end", "n", r6("mean_semi").alias("mean_semi"))


@query(f"""
    SELECT event_id, {s6('69 + 12 * log2(value / 440)')} AS midi,
           ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][((CAST(floor(69.5 + 12 * log2(value / 440)) AS BIGINT) % 12 + 12) % 12) + 1]
           || CAST(CAST(floor(floor(69.5 + 12 * log2(value / 440)) / 12) - 1 AS BIGINT) AS VARCHAR) AS label
    FROM events WHERE value > 0""")
def pitch_labels(spark, sf_dir):
    midi = arrays.hz_to_midi(F.col("value"))
    return fx.load(spark, sf_dir, "events").filter("value > 0").select("event_id", r6(midi).alias("midi"), arrays.midi_label(midi).alias("label"))


@query(f"WITH {GATED} SELECT clip_id, seq, t, {s6('semitone')} AS pitch FROM gated")
def energy_gate(spark, sf_dir):
    return curve.energy_gate(fx.pitch_points(spark, sf_dir)).select("clip_id", "seq", "t", r6("semi").alias("pitch"))


@query(f"WITH RECURSIVE {CURVE} SELECT clip_id, seq, t, {s6('semitone')} AS pitch FROM curve")
def despiked_curve(spark, sf_dir):
    return cleaned(spark, sf_dir).select("clip_id", "seq", "t", r6("semi").alias("pitch"))


@query(f"""WITH RECURSIVE {CURVE}, e AS (SELECT clip_id, floor(min(semitone)) - 1 AS lo, ceil(max(semitone)) + 1 AS hi FROM curve GROUP BY clip_id)
    SELECT clip_id, coalesce(CAST(lo - CASE WHEN hi - lo < 3 THEN 1 ELSE 0 END AS DOUBLE), 55.0) AS low,
           coalesce(CAST(hi + CASE WHEN hi - lo < 3 THEN 1 ELSE 0 END AS DOUBLE), 79.0) AS high FROM e""")
def display_range(spark, sf_dir):
    return curve.display_range(cleaned(spark, sf_dir))


def _smooth(src: str) -> str:
    w = "(PARTITION BY clip_id, run ORDER BY i)"
    return f"SELECT clip_id, run, i, t, semitone * 0.5 + coalesce(lag(semitone) OVER {w}, semitone) * 0.25 + coalesce(lead(semitone) OVER {w}, semitone) * 0.25 AS semitone FROM {src}"


@query(f"WITH RECURSIVE {RUNS}, s1 AS ({_smooth('runs')}), s2 AS ({_smooth('s1')}) SELECT clip_id, run, i, t, {s6('semitone')} AS pitch FROM s2")
def smoothed_runs(spark, sf_dir):
    return curve.smooth(curve.runs(cleaned(spark, sf_dir))).select("clip_id", "run", "i", "t", r6("semi").alias("pitch"))


@query()
def contour_pieces(spark, sf_dir):
    return curve.contour_pieces(cleaned(spark, sf_dir), curve.Sensitivity(0.5))


SCORED = f"""WITH RECURSIVE {CURVE}, refc AS (SELECT * FROM curve), livec AS (SELECT clip_id - 1 AS clip_id, t, seq, semitone FROM curve),
ends AS (SELECT clip_id, greatest(r, l) AS duration, n_live FROM (SELECT clip_id, max(t) AS r FROM refc GROUP BY 1) JOIN (SELECT clip_id, max(t) AS l, count(*) AS n_live FROM livec GROUP BY 1) USING (clip_id)),
grid AS (SELECT clip_id, g, CAST(g AS DOUBLE) / 79.0 * duration AS gt FROM ends, unnest(range(80)) AS u(g)),
both_ AS (SELECT 0 AS side, clip_id, t, semitone FROM refc WHERE semitone IS NOT NULL UNION ALL SELECT 1, clip_id, t, semitone FROM livec WHERE semitone IS NOT NULL),
asked AS (SELECT side, clip_id, g, gt FROM grid, (VALUES (0), (1)) AS s(side)),
prev AS (SELECT a.*, p.t AS t0, p.semitone AS s0 FROM asked a ASOF LEFT JOIN both_ p ON a.side = p.side AND a.clip_id = p.clip_id AND a.gt >= p.t),
nxt AS (SELECT a.*, p.t AS t1, p.semitone AS s1 FROM prev a ASOF LEFT JOIN both_ p ON a.side = p.side AND a.clip_id = p.clip_id AND a.gt <= p.t),
val AS (SELECT side, clip_id, g, coalesce(s0 + (s1 - s0) * CASE WHEN t1 > t0 THEN (gt - t0) / (t1 - t0) ELSE 0 END, s0, s1) AS v FROM nxt),
met AS (SELECT a.clip_id, a.v AS x, b.v AS y FROM val a JOIN val b ON a.clip_id = b.clip_id AND a.g = b.g WHERE a.side = 0 AND b.side = 1 AND a.v IS NOT NULL AND b.v IS NOT NULL),
c AS (SELECT clip_id, count(*) AS pairs, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS corr FROM met GROUP BY clip_id),
o AS (SELECT clip_id, coalesce(pairs, 0) AS pairs, CASE WHEN n_live >= 5 AND pairs >= 10 THEN corr END AS corr FROM ends LEFT JOIN c USING (clip_id))"""


@query(SCORED + f""" SELECT clip_id, CAST(pairs AS BIGINT) AS pairs, {s6('corr')} AS corr, CAST(floor(greatest(0, corr) * 100 + 0.5) AS INTEGER) AS percent,
    CASE WHEN corr IS NULL THEN NULL WHEN floor(greatest(0, corr) * 100 + 0.5) >= 85 THEN 'excellent' WHEN floor(greatest(0, corr) * 100 + 0.5) >= 65 THEN 'very good'
         WHEN floor(greatest(0, corr) * 100 + 0.5) >= 45 THEN 'good' ELSE 'try again' END AS label FROM o""")
def match_scores(spark, sf_dir):
    """Each user's curve scored against that of the user numbered one lower."""
    own = cleaned(spark, sf_dir)
    got = scoring.match_score(own, own.withColumn("clip_id", F.col("clip_id") - 1))
    return got.select("clip_id", "pairs", r6("corr").alias("corr"), "percent", "label")


SAMPLES = "clips AS (SELECT user_id AS clip_id, list(value / 250.0 - 1.0 ORDER BY event_id) AS x FROM events GROUP BY user_id)"
SIZE, HOP = 16, 10


@query(f"""WITH {SAMPLES}, f AS (SELECT clip_id, x, unnest(range(greatest(CAST(floor((len(x) - {SIZE}) / {HOP}) AS BIGINT) + 1, 1))) AS frame_no FROM clips),
    y AS (SELECT clip_id, frame_no, list_slice(x, frame_no * {HOP} + 1, frame_no * {HOP} + {SIZE}) AS w FROM f)
    SELECT clip_id, CAST(frame_no AS INTEGER) AS frame_no, frame_no * {HOP} / 25.0 AS t, CAST({SIZE} AS INTEGER) AS n, {s6(f'sqrt(list_sum(list_transform(w, lambda v: v * v)) / {SIZE})')} AS rms FROM y""")
def sliding_frames(spark, sf_dir):
    got = framing.sliding_frames(fx.clips(spark, sf_dir), SIZE, HOP, 25.0)
    return got.select("clip_id", "frame_no", "t", F.size("frame").alias("n"), r6(arrays.rms(F.col("frame"))).alias("rms"))


@query(f"""WITH {SAMPLES}, d AS (SELECT clip_id, x, len(x) / 25.0 AS dur FROM clips),
    p AS (SELECT *, CAST(least(greatest(floor(dur * 35 + 0.5), 80), 900) AS BIGINT) AS points FROM d),
    f AS (SELECT *, unnest(range(points)) AS frame_no FROM p), s AS (SELECT *, CAST(frame_no AS DOUBLE) / (points - 1) * dur AS t FROM f)
    SELECT clip_id, CAST(frame_no AS INTEGER) AS frame_no, {s6('t')} AS t,
           {s6("coalesce(list_sum(list_slice(x, CAST(floor(t * 25) AS BIGINT) + 1, CAST(floor(t * 25) AS BIGINT) + 8)), 0)")} AS total FROM s""")
def even_frames(spark, sf_dir):
    got = framing.even_frames(fx.clips(spark, sf_dir), 8)
    return got.select("clip_id", "frame_no", r6("t").alias("t"), r6(arrays.total(F.col("frame"))).alias("total"))


@query(f"""WITH {SAMPLES}, f AS (SELECT clip_id, x, unnest(range(greatest(CAST(ceil(len(x) / 50.0) AS BIGINT), 1))) AS c FROM clips)
    SELECT clip_id, CAST(c AS INTEGER) AS chunk_no, CAST(len(list_slice(x, c * 50 + 1, c * 50 + 50)) AS INTEGER) AS n FROM f""")
def fixed_chunks(spark, sf_dir):
    return framing.fixed_chunks(fx.clips(spark, sf_dir), 2).select("clip_id", "chunk_no", F.size("samples").alias("n"))


@query(f"""WITH {SAMPLES}, f AS (SELECT clip_id, x, unnest(range(CAST(floor(len(x) / 5) AS BIGINT) + 1)) AS k FROM clips),
    v AS (SELECT clip_id, sum(CASE WHEN (k + 1) * 5 <= len(x) AND list_sum(list_transform(list_slice(x, k * 5 + 1, k * 5 + 5), lambda v: v * v)) / 5 > 0.36 THEN 1 ELSE 0 END) AS c FROM f GROUP BY clip_id)
    SELECT clip_id, CAST(c * 200 AS INTEGER) AS ms, c * 200 >= 300 AS speech FROM v""")
def voiced_time(spark, sf_dir):
    how = {"rate": 25, "frame_ms": 200, "threshold": 0.6}
    s = F.col("samples")
    return fx.clips(spark, sf_dir).select("clip_id", framing.voiced_ms(s, **how).alias("ms"), framing.has_speech(s, **how).alias("speech"))


@query(f"""WITH {SAMPLES}, m AS (SELECT clip_id, x, list_sum(x) / len(x) AS mu FROM clips),
    d AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - mu) * (v - mu))) / len(x)) AS sd FROM m), z AS (SELECT clip_id, list_transform(x, lambda v: (v - mu) / CASE WHEN sd = 0 THEN 1e-8 ELSE sd END) AS z FROM d)
    SELECT clip_id, {s6('list_max(z)')} AS top, {s6('list_min(z)')} AS bottom FROM z""")
def normalised_clips(spark, sf_dir):
    z = arrays.z_normalise(F.col("samples"))
    return fx.clips(spark, sf_dir).select("clip_id", z.alias("z")).select("clip_id", r6(F.array_max("z")).alias("top"), r6(F.array_min("z")).alias("bottom"))


@query(f"""WITH {SAMPLES}, n AS (SELECT clip_id, x, greatest(CAST(floor(len(x) / (25.0 / 16) + 0.5) AS BIGINT), 1) AS m FROM clips),
    p AS (SELECT clip_id, x, unnest(range(m)) * (25.0::DOUBLE / 16) AS p FROM n), q AS (SELECT *, CAST(floor(p) AS BIGINT) AS a FROM p)
    SELECT clip_id, count(*) AS n, {s6('sum(x[a + 1] * (1 - (p - a)) + x[least(a + 1, len(x) - 1) + 1] * (p - a))')} AS total FROM q GROUP BY clip_id""")
def resampled_clips(spark, sf_dir):
    got = arrays.resample_linear(F.col("samples"), F.lit(25), F.lit(16))
    out = fx.clips(spark, sf_dir).select("clip_id", got.alias("x"))
    return out.select("clip_id", F.size("x").cast("long").alias("n"), r6(arrays.total(F.col("x"))).alias("total"))


@query()
def detected_pitch(spark, sf_dir):
    fine = framing.even_frames(fx.clips(spark, sf_dir, 2000), 256)
    return fine.select("clip_id", "frame_no", pitch.detect_pitch("frame", F.lit(2000.0)).alias("p")).select("clip_id", "frame_no", "p.*")


VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings)"


@query(f"""WITH {VECTORS}, a AS (SELECT vec_id, x, list_max(x) AS top, list_position(x, list_max(x)) - 1 AS k FROM v),
    w AS (SELECT *, greatest(k - 4, 0) AS lo, list_slice(x, greatest(k - 4, 0) + 1, least(k + 4, len(x) - 1) + 1) AS part FROM a),
    c AS (SELECT *, list_sum(part) AS mass, list_sum(list_transform(part, lambda e, i: e * (7180.0::DOUBLE * (i - 1 + lo) / 63.0 + 1997.3794084376191::DOUBLE))) AS num FROM w)
    SELECT vec_id, {s6('top')} AS confidence, {s6('CASE WHEN top > 0.2 THEN 10 * pow(2, CASE WHEN mass > 0 THEN num / mass ELSE 7180.0::DOUBLE * k / 63.0 + 1997.3794084376191::DOUBLE END / 1200) ELSE -1 END')} AS freq FROM c""")
def decoded_activations(spark, sf_dir):
    got = fx.frames(spark, sf_dir).select(F.col("t").alias("vec_id"), arrays.decode_activation(F.col("lp"), 64, threshold=0.2).alias("d"))
    return got.select("vec_id", r6("d.confidence").alias("confidence"), r6("d.freq").alias("freq"))


@query(f"""WITH {VECTORS} SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS best,
    {s6('list_max(x) + ln(list_sum(list_transform(x, lambda e: exp(e - list_max(x)))))')} AS norm FROM v""")
def frame_normalisers(spark, sf_dir):
    lp = F.col("lp")
    return fx.frames(spark, sf_dir).select(F.col("t").alias("vec_id"), arrays.first_argmax(lp).alias("best"), r6(arrays.log_sum_exp(lp)).alias("norm"))


@query(f"""WITH {VECTORS}, b AS (SELECT label, vec_id, list_position(x, list_max(x)) - 1 AS id FROM v),
    k AS (SELECT *, lag(id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM b)
    SELECT CAST(label AS BIGINT) AS clip_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY vec_id) FILTER (WHERE id <> coalesce(before, -1) AND id <> 63), '') AS ids FROM k GROUP BY label""")
def greedy_tokens(spark, sf_dir):
    got = sequences.greedy_ids(fx.frames(spark, sf_dir), 63)
    return got.select("clip_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query()
def forced_alignment(spark, sf_dir):
    frames = fx.frames(spark, sf_dir)
    return sequences.align_tokens(frames, sequences.greedy_ids(frames, 63), 63)


SPACE_RE = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
MARK_RE = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}"
SCRIPTED = f"translate(lower(text), '{fx.LATIN}', '{fx.SCRIPT}')"


def _normal_sql(c: str) -> str:
    return f"trim(regexp_replace(translate(regexp_replace(replace({c}, chr(65279), ''), '{MARK_RE}\\x{{0640}}]', '', 'g'), '{text.FOLD_FROM}', '{text.FOLD_TO}'), '{SPACE_RE}', ' ', 'g'))"


def _judge_sql(c: str) -> str:
    bare = f"replace(translate(regexp_replace({c}, '{MARK_RE}]', '', 'g'), '{text.JUDGE_FROM}', '{text.JUDGE_TO}'), chr(1600), '')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({bare}, '{SPACE_RE}', ' ', 'g'), '[^\\x{{0600}}-\\x{{06FF}} ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH d AS (SELECT conv_id, turn, {_normal_sql(SCRIPTED)} AS a, {_judge_sql(SCRIPTED)} AS b FROM conversations)
    SELECT conv_id, turn, md5(a) AS normal, md5(b) AS judged, md5(translate(b, '{text.PHONETIC_FROM}', '{text.PHONETIC_TO}')) AS phonetic,
           CAST(len(regexp_extract_all(a, '[\\x{{0621}}-\\x{{064A}}\\x{{0671}}-\\x{{06D3}}]')) AS INTEGER) AS letters, CAST(len(list_filter(string_split(a, ' '), lambda w: w <> '')) AS INTEGER) AS n_words FROM d""")
def normalised_texts(spark, sf_dir):
    t = fx.scripted(F.col("text"))
    rows = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalise(t).alias("a"), text.judge_normalise(t).alias("b"), text.phonetic_fold(t).alias("c"))
    return rows.select("conv_id", "turn", digest(F.col("a")).alias("normal"), digest(F.col("b")).alias("judged"), digest(F.col("c")).alias("phonetic"), text.letter_count(F.col("a")).alias("letters"), F.size(text.words(F.col("a"))).alias("n_words"))


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS a FROM conversations),
    p AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
    SELECT conv_id, turn, {s6('CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE (length(a) + length(b) - levenshtein(a, b)) / (length(a) + length(b)) END')} AS similarity FROM p WHERE b IS NOT NULL""")
def neighbour_similarity(spark, sf_dir):
    from pyspark.sql import Window as W

    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    rows = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    return rows.select("conv_id", "turn", r6(similarity.ratio(F.col("a"), F.col("b"))).alias("similarity"))


@query("""WITH q AS (SELECT item_id, replace(text, ' ', '') AS s FROM benchmark), d AS (SELECT doc_id, replace(text, ' ', '') AS s FROM documents),
    qg AS (SELECT DISTINCT item_id, n, substr(s, i, n) AS g FROM (SELECT item_id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM q, (VALUES (2), (3)) AS v(n) WHERE length(s) >= n)),
    dg AS (SELECT DISTINCT doc_id, n, substr(s, i, n) AS g FROM (SELECT doc_id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM d, (VALUES (2), (3)) AS v(n) WHERE length(s) >= n))
    SELECT item_id AS query_id, doc_id, floor((count(*) FILTER (WHERE qg.n = 2) + CAST(0.48 AS DOUBLE) * count(*) FILTER (WHERE qg.n = 3)) * 1e6 + 0.5) / 1e6 AS overlap FROM qg JOIN dg USING (n, g) GROUP BY 1, 2""")
def gram_overlaps(spark, sf_dir):
    q = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.no_spaces(F.col("text")).alias("ns"))
    d = fx.load(spark, sf_dir, "documents").select("doc_id", text.no_spaces(F.col("text")).alias("ns"))
    return retrieval.gram_hits(q, d, ["doc_id"]).select("query_id", "doc_id", r6("overlap").alias("overlap"))


@query("""WITH s AS (SELECT conv_id, turn, size, list(text) OVER (PARTITION BY conv_id, size ORDER BY turn ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS l,
        list(turn) OVER (PARTITION BY conv_id, size ORDER BY turn ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS tl FROM conversations, unnest(range(2, 8)) AS u(size))
    SELECT conv_id AS grp, turn AS pos, tl[size] AS pos_end, CAST(size AS INTEGER) AS size, md5(array_to_string(list_slice(l, 1, size), ' ')) AS joined FROM s WHERE len(l) >= size""")
def passage_spans(spark, sf_dir):
    got = retrieval.spans(fx.passages(spark, sf_dir), 7)
    return got.select("grp", "pos", "pos_end", "size", digest(F.col("joined")).alias("joined"))


@query("""WITH f AS (SELECT conv_id, min(turn) AS m FROM conversations GROUP BY 1), n AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
    SELECT n.conv_id AS grp, turn AS pos, CASE WHEN nx IS NOT NULL THEN n.conv_id WHEN m IS NOT NULL THEN n.conv_id + 1 END AS next_grp, coalesce(nx, m) AS next_pos FROM n LEFT JOIN f ON f.conv_id = n.conv_id + 1""")
def following_passages(spark, sf_dir):
    return retrieval.next_passage(fx.passages(spark, sf_dir))


@query("""WITH c AS (SELECT conv_id AS grp, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
    h AS (SELECT grp * 1000 + pos AS query_id, grp, pos AS h FROM c), f AS (SELECT h.* FROM h JOIN c ON c.grp = h.grp AND c.pos = h.h + 1)
    SELECT f.query_id, c.grp, c.pos, list_extract([0.22::DOUBLE, 0.12::DOUBLE, 0.06::DOUBLE], c.pos - f.h) AS bonus FROM f JOIN c ON c.grp = f.grp AND c.pos - f.h BETWEEN 1 AND 3
    UNION ALL SELECT h.query_id, c.grp, c.pos, list_extract([0.22::DOUBLE, 0.12::DOUBLE, 0.06::DOUBLE], c.nth) FROM h JOIN c ON c.grp = h.grp + 1 AND c.nth <= 3 WHERE h.query_id NOT IN (SELECT query_id FROM f)""")
def continuation_bonuses(spark, sf_dir):
    c = fx.passages(spark, sf_dir)
    hints = c.select((F.col("grp") * 1000 + F.col("pos")).alias("query_id"), "grp", "pos")
    return retrieval.hint_bonuses(hints, c)


@query(r"""WITH b AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM benchmark),
    p AS (SELECT q.item_id AS query_id, c.item_id, (length(q.text) + length(c.text) - levenshtein(q.text, c.text)) / (length(q.text) + length(c.text)) AS s FROM b q, b c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) - 1 AS k FROM p)
    SELECT query_id, CAST(item_id // 5 AS BIGINT) AS grp, CAST(item_id % 5 + 1 AS BIGINT) AS pos, floor(s * 1e6 + 0.5) / 1e6 AS score, CAST(k AS INTEGER) AS rank FROM r WHERE k < 5""")
def nearest_passages(spark, sf_dir):
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    q = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), plain("text").alias("text"))
    got = retrieval.search(q, fx.benchmark_corpus(spark, sf_dir).withColumn("joined", plain("joined")), 5)
    return got.select("query_id", "grp", "pos", r6("score").alias("score"), "rank")


#: Every fifth letter of a run is lost.
LOSS = "([A-Za-z]{4})[A-Za-z]"


@query(rf"""WITH b AS (SELECT item_id, item_id // 5 AS grp, item_id % 5 + 1 AS pos, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM benchmark),
    q AS (SELECT item_id AS query_id, regexp_replace(text, '{LOSS}', '\1', 'g') AS q FROM b
          UNION ALL SELECT 1000000 + x.grp, regexp_replace(x.text || ' ' || y.text, '{LOSS}', '\1', 'g') FROM b x JOIN b y ON x.grp = y.grp AND x.pos = 1 AND y.pos = 2),
    s AS (SELECT grp, pos, size, list(text) OVER w AS l, list(pos) OVER w AS p FROM b, unnest(range(1, 7)) AS u(size)
          WINDOW w AS (PARTITION BY grp, size ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
    t AS (SELECT grp, pos, CASE WHEN size > 1 THEN p[size] END AS pos_end, size, array_to_string(list_slice(l, 1, size), ' ') AS t FROM s WHERE len(l) >= size),
    r AS (SELECT query_id, grp, pos, pos_end, size, floor((length(q) + length(t) - levenshtein(q, t)) / (length(q) + length(t)) * 1e4 + 0.5) / 1e4 AS score FROM q, t)
    SELECT query_id, grp, pos, pos_end, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size, grp, pos) AS k FROM r) WHERE k = 1""")
def best_passages(spark, sf_dir):
    """Passages, and the first two of each group joined, with letters lost, find their own."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    rows = fx.benchmark_corpus(spark, sf_dir)
    corpus = rows.withColumns({c: F.regexp_replace(c, r"[^\x00-\x7F]", "?") for c in ("display", "joined")})
    items = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), plain.alias("text"))
    two = corpus.filter("pos <= 2").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "joined"))).alias("x")).filter("size(x) = 2 and x[0].pos = 1")
    both = items.unionByName(two.select((F.col("grp") + 1_000_000).alias("query_id"), F.array_join("x.joined", " ").alias("text")))
    found = retrieval.best_match(both.withColumn("text", F.regexp_replace("text", LOSS, "$1")), corpus)
    return found.select("query_id", "grp", "pos", "pos_end", "score")


@query("SELECT item_id, doc_id, 1.0::DOUBLE AS fit FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contained_passages(spark, sf_dir):
    """Passages that fit a document exactly, by five-word blocking and fragment fit."""

    def blocks(rows: DataFrame, key: str) -> DataFrame:
        ws = F.split("text", " ")
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("ws", i, F.lit(5))))
        return rows.select(key, ws.alias("ws")).select(key, F.explode(F.array_distinct(grams)).alias("b"))

    items, docs = fx.load(spark, sf_dir, "benchmark"), fx.load(spark, sf_dir, "documents")
    # a passage's inner words are met whole, whatever touches its ends
    inner = items.select("item_id", F.array_join(F.slice(F.split("text", " "), F.lit(2), F.greatest(F.size(F.split("text", " ")) - 2, F.lit(1))), " ").alias("text"))
    met = blocks(inner, "item_id").join(blocks(docs.select("doc_id", "text"), "doc_id"), "b").select("item_id", "doc_id").distinct()
    rows = met.join(items.select("item_id", F.col("text").alias("q")), "item_id").join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    return rows.select("item_id", "doc_id", similarity.fragment_score("q", "t").alias("fit")).filter("fit = 1.0")


@query("""WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda w: w <> '') AS ws FROM conversations),
    e AS (SELECT conv_id, turn, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM s)
    SELECT conv_id AS clip_id, turn AS seg, CAST(i AS INTEGER) AS i, md5(word) AS word, floor((turn * 10.0 + 5.0 * i / n) * 1e6 + 0.5) / 1e6 AS t_start, floor((turn * 10.0 + 5.0 * (i + 1) / n) * 1e6 + 0.5) / 1e6 AS t_end FROM e""")
def segment_words(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "conversations")
    seg = rows.select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("seg"), (F.col("turn") * 10.0).alias("t_start"), (F.col("turn") * 10.0 + 5.0).alias("t_end"), "text")
    got = sequences.segment_words(seg, F.filter(F.split("text", r"[\t-\r ]+"), lambda w: w != ""))
    return got.select("clip_id", "seg", "i", digest(F.col("word")).alias("word"), r6("t_start").alias("t_start"), r6("t_end").alias("t_end"))


@query()
def pause_word_times(spark, sf_dir):
    summary = curve.run_summary(curve.runs(cleaned(spark, sf_dir)))
    texts = fx.load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    ends = summary.groupBy("clip_id").agg(F.max("t_end").alias("duration"))
    return sequences.pause_times(summary, texts.select("clip_id", text.words(F.array_join("x.text", " ")).alias("words")).join(ends, "clip_id"))


@query()
def judged_attempts(spark, sf_dir):
    return judge.judge(attempts(spark, sf_dir))


@query()
def attempt_totals(spark, sf_dir):
    tries = attempts(spark, sf_dir)
    return judge.totals(judge.judge(tries), tries)


def attempts(spark, sf_dir):
    """Benchmark passages as expected words; heard is the next passage's start and end
    around the passage's middle."""
    words = F.split(fx.scripted(F.col("text")), " ")
    rows = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("attempt_id"), words.alias("expected"))
    heard = F.concat(F.slice("expected", 3, 12), F.slice("expected", 16, 40))
    return rows.select("attempt_id", "expected", heard.alias("heard"), F.lit(None).cast("array<double>").alias("confidences"), F.array(F.lit(5)).alias("boundaries"))


@query()
def stitched_transcripts(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "conversations")
    return sequences.stitched(rows.select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("chunk_no"), "text"))


LIVE = f"""WITH RECURSIVE {POINTS}, b AS (SELECT clip_id, seq, t, rms, freq, row_number() OVER (PARTITION BY clip_id ORDER BY seq) AS i FROM pts),
f AS (SELECT clip_id, i, seq, t, rms, freq, CAST(rms AS DOUBLE) AS peak FROM b WHERE i = 1
      UNION ALL SELECT b.clip_id, b.i, b.seq, b.t, b.rms, b.freq, greatest(0.985 * f.peak, b.rms) FROM f JOIN b ON b.clip_id = f.clip_id AND b.i = f.i + 1)
SELECT clip_id, seq, {s6('peak + 1.23456789e-8')} AS peak, rms >= peak * 0.28 AND freq > 0 AS voiced FROM f"""


def live_blocks(spark, sf_dir):
    return fx.pitch_points(spark, sf_dir).select("clip_id", "seq", "t", "rms", "freq", F.lit(1.0).alias("clarity"))


@query(LIVE)
def live_gate(spark, sf_dir):
    return live.gated_batch(live_blocks(spark, sf_dir)).select("clip_id", "seq", r6(F.col("peak") + 1.23456789e-8).alias("peak"), "voiced")


@contextlib.contextmanager
def rocksdb_state(spark):
    """The state store that stateful processors need, while a stream runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query(LIVE)
def live_gate_stream(spark, sf_dir):
    """The same by Structured Streaming over the blocks as files."""
    base = scratch(spark, "live")
    with rocksdb_state(spark):
        live_blocks(spark, sf_dir).write.parquet(f"{base}/in")
        gated = live.gated_stream(live.block_stream(spark, f"{base}/in", 1000))
        run = gated.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(live.GATED).parquet(f"{base}/out").select("clip_id", "seq", r6(F.col("peak") + 1.23456789e-8).alias("peak"), "voiced")
