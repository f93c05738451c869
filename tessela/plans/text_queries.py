"""Registered queries of text, similarity, retrieval and sequence operators, each with its
DuckDB SQL.  Texts are reduced to ASCII where the SQL side counts bytes.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import retrieval, sequences
from ..sources import assets
from . import fixtures as fx
from .queries import SCRIPTED, digest, query, r6, s6

ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"


def ascii_turns(spark, sf_dir):
    """conv_id, turn, a (ASCII text), b (the next turn's)."""
    rows = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("a"))
    return rows.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")


TURNS = f"""t AS (SELECT conv_id, turn, {ASCII_SQL} AS a FROM conversations),
    p AS (SELECT * FROM (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t) WHERE b IS NOT NULL)"""


#: Characters that a byte-level vocabulary writes as themselves, and the space.
PRINTED, PRINTED_SQL = r"[^\x20-\x7E]", r"regexp_replace(text, '[^\x20-\x7E]', '?', 'g')"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE (length({a}) + length({b}) - levenshtein({a}, {b})) / (length({a}) + length({b})) END)"


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, turn, substr(a, 1, 12) AS s, substr(b, 1, 60) AS l FROM p),
    o AS (SELECT conv_id, turn, CASE WHEN length(s) <= length(l) THEN s ELSE l END AS s, CASE WHEN length(s) <= length(l) THEN l ELSE s END AS l FROM c)
    SELECT conv_id, turn, {s6(f"list_max(list_transform(range(1, length(l) - length(s) + 2), lambda i: {ratio_sql('s', 'substr(l, i, length(s))')}))")} AS best FROM o WHERE length(s) > 0""")
def window_ratios(spark, sf_dir):
    rows = ascii_turns(spark, sf_dir).select("conv_id", "turn", F.substring("a", 1, 12).alias("s"), F.substring("b", 1, 60).alias("l"))
    rows = rows.filter((F.length("s") > 0) & (F.length("l") > 0))
    return rows.select("conv_id", "turn", r6(similarity.partial_ratio(F.col("s"), F.col("l"))).alias("best"))


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, turn, string_split(substr(a, 1, 120), ' ') AS x, string_split(substr(b, 1, 120), ' ') AS y FROM p),
    k AS (SELECT *, greatest(1, least(len(x) // 2, 4)) AS most FROM c WHERE len(x) >= 2 AND len(y) >= 2),
    e AS (SELECT conv_id, turn, array_to_string(list_slice(x, k + 1, len(x)), ' ') AS s, array_to_string(list_slice(y, 1, len(x) - k), ' ') AS v
          FROM (SELECT *, unnest(range(1, most + 1)) AS k FROM k))
    SELECT conv_id, turn, {s6(f"greatest(0.0, max({ratio_sql('s', 'v')}))")} AS score FROM e GROUP BY conv_id, turn""")
def continued_texts(spark, sf_dir):
    rows = ascii_turns(spark, sf_dir).select("conv_id", "turn", F.substring("a", 1, 120).alias("s"), F.substring("b", 1, 120).alias("v"))
    rows = rows.filter((F.size(F.split("s", " ")) >= 2) & (F.size(F.split("v", " ")) >= 2))
    return rows.select("conv_id", "turn", r6(similarity.suffix_prefix_score(F.col("s"), F.col("v"))).alias("score"))


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, turn, replace(substr(a, 1, 10), ' ', '') AS q, replace(b, ' ', '') AS v, string_split(trim(b), ' ')[1] AS w FROM p)
    SELECT conv_id, turn, {s6(f"CASE WHEN v = '' THEN 0.0 ELSE greatest({ratio_sql('q', 'substr(v, 1, length(q) + 6)')}, CASE WHEN w <> '' THEN {ratio_sql('q', 'w')} ELSE 0.0 END) END")} AS boost FROM c""")
def short_boosts(spark, sf_dir):
    rows = ascii_turns(spark, sf_dir).select(
        "conv_id", "turn", text.no_spaces(F.substring("a", 1, 10)).alias("q"), text.no_spaces(F.col("b")).alias("v"), F.get(F.split(F.trim("b"), " "), F.lit(0)).alias("w")
    )
    return rows.select("conv_id", "turn", r6(similarity.short_query_boost(F.col("q"), F.col("v"), F.col("w"))).alias("boost"))


_PAIRS = ", ".join(f"'{x}'" for c in similarity.CONFUSIONS for x in (c, c[::-1]))


@query(f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split({SCRIPTED}, ' ')) AS word FROM benchmark) WHERE length(word) BETWEEN 2 AND 8),
    v AS (SELECT word AS a, translate(word, 'قصضطظهعحغثذ', 'كسدتذةاهخسز') AS b FROM w UNION ALL SELECT word, reverse(word) FROM w),
    d AS (SELECT a, b, list_filter(list_transform(range(1, length(a) + 1), lambda i: substr(a, i, 1) || substr(b, i, 1)), lambda p: substr(p, 1, 1) <> substr(p, 2, 1)) AS ps FROM v)
    SELECT md5(a) AS a, md5(b) AS b, coalesce(len(ps) = 1 AND list_contains([{_PAIRS}], ps[1]), false) AS confused FROM d""")
def confused_words(spark, sf_dir):
    words = fx.load(spark, sf_dir, "benchmark").select(F.explode(F.split(fx.scripted(F.col("text")), " ")).alias("word")).filter("length(word) between 2 and 8").distinct()
    swapped = words.select(F.col("word").alias("a"), F.translate("word", "قصضطظهعحغثذ", "كسدتذةاهخسز").alias("b"))
    both = swapped.unionByName(words.select(F.col("word").alias("a"), F.reverse("word").alias("b")))
    return both.select(digest(F.col("a")).alias("a"), digest(F.col("b")).alias("b"), similarity.is_confusion(F.col("a"), F.col("b")).alias("confused"))


LEAD = ["zz", "yy"]


@query(r"""WITH c AS (SELECT conv_id AS grp, turn AS pos, trim(regexp_replace(CASE WHEN conv_id % 2 = 0 THEN 'zz yy ' ELSE '' END || regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[\t-\r ]+', ' ', 'g')) AS joined FROM conversations)
    SELECT grp, pos, md5(joined) AS joined, md5(CASE WHEN pos = 1 AND grp NOT IN (1, 9) AND starts_with(joined, 'zz yy ') THEN substr(joined, 7) END) AS short FROM c""")
def preamble_forms(spark, sf_dir):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    rows = fx.load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.concat(F.when(F.col("conv_id") % 2 == 0, "zz yy ").otherwise(""), plain).alias("text")
    )
    return retrieval.adapt_corpus(rows, LEAD).select("grp", "pos", digest(F.col("joined")).alias("joined"), digest(F.col("short")).alias("short"))


@query("""WITH m AS (SELECT DISTINCT conv_id AS grp FROM conversations)
    SELECT m.grp AS query_id, md5(string_agg(text, ' ' ORDER BY turn)) AS display FROM m JOIN conversations c ON c.conv_id = m.grp AND c.turn BETWEEN 2 AND 4 GROUP BY m.grp""")
def span_displays(spark, sf_dir):
    c = fx.passages(spark, sf_dir)
    spans = c.select(F.col("grp").alias("query_id"), "grp", F.lit(2).cast("long").alias("pos"), F.lit(4).cast("long").alias("pos_end")).distinct()
    return retrieval.span_display(spans, c).filter("display is not null").select("query_id", digest(F.col("display")).alias("display"))


@query("""SELECT l_orderkey AS clip_id, l_linenumber AS ord, l_discount AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def best_hypotheses(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("ord"), F.col("l_discount").alias("score"))
    return retrieval.best_of_hypotheses(rows)


@query("""SELECT l_orderkey, l_linenumber,
    (l_discount * 10 >= 0.8 OR (l_discount * 10 >= 0.62 AND l_tax * 12 >= 0.75 AND l_tax * 3 >= 0.15 AND l_quantity >= 12)) AND l_linenumber + 2 >= 5 AS shown FROM lineitem""")
def trusted_matches(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"), (F.col("l_tax") * 12).alias("frag_fit"), (F.col("l_tax") * 3).alias("fit_margin"), "l_quantity"
    )
    return rows.select("l_orderkey", "l_linenumber", retrieval.trusted(F.col("l_quantity"), F.col("l_linenumber") + 2).alias("shown"))


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\t-\r ]+'), lambda w: w <> '') AS ws FROM conversations),
    e AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM s),
    x AS (SELECT conv_id, turn, word, i, turn * 10.0 + 5.0 * i / n AS a, turn * 10.0 + 5.0 * (i + 1) / n AS b FROM e)
    SELECT conv_id AS clip_id, CAST(turn * 10.0 + 2.3 AS DOUBLE) AS t, md5(word) AS word FROM x WHERE a <= turn * 10.0 + 2.3 AND turn * 10.0 + 2.3 < b""")
def active_words(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "conversations")
    seg = rows.select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("seg"), (F.col("turn") * 10.0).alias("t_start"), (F.col("turn") * 10.0 + 5.0).alias("t_end"), "text")
    timed = sequences.segment_words(seg, F.filter(F.split("text", r"[\t-\r ]+"), lambda w: w != ""))
    heads = rows.select(F.col("conv_id").alias("clip_id"), (F.col("turn") * 10.0 + 2.3).alias("t"))
    return sequences.active_word(timed, heads).select("clip_id", "t", digest(F.col("word")).alias("word"))


@query(rf"""WITH w AS (SELECT item_id, list_filter(string_split({ASCII_SQL}, ' '), lambda w: w <> '') AS ws FROM benchmark),
    n AS (SELECT item_id, list_transform(ws, lambda w: CASE WHEN length(w) > 3 THEN 2 ELSE 1 END) AS pieces FROM w)
    SELECT item_id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: CAST(list_sum(list_slice(pieces, 1, i)) AS INTEGER)), ',') AS pieces,
           array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: CAST(list_sum(list_slice(pieces, 1, i)) + i - 1 AS INTEGER)), ',') AS bars FROM n""")
def token_word_ends(spark, sf_dir):
    """Words are one token, or two if they have more than three letters."""
    ws = F.filter(F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), " "), lambda w: w != "")
    cut = lambda lead: F.transform(ws, lambda w: F.when(F.length(w) > 3, F.array(F.concat(F.lit(lead), F.substring(w, 1, 3)), F.substring(w, 4, 1000))).otherwise(F.array(F.concat(F.lit(lead), w))))
    barred = F.flatten(F.transform(cut(""), lambda ts, i: F.when(i > 0, F.concat(F.array(F.lit("|")), ts)).otherwise(ts)))
    shown = lambda ends: F.array_join(F.transform(ends, lambda e: e.cast("string")), ",")
    rows = fx.load(spark, sf_dir, "benchmark").select("item_id", F.flatten(cut(text.WORD_MARK)).alias("p"), barred.alias("b"))
    return rows.select("item_id", shown(text.piece_word_ends(F.col("p"))).alias("pieces"), shown(text.bar_word_ends(F.col("b"))).alias("bars"))


@query("""WITH v AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) - 1 AS id FROM embeddings),
    k AS (SELECT *, lag(id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM v),
    x AS (SELECT label, string_agg(CASE WHEN id % 5 = 0 THEN ' ' ELSE '' END || chr(CAST(97 + id % 26 AS INTEGER)), '' ORDER BY vec_id) FILTER (WHERE id <> coalesce(before, -1) AND id <> 63) AS s FROM k GROUP BY label)
    SELECT CAST(label AS BIGINT) AS clip_id, trim(coalesce(s, '')) AS text FROM x""")
def decoded_texts(spark, sf_dir):
    letter = F.chr(F.lit(97) + F.col("id") % 26)
    vocab = spark.range(64).select(F.col("id").cast("int").alias("id"), F.concat(F.when(F.col("id") % 5 == 0, text.WORD_MARK).otherwise(""), letter).alias("token"))
    return sequences.ids_to_text(sequences.greedy_ids(fx.frames(spark, sf_dir), 63), vocab)


@query(rf"SELECT item_id, md5({PRINTED_SQL}) AS text FROM benchmark")
def byte_texts(spark, sf_dir):
    """Byte-level tokens: a space is written as its stand-in and opens a token."""
    stand_in = next(k for k, v in sequences.byte_alphabet().items() if v == 32)
    plain = F.regexp_replace("text", PRINTED, "?")
    tokens = F.concat(F.array(F.lit("<|start|>")), F.split(F.replace(plain, F.lit(" "), F.lit(f"\x01{stand_in}")), "\x01"))
    return fx.load(spark, sf_dir, "benchmark").select("item_id", digest(sequences.byte_text(tokens)).alias("text"))


@query("""WITH c AS (SELECT conv_id AS grp, turn AS pos, length(text) % 25 AS n FROM conversations) SELECT grp, pos, CAST(n AS INTEGER) AS n_ids FROM c WHERE n BETWEEN 1 AND 15""")
def short_passages(spark, sf_dir):
    c = fx.passages(spark, sf_dir)
    n = (F.length("joined") % 25).cast("int")
    tokens = c.select("grp", "pos", F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("ids"))
    return retrieval.short_passages(c, tokens).select("grp", "pos", F.size("ids").alias("n_ids"))


@query("""SELECT conv_id AS grp, turn AS pos, CASE WHEN turn % 5 = 0 THEN 'no token ids' ELSE 'decoded text differs' END AS problem FROM conversations
    WHERE turn % 5 = 0 OR (turn % 3 = 0 AND text <> '')""")
def round_trip_problems(spark, sf_dir):
    c = fx.passages(spark, sf_dir)
    told = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("x"), "joined")).otherwise(F.col("joined"))
    decoded = c.filter("pos % 5 <> 0").select("grp", "pos", F.array(F.lit(1)).alias("ids"), told.alias("text"))
    return assets.decode_mismatches(decoded, c)


@query(rf"""WITH w AS (SELECT conv_id, turn, list_filter(string_split({PRINTED_SQL}, ' '), lambda w: w <> '') AS ws FROM conversations),
    x AS (SELECT conv_id, turn, array_to_string(list_slice(ws, 1, 6), ' ') AS s FROM w)
    SELECT conv_id AS clip_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seg, md5(s) AS text, CAST(turn * 2.0 AS DOUBLE) AS t_start,
           CAST(coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) * 2.0, least(30.0, turn * 2.0 + 5)) AS DOUBLE) AS t_end FROM x WHERE s <> ''""")
def stamped_segments(spark, sf_dir):
    """A time stamp before the first six words of every turn."""
    ws = F.slice(F.filter(F.split(F.regexp_replace("text", PRINTED, "?"), " "), lambda w: w != ""), 1, 6)
    stand_in = next(k for k, v in sequences.byte_alphabet().items() if v == 32)
    rows = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("ws")).filter("size(ws) > 0")
    stamp = F.struct(F.lit("").alias("token"), (F.col("turn") * 2.0).alias("seconds"))
    word = F.transform("ws", lambda w: F.struct(F.concat(F.lit(stand_in), w).alias("token"), F.lit(None).cast("double").alias("seconds")))
    each = rows.select("conv_id", "turn", F.posexplode(F.concat(F.array(stamp), word)).alias("j", "x"))
    tokens = each.select(F.col("conv_id").alias("clip_id"), (F.col("turn") * 1000 + F.col("j")).alias("i"), "x.token", "x.seconds")
    got = sequences.stamped_segments(tokens.withColumn("t_offset", F.lit(0.0)))
    return got.select("clip_id", "seg", digest(F.col("text")).alias("text"), "t_start", "t_end")
