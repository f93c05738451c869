"""Queries of the corpus operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, filter_audit, imatch, langid, licenses, line_dedup, ngram_join, packing, pii, piece_codec, token_alignment, toxicity, warc
from .common import documents, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(documents(spark, sf_dir))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_pairs(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(documents(spark, sf_dir))
    return found.selectExpr("doc_id", "keep_id", "group_size", "kept", "digest AS text_sha256")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_history(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_piece_codec": op6_piece_codec,
    "op7_licenses": op7_licenses,
    "op8_imatch": op8_imatch,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_token_alignment": op11_token_alignment,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

#: Lower-cases A-Z only, in DuckDB.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWERED}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op10_ngram_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS gs FROM w),
        s AS (SELECT doc_id, unnest(gs) AS gram, len(gs) AS n FROM g),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id, doc_id AS other FROM g UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a)
        SELECT r.doc_id, any_value(CAST(len(gs) AS BIGINT)) AS n_shingles, min(other) AS component_id
        FROM r JOIN g ON g.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
        d AS (SELECT page_id, strlen(x) AS n, sha1(x) AS h, min(page_id) OVER (PARTITION BY x) AS first FROM p),
        v AS (SELECT *, list_transform(string_split(h, ''), lambda c: instr('0123456789abcdef', c) - 1) AS g FROM d),
        q AS (SELECT *, list_transform(range(0, 8), lambda i: ((((g[5 * i + 1] * 16 + g[5 * i + 2]) * 16 + g[5 * i + 3]) * 16
                    + g[5 * i + 4]) * 16 + g[5 * i + 5])::BIGINT) AS parts,
                    first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM v)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(parts, lambda b: array_to_string(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((b >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
        FROM q""",
    "op13_filter_audit": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                   CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS failed
            FROM t LEFT JOIN marks USING (doc_id)),
        c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, failed),
        o AS (SELECT '' AS filter_order UNION ALL
              SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
        s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS letter, filter_order[1:i - 1] AS earlier
              FROM o, (SELECT unnest(range(1, 6)) AS i) WHERE length(filter_order) = 5),
        m AS (SELECT s.*, c.*, contains(failed, letter) AS hit,
                     earlier <> '' AND translate(failed, earlier, '') <> failed AS gone FROM s, c),
        g AS (
            SELECT part, filter_order, step, letter,
                   CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
                   CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
                   CAST(coalesce(sum(n) FILTER (failed = letter), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
                   CAST(coalesce(sum(bad) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
            FROM m GROUP BY part, filter_order, step, letter)
        SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g""",
}
