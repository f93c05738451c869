"""I-Match fingerprints with several randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band of shares of all
documents (so of inverse document frequencies).  Each of the ``GROUPS`` * ``LEVELS``
randomised lexicon subsets takes terms by their hash: on the first level the subsets
part the lexicon, on each further level they part a ``THIN``-th of the level before, so
that short and long texts both meet subsets in which they have few terms.  A text's
component for a subset is the hash of its sorted distinct terms there; the fingerprint
is the components in order.  Two fingerprints are alike to the share of equal
components among those that either text fills.

The lexicon is the whole band.  A term of it is in at least ``LOW`` of the documents, so
there are at most (mean distinct terms of a document) / LOW whatever the corpus: that
bound is why it may be a literal set; nothing is joined with it.

To set each document beside the next one (descending doc_id), documents are dealt to
buckets of doc_id ranges: quantile cells by a decision tree over at most ``CELLS``
bounds, each cut into equal widths of about ``BUCKET_ROWS`` rows; a doc_id (or null) that
takes up several quantiles is cut by text hash into as many buckets.  A bucket's first
document is also sent, as a guest, to the bucket before it.  Everything after that one
exchange of texts (neighbours, terms, components, likeness) stays in the bucket.

Defined cases: null text is empty text; null doc_ids come after all others, equal
ones are ordered by text hash, descending (rows that repeat both meet in one bucket); the
only document follows itself; a text without a lexicon term is fingerprinted by the md5 of
all its terms and by the components of them all, and is compared by these with other such
texts only; an empty table gives no rows; only ``doc_id`` and ``text`` are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, ascii_lower, text_of, written

LOW, HIGH = 0.001, 0.2
GROUPS, LEVELS, THIN = 16, 3, 8
SUBSETS = GROUPS * LEVELS
CELLS = 256
BUCKET_ROWS = 4000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CODE_BITS = 26
NULL_KEY = -(1 << 63)
#: Marks the fingerprint of a text without a lexicon term.
BARE = "all:"


def words_of(text: Column) -> Column:
    """Terms of a text in order, perhaps with an empty one at either end."""
    return F.split(ascii_lower(text), SEPARATORS)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Term hashes of the lexicon, in order.  Frequencies are counted over all documents,
    with a map-side combine; only the band reaches the driver."""
    n = docs.count()
    each = docs.filter("text is not null").select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("w")).filter("w <> ''")
    found = each.groupBy(F.xxhash64("w").alias("term")).count()
    band = found.filter((F.col("count") >= max(2.0, low * n)) & (F.col("count") <= max(2.0, high * n)))
    return sorted(r["term"] for r in band.select("term").collect())


def kept_terms(name: str, lex: list[int]) -> Column:
    """Distinct lexicon terms of the words in column ``name``.  The set is given as SQL
    text: one call instead of one for each of its literals."""
    if not lex:
        return F.array().cast("array<string>")
    return F.expr(f"array_distinct(filter({name}, w -> w <> '' and xxhash64(w) in ({','.join(f'{h}L' for h in lex)})))")


def codes_of(terms: Column) -> Column:
    """Sorted distinct codes (subset, term) of distinct terms."""

    def levels(w):
        h, low = F.xxhash64(w, F.lit(7)), F.pmod(F.xxhash64(w, F.lit(11)), F.lit(1 << CODE_BITS))
        out = []
        for level in range(LEVELS):
            subset = F.lit(level * GROUPS) + F.pmod(F.shiftright(h, 8 * level), F.lit(GROUPS))
            code = F.shiftleft(subset.cast("long"), CODE_BITS) + low
            out.append(code if not level else F.when(F.pmod(F.shiftright(h, 40), F.lit(THIN**level)) == 0, code))
        return F.array(*out)

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(terms, levels)))))


def cell_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below or equal to ``key``, by a balanced decision tree."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, bucket of every row; buckets rise with the key, a struct of
    doc_id and text hash."""
    number = F.coalesce(F.col("doc_id"), F.lit(NULL_KEY))
    rows = docs.select("doc_id", text_of().alias("text"), number.alias("number"))
    n = rows.count()
    cells = max(1, min(CELLS, n // BUCKET_ROWS))
    shares = [i / cells for i in range(1, cells)]
    found = rows.select(F.percentile_approx("number", shares, 10_000).alias("q")).first()["q"] if shares and n else []
    bounds = sorted(set(found or []))
    cell = cell_of(F.col("number"), bounds).cast("long")
    subs = max(1, n // (BUCKET_ROWS * max(1, len(bounds) + 1)))
    edges = F.array(*[F.lit(b) for b in [NULL_KEY, *bounds, (1 << 63) - 1]])
    lo, hi = F.element_at(edges, (cell + 1).cast("int")).cast("double"), F.element_at(edges, (cell + 2).cast("int")).cast("double")
    sub = F.least(F.floor((F.col("number").cast("double") - lo) / (hi - lo + 1) * subs), F.lit(subs - 1))
    bucket = cell * subs + sub if subs > 1 else cell
    # a number that is a bound several times is the least of its cell: its parts come first
    heavy = {b: k * subs for b, k in Counter(found or []).items() if k > 1}
    h = F.xxhash64("text")
    if heavy:
        most = max(heavy.values())
        share = h.cast("double") / F.lit(2.0**64) + 0.5
        part = F.lit(most)
        for b, k in heavy.items():
            part = F.when(F.col("number") == b, F.least(F.floor(share * k), F.lit(k - 1))).otherwise(part)
        bucket = bucket * (most + 1) + part
    return rows.select("doc_id", "text", F.struct("number", h.alias("h")).alias("key"), bucket.cast("long").alias("bucket"))


def guests(rows: DataFrame) -> DataFrame:
    """(bucket, top, host): the largest key of each bucket, and the bucket whose last
    document is followed by that key's document."""
    tops = written(rows.groupBy("bucket").agg(F.max("key").alias("top")), "bucket-tops")
    per = tops.count() // 1000 + 1  # buckets are ordered in runs of about a thousand
    low, high = tops.agg(F.min("bucket"), F.max("bucket")).first()
    width = ((high or 0) - (low or 0)) // 1000 + 1 if per > 1 else (high or 0) - (low or 0) + 1
    inside = tops.withColumn("run", F.floor((F.col("bucket") - F.lit(low or 0)) / F.lit(width)))
    firsts = {r["run"]: r["b"] for r in inside.groupBy("run").agg(F.min("bucket").alias("b")).collect()}
    order = sorted(firsts)
    after = {r: firsts[order[(i + 1) % len(order)]] for i, r in enumerate(order)}
    step = F.lit(None).cast("long")
    for r, b in after.items():
        step = F.when(F.col("run") == r, F.lit(b)).otherwise(step)
    following = F.lead("bucket").over(W.partitionBy("run").orderBy("bucket"))
    return inside.select("bucket", "top", F.coalesce(following, step).alias("host"))


def beside_next(docs: DataFrame) -> DataFrame:
    """bucket, guest, rn, doc_id, text, next_text; in a bucket rows are numbered in
    descending order, guests last."""
    rows = bucketed(docs)
    side = guests(rows)
    small = side.count() <= BROADCAST_IDS
    met = rows.join(F.broadcast(side) if small else side, "bucket")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    sent = met.withColumn("at", F.explode(F.when(F.col("key") == F.col("top"), F.array(own, guest)).otherwise(F.array(own))))
    placed = sent.select(F.col("at.bucket").alias("bucket"), F.col("at.guest").alias("guest"), "key", "doc_id", "text")
    w = W.partitionBy("bucket").orderBy("guest", F.desc("key"))
    return placed.select("bucket", "guest", F.row_number().over(w).alias("rn"), "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited_text() -> Column:
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))


def components_of(codes: Column) -> Column:
    """An item for each subset that the sorted codes fill, in order: two digits for the
    subset, then 32 bits of the hash of its terms, all in hexadecimal."""
    start = F.struct(F.lit(-1).cast("long").alias("subset"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<string>").alias("items"))

    def closed(acc):
        name = F.lpad(F.lower(F.hex(acc["subset"])), 2, "0")
        item = F.concat(name, F.lpad(F.lower(F.hex(acc["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
        return F.when(acc["subset"] < 0, acc["items"]).otherwise(F.concat(acc["items"], F.array(item)))

    def step(acc, code):
        subset = F.shiftright(code, CODE_BITS)
        same = F.struct(subset.alias("subset"), F.xxhash64(acc["hash"], code).alias("hash"), acc["items"].alias("items"))
        fresh = F.struct(subset.alias("subset"), F.xxhash64(code).alias("hash"), closed(acc).alias("items"))
        return F.when(subset == acc["subset"], same).otherwise(fresh)

    return F.aggregate(codes, start, step, closed)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that either fills; equal fingerprints are
    alike to 1, those of a text with and one without a lexicon term to 0."""
    x, y = (F.filter(F.split(c, "-"), lambda s: ~F.startswith(s, F.lit(BARE))) for c in (a, b))
    names = lambda c: F.transform(c, lambda s: F.substr(s, F.lit(1), F.lit(2)))
    filled = F.size(F.array_union(names(x), names(y)))
    share = F.when(filled > 0, F.size(F.array_intersect(x, y)) / filled).otherwise(0.0)
    bare = F.startswith(a, F.lit(BARE)) != F.startswith(b, F.lit(BARE))
    return F.when(a == b, 1.0).when(bare, 0.0).otherwise(share)


def fingerprint(words: Column, kept: Column, codes: Column) -> Column:
    """The printed fingerprint of a text with these words, lexicon terms and codes."""
    whole = F.concat(F.lit(BARE), F.md5(F.array_join(F.array_sort(F.array_distinct(words)), " ").cast("binary")))
    items = components_of(codes)
    return F.array_join(F.when(F.size(kept) > 0, items).otherwise(F.concat(F.array(whole), items)), "-")


def fingerprint_pairs(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    lex = lexicon(docs, low, high)
    coded = beside_next(docs).withColumn("edited", edited_text())
    for side, text in (("own", "text"), ("edited", "edited")):
        coded = coded.withColumn(f"{side}_words", words_of(F.col(text))).withColumn(f"{side}_kept", kept_terms(f"{side}_words", lex))
        every = F.array_distinct(F.filter(f"{side}_words", lambda w: w != ""))
        coded = coded.withColumn(f"{side}_codes", codes_of(F.when(F.size(f"{side}_kept") > 0, F.col(f"{side}_kept")).otherwise(every)))
    printed_of = lambda side: fingerprint(F.col(f"{side}_words"), F.col(f"{side}_kept"), F.col(f"{side}_codes"))
    printed = coded.select(
        "bucket", "guest", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed_of("own").alias("fingerprint"), printed_of("edited").alias("edited_fingerprint"),
    )
    w = W.partitionBy("bucket").orderBy("rn")
    out = printed.withColumn("next_fp", F.lead("fingerprint").over(w)).filter("guest = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )
