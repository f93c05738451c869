"""Interaction audit of a set of filters: what each filter removes in every order.

Every document gets a mask with one bit for each filter that it fails.  All that any
order of the filters does follows from the number of documents with each mask: with k
filters, a part of the corpus is 2^k counts.  A subset-zeta transform (k passes over
these counts, each adding the neighbour without one bit) turns them into the survivors
of every filter subset.  A step of an order is then a difference between two
neighbouring subsets, and a filter's Shapley sum is a weighted sum of such differences.
The same transform runs over the counts of labelled documents.

Scale: texts are read once and leave a digest and a mask.  The filter that looks for
earlier equal texts needs the smallest doc_id of each digest: a partial aggregate, so
a text that a third of all rows hold sends one row a task.  Rows then meet these
firsts by (digest, doc_id) and the labels by doc_id, after rows that repeat everything
were counted into one; a hot text is split by its doc_ids, and rows without a doc_id
need no join.  Counts are pre-aggregated by (part, mask); what follows works on one row of
3 * 2^k numbers for each part, inside the row.

Defined cases: a null text is empty; a null part is the empty string; a null doc_id has
no earlier text, is no earlier text, and has no labels; rows that repeat a doc_id and its text
are copies of none of each other; repeated labels of a document count once, and it is
good (toxic) when one of them says so; an empty table has no part and gives no
rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, text_of, written

MEASURES = ("n", "good", "toxic")


def text_filters(text: Column) -> list[Column]:
    """Failure conditions of the filters that need nothing but a document's own text:
    short, repetitive, upper-case, markup.  They stand for A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def masked(failures: list[Column]) -> Column:
    """Bit i is set when condition i holds."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures)), F.lit(0)).cast("int")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` (doc_id, digest, mask, ...) with ``bit`` added to the mask of those whose
    digest a smaller doc_id has; the digest goes."""
    firsts = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("__first", F.lit(True))
    known = rows.filter("doc_id is not null").join(firsts, ["digest", "doc_id"], "left")
    known = known.withColumn("mask", F.when(F.col("__first"), F.col("mask")).otherwise(F.col("mask") + F.lit(bit))).drop("__first")
    return known.unionByName(rows.filter("doc_id is null")).drop("digest")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with 0/1 columns good and toxic."""
    says = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))]
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*says)
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.filter("doc_id is null"), allowMissingColumns=True)
    return known.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def mask_counts(rows: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones for each part and mask; ``n`` rows of a kind
    come as one."""
    sums = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in MEASURES[1:])]
    return rows.groupBy("part", "mask").agg(*sums)


def survivors(counts: DataFrame, k: int) -> DataFrame:
    """One row a part with an array for each measure: element s is the number of
    documents whose failures all lie in the set s, that is, the survivors of the filters
    outside of s."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("held"))

    def zeta(name: str) -> Column:
        size = F.sequence(F.lit(0), F.lit((1 << k) - 1))
        start = F.transform(size, lambda m: F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + F.when(x["mask"] == m, x[name]).otherwise(F.lit(0))))
        bits = F.array(*[F.lit(1 << i) for i in range(k)])
        return F.aggregate(bits, start, lambda f, b: F.transform(f, lambda x, i: F.when(i.bitwiseAND(b) != 0, x + F.get(f, i.bitwiseXOR(b))).otherwise(x)))

    return held.select("part", *(zeta(m).alias(m) for m in MEASURES))


def order_steps(found: DataFrame, k: int) -> DataFrame:
    """Every step of every order of the filters, for each row of ``survivors``."""
    names = [chr(ord("A") + i) for i in range(k)]
    full = (1 << k) - 1
    orders = found.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    at = [F.instr("filter_order", c) for c in names]
    bit = sum((F.when(a == F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, a in enumerate(at)), F.lit(0))
    before = sum((F.when(a < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, a in enumerate(at)), F.lit(0))
    steps = steps.withColumns({"bit": bit.cast("int"), "open": (F.lit(full) - before).cast("int")})

    def lost(measure: str, still: Column) -> Column:
        """Survivors of the filters outside of ``still`` that the step's filter removes."""
        return F.get(measure, still) - F.get(measure, still.bitwiseXOR(F.col("bit")))

    removed = lost("n", F.col("open"))
    orders_with = F.array(*[F.lit(math.factorial(k - 1 - j) * math.factorial(j)) for j in range(k)])
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("bit")) != 0), F.lit(0).cast("long"),
        lambda total, s: total + lost("n", s) * F.get(orders_with, F.bit_count(s) - 1),
    )
    return steps.select(
        "part", "filter_order", "step", F.get("n", F.col("open").bitwiseXOR(F.col("bit"))).alias("kept"), removed.alias("removed"),
        (lost("n", F.lit(full)) - removed).alias("redundant"), lost("n", F.col("bit")).alias("unique_fails"),
        lost("good", F.col("open")).alias("good_lost"), lost("toxic", F.col("open")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of filters A to D of ``text_filters`` and E, equal to an earlier text, of
    ``docs`` (doc_id, text, ``part``) and ``labels`` (doc_id, quality, toxic)."""
    text = text_of()
    own = text_filters(text)
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), digest.alias("digest"), masked(own).alias("mask"))
    rows = written(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "filter-masks")
    counts = written(mask_counts(with_labels(with_copies(rows, 1 << len(own)), labels)), "mask-counts")
    drop_table(rows)
    return order_steps(survivors(counts, len(own) + 1), len(own) + 1)
