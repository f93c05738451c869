"""Finding the passage, or span of passages, that a query text comes from.

The corpus is (grp, pos, display, joined, short): ``short`` is the passage without its
preamble or null.  Queries are (query_id, text).  Both may be large: queries meet
passages by an n-gram equi-join, ranked per query with bounded top-k windows; only
queries too short to block on, or with few hits, meet the whole corpus.  Order among
equal scores always follows an explicit ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import round4
from ..functions.similarity import fragment_score, gram_sets, packed_grams, ratio, short_query_boost, suffix_prefix_score
from ..functions.text import no_spaces, normalise, without_preamble, words
from ..scratch import written
from .nearest import nearest

#: Limits, weights and thresholds of the stages.
TRIGRAM_WEIGHT, FEWEST_HITS, POOL, SHORTLIST = 0.48, 80, 950, 320
TOP_K, SINGLES, TOP_GROUPS, LONGEST_SPAN, LONGEST_PREFIX = 18, 32, 32, 6, 7
BLEND, SHORT_CHARS, FRAGMENT_CHARS, FRAGMENT_SHARE = 0.82, 10, 8, 0.8
PREFIX_CHARS, PREFIX_SCORE, PREFIX_MARGIN = 34, 0.5, -0.02
GLOBAL_CHARS, GLOBAL_SCORE, GLOBAL_MARGIN = 80, 0.54, -0.015
RESCUED, UNSURE, COLLAPSE_LONGEST, COLLAPSE_SCORE = 12, 0.62, 115, 0.5
OPENING_LONGEST, OPENING_CHARS, OPENING_SCORE, OPENING_MARGIN, OPENING_FIT = 10, 8, 0.48, -0.18, 0.72
TRUSTED, TRUST_FLOOR, TRUST_FIT, TRUST_FIT_MARGIN, TRUST_CHARS, TRUST_LETTERS = 0.8, 0.62, 0.75, 0.15, 12, 5
HINT_BONUS = [0.22, 0.12, 0.06]

MATCH = ["query_id", "grp", "pos", "pos_end", "joined", "score", "raw_score"]


def adapt_corpus(passages: DataFrame, preamble: list[str] | None = None) -> DataFrame:
    """(grp, pos, text) to the corpus form: normalised words, and the form without
    preamble."""
    joined = normalise(F.col("text"))
    rows = passages.select("grp", "pos", F.col("text").alias("display"), joined.alias("joined"))
    return rows.withColumn("short", without_preamble(F.col("joined"), F.col("grp"), F.col("pos"), preamble))


def top(rows: DataFrame, key: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key in the given order, numbered from 0."""
    ranked = rows.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1)
    return ranked.filter(F.col(name) < k)


#: Gram rows of queries (16 bytes each) up to which they are sent to the targets.
BROADCAST_GRAMS = 2_000_000


def gram_hits(queries: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """query_id, key, overlap > 0: distinct shared bigrams plus weighted trigrams.  The
    queries' grams are sent to the targets if a count shows them few, else both are
    shuffled."""
    q = queries.select("query_id", F.explode(gram_sets("ns")).alias("gram"))
    few = (queries.agg(F.sum(2 * F.length("ns"))).first()[0] or 0) <= BROADCAST_GRAMS
    # grams are counted as integers so that equal overlaps compare equal
    if few:
        each = counted_hits(q, targets.select(*key, "ns"), key)
    else:
        t = targets.select(*key, F.explode(gram_sets("ns")).alias("gram"))
        each = t.join(q, "gram").select("query_id", *key, (F.col("gram") < 0).cast("int").alias("two"), (F.col("gram") >= 0).cast("int").alias("three"))
    met = each.groupBy("query_id", *key).agg(F.sum("two").alias("two"), F.sum("three").alias("three"))
    return met.select("query_id", *key, (F.col("two") + F.lit(TRIGRAM_WEIGHT) * F.col("three")).alias("overlap"))


def counted_hits(asked: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """query_id, key, two, three: bigrams and trigrams that a target (key, ns) shares with each of the
    few queries (query_id, gram), counted where the target lies."""
    rows = asked.toPandas()
    known, ids = pd.factorize(rows.query_id, use_na_sentinel=False)
    order = np.argsort(rows.gram.to_numpy(np.int64), kind="stable")
    grams, starts = np.unique(rows.gram.to_numpy(np.int64)[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    held = asked.sparkSession.sparkContext.broadcast((grams, starts, ends, known[order], list(ids)))
    kinds = dict(asked.dtypes) | dict(targets.dtypes)
    schema = ", ".join([f"query_id {kinds['query_id']}", *(f"`{c}` {kinds[c]}" for c in key), "two long", "three long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, starts, ends, queries, ids = held.value
        names = pd.Series(ids)

        def hits(own: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(np.isin(grams, own, assume_unique=True))
            n = ends[at] - starts[at]
            places = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return np.bincount(queries[places], minlength=len(ids))

        for batch in batches:
            for i, text in enumerate(batch.ns):
                if not isinstance(text, str) or not len(grams):
                    continue
                own = packed_grams(text)
                two, three = hits(own[own < 0]), hits(own[own >= 0])
                met = np.flatnonzero(two + three)
                if len(met):
                    yield pd.DataFrame({"query_id": names.iloc[met].to_numpy(), **{c: [batch[c].iloc[i]] * len(met) for c in key}, "two": two[met], "three": three[met]})

    return targets.mapInPandas(run, schema)


def meet_all(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """A query set against the whole corpus, in blocks: the corpus is dealt to blocks once,
    and every block gets the queries."""
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return asked.join(corpus.withColumn("block", F.pmod(F.hash("grp", "pos"), F.lit(n))), "block").drop("block")


def prune(queries: DataFrame, corpus: DataFrame, pool: int = POOL, fewest: int = FEWEST_HITS) -> DataFrame:
    """query_id, grp, pos, ord: candidates of each query, in the order (ord, grp, pos) of
    their overlap; the whole corpus, in its own order, for queries of fewer than 4
    characters or with fewer than ``fewest`` hits."""
    q = queries.select("query_id", no_spaces(F.col("text")).alias("ns"))
    c = corpus.select("grp", "pos", no_spaces(F.col("joined")).alias("ns"))
    hits = gram_hits(q.filter(F.length("ns") >= 4), c.filter(F.length("ns") >= 2), ["grp", "pos"])
    counted = hits.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("query_id"))).filter(F.col("n") >= fewest)
    best = top(counted, ["query_id"], [F.desc("overlap"), "grp", "pos"], pool, "ord").select("query_id", "grp", "pos", "ord")
    rest = q.select("query_id").join(best.select("query_id").distinct(), "query_id", "left_anti")
    return best.unionByName(meet_all(rest, c.select("grp", "pos")).withColumn("ord", F.lit(0)).select("query_id", "grp", "pos", "ord"))


def spans(corpus: DataFrame, longest: int) -> DataFrame:
    """grp, pos, pos_end, size, joined: spans of 2 to ``longest`` consecutive passages;
    the first passage without its preamble."""
    w = W.partitionBy("grp").orderBy("pos").rowsBetween(0, longest - 1)
    ahead = corpus.withColumn("next", F.collect_list(F.struct("pos", "joined")).over(w))
    sizes = F.sequence(F.lit(2), F.greatest(F.size("next"), F.lit(2)))
    each = ahead.filter(F.size("next") >= 2).select("grp", "pos", F.coalesce("short", "joined").alias("lead"), "next", F.explode(sizes).alias("size"))
    rest = F.slice("next", F.lit(2), F.col("size") - 1)
    joined = F.concat_ws(" ", F.col("lead"), F.array_join(F.transform(rest, lambda x: x["joined"]), " "))
    return each.select("grp", "pos", F.element_at("next", F.col("size"))["pos"].alias("pos_end"), "size", joined.alias("joined"))


def span_display(matches: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``display``: the corpus text of grp, pos..pos_end in order."""
    rows = matches.alias("m").join(corpus.select("grp", F.col("pos").alias("p"), "display"), "grp")
    inside = rows.filter((F.col("p") >= F.col("pos")) & (F.col("p") <= F.coalesce("pos_end", "pos")))
    texts = inside.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("p", "display"))).alias("d"))
    return matches.join(texts.select("query_id", F.array_join("d.display", " ").alias("display")), "query_id", "left")


def blended(raw: Column, fit: Column, share: float = BLEND) -> Column:
    """Raw score moved towards a better fragment fit."""
    return F.when(F.coalesce(fit, F.lit(0.0)) > raw, raw + (fit - raw) * share).otherwise(raw)


def first_word(c: Column) -> Column:
    return F.get(words(c), F.lit(0))


def single_score(text: Column, ns: Column) -> Column:
    """Best ratio of the text with a passage, with or without its preamble; short
    queries also by the passage's beginning."""
    brief = F.length(ns) <= SHORT_CHARS
    options = [
        ratio(text, F.col("joined")),
        F.when(brief, short_query_boost(ns, no_spaces(F.col("joined")), first_word(F.col("joined")))),
        F.when(F.col("short").isNotNull(), ratio(text, F.col("short"))),
        F.when(F.col("short").isNotNull() & brief, short_query_boost(ns, no_spaces(F.col("short")), F.get(F.split("short", " "), F.lit(0)))),
    ]
    return F.greatest(F.lit(0.0), *options)


def fitted(rows: DataFrame, text: str, reference: str, when: Column, name: str) -> DataFrame:
    """Adds the fragment score of a query in a reference, null where ``when`` is false;
    rows it is false for never reach Python's distance."""
    return rows.withColumn(name, fragment_score(F.when(when, no_spaces(F.col(text))), F.when(when, no_spaces(F.col(reference)))))


def joint_matches(queries: DataFrame, corpus: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best singles and spans of each query: MATCH columns, kind and rank.  Groups
    for spans are chosen before fragments are blended in."""
    asked = queries.filter(F.trim("text") != "")
    found = written(prune(asked, corpus), "candidates")
    pool = found.join(corpus.drop("display"), ["grp", "pos"]).join(asked.select("query_id", "text"), "query_id").filter("joined <> ''")
    ns = no_spaces(F.col("text"))
    scored = written(pool.withColumn("raw", single_score(F.col("text"), ns)), "scored-candidates")
    ranked = scored.withColumn("r1", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("raw"), "ord", "grp", "pos")))
    groups = top(ranked.groupBy("query_id", "grp").agg(F.min("r1").alias("r1")), ["query_id"], ["r1"], TOP_GROUPS, "grp_rank").select("query_id", "grp", "grp_rank")
    ranked = ranked.withColumn("ns_len", F.length(ns))
    long = (F.col("ns_len") >= FRAGMENT_CHARS) & (F.col("ns_len") < F.length(no_spaces(F.col("joined"))) * FRAGMENT_SHARE)
    ranked = fitted(ranked.withColumn("long", long), "text", "joined", F.col("long"), "fit1")
    ranked = fitted(ranked, "text", "short", F.col("long") & F.col("short").isNotNull(), "fit2")
    boosted = ranked.withColumn("boosted", blended(F.col("raw"), F.greatest("fit1", "fit2")))
    single = top(boosted, ["query_id"], [F.desc("boosted"), "r1"], max(k, SINGLES), "ord2")
    single = single.select(
        "query_id", "grp", "pos", F.lit(None).cast("long").alias("pos_end"), "joined",
        round4(F.col("boosted")).alias("score"), round4(F.col("raw")).alias("raw_score"), F.lit("single").alias("kind"),
        F.lit(0).alias("o1"), F.col("ord2").cast("long").alias("o2"), F.lit(0).alias("o3"),
    )
    span = groups.join(spans(corpus, LONGEST_SPAN), "grp").join(asked.select("query_id", "text"), "query_id")
    score = round4(ratio(F.col("text"), F.col("joined")))
    span = span.select(
        "query_id", "grp", "pos", F.col("pos_end").cast("long").alias("pos_end"), "joined", score.alias("score"), score.alias("raw_score"),
        F.lit("span").alias("kind"), (F.col("grp_rank") + 1).cast("int").alias("o1"), F.col("pos").cast("long").alias("o2"), F.col("size").alias("o3"),
    )
    return top(single.unionByName(span), ["query_id"], [F.desc("score"), "o1", "o2", "o3"], k).drop("o1", "o2", "o3")


#: The same under the name of the text entry point.
match_texts = joint_matches


def rescue_score(rows: DataFrame) -> DataFrame:
    """Adds raw and score: the ratio, moved towards the fragment fit."""
    raw = rows.withColumn("raw", ratio(F.col("text"), F.col("joined")))
    return fitted(raw, "text", "joined", F.lit(True), "fit").withColumn("score", F.greatest("raw", F.col("raw") + (F.col("fit") - F.col("raw")) * BLEND))


def prefix_spans(corpus: DataFrame) -> DataFrame:
    """Spans of 2 to 7 passages from the start of each group that starts at 1."""
    first = corpus.groupBy("grp").agg(F.min("pos").alias("m")).filter("m = 1").select("grp")
    return spans(corpus, LONGEST_PREFIX).filter("pos = 1").join(first, "grp")


def prefix_rescue(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Best prefix spans of queries of 34 characters or more."""
    long = queries.filter(F.length(no_spaces(F.col("text"))) >= PREFIX_CHARS)
    rows = rescue_score(meet_all(long, prefix_spans(corpus))).filter(F.col("score") >= PREFIX_SCORE)
    rows = rows.withColumn("score", round4(F.col("score"))).withColumn("raw_score", round4(F.col("raw")))
    return top(rows, ["query_id"], [F.desc("score"), "grp", "size"], RESCUED).select(*MATCH, "rank")


def global_rescue(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Best spans anywhere for queries of 80 characters or more, after an n-gram
    shortlist."""
    long = queries.withColumn("ns", no_spaces(F.col("text"))).filter(F.length("ns") >= GLOBAL_CHARS)
    table = spans(corpus, LONGEST_PREFIX).withColumn("ns", no_spaces(F.col("joined")))
    key = ["grp", "pos", "size"]
    short = top(gram_hits(long, table, key), ["query_id"], [F.desc("overlap"), *key], SHORTLIST, "ord")
    rows = rescue_score(short.join(table.drop("ns"), key).join(long.select("query_id", "text"), "query_id")).filter(F.col("score") >= GLOBAL_SCORE)
    rows = rows.withColumn("score", round4(F.col("score"))).withColumn("raw_score", round4(F.col("raw")))
    return top(rows, ["query_id"], [F.desc("score"), "ord"], RESCUED).select(*MATCH, "rank")


def opening_rescue(queries: DataFrame, best: DataFrame, corpus: DataFrame) -> DataFrame:
    """A prefix span whose first passage is very short and opens the query."""
    first = corpus.filter("pos = 1").select("grp", no_spaces(F.coalesce("short", "joined")).alias("f"))
    second = corpus.filter("pos = 2").select("grp", no_spaces(F.col("joined")).alias("s"))
    heads = first.join(second, "grp").filter((F.col("f") != "") & (F.length("f") <= OPENING_LONGEST))
    asked = queries.withColumn("ns", no_spaces(F.col("text"))).filter(F.length("ns") >= OPENING_CHARS).join(best.select("query_id", F.col("score").alias("best")), "query_id")
    opened = asked.join(heads, F.startswith("ns", F.col("f")))
    rest = F.substr("ns", F.length("f") + 1, F.length("ns"))
    n = F.least(F.length("s"), F.length(rest), F.lit(12))
    opened = opened.filter((n < 4) | (ratio(F.substr(rest, F.lit(1), n), F.substr("s", F.lit(1), n)) >= OPENING_FIT))
    rows = rescue_score(opened.join(prefix_spans(corpus), "grp"))
    ok = (F.col("score") >= OPENING_SCORE) & (F.col("score") >= F.col("best") + OPENING_MARGIN)
    return running_best(rows.filter(ok))


def running_best(rows: DataFrame) -> DataFrame:
    """The row a scan in (grp, size) order ends with when a row replaces the best so far
    if its unrounded score exceeds the best's rounded one."""
    lists = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("grp", "size", "pos", F.col("pos_end").cast("long").alias("pos_end"), "joined", "score", "raw"))).alias("r")
    )
    kept = F.aggregate("r", F.get("r", F.lit(0)), lambda acc, x: F.when(x["score"] > round4(acc["score"]), x).otherwise(acc))
    b = lists.select("query_id", kept.alias("b"))
    return b.select("query_id", "b.grp", "b.pos", "b.pos_end", "b.joined", round4(F.col("b.score")).alias("score"), round4(F.col("b.raw")).alias("raw_score"))


def best_match(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per query that has a match: MATCH columns, frag_fit, margin, fit_margin."""
    asked = queries.filter(F.trim("text") != "").select("query_id", "text")
    # every later stage starts from these rows: they are made once
    joint = written(joint_matches(asked, corpus), "joint-matches")
    best = joint.filter("rank = 0").drop("rank", "kind")
    late = F.col("pos_end").isNotNull() & (F.col("pos") > 1)
    doubtful = best.filter(late | (F.col("score") < UNSURE))
    again = asked.join(doubtful.select("query_id"), "query_id", "left_semi")
    mine = doubtful.select("query_id", F.col("grp").alias("b_grp"), F.col("pos").alias("b_pos"), F.col("pos_end").alias("b_end"), F.col("score").alias("b_score"))
    prefix = written(prefix_rescue(again, corpus), "prefix-rescues").join(mine, "query_id")
    anywhere = written(global_rescue(again, corpus), "global-rescues").join(mine, "query_id")
    sized = asked.select("query_id", F.length(no_spaces(F.col("text"))).alias("n_ns"))
    collapse = prefix.join(sized, "query_id").filter(
        F.col("n_ns").between(PREFIX_CHARS, COLLAPSE_LONGEST) & F.col("b_end").isNotNull() & (F.col("b_pos") > 1)
        & (F.col("grp") == F.col("b_grp")) & (F.col("score") >= COLLAPSE_SCORE) & (F.col("pos_end").isNull() | (F.col("pos_end") >= F.col("b_end")))
    )
    opening = opening_rescue(asked, best, corpus)
    # class 0 wins outright, 1 overrides, 2 competes by score in list order
    parts = [
        opening.select(*MATCH, F.lit(0).alias("cls"), F.lit(0).alias("o1"), F.lit(0).alias("o2")),
        collapse.select(*MATCH, F.lit(1).alias("cls"), F.lit(0).alias("o1"), F.col("rank").alias("o2")),
        best.select(*MATCH, F.lit(2).alias("cls"), F.lit(0).alias("o1"), F.lit(0).alias("o2")),
        prefix.filter(F.col("score") >= F.col("b_score") + PREFIX_MARGIN).select(*MATCH, F.lit(2).alias("cls"), F.lit(1).alias("o1"), F.col("rank").alias("o2")),
        anywhere.filter(F.col("score") >= F.col("b_score") + GLOBAL_MARGIN).select(*MATCH, F.lit(2).alias("cls"), F.lit(2).alias("o1"), F.col("rank").alias("o2")),
    ]
    every = reduce(DataFrame.unionByName, [p.withColumn("pos_end", F.col("pos_end").cast("long")) for p in parts])
    winner = top(every, ["query_id"], ["cls", F.desc("score"), "o1", "o2"], 1).select(*MATCH)
    return annotate(winner, joint, asked)


def annotate(winner: DataFrame, joint: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds frag_fit, and the margins over the best of the top matches that does not
    overlap the winner."""
    own = fitted(winner.join(queries.select("query_id", "text"), "query_id"), "text", "joined", F.lit(True), "fit")
    last = lambda p, e: F.coalesce(F.col(e), F.col(p))
    w = own.select("query_id", F.col("grp").alias("wg"), F.col("pos").alias("wp"), last("pos", "pos_end").alias("we"), "text")
    others = joint.join(w, "query_id").filter(~((F.col("grp") == F.col("wg")) & (F.col("pos") <= F.col("we")) & (last("pos", "pos_end") >= F.col("wp"))))
    others = fitted(others, "text", "joined", F.lit(True), "ofit").groupBy("query_id").agg(F.max("score").alias("other"), F.max("ofit").alias("other_fit"))
    out = own.join(others, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        *MATCH, round4(F.col("fit")).alias("frag_fit"), round4(F.col("score") - zero("other")).alias("margin"),
        round4(F.col("fit") - zero("other_fit")).alias("fit_margin"),
    )


def trusted(n_chars: Column, letters: Column) -> Column:
    """Whether a best match may be shown: a high score, or a distinctive fragment."""
    fragment = (F.col("score") >= TRUST_FLOOR) & (F.col("frag_fit") >= TRUST_FIT) & (F.col("fit_margin") >= TRUST_FIT_MARGIN) & (n_chars >= TRUST_CHARS)
    return ((F.col("score") >= TRUSTED) | fragment) & (letters >= TRUST_LETTERS)


def best_of_hypotheses(matches: DataFrame) -> DataFrame:
    """Of (clip_id, ord, score, ...) the best scored hypothesis, the first of equals."""
    return top(matches, ["clip_id"], [F.desc("score"), "ord"], 1).drop("rank")


def search(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """query_id, grp, pos, score, rank: the k passages of the best plain ratio, by an exact
    index search."""
    return nearest(queries, corpus, k, ["grp", "pos"])[0].select("query_id", "grp", "pos", "score", "rank")


def next_passage(corpus: DataFrame) -> DataFrame:
    """grp, pos, next_grp, next_pos: the following passage; after a group's last, the
    first of the group numbered one higher, if there is one."""
    w = W.partitionBy("grp").orderBy("pos")
    ahead = corpus.select("grp", "pos", F.lead("pos").over(w).alias("after"))
    starts = corpus.groupBy("grp").agg(F.min("pos").alias("first")).select((F.col("grp") - 1).alias("grp"), "first")
    both = ahead.join(starts, "grp", "left")
    inside = F.col("after").isNotNull()
    return both.select(
        "grp", "pos", F.when(inside, F.col("grp")).when(F.col("first").isNotNull(), F.col("grp") + 1).alias("next_grp"), F.coalesce("after", "first").alias("next_pos")
    )


def hint_bonuses(hints: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, grp, pos, bonus: the three passages after the hinted one; if none
    follows, the first three of the next group."""
    ranked = corpus.select("grp", "pos", F.row_number().over(W.partitionBy("grp").orderBy("pos")).alias("nth"))
    steps = hints.select("query_id", "grp", F.col("pos").alias("h"))
    met = steps.join(ranked, "grp").withColumn("d", F.col("pos") - F.col("h")).filter("d between 1 and 3")
    follows = met.filter("d = 1").select("query_id")
    bonus = lambda d: F.element_at(F.array(*[F.lit(b) for b in HINT_BONUS]), d.cast("int"))
    inside = met.join(follows, "query_id", "left_semi").select("query_id", "grp", "pos", bonus(F.col("d")).alias("bonus"))
    left = steps.join(follows, "query_id", "left_anti").select("query_id", (F.col("grp") + 1).alias("grp"))
    across = left.join(ranked.filter("nth <= 3"), "grp").select("query_id", "grp", "pos", bonus(F.col("nth")).alias("bonus"))
    return inside.unionByName(across)


def equal_words(text: Column, passage: Column) -> Column:
    """Ratio of as many leading words as both have."""
    a, b = words(text), words(passage)
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, ratio(F.array_join(F.slice(a, F.lit(1), n), " "), F.array_join(F.slice(b, F.lit(1), n), " "))).otherwise(0.0)


def retrieve(queries: DataFrame, corpus: DataFrame, hints: DataFrame | None = None, longest: int = 4, singles: int = 32, groups: int = 3, span_limit: int = 32) -> DataFrame:
    """Ranked singles and spans over the whole corpus: MATCH columns, bonus, kind, rank.
    ``hints`` is (query_id, grp, pos) of the passage last recited."""
    asked = queries.filter(F.trim("text") != "").select("query_id", "text")
    pairs = meet_all(asked, corpus.drop("display"))
    if hints is None:
        pairs = pairs.withColumn("bonus", F.lit(0.0))
    else:
        pairs = pairs.join(hint_bonuses(hints, corpus), ["query_id", "grp", "pos"], "left").fillna(0.0, ["bonus"])
    ns = no_spaces(F.col("text"))
    hinted = F.when(F.col("bonus") > 0, suffix_prefix_score(F.col("text"), F.col("joined"))).otherwise(0.0)
    scored = pairs.withColumn("raw", F.greatest(single_score(F.col("text"), ns), equal_words(F.col("text"), F.col("joined")), hinted))
    scored = scored.withColumn("total", F.least(F.col("raw") + F.col("bonus"), F.lit(1.0)))
    order = W.partitionBy("query_id")
    scored = scored.withColumn("r1", F.row_number().over(order.orderBy(F.desc("total"), "grp", "pos"))).withColumn("ns_len", F.length(ns))
    chosen = top(scored.groupBy("query_id", "grp").agg(F.min("r1").alias("r1")), ["query_id"], ["r1"], groups, "grp_rank").select("query_id", "grp", "grp_rank")
    long = (F.col("ns_len") >= FRAGMENT_CHARS) & (F.col("ns_len") < F.length(no_spaces(F.col("joined"))) * FRAGMENT_SHARE)
    fits = fitted(scored.withColumn("long", long), "text", "joined", F.col("long"), "fit1")
    fits = fitted(fits, "text", "short", F.col("long") & F.col("short").isNotNull(), "fit2")
    fits = fits.withColumn("raw", blended(F.col("raw"), F.greatest("fit1", "fit2"), 0.7)).withColumn("total", F.least(F.col("raw") + F.col("bonus"), F.lit(1.0)))
    one = top(fits, ["query_id"], [F.desc("total"), "r1"], singles).select(
        "query_id", "grp", "pos", F.col("pos").cast("long").alias("pos_end"), "joined", F.col("total").alias("score"), F.col("raw").alias("raw_score"), "bonus",
        F.lit("single").alias("kind"), "rank",
    )
    many = chosen.join(spans(corpus, longest), "grp").join(asked, "query_id")
    many = many.join(pairs.select("query_id", "grp", "pos", "bonus"), ["query_id", "grp", "pos"])
    many = many.withColumn("raw", F.greatest(ratio(F.col("text"), F.col("joined")), equal_words(F.col("text"), F.col("joined"))))
    many = many.withColumn("total", F.least(F.col("raw") + F.col("bonus"), F.lit(1.0)))
    many = top(many, ["query_id"], [F.desc("total"), "grp_rank", "pos", "size"], span_limit).select(
        "query_id", "grp", "pos", F.col("pos_end").cast("long").alias("pos_end"), "joined", F.col("total").alias("score"), F.col("raw").alias("raw_score"), "bonus",
        F.lit("span").alias("kind"), "rank",
    )
    return one.unionByName(many)


def match_passage(queries: DataFrame, corpus: DataFrame, hints: DataFrame | None = None, threshold: float = 0.3, longest: int = 3) -> DataFrame:
    """The best of ``retrieve`` for each query, if it reaches the threshold."""
    found = retrieve(queries, corpus, hints, longest, singles=5, groups=20, span_limit=64)
    order = [F.desc("score"), F.when(F.col("kind") == "single", 0).otherwise(1), "rank"]
    return top(found.withColumnRenamed("rank", "place").withColumn("rank", F.col("place")), ["query_id"], order, 1, "first").filter(F.col("score") >= threshold).drop("first", "rank", "place")


def short_passages(corpus: DataFrame, tokens: DataFrame, most: int = 15) -> DataFrame:
    """Passages with 1 to ``most`` token ids; ``tokens`` is (grp, pos, ids)."""
    return corpus.join(tokens, ["grp", "pos"]).filter((F.size("ids") > 0) & (F.size("ids") <= most))
