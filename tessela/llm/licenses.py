"""Licence scan by a positional index of rare words.

Templates (key phrases and notices of licences) are indexed by their rarest words: word ->
(template, offset), at most ``INDEXED`` words each.  A word's rarity is its inverse
document frequency, counted over all documents.  Texts without one of the rarest words of
any template are done at once.  In the others, the file's licence words that are in the
index are looked up with their positions, and the postings of a template are intersected,
its rarest word first, on the relative position (position in the text minus offset in the
template): a phrase needs all of its indexed words there, a notice two of three, so that
one word may be changed.
Where postings meet, a notice stands if ``SUPPORT`` of its words are met at their distance;
a label also needs its mandatory key phrases, which are verified word for word.

Everything is DataFrame expressions: one pass for the frequencies, whose aggregate has
at most one row per vocabulary word and task, and one narrow pass for the scan; no text
and no position is shuffled.  Positions are intersected as sets, in time linear in them.

Defined cases: null text is empty text (no words, no labels, score 0); a null or
repeated doc_id is one row each; a word of any length or script is a word; texts of any
length are scanned whole; an empty table gives no rows; only ``doc_id`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

#: What separates words.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base, and the label each gives.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further labels, each with key phrases that are all mandatory.
MORE = {
    "agpl": ["gnu affero general public license"],
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-sa": ["cc by sa"],
    "cc0": ["cc0 1 0"],
    "creative-commons": ["creative commons attribution"],
    "epl": ["eclipse public license"],
    "isc": ["isc license"],
    "lgpl": ["gnu lesser general public license"],
    "mit-text": ["permission is hereby granted free of charge", "without warranty of any kind"],
    "mpl": ["mozilla public license"],
    "proprietary": ["all rights reserved"],
    "spdx": ["spdx license identifier"],
    "unlicense": ["this is free and unencumbered software"],
}
#: Notices; a label, the notice, and its mandatory key phrase.
NOTICES = [
    ("apache-notice",
     "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "in compliance with the license"),
    ("bsd-notice",
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
     "the above copyright notice"),
    ("gpl-notice",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation",
     "free software foundation"),
    ("isc-notice",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "is hereby granted"),
    ("mit-notice",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction",
     "without restriction"),
    ("mpl-notice",
     "this source code form is subject to the terms of the mozilla public license v 2 0",
     "subject to the terms of"),
    ("zlib-notice",
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
     "damages arising from the use of this software",
     "held liable for any damages"),
]
#: Words of a template in the index, and the share of a notice's words that must stand at
#: their distance.
INDEXED, SUPPORT = 3, 0.8

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(low: Column) -> Column:
    """Words of a lowered text; only the ends of a split can be empty."""
    return F.filter(F.split(low, NON_WORD), lambda w: w != "")


@dataclass(frozen=True)
class Template:
    """Words to find; ``exact`` ones stand word for word."""

    name: str
    label: str
    words: tuple[str, ...]
    exact: bool


def templates() -> list[Template]:
    """Base phrases, key phrases, notices and their key phrases."""
    out = [Template(f"base {p}", label, tuple(p.split()), True) for p, label in BASE.items()]
    out += [Template(f"key {label} {p}", label, tuple(p.split()), True) for label, ps in MORE.items() for p in ps]
    out += [Template(f"notice {label}", label, tuple(p.split()), False) for label, p, _ in NOTICES]
    return out + [Template(f"key {label} {key}", label, tuple(key.split()), True) for label, _, key in NOTICES]


def rules() -> list[tuple[str, list[str]]]:
    """(label, templates that must all stand)."""
    out = [(label, [f"base {p}"]) for p, label in BASE.items()]
    out += [(label, [f"key {label} {p}" for p in ps]) for label, ps in MORE.items()]
    return out + [(label, [f"notice {label}", f"key {label} {key}"]) for label, _, key in NOTICES]


def vocabulary() -> list[str]:
    return sorted({w for t in templates() for w in t.words})


def indexed(t: Template, idf: dict[str, float]) -> list[int]:
    """Offsets of a template's words in the index, the rarest first: its rarest ones, of a
    repeated word the first; of an exact phrase that short, all."""
    first = {w: t.words.index(w) for w in t.words}
    return sorted(first.values(), key=lambda k: (-idf[t.words[k]], k))[:INDEXED]


def document_frequencies(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every vocabulary word, over all documents: at most
    one row per word and task is shuffled."""
    vocab = F.array(*[F.lit(w) for w in vocabulary()])
    met = docs.select(F.explode(F.array_intersect(F.split(ascii_lower(text_of()), NON_WORD), vocab)).alias("w"))
    df = {r["w"]: r["count"] for r in met.groupBy("w").count().collect()}
    n = docs.count()
    return {w: rarity((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary()}


def rarity(x: float) -> float:
    return max(0.0, math.log(x))


def array_of(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def stands(t: Template, idf: dict[str, float]) -> Column:
    """Array of the starts of a template in columns ``words`` and ``hits`` (w, i)."""
    at = indexed(t, idf)
    # starts that a word's postings allow
    posting = lambda k: F.transform(F.filter("hits", lambda h: h["w"] == t.words[k]), lambda h: h["i"] - k)
    lists = [posting(k) for k in at]
    if t.exact:
        met = reduce(F.array_intersect, lists) if len(lists) > 1 else lists[0]
    else:
        met = reduce(F.array_union, [F.array_intersect(lists[i], lists[j]) for i in range(len(at)) for j in range(i)])
    least = len(t.words) if t.exact else math.ceil(SUPPORT * len(t.words))

    def whole(start):
        stretch = F.slice(F.col("words"), start + 1, F.lit(len(t.words)))
        return F.size(F.filter(F.zip_with(stretch, array_of(t.words), lambda x, y: x == y), lambda same: same)) >= least

    return F.filter(met, lambda s: (s >= 0) & (s + len(t.words) <= F.size("words")) & whole(s))


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.  A narrow pass."""
    idf = document_frequencies(docs)
    known = templates()
    weights = {t.name: sum(idf[w] for w in t.words) for t in known}
    top = max(weights.values(), default=1.0) or 1.0
    of_index = sorted({t.words[k] for t in known for k in indexed(t, idf)})
    # two of a template's three rarest words must stand: one of the first two does
    spots = sorted({t.words[k] for t in known for k in indexed(t, idf)[: 1 if t.exact else 2]})

    low = docs.select("doc_id", ascii_lower(text_of()).alias("low"))
    spotted = reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in spots])
    none = F.array().cast("array<string>")
    # only texts that hold one of these are cut into words; the others' words are counted
    rows = low.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.when(spotted, words_of(F.col("low"))).otherwise(none).alias("words"))
    places = F.transform("words", lambda w, i: F.when(w.isin(*of_index), F.struct(w.alias("w"), i.cast("long").alias("i"))))
    rows = rows.withColumn("hits", F.array_compact(places))
    for n, t in enumerate(known):
        rows = rows.withColumn(f"at{n}", stands(t, idf))
    names = F.array_compact(F.array(*[F.when(F.size(f"at{n}") > 0, t.name) for n, t in enumerate(known)]))
    starts = F.concat(*[F.col(f"at{n}") for n, t in enumerate(known) if t.name.startswith("base ")])
    found = rows.select("doc_id", "n_words", starts.alias("starts"), names.alias("phrases"))
    rarest = F.greatest(F.lit(0.0), *[F.when(F.array_contains("phrases", name), F.lit(w / top)) for name, w in weights.items()])
    base = [r for r in rules() if r[1][0].startswith("base ")]
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        label_list(base).alias("base_labels"), label_list(rules()).alias("labels"),
        F.when(F.size("phrases") > 0, 0.5 + 0.5 * rarest).otherwise(0.0).alias("score"),
    )


def label_list(rules: list[tuple[str, list[str]]]) -> Column:
    """Sorted, comma-joined labels all of whose phrases stand in ``phrases``."""
    picks = []
    for label, needed in rules:
        ok = F.lit(True)
        for p in needed:
            ok = ok & F.array_contains("phrases", p)
        picks.append(F.when(ok, F.lit(label)))
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*picks)))), ",")
