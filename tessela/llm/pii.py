"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from patterns: the base kinds (whose valid matches always count)
and wider ones for further kinds.  Labelers vote on every candidate: patterns and
checksums vote on its form, gazetteers on known words in it, context labelers on the
characters around it; a labeler may abstain.  Expectation-maximisation estimates, from
how often each pattern of votes occurs over all documents, how reliable every labeler
is for each kind; the pattern counts are all that reaches the driver (at most
3^labelers rows a kind, far fewer in practice).  The soft labels then train the final
span classifier, a logistic model over the votes, whose weights become a plain
expression again.

Positions are found natively: ``split`` gives what lies between matches and
``regexp_extract_all`` the matches; running sums of their lengths are the offsets, in
code points, and bodies and contexts are taken from these pieces.  Before matching, single separators inside digit runs and host names are
replaced one for one by a control character, so that every pattern is a run of a
character class: matching takes linear time and no recursion on texts of any length.

Defined cases: null text is empty text; null and repeated doc_ids pass through, one
row each; a text without a candidate gets zero counts, the digest of the empty string
and no spans; U+0001 in a text is an ordinary character; an empty table gives no rows;
``annotate`` reads ``doc_id`` and ``text`` only, ``redact`` keeps other columns whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds; spans are listed in this order after the base kinds.
MORE_KINDS = ("iban", "local_phone", "secret", "ssn")
KINDS = BASE_KINDS + MORE_KINDS
#: Endings of host names, words near personal data, test values.
GAZETTEER_TLD = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
GAZETTEER_TEST = ("example", "test", "localhost", "0.0.0.0", "127.0.0.1")
CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("call", "phone", "tel", "fax", "mobile"),
    "iban": ("iban", "account", "bank"),
    "local_phone": ("call", "phone", "tel", "fax", "mobile"),
    "secret": ("token", "secret", "key", "password", "bearer"),
    "ssn": ("ssn", "social", "security"),
}
#: Characters before a span that the context labelers see.
CONTEXT = 24
SEP = "\x01"
EMAIL_CHARS = "A-Za-z0-9._%+" + SEP + "-"
#: Patterns over the prepared text (see ``prepared``); each match is linear.
PATTERNS = {
    "email": rf"(?:(?<![{EMAIL_CHARS}])|\G)[{EMAIL_CHARS}]++@[A-Za-z0-9-]++{SEP}[A-Za-z0-9{SEP}-]++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": rf"[0-9][0-9{SEP}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])",
    "secret": r"(?i)(?:token|secret|api_?key|password|passwd)[\"']? ?[:=] ?[\"'][A-Za-z0-9_+/=-]{16,}+[\"']",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap necessary condition of each pattern, on the raw text.
GUARDS = {
    "email": r"@[A-Za-z0-9-]+\.",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",
    "local_phone": r"\([0-9]{3}\)[ ]?[0-9]{3}-",
    "secret": r"(?i)(?:token|secret|key|passw)[a-z]*[\"']? ?[:=]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


SPAN = "array<struct<start:int,end:int,body:string,before:string,after:string>>"
#: Values of a running sum that are folded at a time.
FOLDED = 256


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Running sums of an array of integers.  A fold copies what it has gathered, so only
    stretches of ``FOLDED`` values are folded, and then moved by the sums before them."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    more = lambda acc, x: F.concat(acc, F.array(last(acc) + x))
    none = F.array().cast("array<int>")
    count = F.ceil(F.size(values) / F.lit(FOLDED)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.aggregate(F.slice(values, c * FOLDED + 1, F.lit(FOLDED)), none, more))

    def moved(own):
        before = F.aggregate(own, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(last(acc) + last(p))))
        return let(before, lambda b: F.flatten(F.transform(own, lambda p, c: F.transform(p, lambda x: x + F.get(b, c)))))

    return F.when(F.size(values) > 0, let(parts, moved)).otherwise(none)


def prepared(kind: str, text: Column) -> Column:
    """The text with U+0001 set aside and single separators replaced, length kept."""
    if kind == "email":
        return F.regexp_replace(F.translate(text, SEP, "\x02"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", SEP)
    if kind == "card":
        return F.regexp_replace(F.translate(text, SEP, "\x02"), r"(?<=[0-9])[ -](?=[0-9])", SEP)
    return text


def matches(kind: str, text: Column) -> Column:
    """Array of (start, end, body, before, after) of every match of a pattern, left to
    right: what it holds, up to ``CONTEXT`` characters before it and one after it, of those
    outside other matches.  All pieces come from cutting the text once."""

    def placed(t):
        found, gaps = F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)), F.split(t, PATTERNS[kind], -1)

        def spans(cut):
            found, gaps = cut["found"], cut["gaps"]
            ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
            shown = lambda c: F.translate(c, SEP, "." if kind == "email" else " ")

            def one(x, i):
                return F.struct(
                    (x["end"] - F.length(x["m"])).alias("start"), x["end"].alias("end"), shown(x["m"]).alias("body"),
                    shown(F.right(x["gap"], F.lit(CONTEXT))).alias("before"), shown(F.left(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.lit(1))).alias("after"),
                )

            zipped = F.arrays_zip(ends.alias("end"), found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
            return F.transform(zipped, one)

        return let(F.struct(found.alias("found"), gaps.alias("gaps")), spans)

    return let(prepared(kind, text), placed)


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn sum."""
    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))

    def value(i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.coalesce(F.when(i % 2 == 1, twice).otherwise(d), F.lit(0))

    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def octets_valid(body: Column) -> Column:
    """All parts at most 255, however many leading zeros."""
    small = lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    return F.forall(F.split(body, r"\."), small)


def well_formed(kind: str, body: Column) -> Column:
    """The base rule of a base kind; true for the others."""
    if kind == "ip":
        return octets_valid(body)
    if kind == "card":
        digits = digits_of(body)
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits_of(body)).between(9, 15)
    return F.lit(True)


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, body, before, after, valid), in the order of KINDS."""

    def widen(kind: str):
        def one(m):
            return F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["body"].alias("body"),
                F.lower(m["before"]).alias("before"), m["after"].alias("after"), well_formed(kind, m["body"]).alias("valid"),
            )

        found = F.when(text.rlike(GUARDS[kind]), matches(kind, text)).otherwise(F.array().cast(SPAN))
        return F.transform(found, one)

    return F.concat(*[widen(k) for k in KINDS])


def labelers(c: Column) -> dict[str, Column]:
    """Votes on a candidate struct: 1 for, 0 against, -1 abstains."""
    kind, body, before, after, valid = c["kind"], F.lower(c["body"]), c["before"], c["after"], c["valid"]
    base = kind.isin(*BASE_KINDS)
    digits = digits_of(c["body"])
    cue = F.lit(False)
    for k, words in CUES.items():
        near = F.lit(False)
        for w in words:
            near = near | F.contains(before, F.lit(w))
        cue = cue | ((kind == k) & near)
    test = F.lit(False)
    for w in GAZETTEER_TEST:
        test = test | F.contains(body, F.lit(w))
    tld = F.regexp_extract(body, r"\.([a-z]+)$", 1).isin(*GAZETTEER_TLD)
    same = digits.rlike(r"^([0-9])\1+$")
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    return {
        "form": vote(valid & base, ~valid),
        "gazetteer": vote((kind == "email") & tld & ~test, test & (kind != "email")),
        "cue": vote(cue, F.lit(False)),
        "edges": vote(after.rlike(r"^[\s.,;:!?\"')]?$") & ~before.rlike(r"[a-z0-9_]$"), after.rlike(r"[A-Za-z0-9_]")),
        "variety": vote(F.lit(False), (kind != "email") & same),
        "shape": vote(kind.isin("secret", "local_phone", "ssn") & ~same, (kind == "iban") & (F.length(body) > 34)),
    }


def voted(text: Column) -> Column:
    """The candidates with their votes."""
    names = ("kind", "start", "end", "valid")
    return F.transform(candidates(text), lambda c: F.struct(*[c[n].alias(n) for n in names], *[v.alias(k) for k, v in labelers(c).items()]))


LABELERS = ("form", "gazetteer", "cue", "edges", "variety", "shape")


@dataclass
class SpanClassifier:
    """Log-odds of a span: a bias for each kind and a weight for each vote."""

    bias: dict[str, float]
    weights: dict[tuple[str, int], float]

    def score(self, c: Column) -> Column:
        z = F.lit(0.0)
        for kind, b in sorted(self.bias.items()):
            z = z + F.when(c["kind"] == kind, F.lit(float(b))).otherwise(F.lit(0.0))
        for (name, vote), w in sorted(self.weights.items()):
            z = z + F.when(c[name] == vote, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


#: Right votes of either kind that every labeler is credited with beforehand.
PRIOR_VOTES = 4.0


def fit_votes(patterns: Iterable[tuple[str, tuple[int, ...], int]], names: list[str], rounds: int = 30) -> SpanClassifier:
    """Expectation-maximisation over counts of vote patterns, then the classifier.

    Labelers are taken as independent given the truth.  The start follows the majority
    of votes, so a labeler that mostly agrees with the others ends reliable; Dirichlet
    priors of ``PRIOR_VOTES`` right votes favour labelers that are better than chance."""
    rows = [(k, v, n) for k, v, n in patterns if n > 0]
    kinds = sorted({k for k, _, _ in rows})
    post = [min(0.95, max(0.05, (1 + sum(x == 1 for x in v)) / (2 + sum(x >= 0 for x in v)))) for _, v, _ in rows]
    prior, rate = {}, {}
    for _ in range(rounds):
        for k in kinds:
            own = [(p, n) for (kind, _, n), p in zip(rows, post, strict=True) if kind == k]
            prior[k] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for j, name in enumerate(names):
            for truth in (0, 1):
                mass = [0.5, 0.5, 0.5]
                mass[1 + truth] += PRIOR_VOTES
                for (_, v, n), p in zip(rows, post, strict=True):
                    mass[v[j] + 1] += n * (p if truth else 1 - p)
                rate[name, truth] = [m / sum(mass) for m in mass]
        for i, (k, v, _) in enumerate(rows):
            z = math.log(prior[k] / (1 - prior[k]))
            z += sum(math.log(rate[name, 1][v[j] + 1] / rate[name, 0][v[j] + 1]) for j, name in enumerate(names))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return train_classifier(rows, post, kinds, names)


def train_classifier(rows, post, kinds: list[str], names: list[str], steps: int = 400) -> SpanClassifier:
    """Logistic regression on soft labels, by gradient ascent on the pattern table."""
    bias = dict.fromkeys(kinds, 0.0)
    weights = {(name, vote): 0.0 for name in names for vote in (0, 1)}
    total = sum(n for _, _, n in rows) or 1
    for _ in range(steps):
        gb, gw = dict.fromkeys(kinds, 0.0), dict.fromkeys(weights, 0.0)
        for (k, v, n), p in zip(rows, post, strict=True):
            z = bias[k] + sum(weights[name, v[j]] for j, name in enumerate(names) if v[j] >= 0)
            err = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            gb[k] += err
            for j, name in enumerate(names):
                if v[j] >= 0:
                    gw[name, v[j]] += err
        for k in bias:
            bias[k] += 4 * (gb[k] - 1e-4 * bias[k])
        for w in weights:
            weights[w] += 4 * (gw[w] - 1e-4 * weights[w])
    return SpanClassifier(bias, weights)


def learn(docs: DataFrame) -> SpanClassifier:
    """Fits labeler reliabilities and the classifier on all candidates of ``docs``."""
    each = docs.select(F.explode(voted(text_of())).alias("c")).select("c.kind", *[f"c.{n}" for n in LABELERS])
    counted = each.groupBy("kind", *LABELERS).count().collect()
    return fit_votes([(r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in counted], list(LABELERS))


def accepted(text: Column, model: SpanClassifier, threshold: float = 0.5) -> Column:
    """Array of (o, start, end, kind, base) of a text's spans, sorted; base spans are
    always accepted, others by the classifier."""
    marked = F.transform(
        voted(text),
        lambda c: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
            (c["kind"].isin(*BASE_KINDS) & c["valid"]).alias("base"),
            (~c["kind"].isin(*BASE_KINDS) & c["valid"] & (model.score(c) >= threshold)).alias("more"),
        ),
    )
    chosen = F.filter(marked, lambda s: s["base"] | s["more"])
    return F.array_sort(F.transform(chosen, lambda s: F.struct(s["o"], s["start"], s["end"], s["kind"], s["base"])))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def annotate(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, digest of the base
    spans, all spans.  A narrow pass; learning, unless a model is given, is another."""
    model = model or learn(docs)
    out = docs.select("doc_id", accepted(text_of(), model).alias("s"))
    base = F.filter("s", lambda x: x["base"])
    count = lambda k: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("s")).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap
    are replaced together, under the kind of the first."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, piece).otherwise(acc["out"]).alias("out"))

    return F.aggregate(by_start, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """``docs`` with the spans of ``text`` masked, columns and null texts as they were."""
    model = model or learn(docs)
    spans = unused("spans", docs)
    text = F.when(F.col("text").isNull(), F.col("text")).when(F.size(spans) > 0, masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return docs.withColumn(spans, accepted(text_of(), model)).withColumn("text", text).drop(spans)
