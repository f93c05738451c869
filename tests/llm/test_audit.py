"""The filter audit against running every order, one filter after the other."""

import random
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tessela.llm import filter_audit

SPACE = " \t\n\x0b\x0c\r"


def fails(rows, i):
    """Letters of the filters that row ``i`` fails."""
    doc_id, text, _ = rows[i]
    text = text or ""
    words = "".join(" " if c in SPACE else c for c in text).split(" ")
    words = [w for w in words if w]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
        out.add("C")
    if set(text) & set("#$%&*|"):
        out.add("D")
    if doc_id is not None and any(j is not None and j < doc_id and (t or "") == text for j, t, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    found = {}
    failing = [fails(rows, i) for i in range(len(rows))]
    for part in {lang or "" for _, _, lang in rows}:
        own = [i for i, (_, _, lang) in enumerate(rows) if (lang or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for f in order:
                shapley[f] += sum(f in failing[i] for i in left)
                left = [i for i in left if f not in failing[i]]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failing[i]]
                left = [i for i in left if f not in failing[i]]
                found[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in failing[i] for i in own) - len(gone), sum(failing[i] == {f} for i in own),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone), shapley[f],
                )
    return found


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("n", F.lit("y")).withColumn("digest", F.lit(3))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("p"))
    return filter_audit.audit(docs, marks)


def test_audit_against_all_orders(spark):
    rng = random.Random(4)
    texts = [None, "", "a b", " \x0b ", "A# " * 250, "one two " * 150, "é" * 300]
    texts += [" ".join(rng.choice("ab cd ef G # é | $".split()) + str(rng.randrange(300)) for _ in range(rng.choice([20, 199, 200, 201, 400]))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    rows += [(None, texts[2], "en"), (None, texts[2], "en"), (7, rows[7][1], "fr"), (7, rows[7][1], "fr"), (-5, "a b", "de"), (8, "other", "en")]
    rows.append((400, "word " * 100_000, "long"))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = audited(spark, rows, labels).collect()
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == brute(rows, labels)


def test_audit_of_an_empty_table(spark):
    out = audited(spark, [], [(1, 1, 1)])
    assert out.collect() == [] and out.columns == ["part", "filter_order", "step", *COLUMNS]
    assert dict(out.dtypes)["step"] == "int" and {dict(out.dtypes)[c] for c in COLUMNS} == {"bigint"}


def test_all_rows_alike(spark):
    """One text, one doc_id or none, in one part: a single hot key everywhere."""
    rows = [(i % 3 if i % 4 else None, "same", None) for i in range(400)]
    got = audited(spark, rows, [(1, 1, 1)]).filter("filter_order = 'EABCD' and step = 1").first()
    assert got.removed == sum(i % 4 > 0 and i % 3 > 0 for i in range(400)) and got.part == ""
