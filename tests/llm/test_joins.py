"""Exact dedup, n-gram join and components against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from tessela.llm import components, exact_dedup, ngram_join


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(docs_of):
    rows = [(1, "A b"), (5, "a B"), (3, "a b "), (9, None), (2, ""), (7, "É"), (8, "é"), (None, "a b"), (4, "x"), (4, "x"), (6, "long " * 50_000)]
    got = exact_dedup.dedup(docs_of(rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    for r in got:
        t = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.digest)
        assert r.keep_id == max(i for i in groups[t] if i is not None) and r.group_size == len(groups[t])
    assert sum(r.kept for r in got) == len(groups)
    assert sorted((r.doc_id, r.text) for r in exact_dedup.survivors(docs_of(rows)).collect() if r.doc_id) == sorted(
        (max(i for i in ids if i is not None), next(x for i, x in rows if i == max(j for j in ids if j is not None))) for ids in groups.values()
    )
    assert exact_dedup.dedup(docs_of([])).collect() == [] and exact_dedup.survivors(docs_of([])).collect() == []


def test_digest_index_over_two_sessions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    make = lambda session, rows: session.createDataFrame(rows, "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path, 4)
    assert first.add(make(spark, [(1, "a"), (2, "b"), (0, "A")])).filter("kept").count() == 2
    first.close()
    other = spark.newSession()
    index = exact_dedup.DigestIndex(other, path, 4)
    second = index.add(make(other, [(3, "A"), (4, "c"), (5, "c"), (None, "b")])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.seen, r.kept) for r in second} == {
        (3, 1, 3, True, False), (4, 5, 2, False, False), (5, 5, 2, False, True), (None, 2, 2, True, False),
    }
    assert {r.doc_id: (r.keep_id, r.group_size) for r in index.add(make(other, [(6, "a"), (7, "C")])).collect()} == {6: (1, 4), 7: (5, 3)}
    assert sorted((r.keep_id, r.group_size) for r in index.digests().collect()) == [(1, 4), (2, 2), (5, 3)]
    plan = index.unseen(index.digests())._jdf.queryExecution().explainString(other._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_survivors_keep_clashing_columns(docs_of):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words are here and more")]
    clash = docs_of(rows).withColumn("digest", F.lit("d")).withColumn("digest_", F.lit("e")).withColumn("near_copy", F.col("doc_id") * 2).withColumn("kept", F.lit(7))
    for module, kept in ((exact_dedup, {2, 3}), (ngram_join, {1, 3})):
        got = module.survivors(clash)
        assert got.columns == clash.columns
        assert {(r.doc_id, r.digest, r.digest_, r.near_copy, r.kept) for r in got.collect()} == {(i, "d", "e", 2 * i, 7) for i in kept}


def shingles(text):
    ws = lowered(text).encode().split()
    k = min(5, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    return sets, {d: min(g) for g in out.values() for d in g}


def near_copies(rng, n):
    """Texts in families whose members differ by edits, plus shared passages."""
    vocab = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choice(vocab) for _ in range(12))
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 9, 14, 30, 60]))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
            if rng.random() < 0.3:
                text += " " + passage
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    return rows


def test_ngram_join(docs_of, monkeypatch):
    rng = random.Random(11)
    rows = near_copies(rng, 500) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "x " * 40_000), (9006, "x " * 5)]
    rng.shuffle(rows)
    sets, expected = brute_components(rows)
    got = ngram_join.join(docs_of(rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), expected[d]) for (d, _), s in zip(rows, sets, strict=True)}
    monkeypatch.setattr(ngram_join, "WIDE", 3)
    monkeypatch.setattr(ngram_join, "LOCAL_WIDE", 2)
    again = ngram_join.join(docs_of(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in again} == {(r.doc_id, r.component_id) for r in got}


def test_ngram_join_odd_rows(docs_of):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(docs_of(rows)).collect())
    assert got == [("4", 2, "4"), ("4", 2, "4"), ("None", 0, "None"), ("None", 2, "4")]
    assert ngram_join.join(docs_of([])).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    seen = {}
    for a, b in edges:
        seen.setdefault(a, set()).add(b)
        seen.setdefault(b, set()).add(a)
    for node, root in got.items():
        todo, reach = [node], {node}
        while todo:
            for x in seen[todo.pop()] - reach:
                reach.add(x)
                todo.append(x)
        assert root == min(reach)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_rows_without_ids_meet_by_their_texts(docs_of):
    """Near copies without doc_id link with each other and with rows that have one."""
    rng = random.Random(13)
    rows, want = [], []
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        near = " ".join([*words[:-1], "changed"])
        other = None if i % 2 else 1000 - i
        rows += [(None, " ".join(words)), (other, near)]
        want += [("None", str(other)), (str(other), str(other))]
    docs = docs_of(rows)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.join(docs).collect())
    assert got == sorted(want)
    # each text that is needed is fetched once: rows without ids do not meet each other's routes
    owners = docs.select(F.xxhash64("text").alias("sid"), "doc_id", F.xxhash64("text").alias("owner_hash"))
    pairs = owners.alias("x").join(owners.alias("y"), F.expr("x.sid < y.sid")).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).limit(200)
    wanted = ngram_join.routes(pairs, owners)
    own = docs.withColumn("text_hash", ngram_join.text_hash())
    met = own.join(wanted, own.doc_id.eqNullSafe(wanted.owner) & (own.text_hash == wanted.owner_hash))
    assert met.count() == wanted.count()
