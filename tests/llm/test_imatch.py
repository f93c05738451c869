"""I-Match fingerprints: neighbours and edits by brute force, likeness by its laws."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessela.llm import imatch


def test_edits_and_fingerprints(docs_of, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 9)
    rng = random.Random(8)
    vocab = [f"w{i}é" for i in range(80)]
    rows = [(rng.randrange(10**6) * 3, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40])))) for _ in range(150)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(3_000_001, None), (3_000_002, "same text here"), (-5, "same text here"), (7_000_000, "é" * 30_001)]
    got = {r.doc_id: r for r in imatch.fingerprint_pairs(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    down = sorted(rows, key=lambda r: -r[0])
    for (i, t), (j, nxt) in zip(down, down[1:] + down[:1], strict=True):
        t, nxt, half = t or "", nxt or "", len(t or "") // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        if got[j].fingerprint == r.fingerprint:
            assert r.near_next == 1
    assert got[3_000_002].fingerprint == got[-5].fingerprint
    long = [r for r in got.values() if r.n_chars > 150]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)


def test_odd_rows(docs_of):
    assert imatch.fingerprint_pairs(docs_of([])).collect() == []
    only = imatch.fingerprint_pairs(docs_of([(None, "a b c")])).collect()
    assert only[0].near_next == 1.0
    assert len(imatch.fingerprint_pairs(docs_of([(1, "a b"), (1, "a b"), (None, None), (None, "x")])).collect()) == 4


def test_the_whole_band_is_the_lexicon(docs_of):
    rows = [(i, " ".join(f"w{j}" for j in range(i // 2 * 50, i // 2 * 50 + 50))) for i in range(200)]
    assert len(imatch.lexicon(docs_of(rows))) == 5000


def test_texts_without_a_lexicon_term_are_compared_by_all_terms(docs_of):
    rows = [(i, " ".join(f"only{i}x{j}" for j in range(40))) for i in range(3)]
    bare = imatch.fingerprint_pairs(docs_of(rows)).collect()
    assert all(r.fingerprint.startswith(imatch.BARE) and 0 < r.near_edited < 1 and r.near_next == 0 for r in bare)


def parts_of(spark, terms):
    """subset -> codes of a text's terms, from the hashes of each term."""
    frame = spark.createDataFrame([(t,) for t in sorted(terms)] or [("",)], "w string")
    rows = frame.select("w", F.xxhash64("w", F.lit(7)).alias("h"), F.pmod(F.xxhash64("w", F.lit(11)), F.lit(1 << imatch.CODE_BITS)).alias("low")).collect()
    out = {}
    for r in rows:
        for level in range(imatch.LEVELS):
            if not level or (r.h >> 40) % imatch.THIN**level == 0:
                subset = level * imatch.GROUPS + (r.h >> 8 * level) % imatch.GROUPS
                out.setdefault(r.w, []).append((subset, r.low))
    return out


def test_likeness_against_brute_force(spark, docs_of):
    rng = random.Random(18)
    vocab = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 8, 30, 60])))) for i in range(120)]
    low, high = 0.02, 0.3
    words = lambda t: {w for w in re.split(imatch.SEPARATORS, t.lower()) if w}
    df = Counter(w for _, t in rows for w in words(t))
    band = {w for w, n in df.items() if max(2, low * len(rows)) <= n <= max(2, high * len(rows))}
    codes = parts_of(spark, set(df) | {f for _, t in rows for f in words(t)})
    down = sorted(rows, reverse=True)
    cut = {}
    for (i, t), (_, nxt) in zip(down, down[1:] + down[:1], strict=True):
        half = len(t) // 2
        cut[i] = t[: len(t) - half] + nxt[:half]
    codes |= parts_of(spark, {w for t in cut.values() for w in words(t)})

    def components(text):
        kept = words(text) & band
        out = {}
        for w in kept or words(text):
            for subset, c in codes[w]:
                out.setdefault(subset, set()).add(c)
        return bool(kept), out, frozenset(words(text))

    def like(x, y):
        (kx, a, wx), (ky, b, wy) = components(x), components(y)
        if kx == ky and a == b and (kx or wx == wy):
            return 1.0
        filled = set(a) | set(b)
        return sum(a.get(s) == b.get(s) for s in filled) / len(filled) if kx == ky and filled else 0.0

    got = {r.doc_id: r for r in imatch.fingerprint_pairs(docs_of(rows), low, high).collect()}
    for (i, t), (_, nxt) in zip(down, down[1:] + down[:1], strict=True):
        assert abs(got[i].near_edited - like(t, cut[i])) < 1e-9 and abs(got[i].near_next - like(t, nxt)) < 1e-9


def test_one_doc_id_for_many_rows_is_cut_into_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 10)
    rows = [(None, f"a b {i} c") for i in range(150)] + [(7, f"d e {i}") for i in range(100)] + [(i, f"f {i}") for i in range(100, 200)]
    frame = docs_of(rows).withColumn("key", F.lit("k")).withColumn("bucket", F.lit("b"))
    sizes = [r["count"] for r in imatch.bucketed(frame).groupBy("bucket").count().collect()]
    assert sum(sizes) == 350 and max(sizes) < 40
    got = imatch.fingerprint_pairs(frame).collect()
    # every row has one next row: the edited texts are those of a ring
    assert len(got) == 350 and Counter(r.doc_id for r in got)[7] == 100
