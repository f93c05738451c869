"""The pipeline against a brute-force version of its filtering stages."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tessela.llm import pii, toxicity

from .test_encoding import check_packing
from .test_joins import brute_components, lowered, near_copies


def test_pipeline(spark, docs_of, tmp_path):
    rng = random.Random(21)
    rows = near_copies(rng, 150)
    rows += [(1000 + i, rows[i][1].swapcase()) for i in range(20)] + [(2000, None), (2001, ""), (2002, "mail a@b.co or call +49 30 1234567 now please")]
    bad = [(3000 + i, " ".join(rng.choice(["vorgath", "snelpik", "w1", "w2"]) for _ in range(30)) + f" u{i}") for i in range(120)]
    rows += bad
    labels = [(i, 0, int(i >= 3000)) for i, t in rows if t]
    base = str(tmp_path)
    docs_of(rows).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")

    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{base}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}

    model = toxicity.fit(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs_of(rows), model).collect()}
    assert set(kept["toxicity"]) == {i for i, t in rows if not scores[i]}
    assert sum(i >= 3000 for i in kept["toxicity"]) < 12

    groups = {}
    for i, t in kept["toxicity"].items():
        groups.setdefault(lowered(t), []).append(i)
    assert set(kept["exact dedup"]) == {max(g) for g in groups.values()}
    left = list(kept["exact dedup"].items())
    _, roots = brute_components(left)
    assert set(kept["n-gram Jaccard join"]) == {i for i, _ in left if roots[i] == i}
    assert set(kept["PII"]) == set(kept["n-gram Jaccard join"])
    assert kept["PII"][2002] == "mail [EMAIL] or call [PHONE] now please"
    assert not any(re.search(pii.PATTERNS["phone"], t or "") for t in kept["PII"].values())

    packed = corpus_pipeline.run(spark, base).collect()
    check_packing(packed, kept["PII"])


def test_stages_on_odd_tables(spark, docs_of, tmp_path):
    base = str(tmp_path)
    rows = [(None, "a b"), (7, None), (7, None), (8, "A B"), (9, "word " * 60_000), (10, "ip 1.2.3.4")]
    docs = docs_of(rows)
    for name in ("score", "digest", "spans", "near_copy", "toxic", "words"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    for full in (True, False):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs if full else docs.filter("false"), base)
            assert out.columns == docs.columns
            got = out.collect()
            assert len(got) >= 3 if full else got == []
            assert all(r.score == "score" and r.digest == "digest" and r.words == "words" for r in got)
            if full and name == "exact dedup":
                assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in got) == [("10", "ip 1"), ("7", ""), ("8", "A B"), ("9", "word")]
            if full and name == "PII":
                assert {r.doc_id: (r.text, r.n_chars) for r in got}[10] == ("ip [IP]", 7)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), base).collect() == []
