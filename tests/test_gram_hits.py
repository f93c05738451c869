"""Shared grams of few queries are counted where the targets lie."""

from tessela.functions.similarity import packed_grams
from tessela.operators import retrieval


def test_counts_equal_sets_and_no_gram_is_joined(spark):
    asked = {1: "abcd", 2: "", 3: None, 4: "bcdbcd", 5: "é1"}
    texts = {10: "abcdx", 11: None, 12: "zz", 13: "bcd é1", 14: "a"}
    q = spark.createDataFrame(list(asked.items()), "query_id int, ns string")
    t = spark.createDataFrame(list(texts.items()), "doc_id long, ns string")
    made = retrieval.gram_hits(q, t, ["doc_id"])
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, a in asked.items():
        for d, b in texts.items():
            both = set(packed_grams(a or "")) & set(packed_grams(b or ""))
            if both:
                want[i, d] = sum(g < 0 for g in both) + 0.48 * sum(g >= 0 for g in both)
    assert {(r.query_id, r.doc_id): r.overlap for r in made.collect()} == want
