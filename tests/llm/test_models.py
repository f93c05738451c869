"""Toxicity and language models on held-out rows, and their defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessela.llm import langid, toxicity
from tessela.llm.common import py_held_out

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "se"], "bb": ["blor", "gwen", "dyth", "rhos"], "cc": ["ска", "то", "мир", "ру"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_of_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, lang := rng.choice(sorted(SYLLABLES)), 40), lang) for i in range(600)]
    odd = [(9000, None, "aa"), (9001, "", None), (9002, "123 !!", "bb"), (None, "blor gwen", None), (9003, "x" * 300_000, None), (9004, "漢字", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    lang_of = {i: lang for i, _, lang in rows}
    tried = [r for i, r in got.items() if r.held_out and i in lang_of]
    assert len(tried) > 100 and sum(r.lang_pred == lang_of[r.doc_id] for r in tried) / len(tried) > 0.98
    assert all(got[i].held_out == py_held_out(i) for i in got)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9000, 9001, 9002)) and got[9004].lang_pred in SYLLABLES
    mixed = say(rng, "aa", 30) + " " + say(rng, "bb", 30)
    cuts = langid.spans(model, mixed)
    assert [c[2] for c in cuts] == ["aa", "bb"] and mixed[cuts[1][0] : cuts[1][1]].split()[0].startswith(tuple(SYLLABLES["bb"]))
    none = langid.fit(df.filter("lang = 'zz'"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.filter("false"), model).collect() == []


def test_viterbi_equals_exhaustive_search():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(0, 6, 4)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        scores = rng.normal(size=(starts[-1], 3)) * 3
        got = langid.viterbi(scores, starts, 2.0)
        for a, b in zip(starts, starts[1:], strict=False):
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: E731, B023
            if b > a:
                assert abs(value(tuple(got[a:b])) - max(map(value, product(range(3), repeat=int(b - a))))) < 1e-9


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(3)
    bad = ["vorgath", "snelpik", "drumfaz"]
    docs, labels = [], []
    for i in range(1200):
        words, toxic = say(rng, "aa", 60).split(), int(rng.random() < 0.2)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    odd = [(9000, None), (9001, ""), (9002, "!!"), (None, "vorgath vorgath snelpik")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (9000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    truth = dict(labels)
    tried = [r for i, r in got.items() if r.held_out and i in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tried) / len(tried) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[9000].score == got[9001].score == got[9002].score < 0.3
    left = {r.doc_id for r in toxicity.reject(df, model).collect()}
    assert left == {i for i, r in got.items() if not r.predicted}
    flat = toxicity.fit(df, lab.filter("toxic = 0"))
    assert {round(r.score, 6) for r in toxicity.score_documents(df, flat).collect()} == {0.0}


def test_gains_are_differences_of_compressed_lengths():
    import zstandard

    rng = random.Random(5)
    ordinary = [say(rng, "aa", 40) for _ in range(60)]
    toxic = [t + " " + " ".join(rng.choice(["vorgath", "snelpik"]) for _ in range(5)) for t in ordinary[:20]]
    base, special = toxicity.train_dictionaries(toxic, ordinary)
    own = toxicity.Scorer(base, special)
    params = zstandard.ZstdCompressionParameters.from_level(
        toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(f" {window} ".encode() + toxicity.TAIL))

    gain = lambda window: length(window, base) - length(window, special)
    for text in [*toxic[:10], *ordinary[:5], "", None, "vorgath", "Vorgath 12 SNELPIK!"]:
        words = toxicity.windows(text)
        found, wide = own.gains_of(text)
        assert found == [g for g in map(gain, words) if g > 0]
        centres, reached = [], 0
        for i, w in enumerate(words):
            if gain(w) > 0 and i >= reached:
                centres.append(" ".join(words[max(0, i - toxicity.AROUND) : i + toxicity.AROUND + 1]))
                reached = i + toxicity.AROUND + 1
        assert wide == [gain(c) for c in centres]
    assert own.gains_of("vorgath snelpik")[0]
    levels = toxicity.calibrated([([], []), ([3], [2, 5])] * 10)
    assert all(1 <= a < b for half in (levels[:5], levels[5:]) for a, b in zip(half, half[1:], strict=False))


def test_models_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "c d", "y")], "doc_id long, text string, score string").withColumn("toxic", F.lit(3)).withColumn("lang", F.lit("aa"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score_documents(docs.filter("false"), model).collect() == []
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.score_documents(docs, model).count() == 2
    assert toxicity.fit(docs.filter("false"), labels.filter("false")).weights.shape == (1,)
    long = spark.createDataFrame([(5, "ka to " * 200_000)], "doc_id long, text string")
    assert 0 <= toxicity.score_documents(long, model).first().score <= 1
    many = spark.createDataFrame([(i, (chr(97 + i % 300 // 26) + chr(97 + i % 300 % 26)) * 3, f"l{i % 300:03}") for i in range(3000)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(many, langid.fit(many)).collect()}
    assert len(set(found.values())) > 256
