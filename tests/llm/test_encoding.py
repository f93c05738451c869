"""Packing and the piece codec against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessela.llm import packing, piece_codec

TEXTS = [
    "", " ", "  a  b ", "\n\n", "Hello, world!\nNext line\t tab", "ñandú ça été", "▁mark ▁ here", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テスト 🙂🙃", "a\x00b\x01",
    "x" * 3000, "the " * 2000, "don't we'll I'VE 12345 3.14", "　ideographic space", "é combining",
]


def pool(seed, n):
    rng = random.Random(seed)
    alphabet = "abc é\n\tß漢🙂.,!'0123 THE▁"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_piece_codec_equals_the_library(docs_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = pool(1, 400)
    rows = [*enumerate(texts), (9000, None), (None, "a"), (0, "")]
    got = piece_codec.encode_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    own = piece_codec.PieceCodec(open(path, "rb").read())
    assert all(own.decode(own.encode(t)) == sp.decode(sp.encode(t)) for t in texts)
    own.whole, whole = True, own.chunks
    assert all(own.encode(t) == sp.encode(t) for t in texts[:60])
    assert piece_codec.encode_documents(docs_of([])).collect() == [] and whole("") == []


def test_the_first_new_chunk_is_checked_in_its_own_form():
    """It had a second mark in front before, which made it another chunk."""
    own = piece_codec.PieceCodec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    own.encode_text("hello there")
    own.verify(["hello there"])
    own.new, own.young["▁hello"] = ["▁hello"], ("5", " x")
    with pytest.raises(ValueError, match="differ"):
        own.verify([])


def test_short_and_long_agendas_agree():
    """There was one agenda before, a heap with an entry for each new pair."""
    own = piece_codec.PieceCodec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    rng = random.Random(8)
    for letters in ("ab▁", "the ing▁éß漢🙂.$#01\n\tAB", "=-_*a", "\x00\x01aeiou▁"):
        for _ in range(500):
            chunk = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 2 * piece_codec.SHORT)))
            assert own.merged_short(chunk) == own.merged_long(chunk)


def test_packing_takes_the_default_tokenizers_ids(docs_of):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.document_encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    mark = "<|endoftext|>"
    special = [f"a{mark}b", mark, f"{mark}{mark}", f"  {mark} \n{mark}  x", f"x  {mark}", f"<|{mark}|>", "<|endoftext|"]
    texts = [*pool(3, 500), *special]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [encode(x) for x in texts]
    assert encode(f"a{mark}b") == [64, 50256, 65]
    assert packing.SPLIT == public_tokenizers.PATTERN
    rows = packing.pack(docs_of([*enumerate(special)])).collect()
    assert check_packing(rows, dict(enumerate(special)), encode=lambda x: t.encode(x, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("seed", range(20))
def test_closest_fill_is_optimal(seed):
    rng = random.Random(seed)
    capacity = rng.randrange(5, 60)
    counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
    sums = {0}
    for n, k in counts.items():
        sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= capacity}
    fill = packing.closest_fill(counts, capacity)
    assert sum(n * k for n, k in fill.items()) == max(sums) and all(k <= counts[n] for n, k in fill.items())


def check_packing(rows, texts_of, window=packing.WINDOW, encode=None):
    encode = encode or packing.document_encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    assert set(by_doc) == set(texts_of)
    for i, t in texts_of.items():
        ids = np.array([*encode(t or ""), packing.END_ID], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    lengths = [sum(r.length for r in parts) for parts in by_seq.values()]
    return sum(lengths) / sum(n if n & (n - 1) == 0 else window for n in lengths)


@pytest.mark.parametrize("parts", [1, 2, 8, 32])
def test_packing(docs_of, parts):
    rng = random.Random(3)
    texts = {i: " ".join("word" for _ in range(rng.randrange(1, rng.choice([30, 900, 3000])))) for i in range(800)} | {5000: None, 5001: "", 5002: "a<|endoftext|>b"}
    frame = docs_of(list(texts.items())).repartition(parts)
    assert check_packing(packing.pack(frame).collect(), texts) == 1
    assert check_packing(packing.pack(frame, block=50).collect(), texts) == 1


def test_packing_of_odd_rows(docs_of):
    assert packing.pack(docs_of([])).collect() == []
    rows = packing.pack(docs_of([(None, "a"), (1, "a"), (1, "a")]).coalesce(1).withColumn("sequence_id", F.lit("x"))).collect()
    assert sorted((str(r.doc_id), r.length, r.doc_tokens) for r in rows) == [("1", 2, 2), ("1", 2, 2), ("None", 2, 2)]
    assert sorted(r.offset for r in rows) == [0, 0, 2]
    long = {1: "word " * 300_000}
    assert check_packing(packing.pack(docs_of(list(long.items()))).collect(), long) == 1
