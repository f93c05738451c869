"""Token alignment against the tokenizers' own tokens and all overlapping byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessela.llm import token_alignment as ta


def byte_alphabet():
    """Byte of each character that a byte-level vocabulary writes for it: printable bytes
    stand for themselves, others in turn from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = byte_alphabet()
    docs = []
    for _, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(alphabet[c] for c in a_of.id_to_token(i))) for i in a_of.encode(" " + text, add_special_tokens=False).ids]
            for i in b_of.encode(text):
                piece = b_of.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if b_of.is_byte(i) else piece.replace("▁", " ").encode()))
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        docs.append((spans(a), spans(b)))
    linked, count = [], Counter()
    for a, b in docs:
        own = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e]
        linked.append(own)
        count.update(own)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for (doc_id, _), (a, b), own in zip(rows, docs, linked, strict=True):
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if start < e <= cut) for side in (a, b)))
            start = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((str(doc_id), len(a), len(b), len(cuts), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), sha))
    return sorted(out)


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def found(docs, **options):
    rows = ta.digest(docs, **options).collect()
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


ODD = ["", None, " ", "  a  b ", "\n\n", "x▁y", "▁", "<|endoftext|> <s></s><unk><0x41>", "日本語 テスト 🙂🙃", "a\x00b\x01", "=" * 500, "don't 12345", "ﷺ é", "\x7f\x85\xa0", "　x", "é"]


def test_alignment_against_all_pairs(docs_of):
    rng = random.Random(11)
    alphabet = "abcde é\n\tß漢🙂.,!'0123 THE=-"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [" ".join(rng.choice("the of and quick brown fox unbelievable Wörter".split()) for _ in range(rng.randrange(1, 80))) for _ in range(50)]
    rows = [*enumerate(texts), (None, "the same"), (None, "the same"), (3, "the same"), (7000, "long words here " * 400)]
    docs = docs_of(rows)
    clash = docs.withColumn("links", F.lit(1)).withColumn("rid", F.lit(1)).withColumn("n", F.lit("x")).withColumn("pair", F.lit(2))
    want = brute(rows)
    assert found(docs) == want and found(clash) == want


def test_cold_pairs_by_shuffle(docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("the of and quick brown fox unbelievable".split()) for _ in range(20))) for i in range(60)]
    assert found(docs_of(rows), hot_pairs=10) == brute(rows)


def test_empty_and_tokenless_tables(docs_of):
    assert found(docs_of([])) == []
    assert found(docs_of([(1, None), (2, ""), (3, "▁")])) == [(str(i), 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_long_text_stays_linear(docs_of):
    text = "antidisestablishmentarianism und Donaudampfschifffahrt " * 20_000
    got = found(docs_of([(1, text)]))[0]
    assert got[4] == got[1] + got[2] - got[3] and got[5] <= got[4]


def test_groups_as_text(docs_of):
    got = {r.doc_id: r for r in ta.align(docs_of([(1, "unbelievable"), (2, None)])).collect()}
    want = brute([(1, "unbelievable")])[0]
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == want[7] and got[2].groups == "" and len(got[1].links) == got[1].n_links
