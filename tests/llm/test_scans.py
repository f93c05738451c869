"""PII and licence scans against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessela.llm import licenses, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m.group())


def base_spans(text):
    t = text or ""
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


PIECES = [
    "a@b.co", "é@x.y", "mail me: jo.e+x@h-1.ex.org.", "@", "a@b", "a@b@c.d", ".", "_", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.3.4", "1..2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "1 - 2", "+1 (499) 555-6503", "+49 30 1234567", "+", "+1", "(212) 555-0100", "token = \"abcdefghijklmnop1234\"",
    "\x01", "a\x01b", "123-45-6789", "0" * 17, "79927398713", "-", " ", "\n", "ü", "x_y@z.w_q@r.s", "DE44500105175407324931",
]


def test_pii_against_brute_force(docs_of):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(9)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "a@b.co"), (1007, "a@b.co"), (1007, "a@b.co"), (1002, "1 " * 30_000), (1003, "a." * 20_000 + "@" + "b." * 20_000 + "c"), (1004, "9" * 40_000)]
    got = pii.annotate(docs_of(rows)).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == expected
    by_id = {r.doc_id: r for r in got}
    for i, t in rows[:400]:
        base = base_spans(t)
        assert [by_id[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s.startswith(k + ":") for s in base) for k in pii.BASE_KINDS]
        assert set(base) <= set(filter(None, by_id[i].spans.split(",")))


def test_redact_hides_spans(docs_of):
    rows = [(1, "write a@b.co or +49 30 1234567, é"), (2, None), (3, "clean"), (4, 'the token = "abcdefghijklmnop1234"!')]
    out = {r.doc_id: r.text for r in pii.redact(docs_of(rows)).collect()}
    assert out[1] == "write [EMAIL] or [PHONE], é" and out[2] is None and out[3] == "clean"
    assert "abcdefgh" not in out[4]


def test_long_secrets_are_candidates(docs_of):
    texts = [f'api_key = "{"aB3" * n}"' for n in (6, 66, 67, 3000)] + ['api_key = "' + "aB3" * 3000]
    rows = docs_of(list(enumerate(texts))).select("doc_id", F.size(pii.matches("secret", pii.prepared("secret", F.col("text")))).alias("n"))
    assert [r.n > 0 for r in rows.orderBy("doc_id").collect()] == [True, True, True, True, False]


def test_pii_empty_table(docs_of):
    assert pii.annotate(docs_of([])).collect() == []


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_licenses_against_brute_force(docs_of):
    rng = random.Random(6)
    vocab = "gnu general public license apache cc by mit nc sa lesser isc x é the MIT License".split()
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "-", "\n", "!!"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "MIT License"), (5, "x"), (902, "cc by " * 3000)]
    got = licenses.scan(docs_of(rows)).collect()
    assert len(got) == len(rows)

    def expect(i, t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        ws = WORD.findall(low)
        at = [(s, lab) for p, lab in licenses.BASE.items() for s in range(len(ws)) if ws[s : s + len(p.split())] == p.split()]
        labs = ",".join(sorted({x for _, x in at}))
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        return str(i), len(ws), len(at), str(first), str(last), labs

    want = sorted(expect(i, t) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(docs_of([])).collect() == []


def test_labels_against_brute_force(docs_of):
    rng = random.Random(16)
    known = licenses.templates()
    filler = "the of and software license without files copy x".split()
    rows = []
    for i in range(250):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = list(rng.choice(known).words)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                part[rng.randrange(len(part))] = rng.choice(filler)
            words += [rng.choice(filler) for _ in range(rng.randrange(4))] + part[rng.choice([0, 0, 0, 2]) :]
        rows.append((i, " ".join(words).upper() if i % 3 else "\n".join(words)))
    frame = docs_of(rows)
    idf = licenses.document_frequencies(frame)

    def standing(t, ws):
        for s in range(len(ws) - len(t.words) + 1):
            same = [x == y for x, y in zip(ws[s:], t.words, strict=False)]
            rare = sum(same[k] for k in licenses.indexed(t, idf))
            if all(same) or not t.exact and sum(same) >= licenses.SUPPORT * len(t.words) and rare >= 2:
                return True
        return False

    for r in licenses.scan(frame).collect():
        ws = rows[r.doc_id][1].lower().split()
        found = {t.name for t in known if standing(t, ws)}
        want = sorted({label for label, needed in licenses.rules() if found >= set(needed)})
        assert r.labels == ",".join(want) and (r.score > 0) == bool(found)


def test_scans_ignore_other_columns(docs_of):
    rows = [(1, "MIT License, a@b.co"), (2, None)]
    clash = docs_of(rows).withColumn("words", F.lit("x")).withColumn("hits", F.lit(1)).withColumn("spans", F.lit("y")).withColumn("kind", F.lit("z"))
    assert [(r.base_labels, r.n_words) for r in licenses.scan(clash).orderBy("doc_id").collect()] == [("mit", 5), ("", 0)]
    assert [r.n_email for r in pii.annotate(clash).orderBy("doc_id").collect()] == [1, 0]
    got = pii.redact(clash)
    assert got.columns == clash.columns and [(r.text, r.spans, r.kind) for r in got.orderBy("doc_id").collect()] == [("MIT License, [EMAIL]", "y", "z"), (None, "y", "z")]
