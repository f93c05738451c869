"""Web archives: round trip, revisits, the merged index."""

import base64
import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessela.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every row, by comparing all payloads."""
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == payload and i is not None]
        first = min(same) if same and len(payload) >= least else None
        revisit = first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def outcome(found):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)


def some_pages():
    rng = random.Random(12)
    bodies = [None, "", "x", "\r\n\r\n", "WARC/1.1\r\n\r\n", "é漢🙂" * 50, "<p>a</p>" * 300, "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"]
    hosts = ["http://www.Example.com", "https://example.com:443", "http://b.example.com:8080", "ftp://u:p@c.org", "mailto:x@y.z", "http://é.de/ä b"]
    rows = []
    for i in range(300):
        url = rng.choice([*hosts, None])
        url = url and url + rng.choice(["", "/", "/A?b=2&a=1#f", f"/{i}", "/x\r\nWARC-Type: y"])
        rows.append((i - 20, url, rng.choice([*bodies, f"page {i} " * rng.randrange(1, 400)])))
    rng.shuffle(rows)
    return [*rows, (None, "http://n", "x"), (None, None, "alone"), (5, "http://again", rows[5][2]), (7, "http://e", "x"), (7, "http://e", "x"), (1000, "http://long", "long " * 200_000)]


@pytest.mark.parametrize("archive_bytes", [1, 3000, 64 << 20])
def test_history_against_all_pairs(spark, tmp_path, archive_bytes):
    rows = some_pages()
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("x")).withColumn("refers_to", F.lit(1)).withColumn("path", F.lit("p"))
    found = warc.capture_history(pages, root=str(tmp_path / "w"), archive_bytes=archive_bytes).collect()
    assert outcome(found) == expected(rows)
    keys = [warc.order_of(tuple(r[c] for c in warc.KEY)) for r in sorted(found, key=lambda r: r.position)]
    assert keys == sorted(keys) and len({r.position for r in found}) == len(rows)
    for r in random.Random(1).sample(found, 40):  # each capture is a member at its place
        raw = (tmp_path / "w" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        assert warc.capture(gzip.decompress(raw))[:7] == tuple(r)[:7]


def test_archives_by_another_reader(spark, tmp_path):
    rows = some_pages()
    warc.capture_history(spark.createDataFrame(rows, PAGES), root=str(tmp_path / "w"))
    kinds, payloads = [], []
    for path in (tmp_path / "w").glob("*.warc.gz"):
        raw = gzip.decompress(path.read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1" and all(re.fullmatch("[A-Za-z-]+: .+", x) for x in lines[1:])
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            if kinds[-1] == "response":
                payloads.append(rest[:n].partition(b"\r\n\r\n")[2])
            raw = rest[n + 4 :]
    want = expected(rows)
    assert kinds.count("response") + kinds.count("revisit") == len(rows)
    assert kinds.count("revisit") == sum(x[3] == "revisit" for x in want)
    assert {p for p in payloads} == {(h or "").encode() for _, _, h in rows}


def test_small_payloads_are_never_revisits(spark):
    rows = [(i, "http://a", "x" * (i % 4)) for i in range(24)]
    got = warc.capture_history(spark.createDataFrame(rows, PAGES), least=2).collect()
    assert outcome(got) == expected(rows, least=2)


def test_many_copies_go_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_IDS", 0)
    rows = [(i, None, "hot" if i % 3 else f"x{i // 6}") for i in range(300)]
    got = warc.capture_history(spark.createDataFrame(rows, PAGES)).collect()
    assert outcome(got) == expected(rows)


def test_empty_table(spark):
    out = warc.capture_history(spark.createDataFrame([], PAGES))
    assert out.collect() == [] and out.columns == [*warc.NAMES, "position"]


@pytest.mark.parametrize("seed", range(30))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = [sorted((rng.randrange(20), i, j) for j in range(rng.choice([0, 1, 5, 40]))) for i in range(rng.randrange(0, 12))]
    got = list(warc.LoserTree([[(x, x) for x in run] for run in runs]))
    assert got == sorted(x for run in runs for x in run)


def test_damage_is_noticed():
    raw = warc.page_record(1, "http://a", b"payload", None)
    assert warc.capture(raw)[2:] == (1, "response", None, warc.sha1(b"payload"), 7)
    for bad in (raw.replace(b"payload", b"payloaf"), raw[:-1], raw.replace(b"WARC/1.1", b"W")):
        with pytest.raises(ValueError):
            warc.capture(bad)
    packed = gzip.compress(raw)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    assert [x[:2] for x in warc.members(Stream(packed * 3))] == [(i * len(packed), len(packed)) for i in range(3)]
    with pytest.raises(ValueError):
        list(warc.members(Stream(packed[:-9])))


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com", "com,example)/"),
        ("https://example.com:443/A?b=2&a=1#f", "com,example)/a?a=1&b=2"),
        ("http://u:p@b.example.com:8080/x?", "com,example,b:8080)/x"),
        ("mailto:X@y", "mailto:x@y"),
        (None, "-"),
        ("", "-"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key
