"""Web archives: records written to rolling WARC files, read back, and one globally
ordered history of captures.

Writing: a page is a ``response`` record, or a ``revisit`` of the page with the smallest id
among those with its payload.  Each task streams its records, one gzip member each, to
archives of its own that roll at ``ARCHIVE_BYTES``.  Names are unique to a task's attempt and only
archives listed by a finished task are ever read, so a lost executor's files are ignored.

Reading: a task streams an archive member by member, parses headers, and checks lengths
and digests.  Its captures, sorted by (URL key, time, page), are one run of the index.

Index: runs are dealt to key ranges; a task gets its range's slice of every run, still
sorted, and merges the k slices with a loser tree (one path of log2 k matches for each
capture).  Ranges follow the whole key, so a host or URL with a third of all captures
spreads over many; there are enough ranges for about ``RANGE_ROWS`` captures each.
Slices are told apart by run, and one that did not arrive in order counts as several.

Equal payloads are found by SHA-256 with a partial aggregate; only digests that occur more than
once are kept.  Pages meet them by broadcast while there are at most ``BROADCAST_IDS``
(counted first), beyond that by a shuffle with hot digests split off.

Defined cases: null html is an empty payload; a null url has no target and the key "-"; of rows that
repeat the smallest page_id with its payload each is a response; a null page_id
ranks behind all others, and pages without any id are responses; an empty table gives no
archive and no capture; only ``page_id``, ``url`` and ``html`` are read, so others
cannot clash.  Archives are written through ``pyarrow.fs``: shared mounts, HDFS and the usual
object stores.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_path
from .common import BROADCAST_IDS, attach, drop_table, scratch, written

ARCHIVE_BYTES = 64 << 20
RANGE_ROWS = 200_000
LEVEL = 4
CHUNK = 1 << 16
BATCH = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "path string, records long, bytes long"
CAPTURES = (
    "url_key string, timestamp string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "archive string, offset long, length long"
)
NAMES = [f.split()[0] for f in CAPTURES.split(", ")]
KEY = ["url_key", "timestamp", "page_id", "archive", "offset"]
#: Capture times, when pages have none: the page's id in seconds from here.
EPOCH, SPAN_S = datetime.datetime(2000, 1, 1), 250_000_000_000

URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the top domain down, then path and sorted
    query, in lower case, without scheme, user, default port, ``www`` and fragment."""
    if not url:
        return "-"
    found = URL.match(url.strip())
    if not found:
        return url.strip().lower()
    host, port, path, query = found.groups()
    host = re.sub(r"^www\d*\.", "", host.lower())
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in {"80", "443"} else "") + ")" + (path or "/").lower()
    return key + ("?" + "&".join(sorted(query.lower().split("&"))) if query else "")


def capture_time(page_id: int | None) -> datetime.datetime:
    return EPOCH + datetime.timedelta(seconds=(page_id or 0) % SPAN_S)


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def urn_page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def target(url: str) -> str:
    """A URL as it may stand in a header: no white space, controls or non-ASCII."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``, which keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", capture_time(page_id).isoformat() + "Z")]
    if url:
        fields.append(("WARC-Target-URI", target(url)))
    fields += [("WARC-Payload-Digest", "sha1:" + sha1(payload)), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", page_urn(refers_to))], http)


class Archives:
    """Archives of one task, in the folder ``root``."""

    def __init__(self, root: str, limit: int):
        self.system, self.folder = fs.FileSystem.from_uri(root)
        self.root, self.limit = root, limit
        self.system.create_dir(self.folder, recursive=True)
        self.out = None
        self.closed: list[tuple[str, int, int]] = []

    def put(self, raw: bytes) -> None:
        if self.out is None:
            self.name, self.records, self.bytes = uuid.uuid4().hex + ".warc.gz", 0, 0
            self.out = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.member(record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{self.name}>"), ("WARC-Filename", self.name)], b"format: WARC File Format 1.1\r\n"))
        self.member(raw)
        self.records += 1
        if self.bytes >= self.limit:
            self.close()

    def member(self, raw: bytes) -> None:
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = c.compress(raw) + c.flush()
        self.out.write(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.closed.append((f"{self.root}/{self.name}", self.records, self.bytes))
            self.out = None


def revisited(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` with ``refers_to``: null for responses."""
    payload = F.coalesce("html", F.lit(""))
    digest = F.unhex(F.sha2(payload.cast("binary"), 256))
    rows = pages.select("page_id", "url", payload.alias("html"), F.when(F.octet_length(payload) >= least, digest).alias("digest"))
    seen = rows.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = written(seen.filter("n > 1 and first is not null"), "payload-copies")
    few = copies.count() <= BROADCAST_IDS
    met = rows.join(F.broadcast(copies), "digest", "left") if few else attach(rows, copies, "digest", "n")
    return met.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` to archives under ``root``; returns the
    table of archives.  Payloads of fewer than ``least`` bytes are always responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Archives(root, archive_bytes)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                own.put(page_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py()))
        own.close()
        paths, records, sizes = zip(*own.closed, strict=True) if own.closed else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return written(revisited(pages, least).mapInArrow(run, ARCHIVES), "archives")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member of a stream."""
    offset, pending = 0, stream.read(CHUNK)
    while pending:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not pending:
                raise ValueError(f"archive ends inside the record at {offset}")
            parts.append(unpack.decompress(pending))
            used += len(pending) - len(unpack.unused_data)
            pending = unpack.unused_data or stream.read(CHUNK)
        yield offset, used, b"".join(parts)
        offset += used


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:n]


def capture(raw: bytes) -> tuple | None:
    """The first seven columns of CAPTURES for a page's record, None for others."""
    fields, block = parsed(raw)
    kind = fields["WARC-Type"]
    if kind not in {"response", "revisit"}:
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or sha1(payload) != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    time = re.sub("[^0-9]", "", fields["WARC-Date"])
    refers_to = urn_page(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return url_key(fields.get("WARC-Target-URI")), time, urn_page(fields["WARC-Record-ID"]), kind, refers_to, digest, n


def order_of(key: tuple) -> tuple:
    """``key`` (columns KEY) with a null page first."""
    return key[0], key[1], -(1 << 63) if key[2] is None else key[2], key[3], key[4]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in CAPTURES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def read_runs(archives: DataFrame) -> DataFrame:
    """The captures of every archive: a sorted run for each, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place, compression=None) as stream:
                    found = [(*c, path.rpartition("/")[2], at, n) for at, n, raw in members(stream) if (c := capture(raw))]
                found.sort(key=lambda r: order_of((r[0], r[1], r[2], r[7], r[8])))
                for i in range(0, len(found), BATCH):
                    yield batch_of(found[i : i + BATCH])

    n = max(1, archives.count())
    return written(archives.select("path").repartition(n).mapInArrow(run, CAPTURES), "capture-runs")


class LoserTree:
    """Merges sorted lists of (key, value): the root holds the smallest head; a node keeps
    the loser of its match, so that taking a head replays one path only."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self.enter(i)

    def beats(self, a: int, b: int) -> bool:
        """Whether the head of run ``a`` comes before that of ``b``; ended runs come last."""
        x, y = self.runs[a], self.runs[b]
        if self.at[a] >= len(x):
            return False
        return self.at[b] >= len(y) or x[self.at[a]][0] <= y[self.at[b]][0]

    def enter(self, i: int) -> None:
        """A first match waits for its second player; later ones go on upwards."""
        node = (i + self.k) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = i
                return
            if self.beats(held, i):
                self.losers[node], i = i, held
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[object]:
        while self.k:
            i = self.losers[0]
            run, at = self.runs[i], self.at[i]
            if at >= len(run):
                return
            yield run[at][1]
            self.at[i] += 1
            node = (i + self.k) // 2
            while node > 0:
                held = self.losers[node]
                if self.beats(held, i):
                    self.losers[node], i = i, held
                node //= 2
            self.losers[0] = i


def merged(slices: pa.Table) -> list[int]:
    """Row numbers of ``slices`` in key order: rows of a run are taken as they arrive, and
    a run is cut where it does not ascend."""
    open_runs: dict[str, list[tuple]] = {}
    runs: list[list[tuple]] = []
    for i, key in enumerate(zip(*(slices.column(c).to_pylist() for c in KEY), strict=True)):
        own, order = open_runs.get(key[3]), order_of(key)
        if own is None or own[-1][0] > order:
            own = open_runs[key[3]] = []
            runs.append(own)
        own.append((order, i))
    return list(LoserTree(runs))


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in one order: columns of CAPTURES and ``position``, which ascends with
    (URL key, time, page)."""
    spark = runs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrived = list(batches)
        if arrived:
            slices = pa.Table.from_batches(arrived)
            rows, first = merged(slices), TaskContext.get().partitionId() << 33
            for i in range(0, len(rows), BATCH):
                part = rows[i : i + BATCH]
                out = slices.take(pa.array(part, pa.int64())).append_column("position", pa.array(range(first + i, first + i + len(part)), pa.int64()))
                yield from out.combine_chunks().to_batches()

    return runs.repartitionByRange(ranges, *KEY).mapInArrow(run, CAPTURES + ", position long")


def capture_history(pages: DataFrame, root: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under ``root``, and their captures in
    global order.  Without ``root`` the archives go once they were read."""
    spark = pages.sparkSession
    folder = root or scratch(spark, "warc")
    archives = write_archives(pages, folder, least, archive_bytes)
    runs = read_runs(archives)
    history = written(merge_runs(runs), "capture-history")
    for done in (archives, runs):
        drop_table(done)
    if root is None:
        drop_path(spark, folder)
    return history
