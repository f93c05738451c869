"""Encoding and decoding with a merge-type piece vocabulary.

A text gets a space in front, spaces become the word mark, and the symbols (at first
single characters) are merged in the order of an agenda: a heap of adjacent pairs
whose concatenation is a piece, best score first and leftmost first among equals;
every merge puts the two new neighbouring pairs on the agenda, and entries whose
symbols have changed since are skipped.  Of a short chunk the agenda is the list of its
pairs' scores in the order of places, from which the least is taken, without entries to
skip.  What is no piece falls back to bytes.

No piece of such vocabularies holds a character before a word mark, or a line break;
that is verified when the vocabulary is loaded, and texts are then cut there without
changing any merge (otherwise a text is one chunk).  Chunks repeat, so each worker
keeps two generations of at most ``CACHE`` chunks of at most ``CACHED_CHARS`` characters
with their ids and what these ids decode to; longer chunks are done each time.

After every Arrow batch, all chunks that were new in it are given to the sentencepiece
library as one text with line breaks between, together with the first ``check_rows`` rows;
ids and decoded text must be equal, or the task fails.

Defined cases: null text is empty text, which has no ids; repeated rows and null
doc_ids pass through; an empty table gives no rows; only ``doc_id`` and ``text`` are read,
so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import default_tokenizer, tokenizer_bytes

MARK = "▁"
CACHE, CACHED_CHARS = 400_000, 64
#: Chunks of at most so many characters have their agenda as a list.
SHORT = 48
NEVER = math.inf
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_codecs: dict[int, "PieceCodec"] = {}


class PieceCodec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        #: what each id decodes to, nothing for control and unknown ids
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(name[1:-1], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(name.replace(MARK, " ").encode())
                self.pieces[name] = (-sp.get_score(i), i)
        self.scores = {name: found[0] for name, found in self.pieces.items()}
        whole = any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces)
        self.cut = re.compile("[^$]*|$" if whole else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
        self.whole = whole
        #: chunk -> (its ids as decimal text, what they decode to)
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.new: list[str] = []

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk, by the agenda."""
        get = self.pieces.get
        ids: list[int] = []
        for s in self.merged_short(chunk) if len(chunk) <= SHORT else self.merged_long(chunk):
            found = get(s)
            if found:
                ids.append(found[1])
            else:
                ids.extend([self.byte_ids[x] for x in s.encode()])
        return ids

    def merged_short(self, chunk: str) -> list[str]:
        """Symbols of a chunk; the agenda has one score for each pair, never for no piece."""
        score, symbols = self.scores.get, list(chunk)
        agenda = list(map(score, map(add, chunk, chunk[1:]), repeat(NEVER)))
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            del agenda[i]
            symbols[i] = made = symbols[i] + symbols.pop(i + 1)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + made, NEVER)
            if i < len(agenda):
                agenda[i] = score(made + symbols[i + 1], NEVER)
        return symbols

    def merged_long(self, chunk: str) -> list[str]:
        """Symbols of a chunk.  A symbol is its first and its end place; an entry
        (score, first, middle, end) holds while its two symbols stand so."""
        get, n = self.pieces.get, len(chunk)
        before, ends = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(found[0], a, a + 1, a + 2) for a in range(n - 1) if (found := get(chunk[a : a + 2]))]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, end = heappop(agenda)
            if ends[a] != b or ends[b] != end:
                continue
            ends[a], ends[b] = end, 0
            if end < n:
                before[end] = a
                found = get(chunk[a : ends[end]])
                if found:
                    heappush(agenda, (found[0], a, end, ends[end]))
            c = before[a]
            if c >= 0:
                found = get(chunk[c:end])
                if found:
                    heappush(agenda, (found[0], c, a, end))
        symbols: list[str] = []
        a = 0
        while a < n:
            symbols.append(chunk[a : ends[a]])
            a = ends[a]
        return symbols

    def coded(self, chunk: str) -> tuple[str, str]:
        """A chunk's ids as decimal text and their decoded text, from the cache if they
        are there."""
        got = self.old.get(chunk)
        if got is None:
            ids = self.merge(chunk)
            got = ",".join(map(str, ids)), self.decode(ids, first=False)
            self.new.append(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[chunk] = got
        return got

    def verify(self, texts: list[str]) -> None:
        """Raises unless the library agrees on ``texts`` and on all chunks made since the
        last call."""
        # a line break in front, as the library puts a mark before the first line
        fresh = "\n".join(["", *self.new]).replace(MARK, " ") if self.new else ""
        for text in [*texts, *([fresh] if fresh else [])]:
            ids, decoded = self.encode_text(text)
            expected = self.library.encode(text)
            if ",".join(map(str, expected)) != ids or self.library.decode(expected) != decoded:
                raise ValueError(f"ids differ from the library's: {text[:80]!r}")
        self.new.clear()

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.whole else self.cut.findall(marked)

    def encode_text(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by commas, the text they decode to)."""
        get = self.young.get
        found = [get(c) or self.coded(c) for c in self.chunks(text)]
        return ",".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ``ids``; byte pieces are read as UTF-8; with ``first``, the space
        in front of the first piece goes."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", errors="replace")
        return text[1:] if first and text[:1] == " " else text


def codec(model: bytes) -> PieceCodec:
    key = zlib.crc32(model)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str | None = None, check_rows: int = 1) -> DataFrame:
    """Rows of SCHEMA for ``docs`` (doc_id, text).  ``tokenizer`` is the path of the
    model file, read by the driver."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tokenizer_bytes(tokenizer or default_tokenizer("piece_bpe_32k.model")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids, decoded = own.encode_text(value.as_py() or "")
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(sha(ids))
                text_sha.append(sha(decoded))
            own.verify([t.as_py() or "" for t in batch.column(1)[:check_rows]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
