"""Packing token sequences by minimum bin slack.

Each document becomes token ids plus an end id and is cut into full windows and one
remainder.  Remainders are packed by minimum bin slack: over the multiset of
remaining lengths, a bitset subset-sum dynamic programme finds the sum closest to
the window's capacity, and walking the bitsets back gives how many pieces of each
length make it.  That choice is repeated for as many windows as the counts allow, so
a plan has at most about one step per distinct length.  Where even the closest sum
leaves slack, the longest waiting piece is cut to close the window and its rest waits
on.

Scale: packing needs no shuffle.  Every partition packs its own remainders, in
blocks of at most ``block`` pieces (ids shorter than a window each, never texts); what
fills no window in one block waits for the next.  A partition's last ids, fewer than a
window, are cut into sequences whose lengths are powers of two, which need no padding.
A sequence id is the partition number shifted left plus a counter, so a lost task is
simply run again.

Defined cases: null text is empty text (its one token is the end id); a null doc_id
is carried through; repeated rows are packed once each; an empty table gives no rows;
only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import default_tokenizer, tokenizer_bytes

WINDOW = 1024
END_ID = 0
BLOCK = 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The published split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The vocabulary's one special token; ``tokenizers`` matches it inside texts.
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict[int, object] = {}


def vocabulary(ranks_file: bytes):
    """The vocabulary, built once per worker process."""
    key = zlib.crc32(ranks_file)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[key]


def document_encoder(ranks_file: bytes):
    """Token ids of one text as ``tokenizers`` gives them by default: a special token
    written in the text gets its own id."""
    return partial(vocabulary(ranks_file).encode, allowed_special="all")


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length make the sum closest to, and not above,
    ``capacity``; of equal sums the one that uses long pieces first."""
    lengths = sorted(counts, reverse=True)
    mask = (1 << (capacity + 1)) - 1
    reach = [1]
    for n in lengths:
        bits, left, step = reach[-1], min(counts[n], capacity // n), 1
        while left:  # bounded copies in binary parts: 1, 2, 4, ... and the rest
            take = min(step, left)
            bits |= (bits << (take * n)) & mask
            left -= take
            step *= 2
        reach.append(bits)
        if bits >> capacity & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(reach) - 1, 0, -1):
        n, before, used = lengths[i - 1], reach[i - 1], 0
        while not before >> total & 1:
            total -= n
            used += 1
        if used:
            chosen[n] = used
    return chosen


class Packer:
    """Packs the pieces of one partition into rows in the order of SCHEMA.  A piece is
    (doc_id, start, ids, tokens of its document)."""

    def __init__(self, partition: int, window: int):
        self.window, self.next_id = window, partition << 33
        self.waiting: dict[int, list[tuple]] = {}
        self.n_waiting = self.tokens = 0

    def sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def hold(self, piece: tuple) -> None:
        n = len(piece[2])
        self.waiting.setdefault(n, []).append(piece)
        self.n_waiting += 1
        self.tokens += n

    def take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.n_waiting -= 1
        self.tokens -= length
        return piece

    def take_part(self, length: int, most: int) -> tuple:
        """The first ``most`` ids of a piece of ``length``; its rest goes on waiting."""
        doc_id, start, ids, total = self.take(length)
        if length > most:
            self.hold((doc_id, start + most, ids[most:], total))
        return doc_id, start, ids[:most], total

    def closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        sid, offset = self.sequence(), 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sid, offset
            offset += len(ids)

    def windows(self, cutting: bool) -> Iterator[tuple]:
        """Rows of full windows, as long as some can be filled by whole pieces or, with
        ``cutting``, by cutting pieces."""
        while self.tokens >= self.window:
            counts = {n: len(v) for n, v in self.waiting.items()}
            fill = closest_fill(counts, self.window)
            slack = self.window - sum(n * k for n, k in fill.items())
            if slack and not cutting:
                return
            for _ in range(1 if slack else min(counts[n] // k for n, k in fill.items())):
                pieces = [self.take(n) for n, k in fill.items() for _ in range(k)]
                if slack:
                    pieces.append(self.take_part(max(self.waiting), slack))
                yield from self.closed(pieces)

    def rest(self) -> Iterator[tuple]:
        """Rows of everything: full windows, then sequences of powers of two."""
        yield from self.windows(cutting=True)
        while self.tokens:
            room, pieces = 1 << (self.tokens.bit_length() - 1), []
            while room:
                pieces.append(self.take_part(max(self.waiting), room))
                room -= len(pieces[-1][2])
            yield from self.closed(pieces)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Rows of SCHEMA for ``docs`` (doc_id, text).  ``tokenizer`` is the path of a
    ``.tiktoken`` rank file of the vocabulary, read by the driver."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(tokenizer_bytes(tokenizer or default_tokenizer("byte_bpe_50k.tiktoken")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_encoder(ranks.value)
        packer = Packer(TaskContext.get().partitionId(), window)
        out: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                raw, total = np.array(ids, dtype="<u4"), len(ids)
                for start in range(0, total, window):
                    piece = (doc_id, start, raw[start : start + window], total)
                    if total - start >= window:
                        out.extend(packer.closed([piece]))
                    else:
                        packer.hold(piece)
            if packer.n_waiting >= block:
                out.extend(packer.windows(cutting=False))
                if packer.n_waiting >= block:  # no sum fills a window among so many
                    out.extend(packer.windows(cutting=True))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        out.extend(packer.rest())
        if out:
            yield batch_of(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
