"""Alignment of two tokenisations of one text, and how often tokens meet in the corpus.

Arrow batches give the ids and the byte ends of both tokenisations; everything after that is
array functions and joins.  ``array_intersect`` of the ends are the places where both
tokenisations end a token; they cut a text into groups.  Links, pairs of
tokens whose byte ranges overlap, are read off the merged ends: between two
neighbouring ends lies one token of each side, so there is one link for each distinct end
and a text of n and m tokens has fewer than n + m.  In the sorted merge of both
sides an end at place p that is number i of its own side has p - i ends of the other
side before it; a ``transform`` thus finds both tokens of every link from its place alone,
in time that grows with the text.

Corpus counts: links are counted by (A id, B id) with partial aggregates.  A pair with at least
1/``HOT_PAIRS`` of all links is hot (so at most that many are) and goes to the links
by broadcast; other links are counted inside their document first and then shuffled to
their pair.  Nothing of the corpus is gathered anywhere but these counts, which the two
vocabularies bound.

Defined cases: texts that are null, empty, or not given back byte by byte by both
tokenisers have no tokens: zeros and an empty string; rows are told apart by a row id, so
null or repeated doc_ids pass through, and repeated rows count as often as they occur;
an empty table gives no rows; only ``doc_id`` and ``text`` are read, so other columns
cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, default_tokenizer, drop_table, tokenizer_bytes, written
from .packing import SPLIT

TOKENS = "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
HOT_PAIRS = 200_000
ROWS = 500
MARK = "▁"
#: A packed end is a long of end, side (one bit) and number on its side.
NUMBER_BITS = 31
NUMBER = (1 << NUMBER_BITS) - 1

_sides: dict[int, object] = {}


class ByteSide:
    """Byte-level vocabulary; its special token's string is plain text."""

    def __init__(self, ranks_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("alignment", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int32)
        for piece, i in ranks.items():
            self.sizes[i] = len(piece)

    def tokens(self, text: str) -> np.ndarray:
        """Ids of a space and the text; the vocabulary has every byte, and the split pattern
        every character, so that their bytes are the text's."""
        return self.encoding.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int32)


class PieceSide:
    """Piece vocabulary with byte fallback, which puts a space in front itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.pieces = [bytes([int(n[1:-1], 16)]) if sp.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.sizes = np.array([len(p) for p in self.pieces], np.int32)

    def tokens(self, text: str) -> tuple[np.ndarray, bytes]:
        ids = self.library.encode(text)
        return np.array(ids, np.int32), b"".join([self.pieces[i] for i in ids])


def side(kind: type, file: bytes):
    """A tokeniser, built once per worker process."""
    key = zlib.crc32(file)
    if key not in _sides:
        _sides[key] = kind(file)
    return _sides[key]


def tokenised(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of TOKENS; ends are byte offsets in a space and the text."""
    sc = docs.sparkSession.sparkContext
    a_file, b_file = sc.broadcast(tokenizer_bytes(a_path)), sc.broadcast(tokenizer_bytes(b_path))
    names = [f.split()[0] for f in TOKENS.split(", ")]

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        at = np.zeros(len(arrays) + 1, np.int32)
        np.cumsum([len(x) for x in arrays], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, none = side(ByteSide, a_file.value), side(PieceSide, b_file.value), np.empty(0, np.int32)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                if text:
                    whole, ia, (ib, made) = (" " + text).encode(), a.tokens(text), b.tokens(text)
                    a_ends, b_ends = np.cumsum(a.sizes[ia], dtype=np.int32), np.cumsum(b.sizes[ib], dtype=np.int32)
                    if a_ends[-1] == len(whole) and made == whole:
                        rows.append((ia, a_ends, ib, b_ends))
                        continue
                rows.append((none,) * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(lists([r[k] for r in rows]) for k in range(4))], names)

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def packed(ends: str, side_bit: int) -> Column:
    return F.transform(ends, lambda e, i: e * F.lit(1 << (NUMBER_BITS + 1)) + (i + F.lit(side_bit)))


def meetings(merged: str) -> Column:
    """For every packed end in column ``merged`` (both sides in order, A first where they are
    equal) the tokens over the stretch that it closes, as A number << 31 | B number.  A B
    end equal to the A end before it closes no stretch but a group: it gives the numbers
    of tokens used so far, packed alike and negated."""
    number, one_less = F.lit(NUMBER), F.lit(NUMBER).cast("long")

    def meet(v: Column, p: Column) -> Column:
        # with k = 2^31: A number i at place p is i * k + (p - i), B number j is (p - j) * k + j
        own = v.bitwiseAND(number) * one_less
        tied = F.get(merged, p - 1).bitwiseXOR(v) < F.lit(1 << (NUMBER_BITS + 1))
        at = p * F.lit(1 << NUMBER_BITS)
        return F.when(v.bitwiseAND(F.lit(1 << NUMBER_BITS)) == 0, own + p).when(tied, own - at - 1).otherwise(at - own)

    return F.transform(merged, meet)


def group_texts(used: str, a_names: str, b_names: str) -> Column:
    """``a1,a2|b1`` for every group; ``used`` holds the packed numbers of tokens used up to
    its end."""
    number = F.lit(NUMBER)
    a_number, b_number = lambda x: F.shiftright(x, NUMBER_BITS).cast("int"), lambda x: x.bitwiseAND(number).cast("int")

    def ids(names: str, first: Column, end: Column) -> Column:
        # not slice, which copies all of the array it cuts from
        return F.array_join(F.transform(F.sequence(first, end - 1), lambda i: F.get(names, i)), ",")

    def group(before: Column, x: Column) -> Column:
        one = F.concat(F.get(a_names, a_number(before)), F.lit("|"), F.get(b_names, b_number(before)))
        more = F.concat(ids(a_names, a_number(before), a_number(x)), F.lit("|"), ids(b_names, b_number(before), b_number(x)))
        return F.when(x - before == F.lit((1 << NUMBER_BITS) + 1), one).otherwise(more)

    starts = F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col(used)), F.lit(1), F.size(used))
    return F.zip_with(starts, used, group)


def aligned(tokens: DataFrame, b_size: int, hashed: bool = False) -> DataFrame:
    """Per row of ``tokens``: rid, doc_id, n_a, n_b, n_groups, n_links, groups (their text or
    its SHA-256), and ``links``, for every link A id * ``b_size`` + B id."""
    text = F.array_join(group_texts("used", "a_names", "b_names"), ";")
    step = tokens.withColumns({
        "rid": F.monotonically_increasing_id(), "common": F.array_intersect("a_ends", "b_ends"),
        "merged": F.sort_array(F.concat(packed("a_ends", 0), packed("b_ends", 1 << NUMBER_BITS))),
        "a_names": F.col("a_ids").cast("array<string>"), "b_names": F.col("b_ids").cast("array<string>"),
    }).withColumn("met", meetings("merged"))
    step = step.withColumns({"pairs": F.filter("met", lambda x: x >= 0), "used": F.transform(F.filter("met", lambda x: x < 0), lambda x: -x)})
    if hashed:
        text = F.when(F.size("a_ids") == 0, F.lit("")).otherwise(F.sha2(text.cast("binary"), 256))

    def ids(x: Column) -> Column:
        return F.get("a_ids", F.shiftright(x, NUMBER_BITS).cast("int")) * F.lit(b_size) + F.get("b_ids", x.bitwiseAND(F.lit(NUMBER)).cast("int"))

    return step.select(
        "rid", "doc_id", F.size("a_ids").cast("long").alias("n_a"), F.size("b_ids").cast("long").alias("n_b"), F.size("common").cast("long").alias("n_groups"),
        F.size("pairs").cast("long").alias("n_links"), text.alias("groups"), F.transform("pairs", ids).alias("links"),
    )


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best) of every id pair in ``links`` (links): how many links hold it, and
    whether no other pair of its B id has more."""
    counts = written(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    b = F.col("pair") % b_size
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    return written(out, "pairs")


def link_sums(links: DataFrame, pairs: DataFrame, hot_pairs: int) -> DataFrame:
    """(rid, n_best, count_sum) of the rows of ``links`` (rid, links) that have any."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    hot = pairs.filter(F.col("n") * hot_pairs >= total)
    cold = pairs.filter(F.col("n") * hot_pairs < total)
    each = links.select("rid", F.explode("links").alias("pair")).join(F.broadcast(hot), "pair", "left")
    cold_pair = F.when(F.col("n").isNull(), F.col("pair")).alias("pair")
    met = written(each.groupBy("rid", cold_pair).agg(F.count(F.lit(1)).alias("times"), F.sum("best").alias("best_sum"), F.sum("n").alias("n_sum")), "link-sums")
    known = met.filter("pair is null").select("rid", "best_sum", "n_sum")
    rest = met.filter("pair is not null").select("rid", "pair", "times").join(cold.hint("merge"), "pair")
    rest = rest.select("rid", (F.col("times") * F.col("best")).alias("best_sum"), (F.col("times") * F.col("n")).alias("n_sum"))
    return known.unionByName(rest).groupBy("rid").agg(F.sum("best_sum").alias("n_best"), F.sum("n_sum").alias("count_sum"))


def align(docs: DataFrame, a_tokenizer: str | None = None, b_tokenizer: str | None = None, hot_pairs: int = HOT_PAIRS, hashed: bool = False) -> DataFrame:
    """Aligned tokenisations of ``docs`` (doc_id, text): the columns of ``aligned``, n_best
    and count_sum.  Tokenizer files (a ``.tiktoken`` rank file, a piece model) are read by
    the driver.  ``hashed`` keeps of the groups' text its SHA-256 only ('' without tokens)."""
    b_path = b_tokenizer or default_tokenizer("piece_bpe_32k.model")
    b_size = len(PieceSide(tokenizer_bytes(b_path)).sizes)
    tokens = tokenised(docs, a_tokenizer or default_tokenizer("byte_bpe_50k.tiktoken"), b_path)
    with arrow_rows(docs.sparkSession, ROWS):
        own = written(aligned(tokens, b_size, hashed), "alignment", compression="zstd")
    pairs = pair_counts(own, b_size)
    sums = link_sums(own, pairs, hot_pairs)
    return own.join(sums, "rid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def digest(docs: DataFrame, **options) -> DataFrame:
    """What the query returns: the numbers, and the groups as a hash."""
    found = align(docs, hashed=True, **options)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
