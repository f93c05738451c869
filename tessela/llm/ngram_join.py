"""Exact n-gram Jaccard self-join as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set and a column for each
five-word shingle; overlaps are entries of its product with its transpose.  Columns are
dealt to blocks by hash and a block multiplies only its own columns, so no task sees
the whole matrix.  Size-derived bounds keep the product sparse:

* of a set of n shingles only the first n - ceil(3n/4) + 1 in a fixed order of columns
  enter the product: two linked sets share one of these;
* the order puts columns met often last (counted over all documents), so that wide
  columns do not enter at all unless a set consists of little else;
* a pair is dropped where its sizes, what its positions leave over, or the parity
  sketches of its two rows cannot reach the overlap that linking needs: ceil(3(n+m)/7).

A parity sketch holds, for each of a number of classes of columns, whether a row has an
odd number of them; every bit that differs stands for at least one column of only one of
the rows, so the bound never fails a link.  Every row has one of ``SKETCH`` bits, a long
one also one that grows with its size (about a thirtieth of the row).

A column of many sets is not multiplied out: it is first tied to its best placed set, a
star of as many pairs as members.  The pairs that pass the bounds are dealt by their first
row, a much paired one to several tasks, and a task meets each row of a pair once: the
overlap is accumulated column block by column block and given up as soon as what is left
cannot reach the bound.  Links are contracted to components, and in
columns whose members still lie in several components the members outside the centre's
component meet the others, behind the same bounds.

Equal sets are one row of the matrix, merged per batch before anything is shuffled;
documents join their set's verdict with hot sets by broadcast.

Defined cases: null or wordless text has no shingle, size 0 and is its own component;
fewer than five words are one shingle; a null doc_id never names a component unless
all its members are null; repeated rows are equal sets; an empty table gives no rows;
``join`` reads ``doc_id`` and ``text`` only, ``survivors`` keeps other columns whatever
their names.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_rows, attach, drop_table, unused, written
from .components import components

WORDS = 5
#: A column counts as wide from so many sets on; at most so many wide columns are ordered.
WIDE, MAX_WIDE = 16, 400_000
#: Sets that share a column in one batch before it is reported for counting.
LOCAL_WIDE = 2
#: Bytes of postings that a block is meant to hold.
BLOCK_BYTES = 8 << 20
#: Rows of an Arrow batch, and shingles that a worker holds before it sends on.
ARROW_ROWS, HELD = 1000, 2_400_000
#: Bits of every row's parity sketch, held in longs; longer sketches have two bits a column.
SKETCH = 512
PARITY = [f"p{i}" for i in range(SKETCH // 64)]
#: Bounds of the blocks of columns over which an overlap is accumulated.
BLOCK_CUTS = np.arange(1, 4, dtype=np.uint64) << np.uint64(62)
#: Pairs of one first row that a task takes on.
FIRST_PAIRS = 500
_WORD_CACHE = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the A-Z-lowered words of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def parity(s: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parity sketch of a set, in bytes: for each class of shingles, whether their number
    is odd.  ``bits`` is a power of two."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def long_sketch(s: np.ndarray) -> bytes | None:
    """A sketch of two bits or more a column, for sets that fill the short one."""
    return parity(s, 1 << (2 * len(s) - 1).bit_length()).tobytes() if 2 * len(s) > SKETCH else None


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the size of the symmetric difference, from two sketches in bytes;
    the longer one is folded to the shorter's classes."""
    if len(x) < len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(folded ^ y).sum())


def prefix_size(n):
    return n - (3 * n + 3) // 4 + 1


def index_size(n):
    """Positions below this can start a link with a set that is not smaller."""
    return n - (6 * n + 6) // 7 + 1


def needed(n, m):
    """Least overlap of linked sets of these sizes: 100 * i >= 75 * (n + m - i)."""
    return (3 * (n + m) + 6) // 7


def repeated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) of the values that occur at least LOCAL_WIDE times; uses up
    ``parts``, so that few copies are alive at a time."""
    every = np.concatenate(parts)
    parts.clear()
    every.sort()
    again = np.flatnonzero(every[1:] == every[:-1])
    h, c = np.unique(every[again], return_counts=True)
    return h[c + 1 >= LOCAL_WIDE], c[c + 1 >= LOCAL_WIDE] + 1


def text_hash() -> Column:
    """Tells rows apart that share a doc_id, or have none."""
    return F.xxhash64("text")


def membership(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, n, sid, parity sketch) of documents, and rows (shingle,
    seen) of columns that several sets of one batch share."""
    names_of = ["doc_id", "text_hash", "n", "sid", "shingle", "seen", *PARITY, "sketch"]
    none = lambda m: pa.nulls(m, pa.int64())

    def wide_rows(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if parts:
            h, c = repeated(parts)
            m = len(h)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [none(m), none(m), none(m), none(m), pa.array(h.view(np.int64)), pa.array(c, pa.int64()), *[none(m) for _ in PARITY], pa.nulls(m, pa.binary())],
                    names_of,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, held = set(), [], 0
        for batch in batches:
            sizes, names, sets, odd, long = [], [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py())
                sizes.append(len(s))
                names.append(set_id(s) if len(s) else None)
                odd.append(parity(s).view(np.int64))
                long.append(long_sketch(s))
                if len(s) and names[-1] not in seen:
                    seen.add(names[-1])
                    sets.append(s)
            k = len(sizes)
            bits = np.stack(odd) if odd else np.zeros((0, len(PARITY)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), none(k), none(k)]
                + [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(PARITY))]
                + [pa.array(long, pa.binary())],
                names_of,
            )
            if sets:
                parts.append(np.concatenate(sets))
                held += len(parts[-1])
            if held >= HELD:
                yield from wide_rows(parts)
                seen, parts, held = set(), [], 0
        yield from wide_rows(parts)

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(run, ", ".join(f"{c} long" for c in names_of[:-1]) + ", sketch binary")


def wide_columns(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, rank by frequency from 1) of the widest columns: a bounded
    table.  It only orders columns, so leaving one out loses no link."""
    top = counts.groupBy("shingle").agg(F.sum("seen").alias("c")).filter(F.col("c") >= WIDE).orderBy(F.desc("c"), "shingle").limit(MAX_WIDE)
    got = top.toPandas()
    h = got["shingle"].to_numpy(np.int64).view(np.uint64)
    rank = np.arange(len(h), 0, -1, dtype=np.int64)
    order = np.argsort(h)
    return h[order], rank[order]


def ranks(h: np.ndarray, wide: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, rank = wide
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, rank[at], 0)


POSTING = np.dtype([("h", "<u8"), ("sid", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def postings(docs: DataFrame, wide: tuple[np.ndarray, np.ndarray], n_blocks: int) -> DataFrame:
    """Packed prefix postings, one row for each batch and block."""
    sent = docs.sparkSession.sparkContext.broadcast(wide)

    def packed(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        rows = np.concatenate(parts)
        parts.clear()
        block = ((rows["h"] >> np.uint64(24)) % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        rows, block = rows[order], block[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        blobs = [x.tobytes() for x in np.split(rows, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(block[np.concatenate([[0], cuts])], pa.int64()), pa.array(blobs, pa.binary())], ["block", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, held = set(), [], 0
        for batch in batches:
            for t in batch.column(0):
                s = shingle_set(t.as_py())
                name = set_id(s) if len(s) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                rank = ranks(s, sent.value)
                if rank.any():
                    s = s[np.argsort(rank, kind="stable")]
                n = len(s)
                p = int(prefix_size(n))
                rows = np.empty(p, POSTING)
                rows["h"], rows["sid"], rows["n"], rows["pos"] = s[:p], name, n, np.arange(p)
                parts.append(rows)
                held += n
            if held >= HELD:
                yield from packed(parts)
                seen, held = set(), 0
        yield from packed(parts)

    return docs.select("text").mapInArrow(run, "block long, rows binary")


def products(packed: DataFrame, n_blocks: int) -> DataFrame:
    """Multiplies each block.  Rows: (a, b, null, null) is a pair to verify, a the
    centre of its star; (column, sid, n, pos) is a member of a column with further pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(b.as_py(), POSTING) for batch in batches for b in batch.column("rows")]
        if not parts:
            return
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.argsort(rows["h"])]
        same = rows["h"][1:] == rows["h"][:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rows = np.unique(rows[shared])  # equal postings came from different batches
        rows = rows[np.lexsort((rows["sid"], rows["n"], rows["pos"], rows["h"]))]
        if len(rows) < 2:
            return
        start = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
        size = np.diff(np.append(start, len(rows)))
        hub = np.repeat(start, size)
        n, pos = rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
        m, mpos = n[hub], pos[hub]
        good = (np.arange(len(rows)) != hub) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
        good &= np.minimum(n - pos, m - mpos) >= needed(n, m)
        pairs = np.unique(np.stack([rows["sid"][hub][good], rows["sid"][good]], 1), axis=0)
        yield table(pairs[:, 0], pairs[:, 1], None, None)
        # a further pair needs three members, one of them placed well enough to be the smaller
        able = np.logical_or.reduceat(pos < index_size(n), start) & (size >= 3)
        more = np.repeat(able, size)
        for i in range(0, int(more.sum()), 1 << 18):
            at = np.flatnonzero(more)[i : i + (1 << 18)]
            yield table(rows["h"][at].view(np.int64), rows["sid"][at], n[at], pos[at])

    return packed.repartition(n_blocks, "block").select("rows").mapInArrow(run, "a long, b long, n long, pos long")


def table(a, b, n, pos) -> pa.RecordBatch:
    k = len(a)
    col = lambda x: pa.nulls(k, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x), pa.int64())
    return pa.RecordBatch.from_arrays([col(a), col(b), col(n), col(pos)], ["a", "b", "n", "pos"])


def sketched(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that the parity sketches leave possible."""
    side = lambda own, tag: owners.select(F.col("sid").alias(own), F.col("n").alias(f"n{own}"), *[F.col(p).alias(f"{p}{own}") for p in PARITY]).hint(tag)
    both = pairs.distinct().join(side("a", "merge"), "a").join(side("b", "merge"), "b")
    return both.filter(F.expr(PARITY_BOUND)).select("a", "b")


#: Of linked sets, at most na + nb - 2 * ceil(3 (na + nb) / 7) columns are in only one.
PARITY_BOUND = " + ".join(f"bit_count({p}a ^ {p}b)" for p in PARITY) + " <= na + nb - 2 * ((3 * (na + nb) + 6) div 7)"


def narrowed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that the long sketches leave possible too; ``rows`` is the
    membership.  Pairs of short rows pass."""
    wanted = ends(pairs)
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    known = rows.filter("sketch is not null").join(side, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    one = lambda own: known.select(F.col("sid").alias(own), F.col("n").alias(f"n{own}"), F.col("sketch").alias(f"s{own}"))
    both = pairs.join(one("a"), "a", "left").join(one("b"), "b", "left").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).fill_null(0).to_numpy() for i in (2, 3))
            most = n + m - 2 * needed(n, m)
            keep = np.ones(len(most), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                if x.is_valid and y.is_valid:
                    keep[i] = least_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= most[i]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def do_link(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two rows link: their overlap is accumulated block by block, and the pair is
    discarded when it and what is left stay below the bound."""
    need, got = needed(len(p), len(q)), 0
    ends_p, ends_q = ([0, *np.searchsorted(x, BLOCK_CUTS), len(x)] for x in (p, q))
    for i in range(len(ends_p) - 1):
        x, y = p[ends_p[i] : ends_p[i + 1]], q[ends_q[i] : ends_q[i + 1]]
        if len(x) and len(y):
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            got += int((y[at] == x).sum())
        if got + min(len(p) - ends_p[i + 1], len(q) - ends_q[i + 1]) < need:
            return False
    return True


def routes(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """(sid, doc_id, a, salt, turn): which rows go where.  The first row of a pair goes, as
    turn 0, to every task that takes on some of its pairs; second rows have turn 1."""
    share = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FIRST_PAIRS).cast("int").alias("parts"))
    first = share.select(F.col("a").alias("sid"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("turn"))
    second = pairs.join(share, "a").select(F.col("b").alias("sid"), "a", F.pmod(F.hash("b"), "parts").alias("salt"), F.lit(1).alias("turn"))
    return first.unionByName(second).join(owners.select("sid", F.col("doc_id").alias("owner"), "owner_hash"), "sid")


def verified(docs: DataFrame, pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact overlap links them, as a written table.  Rows of the
    matrix are made from the one document that owns each and shuffled once."""
    wanted = written(routes(pairs, owners), "routes")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    own = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    mine = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("text_hash") == F.col("owner_hash"))
    named = own.join(side, mine).select("a", "salt", "turn", "sid", "text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name, items = None, None, b""
        for batch in batches:
            keep, sets = [], []
            for i, (sid, t) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4), strict=True)):
                text = t.as_py()
                if text != last:
                    s = shingle_set(text)
                    last, name, items = text, set_id(s) if len(s) else None, s.tobytes()
                if name == sid:  # other texts may have its hash
                    keep.append(i)
                    sets.append(items)
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[picked.column(j) for j in range(4)], pa.array(sets, pa.binary())], ["a", "salt", "turn", "sid", "items"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first = None, None
        for batch in batches:
            found = []
            for a, salt, turn, sid, items in zip(*[batch.column(j).to_pylist() for j in range(4)], batch.column(4), strict=True):
                if turn == 0:
                    current, first = (a, salt), np.frombuffer(items.as_py(), "<u8")
                elif current == (a, salt) and do_link(first, np.frombuffer(items.as_buffer(), "<u8")):
                    found.append((a, sid))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = named.mapInArrow(rows_of, "a long, salt int, turn int, sid long, items binary").repartition("a", "salt").sortWithinPartitions("a", "salt", "turn")
    out = written(dealt.mapInArrow(meet, "a long, b long").distinct(), "links")
    drop_table(wanted)
    return out


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()


def open_pairs(members: DataFrame, roots: DataFrame, owners: DataFrame) -> DataFrame:
    """Pairs of sets that share a column, lie in different components and pass the
    bounds.  In a column, members outside the component of its best placed set (the
    centre, which has met every member already) meet all others."""
    labelled = members.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    centre = F.min_by(F.struct("sid", "root"), F.struct("pos", "n", "sid"))
    split = labelled.groupBy("column").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), centre.alias("hub")).filter("lo <> hi")
    still = labelled.join(split.select("column", "hub"), "column").filter("sid <> hub.sid").withColumn("outside", F.expr("root <> hub.root"))
    still = written(still.drop("hub").join(owners.select("sid", *PARITY), "sid"), "open-columns")
    side = lambda own: still.select("column", *[F.col(c).alias(f"{c}{own}") for c in ("sid", "n", "pos", "root", "outside", *PARITY)])
    # the smaller set (of equal ones the smaller id) must be placed in its index part
    near = F.expr(
        "roota <> rootb AND (NOT outsideb OR sida < sidb) AND 4 * least(na, nb) >= 3 * greatest(na, nb) "
        "AND IF(na < nb OR (na = nb AND sida < sidb), posa < na - (6 * na + 6) div 7 + 1, posb < nb - (6 * nb + 6) div 7 + 1) "
        f"AND least(na - posa, nb - posb) >= (3 * (na + nb) + 6) div 7 AND {PARITY_BOUND}"
    )
    met = side("a").filter("outsidea").join(side("b"), "column").filter(near)
    return met.select(F.least("sida", "sidb").alias("a"), F.greatest("sida", "sidb").alias("b")).distinct()


def join(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    # everything that runs Python is written before this returns
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _join(docs)


def _join(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = written(membership(docs), "membership")
    member = rows.filter("n is not null").select("doc_id", F.col("n").alias("n_shingles"), "sid")
    wide = wide_columns(rows.filter("shingle is not null"))
    total = member.agg(F.sum("n_shingles")).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * POSTING.itemsize // (4 * BLOCK_BYTES), 1)
    found = written(products(postings(docs, wide, n_blocks), n_blocks), "products")
    first = lambda c: F.min(c).alias(c)  # noqa: E731  equal in all rows of a set
    owner_hash = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))
    each = rows.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), owner_hash.alias("owner_hash"), F.count(F.lit(1)).alias("copies"), first("n"), *map(first, PARITY))
    owners = written(each, "owners")
    stars = written(sketched(found.filter("n is null").select("a", "b"), owners), "stars")
    pairs = written(narrowed(stars, rows), "pairs")
    links = verified(docs, pairs, owners)
    roots = components(links, "a", "b")
    members = found.filter("n is not null").select(F.col("a").alias("column"), F.col("b").alias("sid"), "n", "pos")
    rest = written(open_pairs(members, roots, owners), "open-pairs")
    if not rest.isEmpty():
        likely = written(narrowed(rest, rows), "likely-pairs")
        links = links.unionByName(verified(docs, likely, owners))
        roots = components(links, "a", "b")
    named = owners.select("sid", "doc_id", "copies").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    verdict = written(named.join(least, "root").select("sid", "component_id", "copies"), "verdicts")
    out = attach(member, verdict, "sid", "copies")
    for done in (found, stars, pairs, rest, owners):
        drop_table(done)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("sid").isNull(), F.col("doc_id"))).alias("component_id"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id.  Rows with
    a null doc_id stay."""
    name = unused("near_copy", docs)
    gone = join(docs).filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    ids = written(gone, "near-copies")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return docs.join(side, docs["doc_id"] == ids[name], "left_anti")
