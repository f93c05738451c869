"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

A line is lower-cased (A-Z) and trimmed; its shingles are all runs of ``SHINGLE``
characters, hashed to 64 bits.  Lines are exploded to shingles and aggregated to a MinHash
signature: for each of ``BANDS`` * ``ROWS`` masks the least shingle hash after
XOR with the mask.  The masks differ in their top bits, so that the minima come from
different parts of the hash range; each equals that of another line with a chance of the
Jaccard similarity.  ``ROWS`` neighbouring minima make a bucket key: at a similarity of
0.75 no key is shared in about 1 % of the cases.  A line whose minima stand for at most
``FEW`` different shingles is short or repetitive; each of these shingles is one more key
of it, which lines with few shingles cannot miss.

Pairs that agree in fewer than ``AGREE`` minima are given up (of pairs at 0.75 three in a
thousand are lost by this; lines of few shingles are exempt).

Within a bucket every line is paired with one centre, the line whose buckets hold most
lines.  Exact Jaccard over the shingles decides the pairs that are left; links are united by
distributed star contractions.  Lines of buckets that still lie in several components get
the size of their shingle set and its parity sketch: for each of ``BITS`` classes of
shingles, whether the set has an odd number of them.  Bits that differ bound the difference
of two sets from below, so pairs whose sketches differ too much for the similarity are given
up without a loss.  First each line meets one line of those that share two bands with it,
another for other bands; then, in buckets that the new links leave in several components,
the lines outside the centre's component meet the others.  The last step is still quadratic
in the lines of a bucket that belong to no common component.  One line of a component stays:
the earliest by (doc_id, line number).

Texts are split once and kept as a table; only keys, minima and sketches are shuffled, texts
only for lines that share a bucket; copies are merged map-side first.  Shingles are hashed
``WIDE`` or ``SPAN`` at a time, so that a row stands for several of them.  Lines join their
component's verdict with hot lines by broadcast.

Defined cases: null text has no lines; blank lines are kept and belong to no component;
a line shorter than a shingle is its own only shingle; of lines with the same doc_id and
number (repeated rows) the first written stays; null doc_ids rank last; an empty table
gives no rows; only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, ascii_lower, attach, drop_table, text_of, written
from .components import components

SHINGLE = 10
SIMILARITY = 0.75
#: Minima in a bucket key, keys of a line, and minima that a pair must agree in.
ROWS, BANDS, AGREE = 2, 6, 5
#: Up to so many different shingles behind the minima, these are keys too.
FEW = 9
#: Bits of a parity sketch, held in longs.
BITS = 1024
#: Pairs of longer lines are written before their shingles are cut.
LONG = 100_000
#: Neighbouring shingles in one row, for minima and for sets.
WIDE, SPAN = 8, 32


def masks() -> list[int]:
    """Multiples of the golden ratio of the 64-bit range, which spreads their top bits."""
    found = [(0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64) for j in range(ROWS * BANDS)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


MINIMA = [f"m{j}" for j in range(ROWS * BANDS)]
WORDS = BITS // 64


def normal(line: Column) -> Column:
    return F.trim(ascii_lower(line))


def last_start(line: Column) -> Column:
    """Offset of a line's last shingle."""
    return F.greatest(F.length(line) - SHINGLE, F.lit(0))


def points_of(line: Column) -> Column:
    """Four bytes for each character: a shingle is then cut out in constant time."""
    return F.encode(line, "UTF-32")


def shingle_hash(points: str, start: str) -> str:
    return f"xxhash64(substring({points}, 4 * {start} + 1, {4 * SHINGLE}))"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (normalised), lid (null for blank lines)."""
    each = docs.filter("text is not null").select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "raw"))
    each = each.select("doc_id", F.col("line_no").cast("long").alias("line_no"), normal(F.col("raw")).alias("line"))
    return each.withColumn("lid", F.when(F.col("line") != "", F.xxhash64("line")))


def hashed_shingles(points: str) -> Column:
    """Hashes of the shingles of the line in column ``points``."""
    return F.expr(f"transform(sequence(0, greatest(octet_length({points}) div 4 - {SHINGLE}, 0)), i -> {shingle_hash(points, 'int(i)')})")


def common_share(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays as (k, all): sizes of their intersection and union."""
    return F.struct(F.size(F.array_intersect(x, y)).alias("k"), F.size(F.array_union(x, y)).alias("all"))


def shingle_rows(lines: DataFrame, width: int, *keys: str) -> DataFrame:
    """keys, h0 and so on: a row for ``width`` neighbouring shingles of column
    ``line``; the line's last one is repeated where it ends."""
    placed = lines.select(*keys, points_of(F.col("line")).alias("points"), last_start(F.col("line")).alias("last"))
    each = placed.select(*keys, "points", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(width))).alias("start"))
    return each.select(*keys, *[F.expr(shingle_hash("points", f"least(start + {i}, last)")).alias(f"h{i}") for i in range(width)])


def gathered(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, hs: arrays of neighbouring shingles of column ``line``."""
    return shingle_rows(lines, SPAN, *keys).select(*keys, F.array(*[f"h{i}" for i in range(SPAN)]).alias("hs"))


def signatures(lines: DataFrame) -> DataFrame:
    """lid, the minima, few (there are few shingles behind them) of each distinct line."""
    least = lambda m: F.min(F.least(*[F.col(f"h{i}").bitwiseXOR(F.lit(m)) for i in range(WIDE)]))
    found = shingle_rows(lines, WIDE, "lid").groupBy("lid").agg(*[least(m).alias(name) for name, m in zip(MINIMA, masks(), strict=True)])
    return found.withColumn("few", F.size(behind()) <= FEW)


def sketches(lines: DataFrame) -> DataFrame:
    """lid, n (distinct shingles), parity sketch of distinct lines: dealt by line once, a
    line's shingles meet in one task."""
    sets = gathered(lines.repartition("lid"), "lid").groupBy("lid").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"))
    each = sets.select("lid", F.explode("hs").alias("h"))
    word, bit = F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr("shiftleft(1L, int(h & 63))").alias("bit")
    odd = each.select("lid", word, bit).groupBy("lid", "word").agg(F.bit_xor("bit").alias("odd"), F.count(F.lit(1)).alias("n"))
    parity = F.array(*[F.coalesce(F.max(F.when(F.col("word") == j, F.col("odd"))), F.lit(0)) for j in range(WORDS)])
    return odd.groupBy("lid").agg(F.sum("n").alias("n"), parity.alias("parity"))


def behind() -> Column:
    """The different shingles behind the minima."""
    return F.array_distinct(F.array(*[F.col(name).bitwiseXOR(F.lit(m)) for name, m in zip(MINIMA, masks(), strict=True)]))


def bands() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *MINIMA[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def keys_of() -> Column:
    """Bucket keys of a signature: its bands come first."""
    return F.when(F.col("few"), F.concat(bands(), behind())).otherwise(bands())


def bucket_members(signed: DataFrame) -> DataFrame:
    """(key, place, lid, hub) of the lines in buckets of two lines or more, as a written
    table; the place is that of the key among the line's keys.  The hub is the bucket's
    centre: the line whose buckets hold most lines, as it has least of its own."""
    keyed = signed.select("lid", F.posexplode(F.array_distinct(keys_of())).alias("place", "key"))
    bucket = Window.partitionBy("key")
    shared = written(keyed.withColumn("k", F.count(F.lit(1)).over(bucket)).filter("k > 1"), "shared-keys")
    met = shared.groupBy("lid").agg(F.sum("k").alias("met"))
    hub = F.max(F.struct("met", "lid")).over(bucket).getField("lid")
    out = written(shared.join(met, "lid").select("key", "place", "lid", hub.alias("hub")), "bucket-members")
    drop_table(shared)
    return out


def agreement(x: str, y: str) -> str:
    """Number of equal minima of two lines whose columns end in ``x`` and ``y``."""
    return " + ".join(f"int({m}{x} = {m}{y})" for m in MINIMA)


def agreeing(x: str, y: str) -> str:
    return f"(few{x} OR few{y} OR {agreement(x, y)} >= {AGREE})"


def near(x: str, y: str, least: float) -> str:
    """Condition on sketches: of sets of n and m shingles with a similarity of s, the larger
    has at most m / s, and at most (1 - s) / (1 + s) of n + m are in only one.  Loops over
    arrays: sixteen terms more would make the join's method too long to be compiled."""
    differ = f"aggregate(zip_with(parity{x}, parity{y}, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k)"
    return f"{differ} <= (n{x} + n{y}) * {(1 - least) / (1 + least)!r}D + 1e-6D"


def of_like_size(x: str, y: str, least: float) -> str:
    return f"least(n{x}, n{y}) >= {least!r}D * greatest(n{x}, n{y})"


def suffixed(signed: DataFrame, tail: str) -> DataFrame:
    return signed.select(*[F.col(c).alias(c + tail) for c in signed.columns])


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose lid is in the written table ``ids``."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "lid", "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("lid")).unionByName(pairs.select(F.col("b").alias("lid"))).distinct()


def similar(lines: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose lines have a Jaccard similarity of ``least`` or more, as a
    written table."""
    ids = written(ends(pairs), "line-ids")
    texts = of_ids(lines, ids)
    one = lambda own, x: texts.select(F.col("lid").alias(own), F.col("line").alias(x), F.when(F.length("line") > LONG, points_of(F.col("line"))).alias(f"{x}_points"))
    both = pairs.select("a", "b").join(one("b", "y"), "b").join(one("a", "x"), "a")
    points = [F.coalesce(f"{x}_points", points_of(F.col(x))).alias(f"{x}_points") for x in "xy"]
    far = F.expr("x_points IS NOT NULL OR y_points IS NOT NULL")
    # dealt by pair once: the shingles of its lines meet in one task
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("line")) for x in "xy"])).alias("own")
    own = both.filter(~far).select("a", "b", "x", "y").repartition("a", "b").select("a", "b", sides).select("a", "b", "own.*")
    of_side = lambda x: F.flatten(F.collect_list(F.when(F.col("side") == x, F.col("hs"))))
    short = gathered(own, "a", "b", "side").groupBy("a", "b").agg(common_share(of_side("x"), of_side("y")).alias("met"))
    # the points of a line are made before its shingles are cut, not for each of them
    long = written(both.filter(far).select("a", "b", *points), "long-pairs")
    met = short.unionByName(long.select("a", "b", common_share(hashed_shingles("x_points"), hashed_shingles("y_points")).alias("met")))
    out = written(met.filter(F.col("met.k") >= least * F.col("met.all")).select("a", "b"), "line-links")
    drop_table(long)
    drop_table(ids)
    return out


def star_pairs(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's centre with its other lines that agree, as a written
    table."""
    pairs = members.filter("lid <> hub").select(F.col("hub").alias("lid_x"), F.col("lid").alias("lid_y")).distinct()
    both = pairs.join(suffixed(signed, "_x"), "lid_x").join(suffixed(signed, "_y"), "lid_y").filter(F.expr(agreeing("_x", "_y")))
    return written(both.select(F.col("lid_x").alias("a"), F.col("lid_y").alias("b")), "star-pairs")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of the component of column lid."""
    return rows.join(roots.select(F.col("node").alias("lid"), "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets whose lines lie in several components, with their root, as a
    written table; the centre has met all lines of its bucket, those outside its component
    have others to meet."""
    labelled = rooted(members.select("key", "place", "lid", "hub"), roots)
    at_hub = F.max(F.when(F.col("lid") == F.col("hub"), F.col("root")))
    split = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), at_hub.alias("centre"), F.count(F.lit(1)).alias("k"))
    still = labelled.join(split.filter("lo <> hi and k > 2").select("key", "centre"), "key")
    return written(still.select("key", "place", "lid", "hub", "root", (F.col("root") != F.col("centre")).alias("outside")), "open-members")


def open_lines(still: DataFrame, signed: DataFrame, lines: DataFrame) -> DataFrame:
    """Signature and sketch of the lines in open buckets, as a written table."""
    ids = written(still.select("lid").distinct(), "line-ids")
    out = written(of_ids(signed, ids).join(sketches(of_ids(lines, ids)), "lid"), "open-lines")
    drop_table(ids)
    return out


def kin_pairs(known: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of lines in different components that share two bands, as a written
    table: each line with one of those that share the two, another for other bands."""
    both = [F.xxhash64(F.lit(i), F.lit(j), *MINIMA[i * ROWS : (i + 1) * ROWS], *MINIMA[j * ROWS : (j + 1) * ROWS]) for i, j in combinations(range(BANDS), 2)]
    keyed = known.select("lid", F.explode(F.array(*both)).alias("key"))
    first = F.min(F.struct(F.xxhash64("key", "lid").alias("order"), "lid")).over(Window.partitionBy("key")).getField("lid")
    pairs = keyed.select("lid", first.alias("hub")).filter("lid <> hub").select(F.greatest("lid", "hub").alias("lid_x"), F.least("lid", "hub").alias("lid_y")).distinct()
    told = rooted(known, roots)
    met = pairs.join(suffixed(told, "_x"), "lid_x").join(suffixed(told, "_y"), "lid_y").filter(F.expr(f"root_x <> root_y AND {of_like_size('_x', '_y', least)} AND {agreeing('_x', '_y')} AND {near('_x', '_y', least)}"))
    return written(met.select(F.col("lid_y").alias("a"), F.col("lid_x").alias("b")), "kin-pairs")


def open_pairs(still: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of lines that share a bucket and lie in different components, as a
    written table: the lines outside the centre's component meet all others, and only pairs
    that may be similar come out, each by the first of the keys that it shares."""
    told = still.filter("lid <> hub").drop("hub").join(known, "lid")
    told = written(told.withColumn("before", F.slice(bands(), F.lit(1), F.least("place", F.lit(BANDS)))).drop("place"), "open-buckets")
    met = suffixed(told.filter("outside"), "_x").join(suffixed(told, "_y"), F.col("key_x") == F.col("key_y"))
    met = met.filter(F.expr(f"root_x <> root_y AND (NOT outside_y OR lid_x < lid_y) AND {of_like_size('_x', '_y', least)}"))
    met = met.filter(F.expr(f"NOT arrays_overlap(before_x, before_y) AND {agreeing('_x', '_y')} AND {near('_x', '_y', least)}"))
    pairs = met.select(F.least("lid_x", "lid_y").alias("a"), F.greatest("lid_x", "lid_y").alias("b"))
    out = written(pairs.distinct(), "open-pairs")
    drop_table(told)
    return out


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line: doc_id, line_no, component_doc_id and component_line_no (the line
    that stays; null for blank lines), component_size (lines in all), kept."""
    rows = written(lines_of(docs).select(F.monotonically_increasing_id().alias("rid"), "*"), "line-rows", "zstd")
    each = rows.filter("lid is not null").select("lid", "line")
    rows = rows.drop("line")
    signed = written(signatures(each), "signatures")
    members = bucket_members(signed)
    shared = written(members.select("lid").distinct(), "shared-lines")
    lines = written(of_ids(each, shared).distinct(), "lines", "zstd")
    pairs = star_pairs(members, of_ids(signed, shared))
    links = similar(lines, pairs, similarity)
    roots = components(links, "a", "b")
    still = open_members(members, roots)
    if not still.isEmpty():
        known = open_lines(still, signed, lines)
        links = links.unionByName(similar(lines, kin_pairs(known, roots, similarity), similarity))
        roots = components(links, "a", "b")
        left = open_members(still, roots)
        links = links.unionByName(similar(lines, open_pairs(left, known, similarity), similarity))
        roots = components(links, "a", "b")
        for done in (known, left):
            drop_table(done)
    # nulls last: a flag leads the order
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "rid")
    each = rows.filter("lid is not null").groupBy("lid").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    each = each.join(roots.select(F.col("node").alias("lid"), "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    each = written(each, "line-groups")
    best = each.groupBy("root").agg(F.min("first").alias("stay"), F.sum("copies").alias("component_size"))
    verdict = written(each.join(best, "root").select("lid", "copies", "stay", "component_size"), "line-verdicts")
    for done in (lines, signed, members, shared, pairs, still, each):
        drop_table(done)
    out = attach(rows, verdict, "lid", "copies")
    return out.select(
        "doc_id", "line_no", F.col("stay.doc_id").alias("component_doc_id"), F.col("stay.line_no").alias("component_line_no"), "component_size",
        F.coalesce(F.col("rid") == F.col("stay.rid"), F.lit(True)).alias("kept"),
    )
