"""Exact n-gram Jaccard self-join by size-banded tiles and bitmap bounds.

Method. Every document becomes the sorted set of its shingle hashes; documents
with equal sets are folded into one. A pair with Jaccard >= t shares a shingle
among the first ``n - ceil(t n) + 1`` of both sets in any common order, so each
set is posted under these shingles only, and of them under those that the counts give to more
than one document. The order puts frequent shingles last;
it comes from counts over all documents and influences cost, never
results. A tile is (shingle, size band); sets near the lower end of a band
are also guests of the band below. Inside a tile sets are compared with a pivot
first, which settles all pairs of the pivot; only where other members remain in different components and sizes and
positions allow them a partner there are their pairs taken, the likeliest first and with bounded numbers of pairs and comparisons per round,
between which components are named anew, until none is left. Such tiles with the same members are one: the first of them in the common order has
the loosest positions, so it alone is taken; copies of a set stand in it once. Candidate pairs pass size and position bounds, then
hashed bitmap signatures whose bit counts bound the overlap from above, inside the tile
except for pivots, then exact intersection of the sorted arrays. So no link between different
components is lost and no group is turned into all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from emberfield.llm.components import connected
from emberfield.llm.textbatch import Words, flat, mixed, shingle_sets, slices
from emberfield.session import FINE_BYTES, materialize, small_batches

#: A shingle of so many documents is frequent; the most frequent ones make a table of 12 bytes each.
FREQUENT = 8
HITTERS = 400_000
#: Part of the hash range in which shingles are counted. Prefixes take about a quarter of it.
COUNTED = 0.26
#: Bits of the filter of shingles that several documents have, at most (16 MB, broadcast).
SHARED_BITS = 1 << 27
#: So many pairs or documents at most are sent to the sets or texts they need; more are joined by a shuffle.
FEW = 200_000
#: Tiles and counts go by the upper 48 bits of a hash; a clash only makes a tile larger.
_TILE_SHIFT = 16
#: Bits of the filter of wanted documents (8 MB, broadcast).
FILTER_BITS = 1 << 26
#: Comparisons of sizes and positions inside one tile per round; more members take more rounds.
COMPARISONS = 1 << 26
#: Every so many-th tile, by hash, is taken in the first round; the others see the components it has found.
FIRST_TILES = 8
#: Partners that a pivot is paired with per tile in the first round, likeliest first; ``GROWTH`` times as many in each
#: further round, until the pivot has met all of them.
REACH = 4
GROWTH = 8
#: Pivots of a tile that bring pairs in the first round, each tile its own; ``GROWTH`` times as many in each further
#: round. ``LOOKS`` times as many are looked at, since those without a partner bring none.
PIVOTS = 512
LOOKS = 16
#: Members of a tile that are compared by size and position before bitmaps are fetched; all of a larger one stay.
SCREENED = 256
#: Text of a slice. Shingling needs about 40 times as much memory.
SLICE = 1 << 20


def _sets(column: pa.Array, width: int):
    return shingle_sets(Words(*flat(column), lower=True), width)


def _lowest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The shingles of every document that hash order puts into its prefix or shortly after it."""
    limit = np.uint64(int(COUNTED * 2**64))
    for part in slices(batches, "text", SLICE):
        values, _ = _sets(part.column("text"), width)
        yield pa.record_batch({"h": (values[values < limit] >> np.uint64(_TILE_SHIFT)).view(np.int64)})


def _ordered(values: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set in the common order: rare shingles by hash, then frequent ones by rank."""
    if not len(keys):
        return values
    tiles = values >> np.uint64(_TILE_SHIFT)
    at = np.minimum(np.searchsorted(keys, tiles), len(keys) - 1)
    hot = keys[at] == tiles
    return np.concatenate((values[~hot], values[hot][np.argsort(ranks[at[hot]], kind="stable")]))


def _folded(places: DataFrame, size: int) -> np.ndarray:
    """A bit for each ``place`` below ``size``; only the bits reach the driver."""
    at = F.col("place") + 1
    found = places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for row in found.collect():
        first = (row["bucket"] - 1) * 4096
        out[first : first + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _alone(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether no other document has a shingle; those that were not counted may have others."""
    place = (values >> np.uint64(_TILE_SHIFT)) & np.uint64(8 * len(bits) - 1)
    hit = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
    return (values < np.uint64(int(COUNTED * 2**64))) & (hit == 0)


def _prefixes(batches, width: int, keep: int, hitters) -> Iterator[pa.RecordBatch]:
    """Size and digest of every set; the prefix where a task meets the set for the first time.

    Rows without a doc_id post nothing, so they do not count as a meeting. A shingle that no other
    document has keeps its place as -1.
    """
    keys, ranks, several = hitters.value
    met: set[bytes] = set()
    for part in slices(batches, "text", SLICE):
        values, ends = _sets(part.column("text"), width)
        d1, d2, prefix, sizes = [], [], [], np.diff(ends)
        named = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        for a, b, posts in zip(ends[:-1], ends[1:], named):
            own = values[a:b]
            raw = xxhash.xxh3_128_digest(own.tobytes())
            digest = np.frombuffer(raw, np.int64)
            d1.append(digest[0])
            d2.append(digest[1])
            n = b - a
            need = -(-keep * n // 100)
            own = _ordered(own, keys, ranks)[: n - need + 1] if n and posts and raw not in met else own[:0]
            prefix.append(own)
            if posts:
                met.add(raw)
        if len(met) > 1_000_000:
            met.clear()
        values = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
        posted = np.where(_alone(values, several), np.int64(-1), (values >> np.uint64(_TILE_SHIFT)).view(np.int64))
        yield pa.record_batch(
            {
                "doc_id": part.column("doc_id"),
                "n": sizes.astype(np.int64),
                "d1": np.array(d1, np.int64),
                "d2": np.array(d2, np.int64),
                "prefix": pa.ListArray.from_arrays(
                    np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32),
                    posted,
                ),
            }
        )


def _fits(keep: int, n1, p1, n2, p2):
    """Whether sizes and positions of a shared shingle allow the similarity (arrays)."""
    need = -(-keep * (n1 + n2) // (100 + keep))
    return (100 * np.minimum(n1, n2) >= keep * np.maximum(n1, n2)) & (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= need)


#: A tile row: shingle, set, and its guest mark, size and position in one number.
_TILE = "h long, rep long, meta long"


def _parts(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Band, guest mark, size and position of tile rows."""
    guest, n, pos = meta >> 62, (meta >> 31) & 0x7FFFFFFF, meta & 0x7FFFFFFF
    return _band(n) - guest, guest, n, pos


def _band(n: np.ndarray) -> np.ndarray:
    """Size band: 1 to 3, 4 to 15, 16 to 63 and so on."""
    return (np.frexp(n.astype(float))[1] - 1) // 2


def _posted(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """One tile row per prefix shingle, and one more for the band below where partners may lie there."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            prefix = part.column("prefix")
            h = prefix.flatten().to_numpy(zero_copy_only=False)
            size = pc.list_value_length(prefix).to_numpy(zero_copy_only=False).astype(np.int64)
            rep = np.repeat(part.column("rep").to_numpy(), size)
            n = np.repeat(part.column("n").to_numpy(), size)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            some = h >= 0
            h, rep, n, pos = h[some], rep[some], n[some], pos[some]
            meta = (n << 31) | pos
            band = _band(n)
            low = (band > 0) & (keep * n < 100 * 4**band)
            yield pa.record_batch(
                {
                    "h": np.concatenate((h, h[low])),
                    "rep": np.concatenate((rep, rep[low])),
                    "meta": np.concatenate((meta, meta[low] | (1 << 62))),
                }
            )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attach the tile's first own member as pivot to the other members, numbered by ``place``; lone members go.

    Rows arrive sorted by tile, own members first; nothing but the current
    pivot and its number of members is kept between batches.
    """
    last, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("h", "rep", "meta")]
        if last is not None:
            cols = [np.concatenate(([x], c)) for x, c in zip(last, cols)]
        h, rep, meta = cols
        band, guest, _, _ = _parts(meta)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (band[1:] != band[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        # A doc_id may stand in a tile with several sets.
        others = ~new & (guest[first] == 0) & ((rep != rep[first]) | (meta != meta[first]))
        keep = np.flatnonzero(others)
        last = [c[first[-1]] for c in cols]
        at = first[keep]
        count = np.cumsum(others)
        place = count - count[first] - 1 + np.where(first == 0, before, 0)
        # A pivot that was carried over stands first in the batch.
        before = int(place[-1]) + 1
        if len(keep):
            yield pa.record_batch(
                {"h": h[keep], "rep": rep[keep], "meta": meta[keep], "pivot": rep[at], "pivot_meta": meta[at], "place": place[keep]}
            )


def _tiles(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of sorted tile rows in runs of whole tiles, and where in a run the tiles begin and the last one ends."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            cols = [np.concatenate((x, c)) for x, c in zip(held, cols)]
        band = _parts(cols[2])[0]
        edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (band[1:] != band[:-1])) + 1
        cuts = np.concatenate(([0], edge))
        if len(edge):
            yield [c[: cuts[-1]] for c in cols], cuts
        held = [c[cuts[-1] :] for c in cols]
    if held is not None:
        yield held, np.array([0, len(held[0])])


def _screened(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """The members whose tile has one of another component that sizes and positions allow as a partner."""
    names = ("h", "rep", "meta", "component")
    for cols, cuts in _tiles(batches, names):
        _, _, meta, component = cols
        _, guest, n, pos = _parts(meta)
        size = np.diff(cuts)
        tile, ok = np.repeat(np.arange(len(size)), size), np.zeros(len(meta), bool)
        small = size[tile] <= 16
        for step in range(1, min(int(size.max()), 16)):
            a = np.flatnonzero(small[:-step] & (tile[:-step] == tile[step:]))
            b = a + step
            fit = (component[a] != component[b]) & (guest[a] + guest[b] < 2) & _fits(keep, n[a], pos[a], n[b], pos[b])
            ok[a[fit]] = ok[b[fit]] = True
        for t in np.flatnonzero(size > 16):
            at = slice(cuts[t], cuts[t + 1])
            c, g, m, p = component[at], guest[at], n[at], pos[at]
            if len(c) > SCREENED:
                ok[at] = c.min() < c.max()
                continue
            fit = (c[:, None] != c) & (g[:, None] + g < 2) & _fits(keep, m[:, None], p[:, None], m, p)
            ok[at] = fit.any(axis=1)
        if ok.any():
            yield pa.record_batch({k: x[ok] for k, x in zip(names, cols)})


def _bounds(bits: np.ndarray, n: np.ndarray):
    """A function that bounds the overlap of one member of a tile with some others, by their bitmaps."""
    width = np.array([len(x) // 8 for x in bits])
    levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def level(words: int):
        if words not in levels:
            rows = np.flatnonzero(width >= words)
            place = np.full(len(bits), -1)
            place[rows] = np.arange(len(rows))
            folded = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[r], np.uint64).reshape(-1, words)) for r in rows])
            levels[words] = folded, n[rows] - np.bitwise_count(folded).sum(axis=1, dtype=np.int64), place
        return levels[words]

    def bound(one: int, others: np.ndarray) -> np.ndarray:
        out = np.empty(len(others), np.int64)
        both = np.minimum(width[one], width[others])
        for words in np.unique(both):
            folded, collisions, place = level(int(words))
            some = both == words
            x, y = place[one], place[others[some]]
            common = np.bitwise_count(folded[x] & folded[y]).sum(axis=1, dtype=np.int64)
            out[some] = common + np.minimum(collisions[x], collisions[y])
        return out

    return bound


def _rounds(batches: Iterator[pa.RecordBatch], keep: int, comparisons: int, reach: int) -> Iterator[pa.RecordBatch]:
    """Compare the next pivots of each tile with members of other components.

    Yields the pairs that sizes, positions and bitmaps allow, ``reach`` per pivot and those with the largest
    bound first, and the members that remain for the next round (``a`` null). Pivots come from the smaller
    components of a tile, in an order of the tile's own, so that the many tiles of a large group do not all
    yield the same pairs; once a pivot has met every member it leaves, and pivots without a turn keep theirs.
    Where every pivot has been looked at, only those that still have pairs to bring, and their partners, remain.
    """

    met: list[np.ndarray] = []

    def pairs():
        a, b = np.unique(np.concatenate(met, axis=1), axis=1)
        none = pa.nulls(len(a), pa.int64())
        met.clear()
        return pa.record_batch({"a": a, "b": b, "h": none, "rep": none, "meta": none})

    def tile(h, rep, meta, component, bits):
        _, own, sizes = np.unique(component, return_inverse=True, return_counts=True)
        if len(sizes) < 2:
            return
        _, guest, n, pos = _parts(meta)
        # All members of the largest component stay; the others are pivots in turn.
        turn = np.lexsort((mixed([h.view(np.uint64), rep.view(np.uint64)]), guest, sizes[own]))
        turn = turn[own[turn] != np.argmax(sizes)]
        done, wanted = np.zeros(len(rep), bool), np.zeros(len(rep), bool)
        bound = _bounds(bits, n)
        left = max(1, PIVOTS * reach // REACH)
        looks = max(1, min(comparisons // len(rep), LOOKS * left))
        for p in turn[:looks]:
            mate = ~done & (component != component[p]) & (guest + guest[p] < 2)
            m = np.flatnonzero(mate & _fits(keep, n[p], pos[p], n, pos))
            common = bound(p, m)
            some = (100 + keep) * common >= keep * (n[p] + n[m])
            m, common = m[some], common[some]
            done[p] = len(m) <= reach and (left > 0 or not len(m))
            if not done[p]:
                wanted[p] = wanted[m] = True
            if not len(m) or not left:
                continue
            left -= 1
            m = m[np.lexsort((rep[m], -common / (n[p] + n[m])))[:reach]]
            met.append(np.stack((np.minimum(rep[p], rep[m]), np.maximum(rep[p], rep[m]))))
            if len(met) >= 20_000 or len(m) > 100_000:
                yield pairs()
        m = np.flatnonzero(~done & wanted if looks >= len(turn) else ~done)
        if len(m):
            none = pa.nulls(len(m), pa.int64())
            yield pa.record_batch({"a": none, "b": none, "h": h[m], "rep": rep[m], "meta": meta[m]})

    for cols, cuts in _tiles(batches, ("h", "rep", "meta", "component", "bits")):
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield from tile(*[c[a:b] for c in cols])
    if met:
        yield pairs()


def _signature(values: np.ndarray) -> bytes:
    """Hashed bitmap, about eight to sixteen bits per shingle; wider ones fold onto narrower ones."""
    bits = 1 << max(6, int(8 * len(values)).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(values % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """Upper bound of the intersection size from two bitmaps.

    Of the shared shingles at most one per common bit is distinct there; every further one
    is a collision inside its own set, and those are known per set.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x = np.bitwise_or.reduce(x.reshape(-1, size))
    y = np.bitwise_or.reduce(y.reshape(-1, size))
    common = int(np.bitwise_count(x & y).sum())
    return common + min(n_a - int(np.bitwise_count(x).sum()), n_b - int(np.bitwise_count(y).sum()))


def _bitmaps(batches, width: int) -> Iterator[pa.RecordBatch]:
    for made in _digests(batches, width):
        yield made.select(["rep", "n", "bits"])


def _digests(batches, width: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE):
        values, ends = _sets(part.column("text"), width)
        own = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        yield pa.record_batch(
            {
                "rep": part.column("doc_id"),
                "n": np.diff(ends).astype(np.int64),
                "bits": pa.array([_signature(v) for v in own], pa.binary()),
                "shingles": pa.array([v.tobytes() for v in own], pa.binary()),
            }
        )


def _bounded(batches, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {k: batch.column(k).to_pylist() for k in ("n_a", "bits_a", "n_b", "bits_b")}
        ok = [
            (100 + keep) * overlap_bound(x, n, y, m) >= keep * (n + m)
            for n, x, m, y in zip(c["n_a"], c["bits_a"], c["n_b"], c["bits_b"])
        ]
        some = batch.filter(pa.array(ok, pa.bool_()))
        yield some.select(["a", "b"])


def _exact(batches, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[at] == x).sum())
            ok.append(100 * shared >= keep * (len(x) + len(y) - shared))
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _likely(batches, bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.column("place").to_numpy()
        hit = (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        yield batch.filter(pa.array(hit.astype(bool))).select(["doc_id", "text"])


def _made(wanted: DataFrame, docs: DataFrame, width: int, shingles: bool = True) -> DataFrame:
    """Bitmap, and shingles if asked, of the documents whose ``doc_id`` is wanted."""
    schema = "rep long, n long, bits binary" + ", shingles binary" * shingles
    wanted = materialize(wanted, "jaccard-wanted")
    count = wanted.count()
    if not count:
        # No rows from Python: they would start workers beside those that serve the texts.
        return docs.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])
    if count <= FEW:
        found = docs.join(F.broadcast(wanted), "doc_id", "left_semi")
    else:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
        # A filter of fixed size lets only wanted documents, and a few others, into the join.
        shared = docs.sparkSession.sparkContext.broadcast(_folded(wanted.select(place.alias("place")), FILTER_BITS))
        likely = docs.withColumn("place", place).mapInArrow(lambda it: _likely(it, shared), "doc_id long, text string")
        found = likely.join(wanted, "doc_id", "left_semi")
    make = _digests if shingles else _bitmaps
    # Repeated rows go while they are texts: sets are larger.
    return materialize(found.dropDuplicates(["doc_id", "text"]).mapInArrow(lambda it: make(it, width), schema), "jaccard-sets")


def _lacking(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` without a row in the sets."""
    return ids.distinct().join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")


def _sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Attach columns of the sets to both ends of pairs."""
    for end in ("a", "b"):
        own = sets.select(F.col("rep").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(own, end)
    return pairs


def _linked(pairs: DataFrame, sets: DataFrame, keep: int) -> DataFrame:
    """The stored pairs whose sets, intersected exactly, reach the similarity."""
    if pairs.count() <= FEW:
        # Only the sets of these pairs are shuffled.
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        sets = sets.join(F.broadcast(ends), "rep", "left_semi")
    links = _sides(pairs, sets, "shingles").mapInArrow(lambda it: _exact(it, keep), "a long, b long")
    return materialize(links.distinct(), "jaccard-links")


def _meta(meta: F.Column, part: int) -> F.Column:
    """Guest mark, size or position out of a tile row's number."""
    return F.shiftright(meta, (62, 31, 0)[part]).bitwiseAND(F.lit((1, 0x7FFFFFFF, 0x7FFFFFFF)[part]).cast("long"))


def _named(frame: DataFrame, components: DataFrame, column: str) -> DataFrame:
    """Add the component of a set; a set without links is its own."""
    names = components.select(F.col("node").alias(column), F.col("component").alias(f"{column}_component"))
    own = F.coalesce(f"{column}_component", column)
    return frame.join(names, column, "left").withColumn(f"{column}_component", own)


def shingle_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked by Jaccard >= percent / 100.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A-Z are
    lower-cased; words are runs without ASCII white space; fewer words than ``width``
    make one shingle of the whole sequence. Null, empty or white texts have an empty set and link
    with nothing. Equal sets link. Rows that share a doc_id are one node
    that has the links of all of them. A null doc_id gives a row of its own with a null component.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark, FINE_BYTES)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    texts = docs.where(F.col("text").isNotNull())
    counts = texts.mapInArrow(lambda it: _lowest(it, width), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(counts.where("n > 1"), "jaccard-shared")
    size = min(max(1 << 15, 1 << (8 * shared.count()).bit_length()), SHARED_BITS)
    several = _folded(shared.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("place")), size)
    top = materialize(shared.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(HITTERS), "jaccard-frequent").toPandas()
    keys, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.int32)
    ranks[np.lexsort((keys, counts))] = np.arange(len(keys))
    hitters = spark.sparkContext.broadcast((keys[order], ranks[order], several))
    table = materialize(
        docs.mapInArrow(
            lambda it: _prefixes(it, width, percent, hitters),
            "doc_id long, n long, d1 long, d2 long, prefix array<long>",
        ),
        "jaccard-prefixes",
    )
    filled = table.where("n > 0 and doc_id is not null")
    reps = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    # Copies of a set post once per task; the digests link them.
    posted = filled.where(F.size("prefix") > 0).select(F.col("doc_id").alias("rep"), "n", "prefix").mapInArrow(
        lambda it: _posted(it, percent), _TILE
    )
    guest, n, pos = (_meta(F.col("meta"), part) for part in range(3))
    band = F.floor((F.length(F.bin(n)) - 1) / 2) - guest
    # Four orders of pivots, by the tile: a set far from one pivot meets others.
    order = ["h", band, guest, F.xxhash64("rep", F.pmod("h", F.lit(4)))]
    tiles = materialize(
        posted.repartition("h").sortWithinPartitions(*order).mapInArrow(_stars, f"{_TILE}, pivot long, pivot_meta long, place long"),
        "jaccard-tiles",
    )
    _, pivot_n, pivot_pos = (_meta(F.col("pivot_meta"), part) for part in range(3))
    need = F.ceil((n + pivot_n) * percent / (100 + percent))
    pairs = (
        tiles.where(100 * F.least(n, pivot_n) >= percent * F.greatest(n, pivot_n))
        .where(F.least(n - pos, pivot_n - pivot_pos) >= need)
        .where("rep <> pivot")
        .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        .distinct()
    )
    known = materialize(pairs, "jaccard-pairs")
    sets = _made(known.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), texts, width)
    near = _sides(known, sets, "n", "bits").mapInArrow(lambda it: _bounded(it, percent), "a long, b long")
    links = _linked(materialize(near.distinct(), "jaccard-bounded"), sets, percent)
    # Copies of a set are linked without being compared.
    copies = materialize(filled.join(reps, ["d1", "d2"]).select("doc_id", "n", "rep").distinct(), "jaccard-copies")
    links = links.union(copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    components = connected(links, "jaccard-components")
    # The pairs of pivots are settled, so tiles with two other members at least remain.
    members = tiles.withColumn("band", band)
    members = members.join(members.where("place = 1").select("h", "band"), ["h", "band"], "left_semi")
    # A copy gives way to the first of its set, unless it has several sets of that size.
    firsts = copies.groupBy("doc_id", "n").agg(F.min("rep").alias("first_id"), F.max("rep").alias("last_id"))
    firsts = firsts.where("first_id = last_id and doc_id <> first_id").select(F.col("doc_id").alias("rep"), "n", "first_id")
    members = members.select("h", "rep", "meta", "band", n.alias("n")).join(firsts, ["rep", "n"], "left")
    members = materialize(members.select("h", F.coalesce("first_id", "rep").alias("rep"), "meta").distinct(), "jaccard-members")

    def screened(members: DataFrame) -> DataFrame:
        """The members that may have a partner in another component, and their components."""
        named = _named(members, components, "rep").withColumnRenamed("rep_component", "component")
        rows = named.repartition("h").sortWithinPartitions("h", band).mapInArrow(
            lambda it: _screened(it, percent), f"{_TILE}, component long"
        )
        return materialize(rows.withColumns({"band": band, "n": n}), "jaccard-named")

    def unlike(members: DataFrame) -> DataFrame:
        """Of tiles with the same members the first in the common order."""
        same = {
            "size": F.count(F.lit(1)),
            "mark": F.bit_xor(F.xxhash64("rep")),
            "total": F.sum(F.shiftright(F.xxhash64("rep", F.lit(1)), 32)),
        }
        alike = members.groupBy("h", "band").agg(F.min(pos).alias("first"), *[c.alias(k) for k, c in same.items()])
        alike = alike.groupBy("band", *same).agg(F.min_by("h", "first").alias("h")).select("h", "band")
        return materialize(members.join(alike, ["h", "band"], "left_semi"), "jaccard-unlike")

    bitmaps = sets.select("rep", "n", "bits")
    # Some tiles are taken first, so that the others find most of their members in one component.
    chosen = F.pmod(F.shiftright("h", 2), F.lit(FIRST_TILES)) == 0
    members, later = members.where(chosen), members.where(~chosen)
    reach, opened = REACH, True
    while opened or not members.isEmpty():
        named = screened(members)
        if opened:
            named = unlike(named)
            missing = _lacking(named.select(F.col("rep").alias("doc_id")), bitmaps)
            bitmaps = bitmaps.union(_made(missing, texts, width, shingles=False))
        # Bitmaps go only to members that may have a partner in another component.
        turn = materialize(
            named.join(bitmaps, ["rep", "n"])
            .select("h", "rep", "meta", "component", "bits", "band")
            .repartition("h")
            .sortWithinPartitions("h", "band")
            .mapInArrow(lambda it, reach=reach: _rounds(it, percent, COMPARISONS, reach), f"a long, b long, {_TILE}"),
            "jaccard-round",
        )
        reach *= GROWTH
        pairs = materialize(
            turn.where("a is not null").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"),
            "jaccard-pairs",
        )
        # A doc_id with several sets stands in a tile once for each of one size.
        members = turn.where("a is null").select("h", "rep", "meta").distinct()
        if not pairs.isEmpty():
            sets = sets.union(_made(_lacking(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), sets), texts, width))
            known = known.union(pairs)
            links = _linked(pairs, sets, percent)
            if not links.isEmpty():
                stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
                components = connected(stars.union(links), "jaccard-components")
        opened = later is not None
        if opened:
            members, later = members.union(later), None
    return table.select("doc_id", F.col("n").alias("n_shingles")).join(
        components.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left"
    ).withColumn("component_id", F.coalesce("component_id", "doc_id"))
