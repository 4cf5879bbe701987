"""Phrase collocations per language, mined by best-first branch-and-bound growth.

Method. Phrases grow from their prefixes. The count of a prefix bounds the score of everything that grows
from it: a phrase ``w1 w2 w3`` occurs at most as often as its prefix ``w1 w2``, so its score is at most
``floor(SCALE * f(w1 w2) / f(w1))``. The frontier holds the two-word phrases; a round expands the best of each
language, that is every prefix whose bound, and every phrase whose own score, reaches a level. Expanding counts the three-word phrases
around it over the whole corpus. When ``top`` phrases at or above the level survive, nothing unexpanded can
be among them or tie with them, and the language is settled; otherwise its level goes down to where
four times as many phrases lie, in the end to 0.

Texts become slices of word numbers once; the counting passes read these and fold n-grams per slice and per task before the shuffle. Which n-grams can matter at all
is sent to the tasks as bit filters of at most ``FILTER_BITS`` bits: a false hit only costs a counted row, its
count is exact all the same, and a missing hit is impossible.

Defined results: null text counts as empty; a null language is ``und``; texts without words and languages without
candidates give no row; repeated rows count as often as they occur; ties are ordered by count, then by the
phrase's UTF-8 bytes; an empty table gives no row; other columns take no part, whatever their names.
Texts are read whole, in slices that hold one text at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberfield.llm.textbatch import LOWER, encoded, flat, mixed, slices
from emberfield.session import materialize

SCALE = 1_000_000
#: Size of a filter at most (16 MB), and its probes per n-gram.
FILTER_BITS = 1 << 27
_PROBES = 4
#: Text that is folded at once, and how much deeper each round goes.
_SLICE = 2 << 20
#: Rows of an Arrow batch that a task hands back: larger ones fill memory outside the heap on both sides.
_ROWS = 1 << 16
_DEEPER = 4
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_COUNTS = "lang string, phrase string, c long"

_BYTES = np.arange(256)
_BLANK = (_BYTES == 32) | (_BYTES == 9)
_BREAK = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))


_SLICES = "langs array<string>, words array<string>, lang_of binary, ids binary, next binary"


def _unique(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes below ``size``, sorted, and the place of each code among them."""
    if size > 16 * max(len(codes), 1):
        return np.unique(codes, return_inverse=True)
    met = np.zeros(size, bool)
    met[codes] = True
    return np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - 1)[codes]


def _split(part: pa.RecordBatch) -> list:
    """Words of a slice of texts as numbers, and which of them follow each other inside a piece.

    Equal words of one language have one number; ``next[i]`` tells that word ``i + 1`` continues the piece of word ``i``.
    """
    data, offsets = flat(part.column("text"))
    data = LOWER[data]
    breaks = _BREAK[data]
    solid = ~(breaks | _BLANK[data])
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    # A word ends with its text.
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words, distinct = encoded(data[solid], np.concatenate(([0], np.cumsum(ends - starts))))
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(breaks), starts)
    follows = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    coded = pc.fill_null(part.column("lang"), "und").cast(pa.string()).dictionary_encode()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    vocabulary = max(len(distinct), 1)
    codes, ids = _unique(lang * vocabulary + words, len(coded.dictionary) * vocabulary)
    texts = pa.array(distinct, pa.binary()).cast(pa.string()).take(pa.array(codes % vocabulary))
    return [
        coded.dictionary, texts, (codes // vocabulary).astype(np.int32).tobytes(), ids.astype(np.int32).tobytes(), np.packbits(follows).tobytes(),
    ]


def _encoded(docs: DataFrame) -> DataFrame:
    """Texts as slices of word numbers, written out: every pass reads them instead of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _SLICES.split(", ")
        for part in slices(batches, "text", _SLICE):
            langs, words, *rest = _split(part)
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (langs, words)]
            yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x], pa.binary()) for x in rest]], [n.split(" ")[0] for n in names])

    return materialize(docs.select("text", "lang").mapInArrow(run, _SLICES), "collocation-slices")


class Grams:
    """A slice of word numbers: ``ids`` per place, ``words`` and ``lang_of`` per number."""

    def __init__(self, row: pa.RecordBatch):
        self.langs, self.words = (row.column(c)[0].values for c in ("langs", "words"))
        self.lang_of, self.ids = (np.frombuffer(row.column(c)[0].as_buffer(), np.int32).astype(np.int64) for c in ("lang_of", "ids"))
        bits = np.frombuffer(row.column("next")[0].as_buffer(), np.uint8)
        self.next = np.unpackbits(bits, count=max(len(self.ids) - 1, 0)).astype(bool)

    @property
    def hash(self) -> np.ndarray:
        """A hash per word and language."""
        of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        of_lang = np.fromiter(map(xxhash.xxh3_64_intdigest, self.langs.to_pylist()), np.uint64, len(self.langs))
        return mixed([of_lang[self.lang_of], of_word])

    def pairs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of following words as (first, second), and the pair's number per place (-1: none).

        ``keep`` says per word number whether pairs may hold it.
        """
        held = self.next & keep[self.ids[:-1]] & keep[self.ids[1:]]
        size = len(self.words)
        codes, inverse = np.unique(self.ids[:-1][held] * size + self.ids[1:][held], return_inverse=True)
        number = np.full(len(self.ids), -1, np.int64)
        number[:-1][held] = inverse
        return codes // size, codes % size, number


def _rows(langs: pa.Array, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "c"]
    )


def _found(parts: DataFrame, make: Callable[[Grams], Iterator[pa.RecordBatch]], schema: str = _COUNTS) -> DataFrame:
    """What ``make`` finds in the slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = Grams(batch.slice(i, 1))
                if len(grams.ids):
                    for made in make(grams):
                        yield from (made.slice(at, _ROWS) for at in range(0, made.num_rows, _ROWS))

    return parts.mapInArrow(run, schema)


def _counted(parts: DataFrame, make: Callable[[Grams], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Fold the n-grams of the slices to one exact count per language and phrase."""
    return _found(parts, make).groupBy("lang", "phrase").agg(F.sum("c").alias("a"))


def _words(grams: Grams) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words of a language under a null phrase."""
    counts = np.bincount(grams.ids, minlength=len(grams.words))
    yield _rows(grams.langs.take(pa.array(grams.lang_of)), grams.words, counts)
    totals = np.bincount(grams.lang_of, weights=counts, minlength=len(grams.langs)).astype(np.int64)
    yield _rows(grams.langs, pa.nulls(len(grams.langs), pa.string()), totals)


def _joined(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, " ")


class Filter:
    """A bit filter of n-grams, at most ``FILTER_BITS`` bits; ``has`` answers for 64-bit hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> np.ndarray:
        """The probes of hashes, one row per hash."""
        step = mixed([hashes]) | np.uint64(1)
        return (hashes[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)) & np.uint64(size - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, len(self.bits) * 8).astype(np.int64)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    @classmethod
    def of(cls, rows: DataFrame) -> Filter:
        """Fold phrases (``lang, phrase``) or hashes (``h``) to a filter; only its bits reach the driver."""
        count = rows.count()
        size = min(max(1 << 15, 1 << (16 * max(count, 1) - 1).bit_length()), FILTER_BITS)
        hashed = "h" in rows.columns

        def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if hashed:
                    h = batch.column("h").to_numpy().astype(np.int64).view(np.uint64)
                else:
                    h = phrase_hashes(batch.column("lang"), batch.column("phrase"))
                yield pa.RecordBatch.from_arrays([pa.array(cls.places(h, size).ravel().astype(np.int64) + 1)], ["at"])

        folded = (
            rows.select(*(["h"] if hashed else ["lang", "phrase"]))
            .mapInArrow(probes, "at long")
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        )
        bits = np.zeros(size // 8, np.uint8)
        for row in folded.collect():
            first = (row["bucket"] - 1) * 4096
            bits[first : first + 4096] = np.frombuffer(row["bits"], np.uint8)
        return cls(bits)


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hash of phrases of one or two words, the same as ``Grams`` makes from words."""
    out = np.zeros(len(phrases), np.uint64)
    of_lang = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in pc.unique(langs).to_pylist()}
    for i, (lang, phrase) in enumerate(zip(langs.to_pylist(), phrases.to_pylist())):
        words = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in phrase.split(" ")], np.uint64)
        parts = mixed([np.full(len(words), of_lang[lang], np.uint64), words])
        out[i] = parts[0] if len(parts) == 1 else mixed([parts[:1], parts[1:]])[0]
    return out


def _score(a: Column, l: Column, r: Column) -> Column:
    """``floor(SCALE * a * a / (l * r))``, exact: whole numbers of up to 38 digits."""
    a, l, r = (x.cast("decimal(18,0)") for x in (a, l, r))
    product = (F.lit(SCALE).cast("decimal(7,0)") * a).cast("decimal(25,0)") * a.cast("decimal(13,0)")
    return F.call_function("div", product, l * r)


def _best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language; every task hands on its own first ones only."""
    order = ["score", "a", "phrase"]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            both = batch if kept is None else pd.concat([kept, batch])
            kept = both.sort_values(order, ascending=[False, False, True]).groupby("lang", sort=False).head(top)
        if kept is not None:
            yield kept

    ranks = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.mapInPandas(first, found.schema).withColumn("rank", F.row_number().over(ranks).cast("long"))
    return ranked.where(F.col("rank") <= top)


def _levels(pairs: DataFrame, wanted: int) -> DataFrame:
    """``lang, level``: the score that ``wanted`` pairs of a language reach, 0 where there are fewer.

    Scores are whole numbers up to ``SCALE``, so a language has at most that many rows to sum up.
    """
    held = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("lang").orderBy(F.col("score").desc())
    reached = held.withColumn("n", F.sum("n").over(above))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("n") >= wanted, F.col("score"))), F.lit(0)).alias("level"))


def _part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` of a three-word phrase, from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _triples(counted: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Score three-word phrases by their weaker cut; ties go to the cut after the first word."""
    def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
        return table.select("lang", F.col("phrase").alias(key), F.col("a").alias(value))

    rows = counted.withColumns({"w1": _part(1, 1), "w23": _part(2, 3), "w12": _part(1, 2), "w3": _part(3, 3)})
    rows = (
        rows.join(lookup(words, "w1", "l1"), ["lang", "w1"]).join(lookup(pairs, "w23", "r1"), ["lang", "w23"])
        .join(lookup(pairs, "w12", "l2"), ["lang", "w12"]).join(lookup(words, "w3", "r2"), ["lang", "w3"])
        .withColumns({"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": _score(F.col("a"), F.col("l2"), F.col("r2"))})
    )
    late = F.col("s2") < F.col("s1")
    return rows.select(
        "lang", "phrase", "a",
        F.when(late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(late, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )


def collocations(docs: DataFrame, min_count: int = 10, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of 2 to 3 words per language: ``lang, rank, phrase, a, l, r, n, score``.

    All passes run here, with Arrow batches of a slice or two in place of 64 MB, which a task would hold several times over.
    """
    conf = docs.sparkSession.conf
    before = conf.get(_BATCH_BYTES)
    conf.set(_BATCH_BYTES, 2 * _SLICE)
    try:
        return _mined(docs, min_count, top)
    finally:
        conf.set(_BATCH_BYTES, before)


def _mined(docs: DataFrame, min_count: int, top: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    parts = _encoded(docs)
    frequent = F.col("phrase").isNull() | (F.col("a") >= min_count)
    words = materialize(_counted(parts, _words).where(frequent), "collocation-words")
    totals = words.where("phrase is null").select("lang", F.col("a").alias("n"))
    words = words.where("phrase is not null")
    word_filter = context.broadcast(Filter.of(words))

    def hashed(grams: Grams) -> tuple:
        """Pairs of frequent words, their hashes, and the pairs' numbers per place."""
        h = grams.hash
        first, second, number = grams.pairs(word_filter.value.has(h))
        return first, second, number, mixed([h[first], h[second]])

    def rough(grams: Grams) -> Iterator[pa.RecordBatch]:
        *_, number, hashes = hashed(grams)
        counts = np.bincount(number[number >= 0], minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int32))], ["h", "c"])

    def two(grams: Grams) -> Iterator[pa.RecordBatch]:
        first, second, number, hashes = hashed(grams)
        kept = pair_filter.value.has(hashes)
        counts = np.bincount(number[number >= 0], minlength=len(first))[kept]
        first, second = first[kept], second[kept]
        phrases = _joined(grams.words.take(pa.array(first)), grams.words.take(pa.array(second)))
        yield _rows(grams.langs.take(pa.array(grams.lang_of[first])), phrases, counts)

    def three(grams: Grams) -> Iterator[pa.RecordBatch]:
        first, second, number, hashes = hashed(grams)
        known = pair_filter.value.has(hashes)
        grown, inside = known & prefix_filter.value.has(hashes), known & inside_filter.value.has(hashes)
        a, b = number[:-1], number[1:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        held = known[a] & known[b] & (grown[a] | inside[a] | inside[b])
        size = max(len(first), 1)
        codes, counts = np.unique(a[held] * size + b[held], return_counts=True)
        a, b = codes // size, codes % size
        phrases = _joined(*[grams.words.take(pa.array(x)) for x in (first[a], second[a], second[b])])
        yield _rows(grams.langs.take(pa.array(grams.lang_of[first[a]])), phrases, counts)

    def lookup(side: str, value: str) -> DataFrame:
        return words.select("lang", F.col("phrase").alias(side), F.col("a").alias(value))

    # Most pairs are rare: a first count by hash alone, never too low, leaves few whose text must be counted.
    often = _found(parts, rough, "h long, c int").groupBy("h").agg(F.sum("c").alias("a")).where(F.col("a") >= min_count)
    pair_filter = context.broadcast(Filter.of(materialize(often.select("h"), "collocation-hashes")))
    pairs = _counted(parts, two).where(F.col("a") >= min_count)
    pairs = pairs.withColumns({"first": F.substring_index("phrase", " ", 1), "second": F.substring_index("phrase", " ", -1)})
    pairs = pairs.join(lookup("first", "l"), ["lang", "first"]).join(lookup("second", "r"), ["lang", "second"])
    pairs = pairs.select(
        "lang", "phrase", "a", "l", "r",
        _score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
        F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * F.col("a").cast("decimal(18,0)"), F.col("l").cast("decimal(18,0)")).alias("bound"),
    )
    pairs = materialize(pairs, "collocation-pairs")

    out, open_langs, wanted = None, None, top
    while True:
        levels = _levels(pairs, wanted)
        if open_langs is not None:
            levels = levels.join(open_langs, "lang", "left_semi")
        levels = materialize(levels, "collocation-levels")
        frontier = pairs.join(levels, "lang").where(F.col("bound") >= F.col("level"))
        # A phrase's own score never exceeds the bound of what grows from it.
        prefix_filter = context.broadcast(Filter.of(frontier))
        inside_filter = context.broadcast(Filter.of(frontier.where(F.col("score") >= F.col("level"))))
        counted = materialize(_counted(parts, three).where(F.col("a") >= min_count), "collocation-triples")
        longer = counted.select("lang", "a", F.explode(F.array(_part(1, 2), _part(2, 3))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        alone = frontier.where(F.col("score") >= F.col("level")).join(longer, ["lang", "phrase"], "left")
        alone = alone.where(F.col("longer").isNull() | (2 * F.col("longer") < F.col("a")))
        grown = _triples(counted, pairs, words).join(levels, "lang").where(F.col("score") >= F.col("level"))
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        found = materialize(alone.select(*columns).union(grown.select(*columns)), "collocation-found")
        settled = levels.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left")
        still_open = settled.where((F.col("level") > 0) & (F.coalesce("n", F.lit(0)) < top)).select("lang")
        part = materialize(_best(found.join(still_open, "lang", "left_anti"), top), "collocation-best")
        out = part if out is None else out.unionByName(part)
        open_langs = materialize(still_open, "collocation-open")
        if open_langs.isEmpty():
            break
        wanted *= _DEEPER
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
