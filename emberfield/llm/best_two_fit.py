"""Best-two-fit packing of token sequences into bins of fixed capacity.

Method. A bin is filled greedily with the longest pieces that fit. Then its smallest
piece is exchanged for two unpacked pieces whose joint length fits the gap that
opens more tightly. Pieces of equal length are interchangeable, so bins are
composed on the histogram of lengths (at most ``capacity`` numbers, whatever the
table's size) and each composition is used as often as the counts allow. The
pieces then take their places by their rank among those of equal length, which
Spark computes with salted counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberfield.llm.textbatch import slices
from emberfield.llm.tokens import Encoder
from emberfield.session import materialize, small_batches

CAPACITY = 1024
#: Pieces per salt and length on average.
_SALTED = 5000


def compose(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins for ``counts[length]`` pieces: lengths in a bin, and how many such bins.

    Every composition uses up at least one length, so there are few of them.
    """
    left = counts.astype(np.int64).copy()
    lengths = np.arange(len(left))
    out = []
    while left.any():
        own: list[int] = []
        gap = capacity

        def largest(limit: int) -> int:
            some = np.flatnonzero(left[: limit + 1] > 0)
            return int(some[-1]) if len(some) else 0

        while gap > 0 and (size := largest(min(gap, len(left) - 1))):
            own.append(size)
            left[size] -= 1
            gap -= size
        while gap > 0 and len(own) > 1:
            small = own[-1]
            room = gap + small
            # The best partner of each length: the largest one that still fits beside it.
            best = np.maximum.accumulate(np.where(left > 0, lengths, 0))
            first = np.flatnonzero(left[: min(room, len(left))] > 0)
            first = first[first > 0]
            partner = best[np.minimum(room - first, len(left) - 1)]
            alone = (partner == first) & (left[first] < 2)
            partner = np.where(alone, best[np.maximum(first - 1, 0)], partner)
            total = np.where(partner > 0, first + partner, 0)
            if not len(total) or total.max() <= small:
                break
            at = int(np.argmax(total))
            a, b = int(first[at]), int(partner[at])
            left[small] += 1
            left[a] -= 1
            left[b] -= 1
            own = sorted([*own[:-1], a, b], reverse=True)
            gap = capacity - sum(own)
        need = Counter(own)
        times = 1 + min(int(left[size]) // k for size, k in need.items())
        for size, k in need.items():
            left[size] -= k * (times - 1)
        out.append((own, times))
    return out


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, keep_ids: bool):
    encoder = Encoder.of(path)
    for part in slices(batches, "text", keep=True):
        ids, bounds = encoder.encode(part.column("text"))
        rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "ids")}
        for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
            first = len(own) % capacity or capacity
            cuts = [0, *range(first, len(own) + 1, capacity)] if len(own) > capacity else [0, len(own)]
            for piece, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                raw = own[x:y].tobytes()
                for key, value in zip(rows, (row, piece, x, y - x, zlib.crc32(raw), raw if keep_ids else None)):
                    rows[key].append(value)
        columns = {
            "doc_id": part.column("doc_id").take(pa.array(rows["row"], pa.int64())),
            "piece": pa.array(rows["piece"], pa.int32()),
            **{k: pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")},
        }
        if keep_ids:
            columns["ids"] = pa.array(rows["ids"], pa.binary())
        yield pa.record_batch(columns)


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every text: ``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as bytes).

    A text's ids get the end id; texts of more than ``capacity`` ids are cut so that
    all pieces but the first are full. A null or empty text is the end id alone. Rows are
    taken as they are: repeated or null doc_ids give their own pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        lambda it: _cut(it, tokenizer, end, capacity, keep_ids), schema
    )


def _placed(batches: Iterator[pd.DataFrame], table) -> Iterator[pd.DataFrame]:
    keys, first, each, base, at, offsets = table.value
    for frame in batches:
        rank, length = frame.pop("rank").to_numpy(), frame["length"].to_numpy()
        own = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
        nth = rank - first[own]
        yield frame.assign(sequence_id=base[own] + nth // each[own], offset=offsets[at[own] + nth % each[own]])


def packed(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``length`` (1 to capacity) and ``doc_id, piece``.

    Sequences are numbered from 0 and filled without gaps. An empty table stays
    empty. The table is read three times, so it should be stored.
    """
    spark = table.sparkSession
    salts = max(1, table.count() // _SALTED)
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = materialize(salted.groupBy("length", "salt").count(), "pack-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # at most `capacity` rows
        histogram[length] = n
    entries, offsets, used, base = [], [], np.zeros(capacity + 1, np.int64), 0
    for own, times in compose(histogram, capacity):
        starts = np.concatenate(([0], np.cumsum(own)[:-1]))
        for length in sorted(set(own)):
            places = [int(s) for s, size in zip(starts, own) if size == length]
            entries.append((length, used[length], len(places), base, len(offsets)))
            offsets += places
            used[length] += len(places) * times
        base += times
    entries.sort()
    columns = np.array(entries or [(0, 0, 1, 0, 0)], np.int64).T
    places = spark.sparkContext.broadcast(
        ((columns[0] << 48) + columns[1], *columns[1:], np.array(offsets or [0], np.int64))
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in table.columns])
    ranked = (
        salted.withColumn("nth", F.row_number().over(within))
        .join(shift, ["length", "salt"])
        .withColumn("rank", (F.col("shift") + F.col("nth") - 1).cast("long"))
        .select(*table.columns, "rank")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return ranked.mapInPandas(lambda it: _placed(it, places), f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack whole texts: one row per piece with its sequence and place."""
    return packed(materialize(pieces(docs, tokenizer, end, capacity), "pack-pieces"), capacity)


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """Token ids per sequence: ``sequence_id, ids`` (bytes of little-endian 32-bit ids).

    ``placed`` comes from :func:`packed`, ``ids`` from :func:`pieces` with ``keep_ids``. A
    sequence holds at most ``capacity`` pieces, so its group is bounded.
    """
    joined = placed.join(ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return (
        joined.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
        .select("sequence_id", F.expr("aggregate(own, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"))
    )
