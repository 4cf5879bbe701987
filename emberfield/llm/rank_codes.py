"""Token ids as files of frequency-ranked, byte-aligned variable-length codes.

Method. Ids are replaced by their rank in the order of frequency over the whole corpus, so
frequent ones need one byte. A value takes one to four bytes; its length stands in two bits of a
separate control stream, four values per control byte. Decoding looks up the lengths of four
values by control byte and gathers the bytes with numpy.

The files are Parquet: ``segments`` (shard, segment, doc_ids, lengths, control, data) in
ascending doc_id order, and ``ranks`` (id, rank).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from emberfield.llm.textbatch import slices
from emberfield.llm.tokens import Encoder
from emberfield.session import materialize, small_batches

#: Ids of a segment, about; a longer document is a segment of its own.
SEGMENT = 1 << 18
#: Lengths of the four values of each control byte.
_LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = lengths - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again, by table lookup of control bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(count, np.uint32)
    for k in range(4):
        own = np.flatnonzero(lengths > k)
        out[own] |= raw[ends[own] - lengths[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path)
    for part in slices(batches, "text", keep=True):
        ids, bounds = encoder.encode(part.column("text"))
        yield pa.record_batch(
            {
                "doc_id": part.column("doc_id"),
                "codes": pa.array(
                    [np.append(ids[a:b], np.uint32(end)).astype("<u2" if encoder.narrow else "<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])],
                    pa.binary(),
                ),
                "width": np.full(part.num_rows, 2 if encoder.narrow else 4, np.int32),
            }
        )


def _ids(raw: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<u2" if width == 2 else "<u4")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        # Codes of equal width lie behind each other: they are counted at once, not by document.
        for width in pc.unique(batch.column("width")).to_pylist():
            codes = batch.column("codes").filter(pc.equal(batch.column("width"), width))
            _, offsets, data = codes.buffers()
            ends = np.frombuffer(offsets, np.int32)[codes.offset : codes.offset + len(codes) + 1]
            ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<u2" if width == 2 else "<u4")
            own = np.bincount(ids)
            if len(own) > len(counts):
                counts = np.append(counts, np.zeros(len(own) - len(counts), np.int64))
            counts[: len(own)] += own
    seen = np.flatnonzero(counts)
    yield pa.record_batch({"id": seen, "n": counts[seen]})


def _segments(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    rank = ranks.value
    shard, segment, docs, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

    def out():
        control, data = encode_values(rank[np.concatenate(parts)])
        return pa.record_batch(
            {
                "shard": pa.array([shard], pa.int32()),
                "segment": pa.array([segment], pa.int32()),
                "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "lengths": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()),
                "data": pa.array([data], pa.binary()),
            }
        )

    for batch in batches:
        for doc, raw, width in zip(batch.column("doc_id").to_pylist(), batch.column("codes"), batch.column("width").to_pylist()):
            own = _ids(raw, width)
            if parts and held + len(own) > SEGMENT:
                yield out()
                segment, docs, parts, held = segment + 1, [], [], 0
            docs.append(doc)
            parts.append(own)
            held += len(own)
    if parts:
        yield out()


def write(docs: DataFrame, tokenizer: str, end: int, folder: str) -> None:
    """Encode every text of ``docs`` (``doc_id, text``) and write the files under ``folder``.

    Each text is followed by the end id; a null or empty text is the end id alone. Rows are ordered by
    doc_id, null first; rows of the same doc_id follow each other. Other columns are
    ignored. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = materialize(
        docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
            lambda it: _tokens(it, tokenizer, end), "doc_id long, codes binary, width int"
        ),
        "rank-codes-tokens",
    )
    counts = tokens.mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary at most.
    order = counts.orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(np.int64)
    spark.createDataFrame([(int(i), r) for r, i in enumerate(order)], "id long, rank long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)
    tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("codes")
    ).mapInArrow(
        lambda it: _segments(it, ranks),
        "shard int, segment int, doc_ids array<long>, lengths array<long>, control binary, data binary",
    ).write.parquet(f"{folder}/segments")


def _decoded(batches: Iterator[pa.RecordBatch], ids, keep: bool) -> Iterator[pa.RecordBatch]:
    names = ids.value
    for batch in batches:
        for row in range(batch.num_rows):
            lengths = np.array(batch.column("lengths")[row].as_py(), np.int64)
            ends = np.cumsum(lengths)
            values = names[
                decode_values(batch.column("control")[row].as_py(), batch.column("data")[row].as_py(), int(ends[-1]))
            ].astype("<u4")
            raw = [values[a:b].tobytes() for a, b in zip(ends - lengths, ends)]
            columns = {
                "shard": pa.array([batch.column("shard")[row].as_py()] * len(raw), pa.int32()),
                "segment": pa.array([batch.column("segment")[row].as_py()] * len(raw), pa.int32()),
                "doc_id": batch.column("doc_ids")[row].values,
                "inner": pa.array(ends - lengths),
                "n_tokens": pa.array(lengths),
                "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
            }
            if keep:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.record_batch(columns)


def read(spark: SparkSession, folder: str, keep: bool = False) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` (with ``keep`` also ``ids`` as bytes).

    ``start`` counts the ids of all documents before. The running sums go over segments inside
    a shard and over shards (one row per written partition).
    """
    order = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")["id"].to_numpy(np.int64)
    ids = spark.sparkContext.broadcast(order.astype(np.uint32))
    segments = spark.read.parquet(f"{folder}/segments")
    sizes = segments.select("shard", "segment", F.expr("aggregate(lengths, 0L, (s, x) -> s + x)").alias("size"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda w, c: F.coalesce(F.sum(c).over(w), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("size").alias("size")).select("shard", zero(ahead, "size").alias("base"))
    starts = sizes.withColumn("within", zero(inside, "size")).join(shards, "shard")
    schema = "shard int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * keep
    rows = segments.mapInArrow(lambda it: _decoded(it, ids, keep), schema)
    return rows.join(starts.select("shard", "segment", "within", "base"), ["shard", "segment"]).select(
        "doc_id",
        (F.col("base") + F.col("within") + F.col("inner")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *["ids"] * keep,
    )
