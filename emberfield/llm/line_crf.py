"""Quality rules by line labelling: a linear-chain CRF marks content and boilerplate.

Method. Each line that has a word becomes a set of binary shape features. A linear-chain
conditional random field with the labels content and boilerplate is fitted on lines of
documents with a quality label (a line takes its document's label); Viterbi decoding marks
the lines of every document, and the share of characters in content lines
decides whether the document is kept. Exact word and repetition counts
give a base rule beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from emberfield.llm.textbatch import Words, flat, mixed, slices, windows
from emberfield.session import FINE_BYTES, small_batches

#: Labelled documents per class that the model is fitted on (expected number, chosen by a hash of their ids).
FIT_DOCUMENTS = 1500
#: Lines of a training sequence; longer documents give several sequences, none is cut off.
SEQUENCE = 64
#: Share of characters in content lines from which a document is kept.
CONTENT_SHARE = 0.5
FEATURES = 16
#: Bytes of text that are counted at a time; a count over bytes takes eight times as much memory.
SLICE_BYTES = 1 << 20
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Lines:
    """Lines that hold a word, for a slice of texts, with their shape features."""

    def __init__(self, words: Words):
        data, offsets = words.data, words.offsets
        rows = words.rows()
        breaks = np.flatnonzero(data == 10)
        key = np.searchsorted(breaks, words.starts) + rows
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(key)])).astype(np.int64) if len(first) else first
        self.rows = rows[first]
        at = np.searchsorted(breaks, words.starts[first])
        before = np.where(at > 0, breaks[np.maximum(at - 1, 0)] + 1, 0) if len(breaks) else np.zeros(len(first), np.int64)
        after = np.where(at < len(breaks), breaks[np.minimum(at, len(breaks) - 1)], len(data)) if len(breaks) else np.full(len(first), len(data))
        self.starts = np.maximum(before, offsets[self.rows])
        self.ends = np.minimum(after, offsets[self.rows + 1])
        self.bounds = np.searchsorted(self.rows, np.arange(len(offsets)))
        raw = data.tobytes()
        seen: set = set()
        copy = np.zeros(len(first), bool)
        for i, (r, a, b) in enumerate(zip(self.rows, self.starts, self.ends)):
            mark = (int(r), xxhash.xxh3_128_digest(raw[a:b]))
            copy[i] = mark in seen
            seen.add(mark)
        self.copy = copy

        def count(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[self.ends] - total[self.starts]

        upper = (data >= 65) & (data <= 90)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        lower = (data >= 97) & (data <= 122)
        lower[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x9F)
        n = np.maximum(last - first, 1)
        again = np.concatenate(([False], words.ids[1:] == words.ids[:-1])) & ~head if len(key) else head
        repeats = np.concatenate(([0], np.cumsum(again)))
        repeats = repeats[last] - repeats[first]
        chars = np.maximum(count(words.solid), 1)
        self.chars = count((data & 0xC0) != 0x80)
        symbols = count(SYMBOLS[data])
        tail = data[np.maximum(words.starts[last - 1] + np.diff(words.word_offsets)[last - 1] - 1, 0)] if len(first) else np.zeros(0, np.uint8)
        shapes = [
            np.ones(len(first), bool),
            n <= 3,
            (n > 3) & (n <= 8),
            n > 60,
            symbols >= 0.1 * n,
            symbols >= 0.5 * n,
            count(data == 33) >= 0.5 * n,
            count(upper) >= 0.5 * np.maximum(count(upper | lower), 1),
            count(upper) == 0,
            repeats >= 0.3 * n,
            count((data >= 48) & (data <= 57)) >= 0.3 * chars,
            count(data == 124) >= 0.25 * n,
            copy,
            np.isin(tail, list(b".!?")),
            chars > 12 * n,
            chars < 2.5 * n,
        ]
        self.features = np.stack(shapes, axis=1).astype(np.float32)


SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def base_counts(words: Words, lines: Lines) -> dict[str, np.ndarray]:
    """Exact counts per row, as the base rule needs them."""
    rows = len(words.bounds) - 1
    total = lambda mask: np.concatenate(([0], np.cumsum(mask)))[words.offsets]
    first, ends = windows(words.ids, words.bounds, 3)
    keys = mixed([words.ids[first + k].astype(np.uint64) for k in range(3)]) if len(first) else np.zeros(0, np.uint64)
    covered = np.zeros(len(words.ids) + 1, bool)
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a > 1:
            _, back, n = np.unique(keys[a:b], return_inverse=True, return_counts=True)
            at = first[a:b][n[back] > 1]
            for k in range(3):
                covered[at + k] = True
    repeat = np.concatenate(([0], np.cumsum(covered)))
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": np.diff(total(words.solid & ((words.data & 0xC0) != 0x80))),
        "n_symbols": np.diff(total(SYMBOLS[words.data])),
        "n_dup_lines": np.bincount(lines.rows[lines.copy], minlength=rows)[:rows],
        "n_repeat_words": repeat[words.bounds[1:]] - repeat[words.bounds[:-1]],
    }


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE_BYTES):
        lines = Lines(Words(*flat(part.column("text"))))
        codes = lines.features.astype(np.int64) @ (1 << np.arange(FEATURES))
        quality = part.column("quality").to_pylist()
        rows, labels = [], []
        for label, a, b in zip(quality, lines.bounds[:-1], lines.bounds[1:]):
            for at in range(a, b, SEQUENCE):
                rows.append(codes[at : min(at + SEQUENCE, b)].tolist())
                labels.append(label)
        yield pa.record_batch({"codes": pa.array(rows, pa.list_(pa.int32())), "quality": pa.array(labels, pa.int32())})


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit_chain(codes: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> dict:
    """Maximum-likelihood CRF weights for sequences of feature codes, each with one label (0 or 1).

    Gradients come from forward-backward sums over all sequences at once.
    """
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(-lengths, kind="stable")
    lengths, labels = lengths[order], np.asarray(labels)[order]
    steps, many = int(lengths[0]), len(codes)
    grid = np.zeros((steps, many), np.int64)
    for i, j in enumerate(order):
        grid[: lengths[i], i] = codes[j]
    active = [int((lengths > t).sum()) for t in range(steps)]
    known, back = np.unique(grid, return_inverse=True)
    back = back.reshape(grid.shape)
    shapes = ((known[:, None] >> np.arange(FEATURES)) & 1).astype(float)
    weights, moves = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    gain = [np.zeros_like(weights), np.zeros_like(moves)]
    total = lengths.sum()
    for _ in range(rounds):
        emit = shapes @ weights
        forward = [emit[back[0, : active[0]]]]
        for t in range(1, steps):
            n = active[t]
            forward.append(_log_sum(forward[-1][:n, :, None] + moves, 1) + emit[back[t, :n]])
        backward = [np.zeros((active[-1], 2))]
        for t in range(steps - 2, -1, -1):
            n, m = active[t], active[t + 1]
            own = np.zeros((n, 2))
            own[:m] = _log_sum(moves + (emit[back[t + 1, :m]] + backward[0])[:, None, :], 2)
            backward.insert(0, own)
        norm = _log_sum(forward[0] + backward[0], 1)
        counts = np.zeros((len(known), 2))
        moved = np.zeros((2, 2))
        for t in range(steps):
            n = active[t]
            share = -np.exp(forward[t] + backward[t] - norm[:n, None])
            share[np.arange(n), labels[:n]] += 1
            for y in (0, 1):
                counts[:, y] += np.bincount(back[t, :n], share[:, y], len(known))
            if t + 1 < steps:
                m = active[t + 1]
                pair = forward[t][:m, :, None] + moves + (emit[back[t + 1, :m]] + backward[t + 1])[:, None, :]
                moved -= np.exp(pair - norm[:m, None, None]).sum(axis=0)
                moved[0, 0] += (labels[:m] == 0).sum()
                moved[1, 1] += (labels[:m] == 1).sum()
        for at, (value, slope) in enumerate(((weights, shapes.T @ counts / total), (moves, moved / total))):
            slope = slope - penalty * value
            gain[at] += slope**2
            value += rate * slope / (np.sqrt(gain[at]) + 1e-8)
    return {"weights": weights, "moves": moves}


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> dict | None:
    """Fit on about ``documents`` labelled texts per class; None unless both classes occur.

    ``labels`` has ``doc_id`` and ``quality``; null labels are left out, and a document with several
    labels takes the smallest. The chosen ids (2 x ``documents`` expected) are broadcast.
    """
    small_batches(docs.sparkSession, FINE_BYTES)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality")
    )
    sizes = {q: n for q, n in known.groupBy("quality").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    at = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("quality") == 1, documents / sizes[1]).otherwise(documents / sizes[0])
    some = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known.where(at < share)), "doc_id")
    table = some.mapInArrow(_sequences, "codes array<int>, quality int").toPandas()
    if table["quality"].nunique() < 2:
        return None
    return fit_chain([np.array(c) for c in table["codes"]], table["quality"].to_numpy())


def decode(features: np.ndarray, bounds: np.ndarray, model: dict) -> np.ndarray:
    """Viterbi labels (1: content) of all lines; sequences advance together, step by step."""
    emit = features.astype(float) @ model["weights"]
    moves = model["moves"]
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    out = np.zeros(len(features), np.int8)
    if not len(order):
        return out
    starts, sizes = bounds[:-1][order], n[order]
    best = emit[starts]
    choice = np.zeros((len(features), 2), np.int8)
    ends = np.zeros(len(order), np.int8)
    for t in range(int(sizes[0])):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        if t:
            ways = best[:m, :, None] + moves
            choice[starts[:m] + t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + emit[starts[:m] + t]
        done = int(np.searchsorted(-sizes, -(t + 1), side="left"))
        ends[done:m] = best[done:m].argmax(axis=1)
    state = ends.copy()
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:m] + t
        out[at] = state[:m]
        state[:m] = choice[at, state[:m]]
    return out


def _judged(batches, model, carried: list[str], share: float) -> Iterator[pa.RecordBatch]:
    chain = model.value
    for part in slices(batches, "text", SLICE_BYTES):
        words = Words(*flat(part.column("text")))
        lines = Lines(words)
        counts = base_counts(words, lines)
        rows = part.num_rows
        marks = decode(lines.features, lines.bounds, chain) if chain else np.ones(len(lines.rows), np.int8)
        content = np.bincount(lines.rows, marks * lines.chars, rows)[:rows] if len(marks) else np.zeros(rows)
        chars = np.bincount(lines.rows, lines.chars, rows)[:rows] if len(marks) else np.zeros(rows)
        part_share = np.where(chars > 0, content / np.maximum(chars, 1), 0.0)
        failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
        columns = {c: part.column(c) for c in carried}
        columns |= {k: pa.array(np.asarray(counts[k], np.int64)) for k in _BASE}
        columns |= {
            "content_share": pa.array(part_share),
            "base_failed": pa.array(failed),
            "kept": pa.array(~failed & (part_share >= share)),
        }
        yield pa.record_batch(columns)


def judge(docs: DataFrame, model: dict | None, share: float = CONTENT_SHARE) -> DataFrame:
    """Add the counts, ``content_share``, ``base_failed`` and ``kept`` to every row with a ``text``.

    Words are runs without ASCII white space. Null and empty texts have no words and fail the base rule.
    Without a model every line counts as content. Columns of the added names are replaced;
    other columns are carried along.
    """
    small_batches(docs.sparkSession, FINE_BYTES)
    added = {*_BASE, "content_share", "base_failed", "kept"}
    kept = [c for c in docs.columns if c not in added]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema]
        + [f"{k} long" for k in _BASE]
        + ["content_share double, base_failed boolean, kept boolean"]
    )
    return frame.mapInArrow(lambda it: _judged(it, shared, kept, share), schema)
