"""Language identification: known words first, then shorter and shorter character n-grams.

Method. Each language has log frequencies of its words and of the character n-grams (1
to 5) of its words. A word that is known in any language is scored by these word frequencies; an
unseen word falls back to its 5-grams, then 4-grams and so on, at the first
length of which at least half of its n-grams are known. A text gets the language with the
largest sum over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from emberfield.llm.textbatch import Words, flat, slices
from emberfield.session import FINE_BYTES, small_batches

#: Labelled documents per language that the model is fitted on (expected number, chosen by a hash of their ids).
FIT_DOCUMENTS = 2000
#: Most frequent words, and n-grams of each length, kept per language: the bound of the model.
TERMS = 20_000
MAX_LANGUAGES = 500
ORDERS = 5
_SMOOTH = 0.1
_LETTERS = regex.compile(r"\p{L}+")
_RUNS = regex.compile(r"\p{L}+|\n")
#: Bytes of text that are scored at a time. The words of a slice and what is looked up for them take many times as much.
SLICE_BYTES = 1 << 20
#: Distinct words whose scores a task remembers from one slice of texts to the next.
_REMEMBERED = 300_000


def letters(word: bytes) -> list[str]:
    """The letter runs of a word, lower-cased."""
    return _LETTERS.findall(word.decode("utf-8", "replace").lower())


def grams(term: str, order: int) -> list[str]:
    """Character n-grams of a term between marks of its start and end; shorter terms have none."""
    text = f"<{term}>"
    return [text[i : i + order] for i in range(len(text) - order + 1)]


def _counted(batches: Iterator[pa.RecordBatch], flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and n-grams per language, folded inside a task with bounded memory."""
    counts: Counter = Counter()

    def out():
        keys = list(counts)
        yield pa.record_batch(
            {
                "lang": pa.array([k[0] for k in keys], pa.string()),
                "size": pa.array([k[1] for k in keys], pa.int32()),
                "term": pa.array([k[2] for k in keys], pa.string()),
                "n": pa.array([counts[k] for k in keys], pa.int64()),
            }
        )
        counts.clear()

    for part in slices(batches, "text"):
        langs = part.column("lang").to_pylist()
        words = Words(*flat(part.column("text")))
        for lang in set(langs):
            rows = np.flatnonzero([x == lang for x in langs])
            ids = np.concatenate([words.ids[words.bounds[r] : words.bounds[r + 1]] for r in rows])
            for i, n in zip(*np.unique(ids, return_counts=True)):
                for term in letters(words.distinct[i]):
                    counts[lang, 0, term] += int(n)
                    for order in range(1, ORDERS + 1):
                        for gram in grams(term, order):
                            counts[lang, order, gram] += int(n)
            if len(counts) > flush:
                yield from out()
    yield from out()


def fit(labelled: DataFrame, documents: int = FIT_DOCUMENTS, terms: int = TERMS) -> dict:
    """Log frequencies from ``text`` and ``lang`` (nulls of either are left out).

    Fitted on about ``documents`` texts per language, chosen by a hash of ``doc_id``.
    Returns languages in order and, per n-gram length (0: words), the terms and
    their log frequency per language. A word seen once is left to its n-grams. The model has at most ``terms`` entries
    per language and length. No labelled text gives a model without languages. More than ``MAX_LANGUAGES``
    different values of ``lang`` raise ValueError.
    """
    known = labelled.where("text is not null and lang is not null")
    sizes = {lang: n for lang, n in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {"languages": [], "tables": [], "steps": []}
    spark = labelled.sparkSession
    small_batches(spark, FINE_BYTES)
    # At most one entry per language. Rows from Python would start workers beside those that serve the texts.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, documents / n))])
    # A hash of the id spreads evenly over 0..1.
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    some = known.where(at < share[F.col("lang")]).select("lang", "text")
    counts = some.mapInArrow(_counted, "lang string, size int, term string, n long").groupBy("lang", "size", "term").agg(
        F.sum("n").alias("n")
    )
    order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "term")
    kept = counts.where("n > 1 or size > 0").withColumn("at", F.row_number().over(order)).where(F.col("at") <= terms)
    table = kept.select("lang", "size", "term", "n").toPandas()
    languages = sorted(sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    tables = []
    for size in range(ORDERS + 1):
        own = table[table["size"] == size]
        vocabulary = {t: i for i, t in enumerate(sorted(set(own["term"])))}
        n = np.zeros((len(vocabulary), len(languages)))
        n[own["term"].map(vocabulary).to_numpy(int), own["lang"].map(number).to_numpy(int)] = own["n"]
        logs = np.log((n + _SMOOTH) / (n.sum(axis=0) + _SMOOTH * max(1, len(vocabulary))))
        tables.append((vocabulary, logs.astype(np.float32)))
    return {"languages": languages, "tables": tables, "steps": _steps([vocabulary for vocabulary, _ in tables])}


def _steps(vocabularies: list[dict[str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams as a tree of characters. Per length: the sorted keys of its nodes (node of the shorter prefix
    and next character in one integer), and which n-gram a node is, -1 if it is only a prefix of longer ones."""
    steps, above = [], {"": 0}
    for size in range(1, ORDERS + 1):
        prefixes = sorted({g[:size] for vocabulary in vocabularies[size:] for g in vocabulary})
        keys = np.array([above[g[:-1]] << 21 | ord(g[-1]) for g in prefixes], np.int64)
        steps.append((keys, np.array([vocabularies[size].get(g, -1) for g in prefixes], np.int64)))
        above = {g: i for i, g in enumerate(prefixes)}
    return steps


def unseen_scores(terms: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log frequencies of terms that are no known words, by their longest useful n-grams, and whether there are any.

    All positions of all terms go down the tree together, one character at a time.
    """
    scores = np.zeros((len(terms), len(model["languages"])), np.float32)
    told = np.zeros(len(terms), bool)
    if not terms:
        return scores, told
    # Marks of start and end separate the terms, so no path in the tree leads from one into the next.
    codes = np.frombuffer(f"<{'><'.join(terms)}>".encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, terms), np.int64, len(terms)) + 2
    term_at = np.repeat(np.arange(len(terms)), lengths)
    places, nodes, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
    for size, (keys, which) in enumerate(model["steps"], 1):
        inside = places + size <= len(codes)
        places, nodes = places[inside], nodes[inside]
        if not len(keys) or not len(places):
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            places, nodes = places[:0], nodes[:0]
            continue
        key = nodes << 21 | codes[places + size - 1]
        nodes = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[nodes] == key
        places, nodes = places[hit], nodes[hit]
        gram = which[nodes]
        found.append((term_at[places[gram >= 0]], gram[gram >= 0]))
    for size in range(ORDERS, 0, -1):
        owner, gram = found[size - 1]
        n = np.bincount(owner, minlength=len(terms))
        useful = ~told & (n > 0) & (2 * n >= lengths - size + 1)
        taken = useful[owner]
        if taken.any():
            owner, gram = owner[taken], gram[taken]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sums = np.add.reduceat(model["tables"][size][1][gram], first, axis=0)
            scores[owner[first]] = sums / n[owner[first]][:, None]
        told |= useful
    return scores, told


def word_scores(words: list[bytes], model: dict) -> np.ndarray:
    """Per word: the sum of its letter runs' log frequencies per language, how many runs have some, and how many there are."""
    width = len(model["languages"])
    out = np.zeros((len(words), width + 2), np.float32)
    # White space separates words, so one pass over all of them finds the letter runs of each.
    of, terms, word = [], [], 0
    for found in _RUNS.findall(b"\n".join(words).decode("utf-8", "replace").lower()):
        if found == "\n":
            word += 1
        else:
            of.append(word)
            terms.append(found)
    if not terms:
        return out
    scores, told = np.zeros((len(terms), width), np.float32), np.zeros(len(terms), bool)
    if width:
        vocabulary, logs = model["tables"][0]
        at = np.array([vocabulary.get(t, -1) for t in terms], np.int64)
        told = at >= 0
        scores[told] = logs[at[told]]
        rest = np.flatnonzero(~told)
        scores[rest], told[rest] = unseen_scores([terms[i] for i in rest], model)
    of = np.array(of, np.int64)
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    out[of[first], :width] = np.add.reduceat(scores, first, axis=0)
    out[of[first], width] = np.add.reduceat(told.astype(np.float32), first)
    out[of[first], width + 1] = np.diff(np.append(first, len(of)))
    return out


def _predicted(batches: Iterator[pa.RecordBatch], model, carried: list[str]) -> Iterator[pa.RecordBatch]:
    languages = model.value["languages"]
    width = len(languages)
    memory, known_rows = {}, np.zeros((0, width + 2), np.float32)
    for part in slices(batches, "text", SLICE_BYTES):
        words = Words(*flat(part.column("text")))
        rows = part.num_rows
        if len(memory) > _REMEMBERED:
            memory, known_rows = {}, known_rows[:0]
        new = [w for w in words.distinct if w not in memory]
        if new:
            memory.update(zip(new, range(len(memory), len(memory) + len(new))))
            known_rows = np.concatenate((known_rows, word_scores(new, model.value)))
        scores = known_rows[[memory[w] for w in words.distinct]]
        of = words.rows()
        total = np.stack(
            [np.bincount(of, scores[words.ids, k], rows) if len(of) else np.zeros(rows) for k in range(width + 2)], axis=1
        )
        sums, known, seen = total[:, :width], total[:, width], total[:, width + 1]
        if width:
            mean = sums / np.sqrt(np.maximum(known, 1))[:, None]
            power = np.exp(mean - mean.max(axis=1, keepdims=True))
            share = power / power.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            lang = [languages[b] if s > 0 else "und" for b, s in zip(best, seen)]
            score = np.where(seen > 0, share[np.arange(rows), best], 0.0)
        else:
            lang, score = ["und"] * rows, np.zeros(rows)
        yield pa.record_batch(
            [*[part.column(c) for c in carried], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
            [*carried, "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row with a ``text`` (columns of these names are replaced).

    Texts that are null or without letters are ``und`` with score 0, as are all with a model
    without languages. Equal sums go to the first language by name. The score is the share
    of the best language after scaling sums by the root of the number of words.
    """
    spark = docs.sparkSession
    small_batches(spark, FINE_BYTES)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(lambda it: _predicted(it, shared, kept), f"{schema}, lang_pred string, score double")


def held_out() -> F.Column:
    """Rows that are never fitted on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
