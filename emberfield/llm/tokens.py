"""Encode texts with the tokenizers library, each distinct chunk once per worker.

A chunk runs from one white-space gap to the next; the pre-tokenizers used here
never join text across such a gap, so a text's ids are the ids of its chunks. Nor do
they join an ASCII letter or digit with what is no such letter or no digit after it, so
``Encoder`` cuts there as well.

New chunks are encoded some at a time as one text. The bytes that each id stands for
tell where a chunk ends; where they do not fit, a special token between the chunks does.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from emberfield.llm.textbatch import KEPT, LOWER, WHITE, encoded, flat

#: Entries of each of the two halves of a worker's memory of chunks.
MEMORY = 200_000
#: The same for an encoder of the tokenizers library, whose chunks cost more.
CHUNKS = 300_000
#: Chunks that are encoded as one text, and how many of these texts are measured at once.
_JOINED = 32
_TEXTS = 100

_BYTES = np.arange(256)
#: 1 ASCII letters, 2 digits, 3 other visible ASCII characters, 0 all else.
_KIND = np.where((_BYTES > 32) & (_BYTES < 127), 3, 0).astype(np.uint8)
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


def _visible_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before a place is visible for sure: multi-byte ones could be white space."""
    last, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (last > 32) & (last != 127) & ((last < 0x80) | ~((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))


def chunk_offsets(data: np.ndarray, offsets: np.ndarray, finer: bool = False) -> np.ndarray:
    """Offsets at which texts can be cut without changing their tokens.

    A cut lies before ASCII white space that follows a visible character. After a
    multi-byte character that could itself be white space no cut is made. ``finer`` cuts also after
    an ASCII letter or digit before a visible ASCII character of another kind.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        white = np.flatnonzero(WHITE[data[1:]]) + 1
        cut[white[_visible_before(data, white)]] = True
        if finer:
            kind = _KIND[data]
            cut[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (kind[:-1] < 3)
    cut[offsets] = True
    return np.flatnonzero(cut)


def gathered(values: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``values[ends[i]:ends[i + 1]]`` for the given ids; also their new bounds."""
    lengths = np.diff(ends)[ids]
    out = np.concatenate(([0], np.cumsum(lengths)))
    return values[np.arange(out[-1]) + np.repeat(ends[:-1][ids] - out[:-1], lengths)], out


class Memory:
    """A bounded map from chunk to ids: a young half, and an old one that goes when the young is full."""

    def __init__(self, entries: int = MEMORY):
        self.entries, self.young, self.old = entries, {}, {}

    def looked_up(self, keys: list[bytes], make) -> list[bytes]:
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        missing = []
        for i in [i for i, found in enumerate(out) if found is None]:
            found = old.get(keys[i])
            if found is None:
                missing.append(i)
            else:
                out[i] = young[keys[i]] = found
        if missing:
            for i, made in zip(missing, make([keys[i] for i in missing])):
                out[i] = young[keys[i]] = made
        if len(young) > self.entries:
            self.old, self.young = young, {}
        return out


class Encoder:
    """A tokenizer file of the tokenizers library; ids of whole texts, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        special = [t for t in made["added_tokens"] if t["special"]]
        # A special token between chunks keeps them apart and marks where each one ends.
        self.mark, self.mark_id = special[0]["content"], special[0]["id"]
        self.specials = [t["content"].encode() for t in special]
        self.narrow = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.memory = Memory(CHUNKS)
        # The memory of chunks does what the model's own cache of words would do.
        self.tokenizer.model._resize_cache(0)
        # Bytes that each id stands for, if one character of a token is one byte; 0 for added tokens.
        vocabulary, suffix = made["model"]["vocab"], made["model"].get("end_of_word_suffix") or ""
        self.sizes = np.zeros(max([*vocabulary.values(), *[t["id"] for t in made["added_tokens"]]]) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix(suffix))
        self.sizes[[t["id"] for t in made["added_tokens"]]] = 0
        self.keeps_white = self.sizes[self._ids([b"a a"])[0]].sum() == 3
        normalizer = made.get("normalizer")
        steps = normalizer.get("normalizers", [normalizer]) if normalizer else []
        self.normalizer = self.tokenizer.normalizer
        self.lowers = any(s["type"] == "Lowercase" for s in steps)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder per file and worker, as long as the worker serves steps that encode."""
        if path not in KEPT:
            KEPT[path] = cls(path)
        return KEPT[path]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        # The batch form without offsets gives the same ids in less time.
        encode = self.tokenizer.encode_batch_fast
        return [np.array(encode([t.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32) for t in texts]

    def _marked(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks; a special token stands between them."""
        mark, out = self.mark.encode(), []
        for at in range(0, len(chunks), _JOINED):
            group = chunks[at : at + _JOINED]
            # Between chunks there is no special token unless one of them, or two together, hold it.
            alone = any(s in b"".join(group) for s in self.specials)
            ids = np.zeros(0, np.uint32) if alone else self._ids([mark.join(group)])[0]
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(group) - 1:
                out += [i.tobytes() for i in self._ids(group)]
                continue
            raw, bounds = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            out += [raw[4 * a + 4 : 4 * b] for a, b in zip(bounds[:-1], bounds[1:])]
        return out

    def _measured(self, chunks: list[bytes], sizes: np.ndarray) -> list[bytes]:
        """Ids of chunks that follow each other as in a text; ``sizes`` says how many bytes the ids of each stand for."""
        out, step = [], _JOINED * _TEXTS
        for first in range(0, len(chunks), step):
            group = chunks[first : first + step]
            ids = np.concatenate(self._ids([b"".join(group[at : at + _JOINED]) for at in range(0, len(group), _JOINED)]))
            own, ends = self.sizes[ids], np.cumsum(sizes[first : first + step])
            reached = np.cumsum(own)
            at = np.searchsorted(reached, ends)
            if not own.all() or not len(own) or reached[-1] != ends[-1] or (reached[at] != ends).any():
                out += self._marked(group)
                continue
            raw, bounds = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
            out += [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        return out

    def _normal_sizes(self, chunks: list[bytes]) -> list[int] | None:
        """Bytes of each chunk's visible characters once they are normalized, if each has one white gap, at its start."""
        text = self.normalizer.normalize_str(b"".join(chunks).decode("utf-8", "replace"))
        parts = [len(p) for p in text.encode().split(b" ")]
        return parts[1:] if parts[0] == 0 and len(parts) == len(chunks) + 1 else None

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lengths)
        raw = b"".join(chunks)
        if not raw or any(s in raw for s in self.specials):
            return self._marked(chunks)
        data, starts = np.frombuffer(raw, np.uint8), ends - lengths
        # A chunk that starts with white space may follow any that ends with a visible character.
        plain = (lengths > 1) & WHITE[data[np.minimum(starts, len(data) - 1)]] & _visible_before(data, ends)
        sizes = lengths
        if not self.keeps_white:
            white = np.concatenate(([0], np.cumsum(WHITE[data])))
            sizes = lengths - (white[ends] - white[starts])
        if self.normalizer is not None:
            # ASCII characters keep their sizes.
            high = np.concatenate(([0], np.cumsum(data >= 0x80)))
            other = np.flatnonzero(plain & (high[ends] > high[starts]))
            for at in range(0, len(other), _TEXTS):
                some = other[at : at + _TEXTS]
                made = None if self.keeps_white else self._normal_sizes([chunks[i] for i in some.tolist()])
                plain[some] = made is not None
                if made is not None:
                    sizes[some] = made
        out: list[bytes] = [b""] * len(chunks)
        for some, make in ((plain, lambda part: self._measured(part, sizes[plain])), (~plain, self._marked)):
            places = np.flatnonzero(some).tolist()
            for i, made in zip(places, make([chunks[i] for i in places])):
                out[i] = made
        return out

    def _lowered(self, data: np.ndarray) -> np.ndarray:
        """Letters as the tokenizer lowers them; one before a multi-byte character, which may join it, stays."""
        alone = np.ones(len(data), bool)
        alone[:-1] = data[1:] < 0x80
        return np.where(alone, LOWER[data], data)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the bounds of each row; null rows are empty."""
        data, offsets = flat(column)
        lowered = self._lowered(data) if self.lowers else data
        raw = [x.tobytes() for x in ([data, lowered] if self.lowers else [data])]
        # Special tokens in texts are found by the library: nothing is lowered or cut inside them.
        whole = any(s in x for s in self.specials for x in raw)
        del raw
        data = data if whole else lowered
        cuts = chunk_offsets(data, offsets, finer=not whole)
        codes, chunks = encoded(data, cuts)
        made = self.memory.looked_up(chunks, self._encode)
        ends = np.concatenate(([0], np.cumsum([len(m) // 4 for m in made]))).astype(np.int64)
        values, bounds = gathered(np.frombuffer(b"".join(made), np.uint32), ends, codes)
        return values, bounds[np.searchsorted(cuts, offsets)]
