"""Token ids of whole texts with the ``tokenizers`` library.

A byte-level BPE never joins text across a single space that stands between two
non-blank characters: that space opens the next pre-token. Texts are therefore
cut there, every distinct chunk is encoded once per worker, and the ids of a
text are the ids of its chunks in order. ``tests/llm/test_tokens.py`` holds this
against plain encoding on arbitrary texts.
"""

from __future__ import annotations

import itertools
import os

import numpy as np

#: Distinct chunks a worker remembers (some 200 bytes each); at the bound it forgets the rarer ones, half of all at least.
MEMO_CHUNKS = 900_000

_loaded: dict[str, "ChunkTokenizer"] = {}


#: Marks that end a pre-token when they follow a letter or digit (an apostrophe may not: it opens some word endings).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Memo(dict):
    """key -> number of the chunk ``lead + key``; unseen chunks wait in ``new`` for their ids.

    A chunk that ends in marks after a letter or digit waits in ``joined``
    instead: its ids are those of what is before the marks and of the marks.
    """

    def __init__(self, lead: str, owner: "ChunkTokenizer"):
        super().__init__()
        self.lead, self.owner = lead, owner

    def __missing__(self, key: str) -> int:
        stem = key.rstrip(_MARKS)
        if len(stem) != len(key) and stem and stem[-1].isalnum() and "<|" not in key:
            parts = self[stem], self.owner.raw[key[len(stem) :]]
            number = self[key] = next(self.owner.numbers)
            self.owner.joined.append((number, *parts))
        else:
            number = self[key] = next(self.owner.numbers)
            self.owner.new.append((number, self.lead + key))
        return number


def chunks_of(text: str) -> list[str]:
    """Cuts at each space that has a non-blank character on both sides; joined, the chunks are the text."""
    pieces = text.split(" ")
    out = [pieces[0]]
    for piece in pieces[1:]:
        last = out[-1]
        if piece and last and not piece[0].isspace() and not last[-1].isspace():
            out.append(" " + piece)
        else:
            out[-1] = f"{last} {piece}"
    return out


def single_spaced(text: str) -> bool:
    """Whether every space can be cut at; some such texts with rare blanks are not recognised."""
    return text.replace("\n", "").isprintable() and not (text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text)


class ChunkTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new: list[tuple[int, str]] = []
        self.joined: list[tuple[int, int, int]] = []
        self.numbers = itertools.count()
        self.raw = _Memo("", self)
        self.spaced = _Memo(" ", self)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.length, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        most = len(self.raw) + len(self.spaced)
        least = 2
        while (kept := np.flatnonzero(self.seen[:most] >= least)).size > MEMO_CHUNKS // 2:
            least *= 2
        number = np.full(most, -1)
        number[kept] = np.arange(len(kept))
        for memo in (self.raw, self.spaced):
            left = [(k, int(n)) for k, n in zip(memo, number[np.fromiter(memo.values(), np.int64, len(memo))]) if n >= 0]
            memo.clear()
            memo.update(left)
        self.numbers = itertools.count(len(kept))
        begin, length = self.begin[kept], self.length[kept]
        ends = np.cumsum(length)
        self.ids = self.ids[np.arange(int(length.sum())) + np.repeat(begin - (ends - length), length)]
        self.used = len(self.ids)
        room = np.zeros(1 << 14, np.int64)
        self.begin, self.length, self.seen = (np.concatenate([a, room]) for a in (ends - length, length, self.seen[kept] // 2))

    def _store(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        total, most = self.used + len(ids), int(numbers.max()) + 1
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(total, np.uint32)])
        if most > len(self.begin):
            more = np.zeros(most + most // 4 - len(self.begin), np.int64)
            self.begin, self.length, self.seen = (np.concatenate([a, more]) for a in (self.begin, self.length, self.seen))
        self.ids[self.used : total] = ids
        self.begin[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used = total

    def _learn(self) -> None:
        if self.new:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([c for _, c in self.new], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self._store(np.array([n for n, _ in self.new]), np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)
            self.new.clear()
        if self.joined:
            parts = np.array(self.joined, np.int64)
            flat, offsets = self._gather(parts[:, 1:].ravel(), np.full(len(parts), 2), None)
            self._store(parts[:, 0], flat, np.diff(offsets))
            self.joined.clear()

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32) and the offsets of each; null is the empty text."""
        if len(self.spaced) + len(self.raw) > MEMO_CHUNKS:
            self._forget()
        parts, counts = [], np.zeros(len(texts), np.int64)
        spaced, raw = self.spaced.__getitem__, self.raw.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            if single_spaced(text):
                pieces = text.split(" ")
                numbers = np.fromiter(map(spaced, pieces), np.int64, len(pieces))
                numbers[0] = raw(pieces[0])
            else:
                pieces = chunks_of(text)
                numbers = np.fromiter(map(raw, pieces), np.int64, len(pieces))
            parts.append(numbers)
            counts[i] = len(pieces)
        self._learn()
        chunk = np.concatenate(parts) if parts else np.empty(0, np.int64)
        used = np.bincount(chunk)
        self.seen[: len(used)] += used
        return self._gather(chunk, counts, end_id)

    def _gather(self, chunk: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Lays out the ids of chunk numbers; ``counts`` of them make up each text, closed by ``end_id``."""
        length = self.length[chunk]
        ends = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(self.begin[chunk] - ends[:-1], length)
        flat = self.ids[at]
        sizes = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        if end_id is None:
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.empty(len(flat) + len(counts), np.uint32)
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[~keep] = end_id
        out[keep] = flat
        return out, offsets


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer for ``path``, loaded once."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]
