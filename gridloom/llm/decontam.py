"""Benchmark decontamination by winnowed fingerprints and exact extension."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.words import buffers, gram_hashes, slices, spans, word_hashes

#: Words of a shared span, of a hashed gram, and grams of a window: GRAM + GRAMS - 1 = SPAN, so every shared span has a common minimum.
SPAN, GRAM, GRAMS = 13, 7, 7
#: Words of benchmark items that one pass over the documents carries along: the bound of its broadcast.
BLOCK_WORDS = 4_000_000

#: Word bytes: digits, lower-case letters, all bytes of non-ASCII characters. A-Z are lower-cased before.
MEMBER = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Which grams are the least of some window of consecutive ones (all of them, if they are fewer)."""
    n = len(grams)
    if n <= window:
        return grams == grams.min(initial=_NEVER)
    least = grams[: n - window + 1].copy()
    for s in range(1, window):
        np.minimum(least, grams[s : n - window + 1 + s], out=least)
    chosen = np.zeros(n, bool)
    for s in range(window):
        chosen[s : s + len(least)] |= grams[s : s + len(least)] == least
    return chosen


class Words:
    """The words of a batch of texts: hashes in order, and the rows they belong to."""

    def __init__(self, column: pa.Array):
        flat, offsets = buffers(column)
        flat = LOWER[flat]
        starts, ends = spans(flat, offsets, MEMBER)
        self.hashes = word_hashes(flat, starts, ends)
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.first = np.searchsorted(starts, offsets)  # of each row, and the end of all
        self.counts = np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """Gram hashes by start; those across rows are the largest value, which is never looked up."""
        out = gram_hashes(self.hashes, k)
        out[out == _NEVER] = np.uint64(1)
        out[self.row[: len(out)] != self.row[k - 1 :]] = _NEVER
        return out


class Items:
    """A block of benchmark items, ready to be sent to the tasks."""

    def __init__(self, names: list[str], texts: list[str]):
        words = Words(pa.array(texts, pa.large_string()))
        self.names, self.hashes, self.first, self.counts = names, words.hashes, words.first, words.counts
        prints, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        shorts: dict[int, list[int]] = {}
        for item, (at, n) in enumerate(zip(self.first.tolist(), self.counts.tolist())):
            if n >= SPAN:
                grams = gram_hashes(self.hashes[at : at + n], GRAM)
                grams[grams == _NEVER] = np.uint64(1)
                chosen = np.flatnonzero(winnow(grams, GRAMS))
                prints.append(grams[chosen])
                places.append(chosen + at)
            elif n:
                shorts.setdefault(int(self.hashes[at]), []).append(item)
        prints, places = np.concatenate(prints), np.concatenate(places)
        order = np.argsort(prints, kind="stable")
        self.prints, self.places = prints[order], places[order]
        self.item_of = np.searchsorted(self.first, self.places, side="right") - 1
        self.shorts = shorts
        self.short_heads = np.array(sorted(shorts), np.uint64)

    def match(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Marks every document word in an occurrence of a window; the items that occur, by row."""
        hit, found = np.zeros(len(words.hashes), bool), {}
        if len(self.prints) and len(words.hashes) >= SPAN:
            grams = words.grams(GRAM)
            at = np.flatnonzero(winnow(grams, GRAMS) & (grams != _NEVER))
            low = np.searchsorted(self.prints, grams[at], side="left")
            known = low < len(self.prints)
            known[known] = self.prints[low[known]] == grams[at][known]
            at, low = at[known], low[known]
            high = np.searchsorted(self.prints, grams[at], side="right")
            # a document and an item are compared once for each way they are laid side by side
            owner = np.repeat(np.arange(len(at)), high - low)
            posting = np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            laid = np.stack([words.row[at[owner]], self.item_of[posting], at[owner] - self.places[posting]], 1) if len(owner) else np.empty((0, 3), np.int64)
            for row, item, shift in np.unique(laid, axis=0).tolist():
                self._extend(words, row, item, shift, hit, found)
        if len(self.short_heads) and len(words.hashes):
            place = np.minimum(np.searchsorted(self.short_heads, words.hashes), len(self.short_heads) - 1)
            for at in np.flatnonzero(self.short_heads[place] == words.hashes).tolist():
                row = int(words.row[at])
                for item in self.shorts[int(words.hashes[at])]:
                    n, own = int(self.counts[item]), int(self.first[item])
                    if at + n <= words.first[row + 1] and (words.hashes[at : at + n] == self.hashes[own : own + n]).all():
                        hit[at : at + n] = True
                        found.setdefault(row, set()).add(self.names[item])
        return hit, found

    def _extend(self, words: Words, row: int, item: int, shift: int, hit: np.ndarray, found: dict) -> None:
        low = max(int(words.first[row]), int(self.first[item]) + shift)
        high = min(int(words.first[row + 1]), int(self.first[item + 1]) + shift)
        same = np.zeros(high - low + 2, np.int8)
        same[1:-1] = words.hashes[low:high] == self.hashes[low - shift : high - shift]
        turn = np.diff(same)
        for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            if b - a >= SPAN:
                hit[low + a : low + b] = True
                found.setdefault(row, set()).add(self.names[item])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    names, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        names.append("" if row.name is None else row.name)
        texts.append(row.text)
        size += 1 + len(row.text) // 2  # no text has more words
        if size >= BLOCK_WORDS:
            yield Items(names, texts)
            names, texts, size = [], [], 0
    yield Items(names, texts)


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, finish: Callable, schema: T.StructType) -> DataFrame:
    """Sends the benchmark, block by block, past all rows; ``finish`` makes the last pass's batches.

    Between passes a row carries the word spans (``_hit``) and items (``_in``)
    found so far, so no pass shuffles and each broadcast holds one block.
    """
    sc, now = docs.sparkSession.sparkContext, docs
    carried = T.StructType([*docs.schema.fields, T.StructField("_hit", T.ArrayType(T.IntegerType())), T.StructField("_in", T.ArrayType(T.StringType()))])
    at, names = docs.columns.index(text_col), carried.names
    blocks = _blocks(benchmark, item_col, item_text_col)
    block, k = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        sent = sc.broadcast(block)

        def run(batches, sent=sent, k=k, last=after is None):
            for batch in (part for whole in batches for part in slices(whole, at)):
                words = Words(batch.column(at))
                hit, found = sent.value.match(words)
                if k:
                    for row, (pairs, items) in enumerate(zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())):
                        for a, b in zip(pairs[::2], pairs[1::2]):
                            hit[words.first[row] + a : words.first[row] + b] = True
                        if items:
                            found.setdefault(row, set()).update(items)
                if last:
                    yield finish(batch, words, hit, found)
                    continue
                pairs = []
                for a, b in zip(words.first[:-1], words.first[1:]):
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                    pairs.append(turn.tolist())
                columns = [batch.column(c) for c in range(len(names) - 2)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(pairs, pa.list_(pa.int32())), pa.array([sorted(found.get(r, ())) for r in range(batch.num_rows)], pa.list_(pa.string()))], names=names
                )

        now = now.mapInArrow(run, schema if after is None else carried)
        block, k = after, k + 1
    return now


def _tally(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    return n_hit, (n_hit > 0) & (20 * n_hit >= words.counts)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    A window is 13 consecutive words of an item, or the whole of a shorter item;
    ``n_hit`` counts the document's words inside occurrences of windows, ``items``
    names the items they come from, sorted as strings. A document is contaminated
    if at least a twentieth of its words, and one at least, are hit. Null and
    empty texts have no words; items without words never occur; repeated items
    count once by id, an item without an id goes by the empty name; repeated
    documents are judged one by one; an empty benchmark leaves all clean. Columns
    of the same names in ``docs`` are ignored.

    Both sides keep the least hash of every 7 consecutive 7-grams, so each shared
    13 words have a kept hash in common. Hits are looked up in the benchmark's
    table and extended by comparing all words where document and item overlap.
    """

    def finish(batch, words, hit, found):
        n_hit, bad = _tally(words, hit)
        items = [sorted(found.get(r, ())) for r in range(batch.num_rows)]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = [
            batch.column(0),
            pa.array(words.counts, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(list(map(len, items)), pa.int64()),
            pa.array(items, pa.list_(pa.string())),
            pa.array(digests, pa.string()),
            pa.array(bad),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    schema = T.StructType(
        [
            own.schema["doc_id"],
            *[T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")],
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
        ]
    )
    names = schema.names
    return _passes(own, benchmark, "_text", item_col, item_text_col, finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""

    names = docs.columns

    def finish(batch, words, hit, found):
        columns = [batch.column(c) for c in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~_tally(words, hit)[1]))

    return _passes(docs, benchmark, text_col, item_col, item_text_col, finish, docs.schema)
