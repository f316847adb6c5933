"""Canonical length-limited Huffman coding of token ids, and the block format.

A block, all numbers little-endian:

    magic   4 bytes  b"GLH1"
    u32     documents D        u32  tokens N       u32  checkpoint spacing C
    u64     tokens of the file before this block   u64  bits of the payload
    i64[D]  document ids       u8[D] 1 where the id is null
    u32[D]  tokens of each document
    u32[ceil(N / C)]  bit offset of every C-th token
    payload: code words, most significant bit first, padded to 4 bytes

Blocks hold whole documents and decode on their own, given the table of code
lengths; checkpoints let all spans of C tokens of a block decode side by side.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"GLH1"
HEAD = struct.Struct("<4sIIIQQ")
SPACING = 256


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths (uint8, 0 where the count is 0) of at most ``limit`` bits, by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaf_of_level, level = [], weight
    leaves = np.ones(len(weight), bool)
    for _ in range(limit):
        leaf_of_level.append(leaves)
        pairs = level[0 : len(level) // 2 * 2 : 2] + level[1 : len(level) // 2 * 2 : 2]
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        level, leaves = both[by], by < len(weight)
    take, depth = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for leaves in reversed(leaf_of_level):
        n = int(leaves[:take].sum())
        depth[:n] += 1
        take = 2 * (min(take, len(leaves)) - n)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words (uint32): by length, then by id."""
    codes, code = np.zeros(len(lengths), np.uint32), 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= 1
        codes[own] = code + np.arange(len(own))
        code += len(own)
    return codes


class Coder:
    """Encodes and decodes blocks under one table of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(lengths).astype(np.int64)
        self.bits = max(1, int(lengths.max(initial=0)))
        self._table = None

    def encode(self, ids: np.ndarray, counts: np.ndarray, doc_ids: list, before: int) -> bytes:
        """One block: ``ids`` of documents of ``counts`` tokens each, after ``before`` tokens of the file."""
        size = self.lengths[ids]
        if len(size) and size.min() == 0:
            raise ValueError("an id without a code word")
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        begin = end - size
        span = (7 + self.bits + 7) // 8
        word = self.codes[ids] << (8 * span - (begin & 7) - size)
        out = np.zeros(((total + 31) // 32 + 2) * 4 + span, np.uint8)
        at = begin >> 3
        for k in range(span):
            part = (word >> (8 * (span - 1 - k))) & 255
            summed = np.bincount(at + k, weights=part, minlength=len(out)) if len(at) else np.zeros(len(out))
            out += summed.astype(np.uint8)
        null = np.array([d is None for d in doc_ids], np.uint8)
        names = np.array([0 if d is None else d for d in doc_ids], np.int64)
        head = HEAD.pack(MAGIC, len(counts), len(ids), SPACING, before, total)
        return b"".join([head, names.tobytes(), null.tobytes(), counts.astype(np.uint32).tobytes(), begin[::SPACING].astype(np.uint32).tobytes(), out.tobytes()])

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of the next ``bits`` bits: the id, and the length of its code word."""
        if self._table is None:
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            room = 1 << (self.bits - self.lengths[order])
            ids, sizes = np.repeat(order, room), np.repeat(self.lengths[order], room)
            gap = (1 << self.bits) - len(ids)  # the code of a single id leaves one
            self._table = np.concatenate([ids, np.zeros(gap, np.int64)]).astype(np.uint32), np.concatenate([sizes, np.ones(gap, np.int64)])
        return self._table

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray, list, int]:
        """What ``encode`` was given."""
        magic, docs, n, spacing, before, _ = HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size
        names = np.frombuffer(block, np.int64, docs, at)
        null = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs)
        counts = np.frombuffer(block, np.uint32, docs, at := at + docs).astype(np.int64)
        lanes = -(-n // spacing)
        position = np.frombuffer(block, np.uint32, lanes, at := at + 4 * docs).astype(np.int64)
        raw = np.frombuffer(block, np.uint8, -1, at + 4 * lanes).astype(np.int64)
        span = (7 + self.bits + 7) // 8
        window = np.zeros(len(raw) - span + 1, np.int64)
        for k in range(span):
            window = (window << 8) | raw[k : len(raw) - span + 1 + k]
        ids, sizes = self.table()
        out = np.zeros((spacing, lanes), np.uint32)
        mask, last = (1 << self.bits) - 1, len(window) - 1
        for step in range(min(spacing, n)):
            value = (window[np.minimum(position >> 3, last)] >> (8 * span - self.bits - (position & 7))) & mask
            out[step] = ids[value]
            position += sizes[value]
        return out.T.reshape(-1)[:n], counts, [None if z else d for d, z in zip(names.tolist(), null.tolist())], before
