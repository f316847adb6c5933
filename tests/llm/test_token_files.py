import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gridloom.llm import token_files  # noqa: E402
from gridloom.llm.huffman import Coder, canonical, code_lengths  # noqa: E402
from gridloom.llm.token_files import crc32, round_trip  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_bits(counts):
    import heapq

    heap, total = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 500):
        counts = rng.integers(0, 1000, n)
        counts[:2] = 5
        lengths = code_lengths(counts, 30)
        assert (counts * lengths).sum() == huffman_bits(counts.tolist())
    skewed = np.array([2**k for k in range(40)], np.int64)
    lengths = code_lengths(skewed, 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) == 1.0
    assert code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and code_lengths(np.array([0, 0])).max() == 0


def test_codes_are_prefix_free():
    lengths = code_lengths(np.random.default_rng(2).integers(0, 50, 200), 10)
    words = sorted(format(c, f"0{n}b") for c, n in zip(canonical(lengths).tolist(), lengths.tolist()) if n)
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 999)
    coder = Coder(code_lengths(np.bincount(ids, minlength=1000), 16) if n else np.array([0, 1], np.uint8))
    counts = np.array([n // 2, 0, n - n // 2], np.int64)
    back, sizes, names, before = coder.decode(coder.encode(ids, counts, [5, None, -3], 77))
    assert back.tolist() == ids.tolist() and sizes.tolist() == counts.tolist() and names == [5, None, -3] and before == 77


def test_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 50)
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["the", "cat", "é", "\n", "  ", "x9!"]) for _ in range(rng.randint(0, 60))) for i in range(-3, 80)}
    rows = [(i, t, 5, "c") for i, t in texts.items()] + [(90, None, 1, ""), (91, "", 1, ""), (92, "long " * 5000, 1, ""), (93, "again", 1, ""), (93, "again", 1, "")]
    rng.shuffle(rows)
    got = sorted(map(tuple, round_trip(spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(5), PATH).collect()))
    plain, want, at = Tokenizer.from_file(PATH), [], 0
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), crc32(np.array(ids))))
        at += len(ids)
    assert got == want


def test_null_id_and_empty_table(spark):
    schema = "doc_id long, text string"
    got = [tuple(r) for r in round_trip(spark.createDataFrame([(1, "a"), (None, "b")], schema), PATH).orderBy("start").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [(None, 0, 2), (1, 2, 2)]
    assert round_trip(spark.createDataFrame([], schema), PATH).collect() == []
