import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gridloom.llm.packing import best_fit, local_search, pack  # noqa: E402
from gridloom.llm.token_files import crc32  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def items(bins):
    return Counter({n: c for n, c in sum((Counter({n: times * own.count(n) for n in set(own)}) for own, times in bins), Counter()).items() if c})


def squares(bins):
    return sum(sum(own) ** 2 * times for own, times in bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_keeps_pieces_and_fills(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 60))}
    first = best_fit(counts, 100)
    after = local_search(first, 100)
    for bins in (first, after):
        assert items(bins) == Counter(counts) and all(sum(own) <= 100 and own for own, _ in bins)
    assert squares(after) >= squares(first) and sum(t for _, t in after) <= sum(t for _, t in first)


def test_swap_empties_a_bin():
    # best fit needs three bins for these; two do
    bins = local_search([[[5, 3], 1], [[4, 3], 1], [[3, 2], 1]], 10)
    assert sum(t for _, t in bins) == 2 and items(bins) == Counter([5, 3, 4, 3, 3, 2])


def test_pack(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "cat", "é", "x9!"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["long " * 5000, None, "", "hi " * 64, "word " * 31 + "end", "ab " * 127 + "ab"]
    rows = [(i, t, 5, "c") for i, t in enumerate(texts)] + [(0, texts[0], 5, "c"), (None, "lost", 1, "")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, piece long, length string").repartition(4), PATH, capacity=64, bucket_rows=20).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        k = -(-len(ids) // 64)
        cut = [0] + [len(ids) - 64 * (k - 1) + 64 * j for j in range(k)]
        for j, (a, b) in enumerate(zip(cut, cut[1:])):
            want[i, j, a, b - a, crc32(np.array(ids[a:b]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 3


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
