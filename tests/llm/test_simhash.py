import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm.simhash import fingerprint, links, near_duplicates
from gridloom.llm.work import Work

SCHEMA = "doc_id long, text string, bits long, component string"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def plain_components(ids_bits):
    label = list(range(len(ids_bits)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(ids_bits):
        for j, (_, b) in enumerate(ids_bits[:i]):
            if (a ^ b).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(ids_bits):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids_bits))]


def test_fingerprint():
    for text in [None, "", " \t\r\n", "one", "One two", "one two THREE", "É é\x0bÉ\x0c x\xa0y a a a a a", "a b c " * 50, "w" * 100_000, "x " * 70_000]:
        assert fingerprint(text) == plain_fingerprint(text), (text or "")[:20]


def test_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of the town at night".split()
    texts = [None, "", "  ", " ".join(base), " ".join(base).upper()]
    for k in range(40):
        words = base * (1 + k % 7) + [f"w{k % 5}"]
        words[k % len(words)] = f"z{k % 3}"
        texts.append(" ".join(words))
    rows = [(d, t, 7, "x") for d, t in enumerate(texts)] + [(3, texts[3], 1, "y")]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    want = sorted((d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints)))
    assert got == want


@pytest.mark.parametrize("dense", [2, 64])
def test_links_find_all(spark, dense):
    import random

    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(12):
            x = seed
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {0, 1, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "bits long")
    found = links(table, Work(spark, "t"), dense=dense).distinct().collect()
    mask = (1 << 64) - 1
    for r in found:
        assert ((r.a ^ r.b) & mask).bit_count() <= 2
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        label[root(r.a & mask)] = root(r.b & mask)
    want = plain_components([(p, p) for p in prints])
    by = {}
    for p, c in zip(prints, want):
        by.setdefault(root(p), set()).add(c)
    assert all(len(c) == 1 for c in by.values()) and len(by) == len(set(want))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = near_duplicates(spark.createDataFrame([(None, None, 1, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in lone] == [(None, "0" * 16, None)]
    assert near_duplicates(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))).select("component_id").distinct().collect() == [(0,)]
