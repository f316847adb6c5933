import hashlib
import random
import re

import pytest

from gridloom.llm import decontam
from gridloom.llm.decontam import contamination, decontaminate

DOCS = "doc_id long, text string, n_words string, items long"
ITEMS = "item_id long, text string, doc_id long"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for d, text, *_ in docs:
        w = words(text)
        hit, found = set(), set()
        for name, item, *_ in items:
            v = words(item)
            n = min(13, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add("" if name is None else str(name))
        named = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(named.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture
def case():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "x9"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(n)), 1) for i, n in enumerate([40, 13, 14, 25, 12, 5, 1, 0, 30, 30])]
    items[6] = (6, "unique", 1)
    items += [(0, items[0][1], 2), (11, None, 3), (None, " ".join(make(20)), 4), (10, "same " * 30, 5), (12, "!!", 5)]
    docs = []
    for d in range(60):
        parts = make(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            v = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(v) - 1))
            at = rng.randint(0, len(parts))
            parts[at:at] = v[a : a + rng.randint(1, 40)]
        docs.append((d, ", ".join(parts).upper() if d % 2 else "\n".join(parts), "x", 1))
    docs += [(100, None, "x", 1), (101, "", "x", 1), (102, "same " * 500, "x", 1), (102, "same " * 500, "x", 1), (None, items[0][1], "x", 1), (103, "unique", "x", 1), (104, "y" * 5000, "x", 1)]
    return docs, items


@pytest.mark.parametrize("block", [10**6, 40])
def test_against_brute_force(spark, case, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    docs, items = case
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = decontaminate(d, b)
    assert kept.schema == d.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r, w in zip(d.collect(), [brute([x], items)[0] for x in docs]) if not w[5])


def test_empty(spark):
    d, b = spark.createDataFrame([(1, "a b c", "", 1)], DOCS), spark.createDataFrame([], ITEMS)
    assert [r.n_hit for r in contamination(d, b).collect()] == [0]
    assert contamination(d.where("false"), b).collect() == [] and decontaminate(d.where("false"), b).collect() == []
