import math
import random

from pyspark.sql import functions as F

from gridloom.llm import topk
from gridloom.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, id long, score string"


def brute(rows, k=10, step=100):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, set()).add(tuple(math.floor(1024 * x) for x in v))
    out = []
    for q in good:
        if q % step:
            continue
        own = min(good[q])
        scores = sorted((-max(sum(a * b for a, b in zip(own, v)) for v in vs), i) for i, vs in ((i, [v for v in g if len(v) == len(own)]) for i, g in good.items()) if i != q and vs)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **more):
    got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, **more)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    as_float = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [as_float(rng.gauss(0, 1) * (1 + i % 5)) for _ in range(16)], 1, "s") for i in range(901)]
    rows += [(1000 + i, rows[7][1], 1, "tie") for i in range(15)]  # ties
    rows += [(7, rows[7][1], 1, "again"), (300, rows[300][1], 1, "again")]  # repeated rows
    rows += [(2000, None, 1, ""), (2100, [1.0] * 15 + [float("nan")], 1, ""), (2200, [float("inf")] * 16, 1, ""), (2300, [], 1, ""), (2400, [None] * 16, 1, ""), (None, rows[3][1], 1, "")]
    rows += [(2500, [1.0, 2.0], 1, ""), (2501, [3.0, 2.0], 1, "")]  # another dimension
    rows += [(2600, [0.0] * 16, 1, "")]
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SEEDS", 2)
    assert run(spark, rows) == want


def test_large_components_are_exact(spark):
    big = float(2**18)
    rows = [(i, [big * (1 + (i * j) % 7), big - i, 1.0 + i], 1, "") for i, j in zip(range(0, 60, 5), range(3, 99))]
    assert run(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0], 1, ""), (1, [2.0], 1, "")]) == [(0, 1, 1, 1024 * 2048)]
    assert run(spark, [(0, [1.0], 1, "")]) == []
    assert run(spark, []) == []
