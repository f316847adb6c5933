import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm.quality import _CLASS, TEXT_WIDTH, classify, co_train, keep_good, text_features
from gridloom.llm.work import crc32_bucket

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long, score string", "doc_id long, quality int, toxic int, text string"


def test_text_features_of_whole_texts():
    texts = ["Ab c c\nD é!", None, "", "x " * 3_000_000, "A"]
    got = text_features(pa.array(texts))
    assert got.shape == (5, TEXT_WIDTH)
    for row, t in zip(got, texts):
        raw = (t or "").encode()
        want = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=TEXT_WIDTH - 5) / max(1, len(raw))
        assert np.allclose(row[:-5] ** 2, want)
        words = raw.split()
        assert np.isclose(row[-5], sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)))
        assert np.isclose(row[-4], len(set(words)) / max(1, len(words)))
    assert np.allclose(text_features(pa.array(texts)[1:]), got[1:])


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.5).astype(float)
    x, m = (np.where(rng.random((2000, 1)) < 0.95, y[:, None], 1 - y[:, None]) + rng.normal(0, 0.1, (2000, 1)) for _ in range(2))
    few = slice(0, 40)
    model = co_train(x[few], m[few], y[few], x[40:], m[40:])
    assert ((model.score(x, m) >= 0.5) == (y == 1)).mean() > 0.9
    nothing = co_train(x[:0], m[:0], y[:0], x, m)
    assert np.allclose(nothing.score(x, m), nothing.score(x, m)[0])


def test_degenerate_tables(spark):
    rows = [(1, "Good text. Here it is.", "en", "s", 22, ""), (2, "%%% ### $$$", None, None, None, ""), (3, None, "en", "s", 0, ""), (None, "", "", "", -1, ""), (1, "Good text. Here it is.", "en", "s", 22, "")]
    docs = spark.createDataFrame(rows, DOCS)
    for labels in ([], [(1, None, 1, "")], [(1, 1, 0, "")], [(1, 1, 0, ""), (1, 0, 0, ""), (2, 0, None, ""), (None, 1, 1, ""), (3, 1, 0, "")]):
        table = spark.createDataFrame(labels, LABELS)
        got = classify(docs, table).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
        kept = keep_good(docs, table)
        assert kept.schema == docs.schema and kept.count() == sum(r.keep for r in got)
    assert classify(docs.where("false"), table).collect() == []
    assert classify(docs.select("doc_id", "text"), table).count() == 5


@pytest.mark.parametrize("size", ["sf0.1"])
def test_held_out_accuracy(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(crc32_bucket("doc_id", 3) == 1).select("doc_id", "quality")
    rows = classify(docs, labels, crc32_bucket("doc_id", 3) != 1).join(held, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    print("kept of good", np.mean(good), "kept of bad", np.mean(bad), np.mean([r.metadata_score for r in rows]))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
