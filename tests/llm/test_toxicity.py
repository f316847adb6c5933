import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import logistic
from gridloom.llm.toxicity import Lexicon, Scorer, score
from gridloom.llm.work import crc32_bucket


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_against_brute_force():
    rng = random.Random(1)
    terms = ["idiot", "moron", "scum", "disgusting", "moro", "idi*", "abcab*", "aaaaa", "babab"]
    lexicon = Lexicon(terms)
    words = [rng.choice(["idiot", "moron", "scum", "disgusting", "abcabc", "aaaaa", "moro"]) for _ in range(4000)]
    words = ["".join(c if rng.random() > 0.15 else rng.choice(["", "a", "b", c + c, "x"]) for c in w) for w in words] + ["", "z"]
    for w in words:
        want = [(0, i) for i, t in enumerate(terms) if t.endswith("*") and w.startswith(t[:-1])]
        want += [(d, i) for i, t in enumerate(terms) if not t.endswith("*") and (d := levenshtein(t, w)) <= Lexicon.allowed(t)]
        got = lexicon.match(w)
        assert (got is None) == (not want), w
        if want:
            assert got[1] == min(want)[0] and (got[1], got[0]) in want, w


def test_quotation_is_not_abuse():
    scorer = Scorer({"idiot": 4.0})
    plain, quoted, wrong, none = (scorer.features(t) for t in ("you are an IDIOT, go", 'he wrote "idiot" there', "you idiott", "nothing here"))
    assert plain[0] > 0 and plain[2] == 0 and quoted[2] > 0 and quoted[0] == 0 and wrong[1] > 0 and wrong[0] == 0 and none == [0.0] * 5
    assert scorer.features(None) == scorer.features("") == [0.0] * 5


def test_words_of_any_length():
    scorer = Scorer({"idiot*": 4.0, "moron": 3.0})
    for n in (64, 65, 70, 5000):
        word = "idiot" + "s" * (n - 5)
        assert scorer._look_up(word) == (4.0, 0)
        assert scorer._look_up("moron" * n) is None


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < logistic.sigmoid(x @ [2.0, -1.0] + 0.5)).astype(float)
    assert np.allclose(logistic.fit(x, y, 0.01), [2, -1, 0.5], atol=0.25)
    assert logistic.fit(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]


DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int, text string"


def test_degenerate_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot moron", ""), (2, None, ""), (3, "", ""), (None, "a kind word", ""), (1, "you idiot moron", ""), (4, "x " * 50_000, "")], DOCS)
    for labels in ([], [(1, 1, None, "")], [(2, 1, 0, "")], [(1, None, 1, ""), (1, None, 0, ""), (3, None, 0, ""), (None, 0, 1, "")]):
        got = score(docs, spark.createDataFrame(labels, LABELS), F.lit(True)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.where("false"), spark.createDataFrame([], LABELS), F.lit(True)).collect() == []


@pytest.mark.parametrize("size,least", [("sf0.1", 0.9)])
def test_held_out_accuracy(spark, size, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(crc32_bucket("doc_id", 3) == 1).select("doc_id", "toxic")
    rows = score(docs, labels, crc32_bucket("doc_id", 3) != 1).join(held, "doc_id").collect()
    hit = sum(r.score >= 0.7 and r.toxic == 1 for r in rows)
    said, there = sum(r.score >= 0.7 for r in rows), sum(r.toxic for r in rows)
    print("precision", hit / said, "recall", hit / there)
    assert hit / said >= least and hit / there >= least - 0.15
