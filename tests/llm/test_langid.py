from collections import Counter

from pyspark.sql import functions as F

from gridloom.llm.langid import PROFILE, Classifier, grams_of, identify, learn_profiles
from gridloom.llm.work import crc32_bucket

SCHEMA = "doc_id long, text string, lang string, score string"
EN = "the cat sat on the mat and then it ran over the hill with the other animals that were there"
DE = "der hund und die katze sind nicht im haus sondern auf der straße weil das wetter schön ist"


def rows():
    out = [(i, f"{EN} {i}" if i % 2 else f"{DE}! {i}", "en" if i % 2 else "de", "") for i in range(80)]
    return out + [(100, None, "en", ""), (101, "", "de", ""), (102, "123 !? ² _", "en", ""), (103, EN, None, ""), (104, DE * 500, "de", ""), (103, EN, None, ""), (None, DE, "de", "")]


def brute_profile(texts):
    import re

    counts = Counter(g for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()) for g in grams_of(w))
    return [g for g, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:PROFILE]]


def test_profiles_and_distance(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    profiles = learn_profiles(df)
    for lang in ("en", "de"):
        assert profiles[lang] == brute_profile([t for _, t, l, _ in rows() if l == lang and t])
    c = Classifier(profiles)
    text = "The katze sat"
    own = brute_profile([text])
    away = {lang: sum(abs(r - p.index(g)) if g in p else PROFILE for r, g in enumerate(own)) for lang, p in profiles.items()}
    lang = min(sorted(away), key=away.get)
    assert c.predict(text) == (lang, 1 - away[lang] / (PROFILE * len(own)))


def test_predictions(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = identify(df, crc32_bucket("doc_id", 4) != 2).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)) and by[104].lang_pred == "de" and by[103].lang_pred == "en"
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert {r.lang_pred for r in identify(df, F.lit(False)).collect()} == {"und"}
    assert identify(df.where("false"), F.lit(True)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where(crc32_bucket("doc_id", 4) == 2).select("doc_id", "lang")
    got = identify(docs, crc32_bucket("doc_id", 4) != 2).join(held, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 100
