"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams of a profile, and the longest n-gram.
PROFILE, LONGEST = 300, 3
#: Documents of each language that a profile is made of, about: they are picked by a hash of their id.
SAMPLE = 4_000
#: Words whose n-grams a worker remembers, and the longest of them.
MEMO_WORDS, MEMO_LETTERS = 200_000, 40
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def grams_of(word: str) -> list[str]:
    """The n-grams of up to LONGEST letters of a word, which is marked by a space at both ends."""
    letters = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    if not letters:
        return []
    marked = f" {letters} "
    out = list(letters)
    for n in range(2, LONGEST + 1):
        out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return out


class GramCounter:
    """Counts n-grams of whole texts; n-grams have numbers, given in the order of their first use."""

    def __init__(self, known: tuple[str, ...] = ()):
        self.known = known
        self._forget()

    def _forget(self) -> None:
        self.number = {g: i for i, g in enumerate(self.known)}
        self.grams = list(self.known)
        self.memo: dict[str, np.ndarray] = {}

    def _ids(self, word: str) -> np.ndarray:
        number, out = self.number, []
        for g in grams_of(word):
            i = number.get(g)
            if i is None:
                i = number[g] = len(self.grams)
                self.grams.append(g)
            out.append(i)
        ids = np.array(out, np.int32)
        if len(word) <= MEMO_LETTERS:
            self.memo[word] = ids
        return ids

    def count(self, text: str | None) -> np.ndarray:
        """Counts by n-gram number."""
        words = Counter(_WORD.findall(text.lower())) if text else {}
        if not words:
            return np.zeros(0, np.int64)
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        memo = self.memo
        parts = [memo[w] if w in memo else self._ids(w) for w in words]
        times = np.repeat(np.fromiter(words.values(), np.float64, len(words)), list(map(len, parts)))
        return np.bincount(np.concatenate(parts), weights=times).astype(np.int64)

    def ranked(self, text: str | None, size: int = PROFILE) -> np.ndarray:
        """Numbers of the most frequent n-grams, in order; ties go by the n-gram."""
        counts = self.count(text)
        used = np.flatnonzero(counts)
        if len(used) > size:
            used = used[counts[used] >= np.partition(counts[used], len(used) - size)[len(used) - size]]
        grams = self.grams
        return np.array(sorted(used.tolist(), key=lambda i: (-counts[i], grams[i]))[:size], np.int64)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[str]]:
    """The most frequent n-grams of each language, in order.

    Counts whole texts of some ``sample`` documents of each language, or of all
    if it has fewer; ties go by the n-gram.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    share = {lang: min(parts, -(-parts * sample // n)) for lang, n in sizes.items()}
    if any(s < parts for s in share.values()):
        table = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(parts)) < table[F.col("lang")])

    def run(batches):
        counter, total = GramCounter(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = counter.count(text)
                own = total.setdefault(lang, Counter())
                for i in np.flatnonzero(counts).tolist():
                    own[counter.grams[i]] += int(counts[i])
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    profiles: dict[str, list[str]] = {lang: [] for lang in sorted(sizes)}
    for r in best:
        profiles[r.lang].append(r.gram)
    return {lang: grams for lang, grams in profiles.items() if grams}


class Classifier:
    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE):
        self.langs = sorted(profiles)
        self.size = size
        known = tuple(dict.fromkeys(g for lang in self.langs for g in profiles[lang]))
        place = {g: i for i, g in enumerate(known)}
        self.rank = np.full((len(self.langs), len(known) + 1), -1, np.int64)  # the last: n-grams of no profile
        for row, lang in enumerate(self.langs):
            for rank, g in enumerate(profiles[lang]):
                self.rank[row, place[g]] = rank
        self.counter = GramCounter(known)
        self.known = len(known)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the least out-of-place distance (ties: the first by name), and one less its share of the largest."""
        own = self.counter.ranked(text, self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        place = self.rank[:, np.minimum(own, self.known)]
        away = np.where(place < 0, self.size, np.abs(place - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document row: ``doc_id, lang_pred, score`` (0 to 1).

    Profiles are learned from the rows that ``learn_from`` admits and that have a
    language; a prediction sees the text alone. Texts that are null or have no
    letter are ``und`` with score 0, and so is every text if no row can be
    learned from. Whole texts are counted; long ones and repeated rows need no
    care, an empty table gives no rows, other columns are ignored.
    """
    profiles = learn_profiles(docs.where(learn_from), text_col, lang_col, id_col, sample)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE n-grams a language

    def run(batches):
        classifier = Classifier(sent.value)
        for batch in batches:
            found = [classifier.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
