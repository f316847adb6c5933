"""Toxicity: a fuzzy lexicon in context, learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import logistic

#: Labelled documents that are learned from, about: they are picked by a hash of their id.
SAMPLE = 12_000
#: Terms of the learned lexicon, and toxic documents that a term must be in.
TERMS, SUPPORT = 600, 4
#: Letters of a stem, the longest of them, and the log odds a term must have.
STEM, LONG_STEM, ODDS = 4, 6, 2.5
#: Letters from which a term is matched with one and with two errors.
ONE_ERROR, TWO_ERRORS = 5, 9
#: Words to each side of a term that tell a quotation.
WINDOW = 6
MEMO_WORDS = 300_000

# Insults that the lexicon starts from.
SEEDS = ("disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "scumbag", "stupid", "trash", "worthless")
# Words that report what somebody said.
CUES = frozenset("called calling calls definition insult insults meaning means phrase quote quoted quotes quoting reported said saying says slur term word words wrote".split())
QUOTES = frozenset("\"“”„«»‹›‘’`")

_WORD = re.compile(r"[^\W_]+")


class Lexicon:
    """Levenshtein automata of all terms at once: their states run along a trie of the terms.

    States of the product are sets of (trie node, errors so far); they and their
    transitions are made when first needed and then kept, so a word costs one
    table look-up a letter, and one far from every term stops after a few.
    A term that ends in ``*`` is a stem: any ending is admitted, without errors.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.stems: list[int | None] = [None]
        self.errors: list[int] = [0]
        for number, term in enumerate(terms):
            word, stem = term.rstrip("*"), term.endswith("*")
            allowed = 0 if stem else self.allowed(word)
            node = 0
            self.errors[0] = max(self.errors[0], allowed)
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({}), self.ends.append(None), self.stems.append(None), self.errors.append(0)
                node = self.children[node][letter]
                self.errors[node] = max(self.errors[node], allowed)
            (self.stems if stem else self.ends)[node] = number
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state(self._close({(0, 0)}), None)

    @staticmethod
    def allowed(word: str) -> int:
        return 2 if len(word) >= TWO_ERRORS else 1 if len(word) >= ONE_ERROR else 0

    def _close(self, members: set) -> frozenset:
        """Adds what is reached by leaving out letters of a term; keeps the fewest errors at a node."""
        best: dict[int, int] = {}
        todo = list(members)
        while todo:
            node, errors = todo.pop()
            if errors > self.errors[node] or best.get(node, 9) <= errors:
                continue
            best[node] = errors
            todo += [(child, errors + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, members: frozenset, stem: int | None) -> int:
        key = (members, stem)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.next.append({})
            ends = [(errors, self.ends[node]) for node, errors in members if self.ends[node] is not None and errors <= self.allowed(self.terms[self.ends[node]])]
            if stem is not None:
                ends.append((0, stem))
            found = min(ends, default=None)
            self.found.append(None if found is None else (found[1], found[0]))
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        members, stem = self.members[state]
        after = set()
        for node, errors in members:
            if letter in self.children[node]:
                after.add((self.children[node][letter], errors))
            if errors < self.errors[node]:
                after.add((node, errors + 1))
                after |= {(child, errors + 1) for child in self.children[node].values()}
        closed = self._close(after)
        stems = [self.stems[node] for node, errors in closed if errors == 0 and self.stems[node] is not None]
        stem = min([*stems, *([] if stem is None else [stem])], default=None)
        number = self._state(closed, stem) if closed or stem is not None else -1
        self.next[state][letter] = number
        return number

    def match(self, word: str) -> tuple[int, int] | None:
        """The term next to ``word`` and the errors between them; None if every term is too far."""
        state, table = self.start, self.next
        for letter in word:
            after = table[state].get(letter)
            if after is None:
                after = self._step(state, letter)
            if after < 0:
                return None
            state = after
        return self.found[state]


class Scorer:
    """Finds terms in whole texts and sums up what stands around them."""

    #: Log sums of weights (plain; misspelled; quoted), the largest plain weight, hits a hundred words.
    FEATURES = 5

    def __init__(self, weights: dict[str, float], clean: frozenset[str] = frozenset()):
        terms = sorted(weights)
        self.lexicon, self.weight, self.clean = Lexicon(terms), [weights[t] for t in terms], clean
        self.memo: dict[str, tuple[float, int] | None] = {}

    def _look_up(self, word: str) -> tuple[float, int] | None:
        found = self.lexicon.match(word)
        if found is not None:
            term, errors = found
            found = None if errors and word in self.clean else (self.weight[term] / (1 + errors), errors)
        self.memo[word] = found
        return found

    def hits(self, text: str | None) -> tuple[dict[str, tuple[float, int]], list[str]]:
        words = _WORD.findall(text.lower()) if text else []
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo, look_up, found = self.memo, self._look_up, {}
        for w in set(words):
            hit = memo[w] if w in memo else look_up(w)
            if hit is not None:
                found[w] = hit
        return found, words

    def features(self, text: str | None) -> list[float]:
        found, words = self.hits(text)
        if not found:
            return [0.0] * self.FEATURES
        plain = wrong = quoted = most = hits = 0.0
        low = text.lower()
        spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        for i, w in enumerate(words):
            if w not in found:
                continue
            weight, errors = found[w]
            hits += 1
            left, right = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            before, after = low[spans[left][0] : spans[i][0]], low[spans[i][1] : spans[right][1]]
            in_quotes = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
            if in_quotes or not CUES.isdisjoint(words[left:i]):
                quoted += weight
            elif errors:
                wrong += weight
            else:
                plain += weight
                most = max(most, weight)
        return [math.log1p(plain), math.log1p(wrong), math.log1p(quoted), most, min(100.0, 100 * hits / len(words))]


def _labelled(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """``(text, y)`` of the sampled labelled rows: a broadcast of some ``sample`` ids. A document labelled twice takes the larger label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn_from)
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    total = known.count()
    parts = 1 << 20
    if total > sample:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(parts)) < parts * sample // total)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(known), "_id").select("text", F.col("_y").alias("y"))


def _terms(text: str | None) -> set[str]:
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:k] + "*" for w in words for k in range(STEM, LONG_STEM + 1) if len(w) > k}


def learn_weights(rows: DataFrame) -> dict[str, float]:
    """Terms and stems with their log odds: those that mark toxic documents, the most telling first."""

    def toxic(batches):
        total = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(_terms(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    often = rows.where("y = 1").select("text").mapInArrow(toxic, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    first = {r.term: r.n for r in often.orderBy(F.col("n").desc(), "term").limit(50 * TERMS).collect()}
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(first))

    def clean(batches):
        total, wanted = Counter(), sent.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(_terms(text) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    other = {r.term: r.n for r in rows.where("y <> 1").select("text").mapInArrow(clean, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} if first else {}
    odds = {t: math.log((c + 0.5) / (n1 + 1)) - math.log((other.get(t, 0) + 0.5) / (n0 + 1)) for t, c in first.items()}
    # few words stand for many: a term's worth is what it says times how often it says it
    best = sorted((t for t in odds if odds[t] >= ODDS), key=lambda t: (-odds[t] * math.sqrt(first[t]), len(t), t))[:TERMS]
    weights = {t: odds[t] for t in best}
    for t in SEEDS:
        if t not in odds or odds[t] >= ODDS:
            weights.setdefault(t, ODDS)
    return weights


class Model:
    def __init__(self, weights: dict[str, float], clean: frozenset[str], beta: np.ndarray):
        self.weights, self.clean, self.beta = weights, clean, beta

    def scorer(self) -> Scorer:
        return Scorer(self.weights, self.clean)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = _labelled(docs, labels, learn_from, id_col, text_col, label_col, sample)
    weights = learn_weights(rows)
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((weights, frozenset()))

    def near(batches):  # words that look like a term and yet stand in clean documents
        scorer, total = Scorer(*sent.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(w for w, (_, errors) in scorer.hits(text)[0].items() if errors)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    seen = rows.where("y <> 1").select("text").mapInArrow(near, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    clean = frozenset(r.word for r in seen.orderBy(F.col("n").desc(), "word").limit(20 * TERMS).collect())
    told = sc.broadcast((weights, clean))

    def features(batches):
        scorer = Scorer(*told.value)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    found = rows.select("text", "y").mapInArrow(features, "x array<double>, y int").collect()
    x = np.array([r.x for r in found]).reshape(len(found), Scorer.FEATURES)
    y = np.array([r.y == 1 for r in found], float)
    if not y.any():  # nothing to fit: a plain or misspelled insult tells, a quoted one does not
        return Model(weights, clean, np.array([3.0, 1.5, 0.0, 0.5, 0.1, -3.0]))
    return Model(weights, clean, logistic.fit(x, y, ridge=0.1))


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document row: ``doc_id, score`` (0 to 1, higher: toxic likelier).

    Learns a lexicon of words and stems, the look-alikes that are harmless and a
    logistic weighting of the hits from some ``sample`` of the label rows that
    ``learn_from`` admits; scores see whole texts and nothing else. Hits inside
    quotation marks or after a word of saying count apart. Null and empty texts,
    and texts without hits, get the score of none; null labels teach nothing,
    and without labels the built-in terms decide. Repeated rows are scored each
    for themselves, an empty table gives no rows, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn_from, id_col, text_col, label_col, sample))

    def run(batches):
        model = sent.value
        scorer = model.scorer()
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, Scorer.FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logistic.predict(x, model.beta), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
