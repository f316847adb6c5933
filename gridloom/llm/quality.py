"""Quality scores by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import logistic
from gridloom.llm.words import buffers, slices, spans, word_hashes

#: Labelled and unlabelled documents that are learned from, about; they are picked by a hash of their id.
SAMPLE, POOL = 12_000, 12_000
#: Rounds of exchange, the confidence a pseudo-label needs, and how many a view may give in a round.
ROUNDS, CONFIDENT, GROW = 4, 0.97, 1_000
#: Documents scoring less are rejected.
THRESHOLD = 0.5
#: Slots that the values of a metadata column are hashed to.
SLOTS = 32

# Byte classes: upper, lower, digit, blank, line end, non-ASCII, sentence marks, brackets and quotes, then marks rare in prose, one each.
_RARE = b"|%#$&*!@<>=~^_+/\\"
_CLASSES = 8 + len(_RARE) + 1


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES - 1)
    for numbers, kind in ((range(65, 91), 0), (range(97, 123), 1), (range(48, 58), 2), (b" \t", 3), (b"\n\r", 4), (range(128, 256), 5), (b".,;:?-", 6), (b"()[]{}\"'`", 7)):
        table[list(numbers)] = kind
    for k, b in enumerate(_RARE):
        table[b] = 8 + k
    return table


_CLASS = _class_table()
_WORD = np.array([b > 32 for b in range(256)])
TEXT_WIDTH = _CLASSES + 5


def text_features(column: pa.Array) -> np.ndarray:
    """One row per text, from all of its bytes: shares of byte classes, rates of repeated and capital words, mean word and log length."""
    flat, offsets = buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = np.zeros((n, _CLASSES))
    step = 1 << 22
    row_of = np.repeat(np.arange(n), size)
    for at in range(0, len(flat), step):  # in slices, for memory
        own = row_of[at : at + step]
        if len(own):
            low = own[0]
            found = np.bincount((own - low) * _CLASSES + _CLASS[flat[at : at + step]])
            found = np.pad(found, (0, -len(found) % _CLASSES)).reshape(-1, _CLASSES)
            counts[low : low + len(found)] += found
    starts, ends = spans(flat, offsets, _WORD)
    hashes = word_hashes(flat, starts, ends)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(owner, minlength=n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    twice = np.bincount(owner[same], minlength=n)
    # distinct words of a document, of its words
    by = np.lexsort((hashes, owner))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    distinct = np.bincount(owner[by][new], minlength=n)
    some, letters = np.maximum(words, 1), np.maximum(counts[:, 0] + counts[:, 1], 1)
    share = counts / np.maximum(size, 1)[:, None]
    extra = [twice / some, distinct / some, np.minimum(size / some, 50) / 10, np.log1p(words) / 10, counts[:, 0] / letters]
    return np.hstack([np.sqrt(share), np.stack(extra, 1)])


def metadata_features(columns: list[pa.Array], length: pa.Array | None) -> np.ndarray:
    """One row per document: hashed values of its metadata columns (nulls are a value of their own), and its stated length."""
    n = len(columns[0]) if columns else len(length) if length is not None else 0
    out = np.zeros((n, SLOTS * len(columns) + 2))
    for c, column in enumerate(columns):
        slot = {}
        for i, value in enumerate(column.to_pylist()):
            if value not in slot:
                slot[value] = zlib.crc32(b"" if value is None else b"=" + str(value).encode()) % SLOTS
            out[i, SLOTS * c + slot[value]] = 1
    if length is not None:
        stated = length.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
        out[:, -2], out[:, -1] = np.log1p(np.maximum(stated, 0)) / 10, stated < 0
    return out


@dataclass
class Model:
    text: np.ndarray
    metadata: np.ndarray
    calibrated: tuple[np.ndarray, np.ndarray]
    both: np.ndarray

    def views(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Calibrated log odds of either view."""
        raw = [x @ self.text[:-1] + self.text[-1], m @ self.metadata[:-1] + self.metadata[-1]]
        return np.stack([np.clip(z * c[0] + c[1], -12, 12) for z, c in zip(raw, self.calibrated)], 1)

    def score(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return logistic.predict(self.views(x, m), self.both)


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Each view learns from the labels and from what the other is sure of in the pool.

    A fifth of the labelled rows is kept apart: it calibrates the views each
    round (so a view that knows little is sure of nothing and gives nothing) and
    weighs the two against each other at the end.
    """
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart].tolist())) < 2:
        apart[:] = False
    own, held = ~apart, apart if apart.any() else ~apart
    views, pools = (x, m), (pool_x, pool_m)
    given: list[dict[int, float]] = [{}, {}]  # to either view: pool rows and their pseudo-labels
    for turn in range(rounds + 1):
        betas, scales = [], []
        for v in range(2):
            extra = np.array(sorted(given[v]), int)
            rows = np.vstack([views[v][own], pools[v][extra]])
            told = np.concatenate([y[own], [given[v][i] for i in extra.tolist()]])
            beta = logistic.fit(rows, told, ridge=0.05)
            z = views[v][held] @ beta[:-1] + beta[-1]
            betas.append(beta)
            scales.append(logistic.fit(z[:, None], y[held], ridge=1e-2))
        if turn == rounds or not len(pool_x):
            break
        for v in range(2):
            z = pools[v] @ betas[v][:-1] + betas[v][-1]
            p = logistic.sigmoid(z * scales[v][0] + scales[v][1])
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[: GROW * (turn + 1)]
                for i in best[sure[best] >= CONFIDENT].tolist():
                    given[1 - v].setdefault(i, label)
    model = Model(betas[0], betas[1], (scales[0], scales[1]), np.zeros(3))
    model.both = logistic.fit(model.views(views[0][held], views[1][held]), y[held], ridge=1e-2)
    return model


class _Columns:
    """Which columns a batch brings, in which order."""

    def __init__(self, docs: DataFrame, text_col: str, metadata: tuple[str, ...], length_col: str):
        self.text = F.col(text_col).alias("_text")
        self.kinds = [c for c in metadata if c in docs.columns]
        self.length = length_col if length_col in docs.columns else None
        self.all = [self.text, *(F.col(c).cast("string").alias(f"_m{i}") for i, c in enumerate(self.kinds))]
        if self.length:
            self.all.append(F.col(self.length).cast("double").alias("_length"))

    def reader(self):
        kinds, length = len(self.kinds), bool(self.length)

        def read(batch, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
            columns = [batch.column(at + 1 + i) for i in range(kinds)]
            stated = batch.column(at + 1 + kinds) if length else None
            m = metadata_features(columns, stated) if columns or length else np.zeros((batch.num_rows, 2))
            return text_features(batch.column(at)), m

        return read


def _vectors(rows: DataFrame, columns: _Columns, id_expr: Column, label: Column) -> DataFrame:
    read = columns.reader()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            x, m = read(batch, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(m), pa.list_(pa.float64()))], names=["id", "y", "x", "m"])

    return rows.select(id_expr.alias("id"), label.alias("y"), *columns.all).mapInArrow(run, "id long, y int, x array<double>, m array<double>")


def train(docs: DataFrame, labels: DataFrame, columns: _Columns, id_col: str, label_col: str, learn_from: Column, sample: int, pool: int) -> Model:
    parts = 1 << 20
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn_from)
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_y"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(parts)) < parts * sample // total)
    own = docs.withColumn("_id", F.col(id_col).cast("long"))
    found = _vectors(own.join(F.broadcast(known), "_id"), columns, F.col("_id"), F.col("_y")).collect()
    found.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    x, m = (np.array([r[c] for r in found]) for c in ("x", "m"))
    y = np.array([r.y == 1 for r in found], float)
    count = docs.count()
    # documents at large, the labelled ones among them too: a label given twice does no harm
    share = min(parts, parts * pool // max(1, count))
    some = own.where(F.pmod(F.xxhash64(F.lit("pool"), "_id"), F.lit(parts)) < share)
    spare = _vectors(some, columns, F.col("_id"), F.lit(None).cast("int")).collect()
    spare.sort(key=lambda r: (r.id is None, r.id))
    width = (TEXT_WIDTH, SLOTS * len(columns.kinds) + 2)
    pool_x, pool_m = (np.array([r[c] for r in spare]).reshape(len(spare), w) for c, w in zip(("x", "m"), width))
    return co_train(x.reshape(len(y), width[0]), m.reshape(len(y), width[1]), y, pool_x, pool_m)


METADATA, LENGTH = ("source", "lang"), "n_chars"


def classify(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
    pool: int = POOL,
) -> DataFrame:
    """One row per document row: ``doc_id``, ``text_score`` and ``metadata_score`` (calibrated views), ``score``, ``keep``.

    ``score`` is the probability of label 1 that the views give together, from
    the whole text and the columns ``source``, ``lang`` and ``n_chars`` as far as
    they exist; ``keep`` is 1 from ``threshold`` on. Learns from some ``sample``
    of the label rows that ``learn_from`` admits (all, if not given) and ``pool``
    other documents. A document labelled twice counts by the smaller label, null
    labels teach nothing; without labels, or with one class, every score is the
    smoothed share of label 1. Null texts are empty; empty ones are scored like
    any other, repeated rows each for themselves; an empty table gives no rows.
    """
    columns = _Columns(docs, text_col, METADATA, LENGTH)
    model = train(docs, labels, columns, id_col, label_col, F.lit(True) if learn_from is None else learn_from, sample, pool)
    sent, read = docs.sparkSession.sparkContext.broadcast(model), columns.reader()

    def run(batches):
        model = sent.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            x, m = read(batch, 1)
            views, score = logistic.sigmoid(model.views(x, m)), model.score(x, m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "text_score", "metadata_score", "score", "keep"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns.all).mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double, keep int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, pool: int = POOL) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` at least."""
    columns = _Columns(docs, text_col, METADATA, LENGTH)
    model = train(docs, labels, columns, id_col, label_col, F.lit(True), sample, pool)
    sent, read, width, names = docs.sparkSession.sparkContext.broadcast(model), columns.reader(), len(docs.columns), docs.columns

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, width)):
            keep = sent.value.score(*read(batch, width)) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(width)], names=names).filter(pa.array(keep))

    return docs.select("*", *columns.all).mapInArrow(run, docs.schema)
