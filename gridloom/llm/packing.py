"""Packing token sequences: best fit by length, then swaps between underfull bins."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.token_files import END_ID, TEXTS, crc32
from gridloom.llm.tokens import tokenizer
from gridloom.llm.work import Work

CAPACITY = 1024


def best_fit(counts: dict[int, int], capacity: int) -> list[list]:
    """Bins as ``[lengths, times]``: pieces of one length are alike, so equal bins are planned together.

    Takes the longest length left and adds the longest that still fits, again
    and again; that bin is made as often as the counts allow.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    bins = []
    while order:
        room, own, used = capacity, [], {}
        while True:
            at = bisect_right(order, room) - 1
            while at >= 0 and left[order[at]] <= used.get(order[at], 0):
                at -= 1
            if at < 0:
                break
            n = order[at]
            own.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                order.remove(n)
        bins.append([own, times])
    return bins


def _better(full: list[int], other: list[int], capacity: int) -> tuple[list[int], list[int]] | None:
    """The exchange that fills ``full`` best: one moved, one for one, two for one or one for two.

    ``full`` is no emptier than ``other``, so any gain of it raises the sum of
    the squared fills. None where nothing helps.
    """
    room, gain, best = capacity - sum(full), 0, None
    ones = sorted(set(other))
    pairs = sorted({(a + b, a, b) for i, a in enumerate(other) for b in other[i + 1 :]})
    gives = [(0, ())] + [(a, (a,)) for a in set(full)]
    for size, given in gives:
        at = bisect_right(ones, room + size) - 1
        if at >= 0 and ones[at] - size > gain:
            gain, best = ones[at] - size, (given, (ones[at],))
        if given:
            at = bisect_right(pairs, (room + size, capacity, capacity)) - 1
            if at >= 0 and pairs[at][0] - size > gain:
                gain, best = pairs[at][0] - size, (given, pairs[at][1:])
    for i, a in enumerate(full):
        for b in full[i + 1 :]:
            at = bisect_right(ones, room + a + b) - 1
            if at >= 0 and ones[at] - a - b > gain:
                gain, best = ones[at] - a - b, ((a, b), (ones[at],))
    if best is None:
        return None
    out, back = list(full), list(other)
    for n in best[0]:
        out.remove(n)
    for n in best[1]:
        back.remove(n)
    return out + list(best[1]), back + list(best[0])


def local_search(bins: list[list], capacity: int) -> list[list]:
    """Exchanges pieces between underfull bins as long as that raises the squared fill, dropping bins that empty.

    Equal bins take the same exchange at once, as often as both sides allow. The
    search ends when no pair of underfull bins can be bettered, or at the lower
    bound of whole capacities. Every exchange raises the squared fill, and bins
    are counted by their lengths, so its length follows the patterns and not the
    rows.
    """
    table: dict[tuple[int, ...], int] = {}
    for own, times in bins:
        key = tuple(sorted(own, reverse=True))
        table[key] = table.get(key, 0) + times
    total = sum(sum(k) * t for k, t in table.items())
    least, made = -(-total // capacity), sum(table.values())
    done = {k: t for k, t in table.items() if sum(k) == capacity}
    open_ = {k: t for k, t in table.items() if sum(k) < capacity}
    hopeless: set[tuple] = set()
    while made > least:
        order = sorted(open_, key=lambda k: (-sum(k), k))
        found = None
        for j in range(len(order) - 1, -1, -1):  # empty the least filled first
            for i in range(j + 1):
                a, b = order[i], order[j]
                if (a, b) in hopeless or a == b and open_[a] < 2:
                    continue
                if (better := _better(list(a), list(b), capacity)) is not None:
                    found = a, b, better
                    break
                hopeless.add((a, b))
            if found:
                break
        if not found:
            break
        a, b, better = found
        times = min(open_[a], open_[b]) if a != b else open_[a] // 2
        for k in (a, b):
            open_[k] -= times
        for k in {a, b}:
            if not open_[k]:
                del open_[k]
        for own in better:
            if not own:
                made -= times
                continue
            key = tuple(sorted(own, reverse=True))
            into = done if sum(key) == capacity else open_
            into[key] = into.get(key, 0) + times
    return [[list(k), t] for k, t in [*done.items(), *open_.items()]]


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: whole documents, or ``capacity``-token pieces behind a shorter first one."""

    def run(batches):
        coder = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                flat, offsets = coder.encode(part.column(1).to_pylist(), end_id)
                size = np.diff(offsets)
                cuts = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), cuts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first = (size - (cuts - 1) * capacity)[doc]
                start = np.where(number == 0, 0, first + (number - 1) * capacity)
                length = np.where(number == 0, first, capacity)
                begin = (offsets[doc] + start).tolist()
                sums = [crc32(flat[a : a + n]) for a, n in zip(begin, length.tolist())]
                columns = [part.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _layout(bins: list[list]) -> tuple[dict[int, int], tuple[np.ndarray, ...]]:
    """Where the pieces of each length go, by their number among those of that length.

    Runs of numbers, laid end to end over all lengths, and for each run: pieces
    of that length in a bin, the first sequence, and the offset of the first.
    """
    runs = []
    sequence = 0
    for own, times in bins:
        offset = 0
        for n in dict.fromkeys(own):
            k = own.count(n)
            runs.append((n, k, times, sequence, offset))
            offset += n * k
        sequence += times
    runs.sort(key=lambda r: r[0])
    base, at = {}, 0
    rows = []
    for n, k, times, first, offset in runs:
        base.setdefault(n, at)
        rows.append((at, k, first, offset))
        at += k * times
    return base, tuple(np.array([r[c] for r in rows], np.int64) for c in range(4))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, bucket_rows: int = 2_000) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Each text's ids, closed by ``end_id`` (null: the end id alone), go whole into
    one sequence of at most ``capacity`` tokens; only longer ones are cut, and
    then the first piece may be the shorter. Pieces of one length are alike to
    the packer, so it plans on the counts by length, of which there are
    ``capacity`` at most, however many rows there are: best fit, then the swap
    search. Rows take their places by their number among the rows of their
    length; numbers are given out in buckets of some ``bucket_rows``, so no
    length is gathered in one task. Repeated rows are packed each for
    themselves, null ids like any other; an empty table gives no rows; columns
    other than the two are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "packing")
    rows = work.table(pieces(docs, vocabulary, id_col, text_col, capacity, end_id), "pieces")
    by_length = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shares = spark.createDataFrame([(n, 1 + c // bucket_rows) for n, c in by_length.items()], "length long, buckets long")
    bins = local_search(best_fit(by_length, capacity), capacity)
    sent = spark.sparkContext.broadcast(_layout(bins))

    dealt = rows.join(F.broadcast(shares), "length")  # a row for each length, of which there are at most ``capacity``
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("own", F.row_number().over(own)).join(bases, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") - 1 + F.col("base")).alias("number"))
    # a table, so that a task that is run again cannot number its rows anew
    numbered = work.table(numbered, "numbered")

    def place(batches):
        base, (starts, per_bin, first, offset) = sent.value
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sizes, which = np.unique(length, return_inverse=True)
            at = np.array([base[n] for n in sizes.tolist()], np.int64)[which] + number
            run = np.searchsorted(starts, at, side="right") - 1
            turn = at - starts[run]
            sequence, slot = first[run] + turn // per_bin[run], turn % per_bin[run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(5)), pa.array(sequence), pa.array(offset[run] + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
