"""SimHash near-duplicates by a range join over segment bit counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.llm.work import Work

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of a whole text; 0 where it has no words.

    A-Z are lower-cased, words are runs of other than space and \\t to \\r, a text
    of fewer than ``width`` words is one shingle. A bit is 1 if more than half of
    the shingles' XXH64 values, repeats included, have it.
    """
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    spaced, at = b" ".join(words), 0
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(spaced[i:j], seed) for i, j in zip(starts, stops)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, bits)``: the SimHash of every text as a signed 64-bit integer. Null texts count as empty."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["id", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, bits long")


def segment_counts(bits: Column) -> Column:
    """The embedding: bit counts of the 32 two-bit segments, packed two bits each into a long."""
    upper, one_each = F.shiftrightunsigned(bits, 1), F.lit(0x5555555555555555)
    one = bits.bitwiseXOR(upper).bitwiseAND(one_each)
    two = bits.bitwiseAND(upper).bitwiseAND(one_each)
    return one.bitwiseOR(F.shiftleft(two, 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two packed embeddings, never above the bits in which the fingerprints differ."""
    total = F.lit(0)
    for s in range(0, 64, 2):
        total = total + F.abs(F.shiftrightunsigned(a, s).bitwiseAND(F.lit(3)) - F.shiftrightunsigned(b, s).bitwiseAND(F.lit(3)))
    return total


def _cells(distance: int, regions: int) -> list[int]:
    """Masks of the coordinates that each grid keeps: all regions of the 32 but ``distance`` of them."""
    cut = [round(32 * r / regions) for r in range(regions + 1)]
    region = [sum(3 << (2 * s) for s in range(cut[r], cut[r + 1])) for r in range(regions)]
    masks = [sum(region[r] for r in kept) for kept in combinations(range(regions), regions - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, work: Work, distance: int = 2, regions: int = 5, dense: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``bits`` that join all within ``distance`` bits.

    Two points within Manhattan distance d of the embedding differ in at most d
    of ``regions`` groups of coordinates, so they share a cell of at least one
    grid that keeps ``regions - d`` groups. Points of a shared cell are compared
    by the embedding's distance, the lower bound, and then by the fingerprints.
    A cell of more than ``dense`` points could give the square of its size in
    pairs; its points take the exact way instead: each is listed under all
    fingerprints within half the distance of it, and what meets there is linked
    in a star. Both ways join the same points: links by a star hold between
    points within ``distance`` of each other. Supports distance 2.
    """
    if distance != 2:
        raise ValueError("links are found at 2 differing bits")
    masks = _cells(distance, regions)
    points = prints.select("bits", segment_counts(F.col("bits")).alias("counts"))
    cells = points.select(
        "bits",
        "counts",
        F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("cell"),
    )
    size = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = work.table(cells.join(size, "cell"), "cells")
    few = shared.where(F.col("n") <= dense).select("cell", "bits", "counts")
    left, right = few.alias("l"), few.alias("r")
    near = left.join(
        right,
        (F.col("l.cell") == F.col("r.cell"))
        & (F.col("l.bits") < F.col("r.bits"))
        & (manhattan(F.col("l.counts"), F.col("r.counts")) <= distance)
        & (F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= distance),
    ).select(F.col("l.bits").alias("a"), F.col("r.bits").alias("b"))
    crowded = shared.where(F.col("n") > dense).select("bits").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    met = crowded.select("bits", F.explode(F.transform(flips, lambda f: F.col("bits").bitwiseXOR(f))).alias("mid"))
    heart = met.groupBy("mid").agg(F.min("bits").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    stars = met.join(heart, "mid").where("bits <> b").select(F.col("bits").alias("a"), "b")
    return near.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, regions: int = 5) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint``, ``component_id``.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest id reachable, the document's own included.
    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows give repeated rows of one component; null ids are returned with
    the component of their fingerprint (null if it has no other id). Equal
    fingerprints meet before any are compared, so a group of copies of any size
    counts as one point. Other columns of ``docs`` are ignored.
    """
    work = Work(docs.sparkSession, "simhash")
    rows = work.table(fingerprints(docs, id_col, text_col, width), "prints")
    points = work.table(rows.groupBy("bits").agg(F.min("id").alias("least")), "points")
    found = work.table(components(links(points, work, distance, regions), work), "found")
    group = points.join(found, points.bits == found.node, "left").select("bits", F.coalesce("component", "bits").alias("component"), "least")
    ids = group.groupBy("component").agg(F.min("least").alias("component_id"))
    named = group.join(ids, "component").select("bits", "component_id")
    return rows.join(named, "bits").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
