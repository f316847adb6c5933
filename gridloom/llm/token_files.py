"""Token-id output: whole texts as Huffman-coded id files in ascending id order."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.huffman import Coder, code_lengths
from gridloom.llm.tokens import tokenizer
from gridloom.llm.work import Work

#: Tokens after which a block is closed; it holds whole documents.
BLOCK_TOKENS = 1 << 18
#: Texts encoded at a time.
TEXTS = 512
END_ID = 2


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def id_type(vocabulary: str, end_id: int = END_ID) -> str:
    """The narrowest of the two widths that ids are kept in between stages."""
    return "<u2" if max(tokenizer(vocabulary).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def token_rows(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, ids as binary of ``id_type``, each text closed by ``end_id``."""
    kind = id_type(vocabulary, end_id)

    def run(batches):
        coder = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                flat, offsets = coder.encode(part.column(1).to_pylist(), end_id)
                raw, places = flat.astype(kind), (offsets * np.dtype(kind).itemsize).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(places), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), ids], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(rows: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all rows; as long as the vocabulary and no longer."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                own = np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=len(total))
                own[: len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"]
    return counts


def write_files(docs: DataFrame, vocabulary: str, work: Work, id_col: str = "doc_id", text_col: str = "text", limit: int = 16) -> np.ndarray:
    """Writes the blocks as table ``files`` of ``work`` and returns the code lengths.

    A file is the rows of one ``part``, in order of ``seq``; files in order of
    ``part`` hold ascending ids (null first, equal ids next to each other).
    Texts are tokenized once; that table goes when the files stand.
    """
    rows = work.table(token_rows(docs, vocabulary, id_col, text_col), "ids", compression="zstd")
    kind = id_type(vocabulary)
    lengths = code_lengths(id_counts(rows, kind), limit)
    sent = docs.sparkSession.sparkContext.broadcast(lengths)

    def encode(batches):
        coder, part, seq, before = Coder(sent.value), TaskContext.get().partitionId(), 0, 0
        names, counts, held, size = [], [], [], 0

        def block():
            nonlocal seq, before
            sizes = np.array(counts, np.int64)
            blob = coder.encode(np.concatenate(held), sizes, names, before)
            row = [[part], [seq], [int(sizes.sum())], [blob]]
            seq, before = seq + 1, before + int(sizes.sum())
            names.clear(), counts.clear(), held.clear()
            types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["part", "seq", "tokens", "block"])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(value.as_buffer(), kind).astype(np.int64)
                names.append(doc_id), counts.append(len(ids)), held.append(ids)
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield block()
                    size = 0
        if names:
            yield block()

    ordered = rows.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    work.table(ordered.mapInArrow(encode, "part int, seq int, tokens long, block binary"), "files", compression="none")
    work.drop("ids")
    return lengths


def read_files(work: Work, lengths: np.ndarray) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""
    files = work.read("files", "part int, seq int, tokens long, block binary")
    sizes = dict(map(tuple, files.groupBy("part").agg(F.sum("tokens")).collect()))  # one number a file
    bases, total = {}, 0
    for part in sorted(sizes):
        bases[part], total = total, total + sizes[part]
    sent = work.spark.sparkContext.broadcast((lengths, bases))

    def decode(batches):
        lengths, bases = sent.value
        coder = Coder(lengths)
        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, counts, names, before = coder.decode(value.as_py())
                ends = np.cumsum(counts)
                starts = bases[part] + before + ends - counts
                sums = [crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "block").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns what is read back: one row per document row.

    Null and empty texts are the end id alone. Equal ids stand next to each
    other in no fixed order of their own; null ids come first. An empty table
    gives no files and no rows; columns other than the two are ignored.
    """
    work = Work(docs.sparkSession, "tokens")
    return read_files(work, write_files(docs, vocabulary, work, id_col, text_col))
