"""Packing by power-of-two decomposition.

A document's ids and the end id are cut into pieces whose lengths are the powers of two of its length's binary form,
largest first and at most `most` each. Every piece is a sequence of its own, so no sequence crosses documents and none
is padded; batches take sequences of one bucket (one length). One map over the input, no shuffle: sequence ids are the
task's number and a counter in it, with the bucket's exponent in the low bits.

Defined cases: a null or empty text is one piece of the end id alone; repeated rows are packed each; very long
texts are encoded whole, a batch of one; an empty table gives an empty table; extra input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import begun, bounded, ended
from .tokens import default_tokenizer, worker_ids
from .vectext import chunks

MOST = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def binary_pieces(n: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of each n, one n after the other, and how many each n has."""
    top = int(most).bit_length() - 1
    powers = 1 << np.arange(top - 1, -1, -1)
    full = n // most
    bits = (n[:, None] & powers) > 0
    many = full + bits.sum(1)
    at = np.cumsum(many) - many
    out = np.full(int(many.sum()), most, np.int64)
    row, bit = np.nonzero(bits)
    rank = (np.cumsum(bits, axis=1) - 1)[row, bit]
    out[at[row] + full[row] + rank] = powers[bit]
    return out, many


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with_ids adds the ids themselves and the bucket (the sequence's length)."""
    if most < 1 or most & (most - 1):
        raise ValueError(f"most must be a power of two, not {most}")
    path = tokenizer or default_tokenizer()
    shift = np.int64(max(1, int(most).bit_length().bit_length()))

    def each(batches):
        task = np.int64(TaskContext.get().partitionId()) << np.int64(36)
        made = 0
        begun("tokens")
        cache = worker_ids(path)
        for batch in batches:
            for part in chunks(batch, "__text", 1 << 20):
                ids, at = cache.encode(part.column(1).to_pylist())
                n = np.diff(at) + 1
                lengths, many = binary_pieces(n, most)
                row = np.repeat(np.arange(len(n)), many)
                begin = np.cumsum(many) - many
                run = np.cumsum(lengths) - lengths
                start = run - np.repeat(run[begin], many)
                whole = np.insert(ids, at[1:], END_ID).astype("<u4")
                first = np.repeat(at[:-1] + np.arange(len(n)), many) + start
                flat = memoryview(whole.tobytes())
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + lengths).tolist())]
                number = (task + np.arange(made, made + len(row)) << shift) + np.log2(lengths).astype(np.int64)
                made += len(row)
                columns = [part.column(0).take(pa.array(row)), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(number), pa.array(np.zeros(len(row), np.int64))]
                names = SCHEMA.replace(" long", "").split(", ")
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(whole)])).astype(np.int32)), pa.array(whole.astype(np.int32))), pa.array(lengths)]
                    names = [*names, "ids", "bucket"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        cache.trim()
        ended()

    frame = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("__text"))
    return bounded(frame).mapInArrow(each, SCHEMA + (", ids array<int>, bucket long" if with_ids else ""))


def digest(df: DataFrame) -> DataFrame:
    return df.select(*SCHEMA.replace(" long", "").split(", "))
