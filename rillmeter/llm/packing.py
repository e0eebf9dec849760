"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own.

A document's ids are cut into pieces of ``limit`` tokens and the binary parts of what is left, largest first.
A piece's length is a power of two, so it needs no padding, and no sequence crosses documents. Sequences are
bucketed by length: the top bits of ``sequence_id`` are the power, so one filter gives a bucket of equal
lengths. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import id_and_text
from rillmeter.llm.tokens import Encoder, default_tokenizer, slices

LIMIT = 2048
#: Bits of a sequence id below the power of two.
BUCKET_SHIFT = 58


def piece_lengths(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of documents of these sizes, and the number of pieces of each."""
    powers = 1 << np.arange(limit.bit_length() - 2, -1, -1)
    whole = tokens // limit
    parts = (tokens[:, None] & powers) > 0
    counts = whole + parts.sum(1)
    table = np.concatenate([np.full((len(tokens), 1), limit), np.where(parts, powers, 0)], axis=1)
    times = np.concatenate([whole[:, None], parts.astype(np.int64)], axis=1)
    return np.repeat(table.ravel(), times.ravel()), counts


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path)
    for batch in batches:
        for part in slices(batch):
            ids, offsets = encoder.encode(part["text"].to_pylist())
            tokens = np.diff(offsets)
            lengths, counts = piece_lengths(tokens, limit)
            owner = np.repeat(np.arange(len(tokens)), counts)
            begins = np.concatenate([[0], np.cumsum(lengths)])
            payload = pa.Array.from_buffers(
                pa.binary(), len(lengths), [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].take(pa.array(owner)), pa.array(begins[:-1] - offsets[owner]), pa.array(lengths.astype(np.int64)),
                 payload, pa.array(tokens[owner])],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``limit`` is a power of two. Null and empty texts are one piece, the end id. Rows that repeat a doc_id are
    packed each on its own; a null doc_id is carried along. Sequence ids are unique and depend on the row's
    place in the input files only.
    """
    if limit < 2 or limit & (limit - 1):
        raise ValueError("the limit must be a power of two")
    path = tokenizer or default_tokenizer()
    cut = id_and_text(docs, id_col, text_col).mapInArrow(
        lambda batches: _pieces(batches, path, limit), "doc_id long, start long, length long, ids binary, doc_tokens long"
    )
    power = F.round(F.log2("length")).cast("long")
    return cut.withColumn("sequence_id", F.shiftleft(power, BUCKET_SHIFT) + F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long")
    )
