"""Exact dedup by composable polynomial fingerprints, confirmed by a chunkwise comparison.

A text is a polynomial over its bytes, taken at four points modulo 2**31 - 1. Pieces are hashed apart from
each other and combined by length-shifted arithmetic: ``h(ab) = h(a) * B**len(b) + h(b)``. A piece's share of
the sum does not depend on where it was hashed, so the segments of a huge document may lie in different tasks
and are added up by an ordinary grouped sum.

Rows with equal fingerprints and lengths are then compared chunk by chunk: the smallest and the largest chunk
at each position must be the same. Spark combines minima and maxima before the shuffle, so a text held by a
third of all rows crosses the network once per task. Where a comparison fails, SHA-256 tells the rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import col, id_and_text, null_safe, unused
from rillmeter.llm.wordhash import text_bytes
from rillmeter.session import materialise

PRIME = (1 << 31) - 1
#: Points at which the polynomials are taken (fixed values below the prime).
BASES = (1_292_913_986, 1_741_102_451, 836_290_217, 2_045_180_119)
CHUNK = 1024
ROWS_AT_ONCE = 2048
SEGMENT = 1 << 16


def hash_pieces(pieces: pa.Array, prime: int = PRIME) -> np.ndarray:
    """Polynomial hashes of byte strings, one row of ``len(BASES)`` values each; the empty string is 0.

    Products with a table of powers are exact in float64: 256 * 2**31 * CHUNK < 2**53.
    """
    data, offsets = text_bytes(pieces)
    powers = np.array([[pow(b, CHUNK - 1 - i, prime) for b in BASES] for i in range(CHUNK)], np.float64)
    shifts = np.array([[pow(b, CHUNK * j, prime) for b in BASES] for j in range(-(-int(max(np.diff(offsets), default=0)) // CHUNK) + 1)], np.uint64)
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK)
    out = np.zeros((len(lengths), len(BASES)), np.uint64)
    i = 0
    while i < len(lengths):
        j, rows = i, 0
        while j < len(lengths) and (j == i or rows + chunks[j] <= ROWS_AT_ONCE):
            rows += int(chunks[j])
            j += 1
        grid = np.zeros(rows * CHUNK, np.float64)
        at = 0
        for k in range(i, j):
            end = at + int(chunks[k]) * CHUNK
            grid[end - lengths[k] : end] = data[offsets[k] : offsets[k + 1]]
            grid[end - lengths[k] : end] += 1
            at = end
        if rows:
            parts = (grid.reshape(rows, CHUNK) @ powers).astype(np.uint64) % np.uint64(prime)
            owner = np.repeat(np.arange(i, j), chunks[i:j])
            last = np.cumsum(chunks[i:j])[owner - i]
            parts = parts * shifts[last - 1 - np.arange(rows)] % np.uint64(prime)
            np.add.at(out, owner, parts)
        i = j
    return out % np.uint64(prime)


def _segments(batches: Iterator[pa.RecordBatch], prime: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = hash_pieces(_as_text(batch["piece"]), prime)
        after = batch["after"].to_numpy()
        for k in np.flatnonzero(after):
            hashes[k] = [int(h) * pow(b, int(after[k]), prime) % prime for h, b in zip(hashes[k], BASES)]
        names = [n for n in batch.schema.names if n not in ("piece", "after")]
        yield pa.RecordBatch.from_arrays(
            [batch[n] for n in names] + [pa.array(hashes[:, i].astype(np.int64)) for i in range(len(BASES))],
            names=names + [f"f{i}" for i in range(len(BASES))],
        )


def _as_text(pieces: pa.Array) -> pa.Array:
    """The same buffers seen as strings: a segment may end inside a character, so no check is wanted."""
    pieces = pieces.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(pieces), pieces.buffers(), pieces.null_count, pieces.offset)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_id, text_hash, text_sha256, n_bytes, fa, fb (the packed fingerprint)."""
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_id"),
        F.xxhash64("text").alias("text_hash"),
        F.sha2("text", 256).alias("text_sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.col("text").cast("binary").alias("bytes"),
    )
    cut = rows.select(
        "doc_id", "row_id", "text_hash", "text_sha256", "n_bytes", "bytes",
        F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / segment).cast("int"))).alias("k"),
    ).select(
        "doc_id", "row_id", "text_hash", "text_sha256", "n_bytes",
        F.substring("bytes", F.col("k") * segment + 1, F.lit(segment)).alias("piece"),
        F.greatest(F.col("n_bytes") - (F.col("k").cast("long") + 1) * segment, F.lit(0)).alias("after"),
    )
    hashed = cut.mapInArrow(
        lambda batches: _segments(batches, prime),
        "doc_id long, row_id long, text_hash long, text_sha256 string, n_bytes long, " + ", ".join(f"f{i} long" for i in range(len(BASES))),
    )
    whole = hashed.groupBy("doc_id", "row_id", "text_hash", "text_sha256", "n_bytes").agg(
        *[(F.sum(f"f{i}") % prime).alias(f"f{i}") for i in range(len(BASES))]
    )
    return whole.select(
        "doc_id", "row_id", "text_hash", "text_sha256", "n_bytes",
        (F.shiftleft("f0", 31) + F.col("f1")).alias("fa"),
        (F.shiftleft("f2", 31) + F.col("f3")).alias("fb"),
    )


FINGERPRINT = ["fa", "fb", "n_bytes"]


def _differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, segment: int) -> DataFrame:
    """Fingerprints whose rows do not all hold the same bytes."""
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    # Dealt anew before rows are made distinct: else a hot fingerprint would have to stay in one task.
    known = members.select("doc_id", "text_hash", *FINGERPRINT).repartition("doc_id", "text_hash").distinct()
    held = texts.join(known, null_safe(texts, known, ["doc_id", "text_hash"])).select(*FINGERPRINT, F.col("text").cast("binary").alias("bytes"))
    chunks = held.select(
        *FINGERPRINT, "bytes",
        F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / segment).cast("int"))).alias("k"),
    ).select(*FINGERPRINT, "k", F.substring("bytes", F.col("k") * segment + 1, F.lit(segment)).alias("chunk"))
    return (
        chunks.groupBy(*FINGERPRINT, "k")
        .agg((F.min("chunk") != F.max("chunk")).alias("differs"))
        .where("differs")
        .select(*FINGERPRINT)
        .distinct()
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, segment: int = SEGMENT) -> DataFrame:
    """For every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and text_hash, row_id).

    Null texts count as empty, empty texts equal each other. Of equal texts the row with the largest doc_id
    stays; a null doc_id is the smallest. Of rows that repeat one doc_id and one text, one stays. An empty table
    gives an empty result; other columns of ``docs`` are not looked at.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, prime, segment), "fingerprints")
    # Groups are stored before rows are joined back to them: only then can adaptive execution split a hot group.
    groups = materialise(rows.groupBy(*FINGERPRINT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "groups")
    repeated = rows.join(groups.hint("merge"), FINGERPRINT, "left_semi")
    differing = materialise(_differing(docs, repeated, id_col, text_col, segment), "differing")
    split = differing.withColumn("split", F.lit(True))
    classed = rows.join(split, FINGERPRINT, "left").withColumn("told", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split")
    by = [*FINGERPRINT, "told"]
    keepers = classed.groupBy(*by).agg(
        F.max(F.struct("doc_id", "row_id")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )
    keepers = materialise(keepers.where("group_size > 1"), "keepers")
    return classed.join(keepers.hint("merge"), by, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keeper.row_id"), F.lit(True)).alias("kept"),
        "text_sha256",
        "text_hash",
        "row_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps.

    Of rows that repeat one doc_id and one text, the one whose columns have the smallest hash stays.
    """
    decided = materialise(exact_dedup(docs, id_col, text_col).where("kept").select("doc_id", "text_hash"), "kept-rows")
    key, held, rank = unused(docs, "__key", "__held", "__rank")
    keyed = docs.withColumns({key: col(id_col).cast("long"), held: F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))})
    kept = keyed.join(decided, keyed[key].eqNullSafe(decided["doc_id"]) & (keyed[held] == decided["text_hash"]), "left_semi")
    if docs.select(col(id_col)).count() != docs.select(col(id_col)).distinct().count():
        kept = kept.withColumn(rank, F.xxhash64(F.to_json(F.struct(*[col(c) for c in docs.columns]))))
        first = materialise(kept.groupBy(key, held).agg(F.min(rank).alias("least")).toDF("k", "h", "least"), "first-rows")
        same = kept[key].eqNullSafe(first["k"]) & (kept[held] == first["h"]) & (kept[rank] == first["least"])
        kept = kept.join(first.hint("merge"), same, "left_semi").dropDuplicates([key, held])
    return kept.select(*[col(c) for c in docs.columns])
