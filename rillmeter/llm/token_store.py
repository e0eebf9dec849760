"""Token ids in binary shard files, with a minimal perfect hash index for constant-time access by key.

Rows are dealt out by ranges of doc_id, sorted, encoded and written as shards by the tasks themselves, to the
shared folder. A file gets a new name at every attempt and only files named in the manifest count, so a task
that is run again leaves at most an unread file behind.

A shard holds, little-endian: the magic word, five counts (documents, tokens, keys, index buckets, bytes an id),
the raw ids, the documents' keys, a byte each telling null keys, their first tokens (one more entry than
documents), and the index: a displacement per bucket and, per slot, a 32-bit fingerprint of the key, its first
document and its number of documents. A key's bucket gives a displacement, which with the key gives the slot;
a slot whose fingerprint differs means the key is not in the shard. Keys themselves are not compared, so a key
that was never stored is taken for a stored one with probability 2**-32.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillmeter.llm.common import id_and_text
from rillmeter.llm.tokens import Encoder, default_tokenizer, slices
from rillmeter.llm.wordhash import mix
from rillmeter.session import materialise, scratch_path

MAGIC = b"IDSHARD1"
#: Tokens after which a task begins a new shard.
SHARD_TOKENS = 4 << 20
KEYS_PER_BUCKET = 4
MANIFEST = "part long, shard long, path string, first_id long, last_id long, n_docs long, n_tokens long"
_HEADER = np.dtype("<u8")


def _slots(keys: np.ndarray, displacement: np.ndarray | int, n: int) -> np.ndarray:
    seed = np.asarray(displacement).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(mix(keys.astype(np.int64).view(np.uint64)) ^ seed) % np.uint64(n)).astype(np.int64)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0xA5A5A5A5)) % np.uint64(n)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xC0FFEE)) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements per bucket and the slot of each of the (distinct) keys; slots are 0..n-1, each used once.

    Buckets are placed from the largest to the smallest, each with the first displacement that finds free slots.
    A bucket of one key takes any free slot, stored as ``-1 - slot``.
    """
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    displacement = np.zeros(buckets, np.int64)
    of = _buckets(keys, buckets)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(buckets + 1))
    sizes = np.diff(bounds)
    used, slot = np.zeros(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        members = order[bounds[b] : bounds[b + 1]]
        if len(members) < 2:
            break
        base, d = 1, None
        while d is None:  # tries 32 displacements at a time
            tried = _slots(np.repeat(keys[members], 32), np.tile(np.arange(base, base + 32), len(members)), n).reshape(-1, 32)
            free = ~used[tried].any(0)
            for k in np.flatnonzero(free):
                if len(set(tried[:, k].tolist())) == len(members):
                    d, slot[members] = base + k, tried[:, k]
                    break
            base += 32
        used[slot[members]] = True
        displacement[b] = d
    alone = order[bounds[:-1][sizes == 1]]
    slot[alone] = np.flatnonzero(~used)[: len(alone)]
    displacement[of[alone]] = -1 - slot[alone]
    return displacement, slot


class Shard:
    """One shard in memory: written from rows sorted by key, or read back from its bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, tokens, keys, buckets, width = map(int, np.frombuffer(data, _HEADER, 5, 8))
        at = 48

        def block(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.ids = block(f"<u{width}", tokens)
        self.keys, self.null, self.begin = block("<i8", docs), block("u1", docs).astype(bool), block("<u8", docs + 1).astype(np.int64)
        self.displacement, self.prints = block("<i8", buckets), block("<u4", keys)
        self.first, self.number = block("<u4", keys).astype(np.int64), block("<u4", keys).astype(np.int64)

    @staticmethod
    def pack(keys: np.ndarray, null: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> bytes:
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        known, first, number = np.unique(keys[~null], return_index=True, return_counts=True)
        first = first + int(null.sum())  # null keys come first
        displacement, slot = perfect_hash(known) if len(known) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        prints, at, times = (np.zeros(len(known), np.uint32) for _ in range(3))
        prints[slot], at[slot], times[slot] = fingerprint(known), first, number
        head = np.array([len(keys), len(ids), len(known), len(displacement), width], _HEADER)
        blocks = (head, ids.astype(f"<u{width}"), keys.astype("<i8"), null.astype("u1"), begin.astype("<u8"), displacement.astype("<i8"),
                  prints.astype("<u4"), at.astype("<u4"), times.astype("<u4"))
        return MAGIC + b"".join(b.tobytes() for b in blocks)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents where the shard has none."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        d = self.displacement[_buckets(keys, len(self.displacement))]
        slot = np.where(d < 0, -1 - d, _slots(keys, np.maximum(d, 0), len(self.prints)))
        there = self.prints[slot] == fingerprint(keys)
        return np.where(there, self.first[slot], 0), np.where(there, self.number[slot], 0)

    def tokens(self, doc: int) -> np.ndarray:
        return self.ids[self.begin[doc] : self.begin[doc + 1]]


class ShardFile:
    """One shard left in its file: what a key needs is read from where it lies, a few dozen bytes beside its ids."""

    def __init__(self, source) -> None:
        self.source, self.bytes_read = source, 0
        head = self._bytes(0, 48)
        if head[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, tokens, self.n_keys, self.buckets, width = map(int, np.frombuffer(head, _HEADER, 5, 8))
        blocks = (("ids", f"<u{width}", tokens), ("keys", "<i8", docs), ("null", "u1", docs), ("begin", "<u8", docs + 1), ("displacement", "<i8", self.buckets),
                  ("prints", "<u4", self.n_keys), ("first", "<u4", self.n_keys), ("number", "<u4", self.n_keys))
        self.blocks, at = {}, 48
        for name, kind, n in blocks:
            self.blocks[name] = (at, np.dtype(kind))
            at += n * np.dtype(kind).itemsize

    def _bytes(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        self.source.seek(at)
        return self.source.read(n)

    def _values(self, name: str, first: int, n: int = 1) -> np.ndarray:
        at, kind = self.blocks[name]
        return np.frombuffer(self._bytes(at + first * kind.itemsize, n * kind.itemsize), kind)

    def documents(self, key: int) -> list[np.ndarray]:
        """Ids of each document with this key."""
        if not self.n_keys:
            return []
        one = np.array([key], np.int64)
        displacement = int(self._values("displacement", int(_buckets(one, self.buckets)[0]))[0])
        slot = -1 - displacement if displacement < 0 else int(_slots(one, displacement, self.n_keys)[0])
        if self._values("prints", slot)[0] != fingerprint(one)[0]:
            return []
        first, number = (int(self._values(name, slot)[0]) for name in ("first", "number"))
        begin = self._values("begin", first, number + 1).astype(np.int64)
        ids = self._values("ids", int(begin[0]), int(begin[-1] - begin[0]))
        return np.split(ids, begin[1:-1] - begin[0])


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(tokenizer)
    files, root = fs.FileSystem.from_uri(folder)
    part = TaskContext.get().partitionId()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    shard = size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, shard, size
        keys, null, ids, n = (np.concatenate(x) for x in zip(*held))
        path = f"{root}/{part:06d}-{shard:05d}-{uuid.uuid4().hex}.ids"
        with files.open_output_stream(path) as out:
            out.write(Shard.pack(keys, null, ids, np.concatenate([[0], np.cumsum(n)])))
        known = keys[~null]
        row = [part, shard, path, known[0].item() if len(known) else None, known[-1].item() if len(known) else None, len(keys), len(ids)]
        held, shard, size = [], shard + 1, 0
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    for batch in batches:
        for some in slices(batch):
            ids, begin = encoder.encode(some["text"].to_pylist())
            held.append((some["doc_id"].fill_null(0).to_numpy(), some["doc_id"].is_null().to_numpy(zero_copy_only=False), ids, np.diff(begin)))
            size += len(ids)
            if size >= shard_tokens:
                yield flush()
    if held:
        yield flush()


def write_tokens(
    docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of all texts (null: empty) in ascending doc_id order; returns the manifest.

    The manifest has a row per shard: part, shard, path, first_id, last_id, n_docs, n_tokens and start (ids in
    earlier shards). Null ids come first; rows that repeat a doc_id follow each other, ordered by a hash of their
    text. An empty table gives no shard.
    """
    spark = docs.sparkSession
    path, target = tokenizer or default_tokenizer(), folder or scratch_path(spark, "tokens")
    if "://" not in target:
        target = f"file://{target}"
    files, root = fs.FileSystem.from_uri(target)
    files.create_dir(root, recursive=True)
    keyed = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = materialise(ordered.mapInArrow(lambda b: _write(b, path, target, shard_tokens), MANIFEST), "manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")).withColumn("root", F.lit(target))


def _load(root: str, path: str) -> Shard:
    files, _ = fs.FileSystem.from_uri(root)
    with files.open_input_stream(path) as source:
        return Shard(source.read())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = _load(row["root"], row["path"])
            first, number = shard.find(shard.keys)
            place = np.arange(len(shard.keys))
            through_index = shard.null | ((first <= place) & (place < first + number))
            if not through_index.all():
                raise ValueError(f"{row['path']}: the index does not lead to every document")
            crc = [zlib.crc32(shard.tokens(k).astype("<u4").tobytes()) for k in place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.keys, mask=shard.null), pa.array(row["start"] + shard.begin[:-1]), pa.array(np.diff(shard.begin)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every stored document, found through its shard's index: doc_id, start, n_tokens, ids_crc32."""
    shards = manifest.count()
    spread = manifest.repartition(max(1, min(shards, 10_000)), "path")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, _ = fs.FileSystem.from_uri(row["root"])
            with files.open_input_file(row["path"]) as source:
                shard = ShardFile(source)
                found = [(key, ids) for key in row["keys"] for ids in shard.documents(key)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.int64()), pa.array([t.astype("<u4").tobytes() for _, t in found], pa.binary())],
                names=["doc_id", "ids"],
            )


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """Ids (little-endian 32-bit) of the documents with these keys; a key that is not stored has no row.

    ``keys`` is a caller's short list; a key given twice counts once. Shards whose key range holds none of them are not
    opened, and of the others only the header, the index entries of the keys and their ids are read.
    """
    wanted = F.array(*[F.lit(k).cast("long") for k in sorted({int(k) for k in keys})]) if keys else F.array().cast("array<long>")
    within = F.filter(wanted, lambda k: (k >= F.col("first_id")) & (k <= F.col("last_id")))
    asked = manifest.select("root", "path", within.alias("keys")).where(F.size("keys") > 0)
    return asked.mapInArrow(_fetch, "doc_id long, ids binary")
