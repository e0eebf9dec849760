"""Cross-tokenizer alignment: two tokenisations of a text merged in lockstep, and id pairs counted over the corpus.

Both token sequences of a text cover the same bytes. A lane is a document, or a stretch of ``LANE`` bytes of one, with
a pointer into either sequence. One step looks at the two tokens under the pointers of every lane: they overlap, which
is a link; where both end at the same byte there is a cut; whichever ends first (or both) moves on. Lanes that are
done are taken out of the state, so a step costs a few vector operations over the lanes that are left.

A stretch begins inside whatever tokens cover its first byte. A link belongs to the stretch that holds the first byte
of the overlap, so none is seen twice.

Corpus-wide counts come from per-document pair counts, summed per task, then grouped. The pairs with most links, at
most ``HOT`` of them, go to all tasks as one sorted table; the others, each rarer than those, are joined by key.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import id_and_text
from rillmeter.llm.tokens import ragged, slices
from rillmeter.llm.wordhash import text_bytes
from rillmeter.session import materialise

#: Bytes of a stretch.
LANE = 1024
#: Most id pairs that are broadcast (20 bytes each).
HOT = 1 << 19
#: Distinct pairs a counting task holds before it hands them on.
HELD = 1 << 21
#: Characters whose class is the same in every version of Unicode since 3.0: here the ranks file splits as the library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ſ]*")
#: Longest run without white space, or of white space, that the ranks file is asked for.
_LONG = re.compile(r"\S{2000}|\s{2000}")


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.path("byte_bpe_50k.tiktoken")


def _byte_of() -> dict[str, int]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Vocabulary:
    """Bytes and decimal spelling of every id."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.at[ids], self.length[ids])]

    def spelt(self, last: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids in decimal with a comma after them, and with ``last`` after them."""
        return tuple(np.array([f"{i}{c}" for i in range(self.size)], object) for c in (",", last))


class Pair:
    """Both tokenizers; one per worker and files. ``ranks`` is the first one's vocabulary for the tiktoken library, which
    reads texts of well-known characters faster; without it all texts go to the tokenizers library."""

    _made: dict[tuple, Pair] = {}

    def __init__(self, a: str, b: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(a)
        self.library.encode_special_tokens = True
        of, vocab = _byte_of(), self.library.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in json.loads(self.library.to_str())["added_tokens"]}
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = token.encode() if token in added else bytes(of[c] for c in token)
        self.a = _Vocabulary(entries)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        self.b = _Vocabulary([self._piece(i) for i in range(self.pieces.get_piece_size())])
        self.words_a, self.words_b = self.a.spelt("|"), self.b.spelt(";")
        self.fast = self._ranked(ranks) if ranks else None

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, files: tuple) -> Pair:
        if files not in cls._made:
            cls._made[files] = cls(*files)
        return cls._made[files]

    def encode_a(self, texts: list[str]) -> list:
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast and _PLAIN.fullmatch(text) and not _LONG.search(text):
                out[i] = self.fast.encode_ordinary(" " + text)
            else:
                rest.append(i)
        for i in rest:  # one by one: a batch would hold all encodings at once
            out[i] = self.library.encode_batch_fast([" " + texts[i]], add_special_tokens=False)[0].ids
        return out

    def encode_b(self, texts: list[str]) -> list:
        return self.pieces.encode(texts, num_threads=1)


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    out = np.empty(int(first[-1]), np.int64)
    for ids, a, b in zip(lists, first[:-1], first[1:]):
        out[a:b] = ids
    return out, first


def _same(vocabulary: _Vocabulary, ids: np.ndarray, first: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text whether its ids' bytes are a space and the text."""
    total = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])[first]
    same = np.diff(total) == np.diff(at) + 1
    made = vocabulary.joined(ids)
    for i in np.flatnonzero(same):
        got = made[total[i] : total[i + 1]]
        same[i] = got[0] == 32 and np.array_equal(got[1:], data[at[i] : at[i + 1]])
    return same


def lockstep(a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Links and cuts of documents laid one after another on one byte axis.

    ``a_end``, ``b_end``: where each token ends; ``starts``: where each document begins, and the end of the last.
    Returns A and B token numbers of the links in order, and for each token of A and B whether a cut follows it.
    """
    n = -(-np.diff(starts) // lane)  # stretches of each document
    low = np.repeat(starts[:-1], n) + (ragged(np.zeros(len(n), np.int64), n) * lane)
    high = np.minimum(low + lane, np.repeat(starts[1:], n))
    pa_, pb = np.searchsorted(a_end, low, "right"), np.searchsorted(b_end, low, "right")
    begun = np.maximum(np.where(pa_ > 0, a_end[pa_ - 1], 0), np.where(pb > 0, b_end[pb - 1], 0))
    mine = begun >= low
    linked = np.full(len(a_end) + len(b_end), -1, np.int64)
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    while len(pa_):
        ea, eb = a_end[pa_], b_end[pb]
        both = ea == eb
        if mine is None:
            linked[pa_ + pb] = pa_
            cut_a[pa_[both]] = cut_b[pb[both]] = True
        else:  # the first step: an overlap that began before the stretch is not its own
            linked[(pa_ + pb)[mine]] = pa_[mine]
            cut_a[pa_[both & mine]] = cut_b[pb[both & mine]] = True
            mine = None
        left = np.minimum(ea, eb) < high
        pa_, pb = pa_ + (ea <= eb), pb + (eb <= ea)
        if not left.all():
            pa_, pb, high = pa_[left], pb[left], high[left]
    slots = np.flatnonzero(linked >= 0)  # a step moves either pointer, so their sum orders links
    a = linked[slots]
    return a, slots - a, cut_a, cut_b


def _spelt_groups(pair: Pair, a, a_first, b, b_first, cut_a, cut_b) -> list[str]:
    """Per document: A ids, a bar, B ids of each group; groups parted by semicolons."""
    ends_a, ends_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    before = np.concatenate([[0], ends_b])[:-1]
    out = np.empty(len(a) + len(b), object)
    (plain_a, bar), (plain_b, semi) = pair.words_a, pair.words_b
    out[np.arange(len(a)) + before[group_a]] = np.where(cut_a, bar[a], plain_a[a])
    out[np.arange(len(b)) + ends_a[group_b]] = np.where(cut_b, semi[b], plain_b[b])
    at = a_first + b_first
    return ["".join(out[x:y].tolist())[:-1] for x, y in zip(at[:-1], at[1:])]


def align(pair: Pair, texts: pa.Array) -> dict[str, np.ndarray | list]:
    """Counts, group digests and pair counts (keys A id * B vocabulary + B id, CSR offsets) of a batch of texts."""
    data, at = text_bytes(texts)
    strings = [t or "" for t in texts.to_pylist()]
    some = np.flatnonzero(np.diff(at) > 0)
    a, a_first = _flat(pair.encode_a([strings[i] for i in some]))
    b, b_first = _flat(pair.encode_b([strings[i] for i in some]))
    held = np.stack([at[some], at[some + 1]], 1) if len(some) else np.zeros((0, 2), np.int64)
    packed = np.concatenate([[0], np.cumsum(held[:, 1] - held[:, 0])]).astype(np.int64)
    good = _same(pair.a, a, a_first, data, packed) & _same(pair.b, b, b_first, data, packed)  # empty texts add no bytes
    keep_a, keep_b = np.repeat(good, np.diff(a_first)), np.repeat(good, np.diff(b_first))
    n_a, n_b = np.diff(a_first)[good], np.diff(b_first)[good]
    a, b = a[keep_a], b[keep_b]
    a_first, b_first = np.concatenate([[0], np.cumsum(n_a)]).astype(np.int64), np.concatenate([[0], np.cumsum(n_b)]).astype(np.int64)
    some = some[good]
    a_end, b_end = np.cumsum(pair.a.length[a]), np.cumsum(pair.b.length[b])
    starts = np.concatenate([[0], a_end])[a_first]
    la, lb, cut_a, cut_b = lockstep(a_end, b_end, starts)
    owner = np.repeat(np.arange(len(some)), n_a)
    width = pair.a.size * pair.b.size
    coded = owner[la] * width + a[la] * pair.b.size + b[lb]
    coded.sort()
    new = np.flatnonzero(np.concatenate([[True], coded[1:] != coded[:-1]])) if len(coded) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(coded)]]))
    found = coded[new]
    total = len(strings)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(total, np.int64)
        out[some] = values
        return out

    digests = [""] * total
    for i, text in zip(some, _spelt_groups(pair, a, a_first, b, b_first, cut_a, cut_b)):
        digests[i] = hashlib.sha256(text.encode()).hexdigest()
    return {
        "n_a": spread(n_a), "n_b": spread(n_b),
        "n_groups": spread(np.bincount(owner[cut_a], minlength=len(some))), "n_links": spread(np.bincount(owner[la], minlength=len(some))),
        "groups_sha256": digests, "keys": found % width, "counts": counts,
        "offsets": np.concatenate([[0], np.cumsum(spread(np.bincount(found // width, minlength=len(some))))]),
    }


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(batches: Iterator[pa.RecordBatch], files: tuple) -> Iterator[pa.RecordBatch]:
    pair = Pair.of(files)
    for batch in batches:
        for part in slices(batch):
            x = align(pair, part["text"])
            offsets = pa.array(x["offsets"].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *[pa.array(x[c]) for c in _COUNTS], pa.array(x["groups_sha256"], pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(x["keys"])), pa.ListArray.from_arrays(offsets, pa.array(x["counts"].astype(np.int32)))],
                names=["doc_id", *_COUNTS, "groups_sha256", "keys", "counts"],
            )


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of a batch, and how many each row has."""
    sizes = np.diff(batch["keys"].offsets.to_numpy())
    return batch["keys"].flatten().to_numpy(), batch["counts"].flatten().to_numpy().astype(np.int64), sizes


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        k, n, _ = _lists(batch)
        keys, counts = _summed(np.concatenate([keys, k]), np.concatenate([counts, n]))
        if len(keys) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def _slots(hot: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted table, and whether it is there."""
    if not len(hot[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    slot = np.minimum(np.searchsorted(hot[0], keys), len(hot[0]) - 1)
    return slot, hot[0][slot] == keys


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    hot = shared.value
    for batch in batches:
        keys, counts, sizes = _lists(batch)
        slot, known = _slots(hot, keys)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        if known.any():
            np.add.at(best, row[known], counts[known] * hot[2][slot[known]])
            np.add.at(total, row[known], counts[known] * hot[1][slot[known]])
        yield pa.RecordBatch.from_arrays(
            [*[batch[c] for c in ("row", "doc_id", *_COUNTS, "groups_sha256")], pa.array(best), pa.array(total)],
            names=["row", "doc_id", *_COUNTS, "groups_sha256", "n_best", "count_sum"],
        )


def _unknown(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    hot = shared.value
    for batch in batches:
        keys, counts, sizes = _lists(batch)
        _, known = _slots(hot, keys)
        row = np.repeat(batch["row"].to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(x[~known]) for x in (row, keys, counts)], names=["row", "key", "c"])


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(key, n, best): links of each id pair in the corpus, and whether no other pair of its B id has more."""
    counted = aligned.select("keys", "counts").mapInArrow(_tally, "key long, n long")
    counted = materialise(counted.groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    own = F.col("key") % b_size
    most = counted.groupBy(own.alias("b")).agg(F.max("n").alias("most"))  # at most one row per id of B
    met = counted.join(F.broadcast(most), own == most["b"])
    return materialise(met.select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-counts")


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str | None] | None = None, hot: int = HOT
) -> DataFrame:
    """For every row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``files``: a byte-level BPE of the tokenizers library, a sentencepiece model, and the first one's ranks or None; the
    files must be at the same place on every executor. Null and empty texts, and texts that one of the two changes, have
    no tokens: zeros and ''. A repeated row is counted each time; a null doc_id is carried along.
    """
    spark = docs.sparkSession
    files = files or default_files()
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=files[1]).get_piece_size()
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, keys array<long>, counts array<int>"
    found = id_and_text(docs, id_col, text_col).mapInArrow(lambda b: _aligned(b, files), schema)
    aligned = materialise(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = pair_counts(aligned, b_size)
    sizes = sorted(pairs.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True)  # at most 64 rows
    least, taken = 64, 0
    for power, n in sizes:
        if taken + n > hot:
            break
        least, taken = power, taken + n
    often = F.floor(F.log2("n")) >= least
    table = pairs.where(often).toArrow().sort_by("key")  # at most ``hot`` rows
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("key", "n", "best")))
    names = ("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
    scored = aligned.mapInArrow(
        lambda b: _scored(b, shared),
        "row long, doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, n_best long, count_sum long",
    )
    if taken == sum(n for _, n in sizes):
        return scored.select(*names)
    rest = aligned.select("row", "keys", "counts").mapInArrow(lambda b: _unknown(b, shared), "row long, key long, c long")
    more = rest.join(pairs.where(~often).hint("merge"), "key").groupBy("row").agg(
        F.sum(F.col("c") * F.col("best")).alias("more_best"), F.sum(F.col("c") * F.col("n")).alias("more_sum")
    )
    met = scored.join(materialise(more, "rare-pairs").hint("merge"), "row", "left")
    return met.withColumns(
        {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    ).select(*names)
