"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of every text.

Texts and items are normalised byte for byte (A-Z lower-cased, every other ASCII byte that is no letter or
digit a blank), words are joined by single blanks, and the automaton holds every window of ``window`` item
words with a blank at both ends, so matches begin and end at words. Positions of hit words lead back to code
points of the original text.

An automaton is built once per Python worker from a broadcast list of windows. The list's size is checked
first: items beyond ``max_item_bytes`` are dealt into shards, which are scanned one after another, each
carrying on what the earlier ones found. Only one shard's items and windows are on the driver at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import col, id_and_text
from rillmeter.session import materialise

WINDOW = 10
#: Most item text one automaton is built from; it needs about 300 bytes per byte of it.
MAX_ITEM_BYTES = 1 << 20

NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

STATE = "doc_id long, text string, items array<string>, first array<int>, last array<int>"
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: str | bytes) -> list[bytes]:
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).translate(NORMAL).split()


def windows_of(items: list[tuple[str, str]], window: int = WINDOW) -> dict[bytes, tuple[int, list[str]]]:
    """Every window (joined by blanks) with its number of words and the items it occurs in."""
    found: dict[bytes, tuple[int, list[str]]] = {}
    for item, text in items:
        words = words_of(text or "")
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            of = found.setdefault(b" ".join(words[i : i + length]), (length, []))[1]
            if not of or of[-1] != item:
                of.append(item)
    return found


def _automaton(token: str, windows) -> ahocorasick.Automaton:
    if token not in _built:
        _built.clear()
        built = ahocorasick.Automaton()
        for text, (length, items) in windows.value.items():
            built.add_word(f" {text.decode('latin-1')} ", (length, items))
        if len(built):
            built.make_automaton()
        _built[token] = built
    return _built[token]


def _hits(line: bytes, automaton) -> tuple[set, list[int], list[int]]:
    """Items, first and last hit words of a normalised text with a blank at both ends."""
    matches = list(automaton.iter(line.decode("latin-1"))) if len(automaton) else []
    if not matches:
        return set(), [], []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(blanks, [end for end, _ in matches]) - 1
    first = last - np.array([length for _, (length, _) in matches]) + 1
    return {i for _, (_, items) in matches for i in items}, first.tolist(), last.tolist()


def _covered(n: int, first: list[int], last: list[int]) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, np.asarray(first, np.int64), 1)
    np.add.at(depth, np.asarray(last, np.int64) + 1, -1)
    return np.cumsum(depth[:-1]) > 0


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(points[begins[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(runs[::2], runs[1::2])]


def _scan(batches: Iterator[pa.RecordBatch], token: str, windows, begin: bool, finish: bool) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(token, windows)
    for batch in batches:
        rows: dict[str, list] = {name: [] for name in ("items", "first", "last", "n_words", "n_hit", "spans")}
        for k, scalar in enumerate(batch["text"]):
            text = scalar.as_py()
            words = words_of(text)
            items, first, last = _hits(b" %s " % b" ".join(words), automaton) if words else (set(), [], [])
            if not begin:
                items |= set(batch["items"][k].as_py())
                first, last = batch["first"][k].as_py() + first, batch["last"][k].as_py() + last
            rows["items"].append(sorted(items))
            if finish:
                hit = _covered(len(words), first, last) if first else np.zeros(0, bool)
                rows["n_words"].append(len(words))
                rows["n_hit"].append(int(hit.sum()))
                rows["spans"].append(_spans(text, hit) if first else [])
            else:
                rows["first"].append(first)
                rows["last"].append(last)
        ids, items = batch["doc_id"], pa.array(rows["items"], pa.list_(pa.string()))
        if finish:
            spans = pa.array(rows["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_hit"], pa.int64()), items, spans],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )
        else:
            places = [pa.array(rows[c], pa.list_(pa.int32())) for c in ("first", "last")]
            yield pa.RecordBatch.from_arrays([ids, batch["text"], items, *places], names=["doc_id", "text", "items", "first", "last"])


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_item_bytes: int) -> Iterator[tuple[str, object, bool]]:
    """Token, broadcast windows and whether they are the last, one shard at a time; only that shard's items are on the driver."""
    items = benchmark.select(col(item_col).cast("string").alias("item_id"), col(text_col).cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    shards = -(-size // max_item_bytes) or 1
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).distinct().collect()
        windows = windows_of([(r[0], r[1]) for r in part], window)
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(windows), k == shards - 1


def contaminated_words(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit, items (sorted as strings), spans (code points, end exclusive).

    A document word inside any occurrence of a window is hit; an item of fewer than ``window`` words, but not
    none, is one window. Null and empty texts have no words; items without words, text or id have no window;
    repeated items count once. An empty table on either side gives no hits.
    """
    state, begin = id_and_text(docs, id_col, text_col), True
    for token, windows, last in _shards(benchmark, item_col, item_text_col, window, max_item_bytes):
        if last:
            return state.mapInArrow((lambda t, w, b: lambda batches: _scan(batches, t, w, b, True))(token, windows, begin), RESULT)
        step = (lambda t, w, b: lambda batches: _scan(batches, t, w, b, False))(token, windows, begin)
        state, begin = materialise(state.mapInArrow(step, STATE), "scanned"), False
        windows.destroy()  # what it found is stored, and no later stage reads it


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.0, **options
) -> DataFrame:
    """The rows of ``docs``, all columns, with at most ``max_share`` of their words hit.

    A document that is dropped takes all rows that repeat its doc_id along; rows without doc_id stay.
    """
    found = contaminated_words(docs, benchmark, id_col, text_col, **options)
    gone = materialise(found.where(F.col("n_hit") > max_share * F.col("n_words")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, col(id_col).cast("long") == gone["__gone"], "left_anti")
