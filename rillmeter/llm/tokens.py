"""Token ids of whole batches of texts, equal to those of the tokenizers library.

The library's pre-tokeniser cuts a text into pieces that are encoded apart from each other. For texts in Latin-1
without control characters the pieces are found with NumPy, and each distinct piece is given to the library's
model once per worker; the cache is keyed by a 64-bit fingerprint of the piece. Any other text goes to the library
as it is, and so do all texts where the tokenizer file has other rules than those known here.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from rillmeter.llm.wordhash import span_hashes

#: Id appended to every document.
END_ID = 1
#: Text bytes worked on at once, and pieces a worker remembers.
SLICE_BYTES = 4 << 20
REMEMBERED = 2_000_000

_BLANK, _LETTER, _DIGIT, _OTHER, _LIBRARY = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every Latin-1 character; what the two sides could see differently is _LIBRARY."""
    kind, lower = np.full(256, _LIBRARY, np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if c in "\t\n\r ":
            kind[b] = _BLANK
        elif c.isascii() and c.isprintable() or 0xC0 <= b or c in "¡¢£¤¥¦§©«¬®¯°±¶¿»":
            kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER
            if c.isupper():
                lower[b] = ord(c.lower())
    return kind, lower


def _spelling() -> dict[int, str]:
    """How byte-level BPE spells Latin-1 characters: one printable character for each UTF-8 byte."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    spelt = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(256)}


# The normaliser and pre-tokeniser that ``pieces`` stands for, as in a tokenizer file.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def understood(model: dict) -> bool:
    """Whether a tokenizer file cuts texts as ``pieces`` does; its own added tokens must all hold "<|"."""
    return {name: model[name] for name in RULES} == RULES and all("<|" in token["content"] for token in model["added_tokens"])


KIND, LOWER = _classes()
SPELT = _spelling()


def _at(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Characters at positions; 0 beyond the end."""
    return np.where(positions < len(data), data[np.minimum(positions, len(data) - 1)], 0)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces in lower-cased Latin-1 texts laid one after another.

    A piece is a run of letters, one digit, a run of other characters that are no blanks, or an apostrophe that
    begins such a run, with s, t, re, ve, m, ll or d after it.
    """
    kind = KIND[data]
    start = kind != _BLANK
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = kind[edges] != _BLANK
    text_end = np.zeros(len(data) + 1, bool)
    text_end[offsets[1:]] = True
    marks = np.flatnonzero((data == 39) & start)
    marks = marks[~text_end[marks + 1]] if len(marks) else marks
    if len(marks):
        one, two = _at(data, marks + 1), np.where(text_end[np.minimum(marks + 2, len(data))], 0, _at(data, marks + 2))
        short = np.isin(one, list(b"stmd"))
        long = ((two == ord("e")) & np.isin(one, list(b"rv"))) | ((one == ord("l")) & (two == ord("l")))
        for some, size in ((marks[short], 2), (marks[long & ~short], 3)):
            start[some + 1] = False
            after = some + size
            after = after[(after < len(data)) & ~text_end[np.minimum(after, len(data))]]
            start[after] |= kind[after] == _LETTER
    stop = kind != _BLANK
    stop[:-1] &= start[1:] | (kind[1:] == _BLANK) | text_end[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the given runs, one run after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Encoder:
    """Encodes batches with one tokenizer file; one per worker and path."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.loads(self.library.to_str())
        self.understood = understood(model)
        model |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.pieces = Tokenizer.from_str(json.dumps(model))  # the same model, for texts already cut
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.keys, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.length = np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = self.pieces.encode([t.translate(SPELT) for t in texts], is_pretokenized=True, add_special_tokens=False)
        length = np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts))
        at = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, np.array(found.ids, np.uint32)])
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.at = np.insert(self.keys, place, keys[order]), np.insert(self.at, place, at[order])
        self.length = np.insert(self.length, place, length[order])

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text, of Latin-1 texts."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends = pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pa.array(span_hashes(data, starts, ends)).dictionary_encode()
        keys, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        where = np.empty(len(keys), np.int64)
        where[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)  # the first place of each
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        slot = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(slot, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[starts[i] : ends[i]].decode("latin-1") for i in where[new]])
            slot = np.searchsorted(self.keys, keys)
        use = slot[inverse]
        lengths = self.length[use]
        ids = self.ids[ragged(self.at[use], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by END_ID, and where each text begins (one more entry)."""
        plain: list[bytes] = []
        which, rest = [], []
        for i, text in enumerate(texts):
            try:
                raw = text.encode("latin-1") if self.understood else b"<|"
                fits = b"<|" not in raw and not raw.translate(None, _KNOWN)
            except UnicodeEncodeError:
                fits = False
            if fits:
                plain.append(raw)
                which.append(i)
            else:
                rest.append(i)
        ids, counts = self._plain(plain)
        n = np.zeros(len(texts), np.int64)
        n[which] = counts
        other = {}
        for i in rest:
            other[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            n[i] = len(other[i])
        offsets = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(int(offsets[-1]), END_ID, np.uint32)
        out[ragged(offsets[:-1][which], counts)] = ids
        for i, found in other.items():
            out[offsets[i] : offsets[i] + n[i]] = found
        return out, offsets


_KNOWN = bytes(np.flatnonzero(KIND != _LIBRARY).astype(np.uint8))


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES):
    """Parts of a batch whose texts hold about ``size`` bytes (or are one text)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths):
        yield batch.slice(start)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
