import io
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm.conftest import HARD
from rillmeter.llm import packing, token_store
from rillmeter.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_batches_equal_the_library(library):
    rng = random.Random(3)
    texts = [t or "" for _, t, *_ in HARD] + ["don't they're 's's ''s !!'s 'l 'll' 12'3 it's'", "Ünï ÇÃ×÷ ß ÿ µm ª ¿que? «hé»", "x\x0by\x85z\xa0q", "a<|endoftext|>b"]
    texts += ["".join(rng.choice("'streveldm x1!é\nÀ\t<|") for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    ids, at = Encoder.of(default_tokenizer()).encode(texts)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(library, text).tolist(), text[:50]


def test_another_tokenizer_file_is_left_to_the_library(tmp_path):
    file = json.loads(Tokenizer.from_file(default_tokenizer()).to_str())
    assert Encoder.of(default_tokenizer()).understood
    texts = ["Hello World, THE End 123", "don't", "a  b<x>c", ""]
    for n, change in enumerate(({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
                                {"added_tokens": [*file["added_tokens"], {**file["added_tokens"][0], "id": 49408, "content": "<x>"}]})):
        path = str(tmp_path / f"{n}.json")
        with open(path, "w") as out:
            json.dump(file | change, out)
        ids, at = Encoder.of(path).encode(texts)
        library = Tokenizer.from_file(path)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [ids_of(library, t).tolist() for t in texts]


def test_a_key_is_read_without_its_shard():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.choice(1 << 40, 20_000, replace=False))
    begin = np.concatenate([[0], np.cumsum(rng.integers(1, 200, len(keys)))])
    ids = rng.integers(0, 49_000, begin[-1])
    data = token_store.Shard.pack(keys, np.zeros(len(keys), bool), ids, begin)
    for k in rng.integers(0, len(keys), 200):
        shard = token_store.ShardFile(io.BytesIO(data))
        (found,) = shard.documents(int(keys[k]))
        assert found.tolist() == ids[begin[k] : begin[k + 1]].tolist()
        assert shard.bytes_read == 48 + 8 + 3 * 4 + 2 * 8 + 2 * len(found)
    assert not any(token_store.ShardFile(io.BytesIO(data)).documents(int(k)) for k in range(50) if k not in keys)


def test_pieces_are_powers_of_two_and_cover_each_document(hard, nothing, library):
    rows = packing.pack(hard, limit=256).collect()
    pieces = defaultdict(list)
    for r in rows:
        assert r["length"] in (1, 2, 4, 8, 16, 32, 64, 128, 256) and len(r["ids"]) == 4 * r["length"] and r["offset"] == 0
        assert r["sequence_id"] >> packing.BUCKET_SHIFT == int(r["length"]).bit_length() - 1
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    want = Counter((i, ids_of(library, t).tobytes()) for i, t, *_ in HARD)
    for (i, payload), times in want.items():
        parts = Counter(pieces[i, len(payload) // 4])
        assert all(payload[4 * s : 4 * s + len(p)] == p or times < n for (s, p), n in parts.items())
        assert sum(len(p) for _, p in parts.elements()) % len(payload) == 0
    assert sum(r["length"] for r in rows) == sum(len(p) // 4 * n for (_, p), n in want.items())
    assert packing.pack(nothing).count() == 0


def test_perfect_hash_uses_every_slot_once():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        displacement, slot = token_store.perfect_hash(keys)
        assert sorted(slot.tolist()) == list(range(len(keys)))
        shard = token_store.Shard(token_store.Shard.pack(keys, np.zeros(len(keys), bool), np.arange(len(keys)), np.arange(len(keys) + 1)))
        first, number = shard.find(keys)
        assert first.tolist() == list(range(len(keys))) and set(number.tolist()) == {1}
        assert shard.find(keys + 1)[1][~np.isin(keys + 1, keys)].sum() == 0


def test_store_is_an_exact_round_trip(hard, nothing, library):
    manifest = token_store.write_tokens(hard, shard_tokens=50)
    got = token_store.read_tokens(manifest).orderBy("start").collect()
    want = Counter((i, len(x := ids_of(library, t)), zlib.crc32(x.tobytes())) for i, t, *_ in HARD)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and [r["doc_id"] for r in got][:2] == [None, None]
    found = Counter((r["doc_id"], r["ids"]) for r in token_store.lookup(manifest, [5, 9, 77]).collect())
    assert found == Counter((i, ids_of(library, t).tobytes()) for i, t, *_ in HARD if i in (5, 9))
    assert token_store.read_tokens(token_store.write_tokens(nothing)).count() == 0
