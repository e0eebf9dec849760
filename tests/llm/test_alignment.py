import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rillmeter.llm import alignment
from rillmeter.llm.alignment import Pair, align, align_tokenizers, default_files, lockstep
from rillmeter.llm.queries import QUERIES


@pytest.fixture(scope="module")
def pair():
    return Pair.of(default_files())


def entry(vocabulary, i):
    return bytes(vocabulary.flat[vocabulary.at[i] : vocabulary.at[i] + vocabulary.length[i]])


def brute(pair, text):
    """n_a, n_b, groups, links (pairs of ids) of one text, by the definition."""
    if not text:
        return 0, 0, [], []
    a, b = pair.library.encode(" " + text, add_special_tokens=False).ids, pair.pieces.encode(text)
    bytes_a, bytes_b = [entry(pair.a, i) for i in a], [entry(pair.b, i) for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return 0, 0, [], []
    at_a, at_b = (np.concatenate([[0], np.cumsum([len(x) for x in entries])]).tolist() for entries in (bytes_a, bytes_b))
    links, j = [], 0
    for i in range(len(a)):
        while at_b[j + 1] <= at_a[i]:
            j += 1
        k = j
        while k < len(b) and at_b[k] < at_a[i + 1]:
            links.append((a[i], b[k]))
            k += 1
    groups, i, j = [], 0, 0
    for cut in sorted(set(at_a[1:]) & set(at_b[1:])):
        x, y = at_a.index(cut, i), at_b.index(cut, j)
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return len(a), len(b), groups, links


def brute_rows(pair, rows):
    done = [(i, *brute(pair, t)) for i, t in rows]
    counts = Counter(link for *_, links in done for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for i, n_a, n_b, groups, links in done
    ]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


ODD = ["", "a", " ", "  ", "▁x", "日本語 テスト \U0001d11e é́", "\x00 a", "<|endoftext|> <s> <unk> <0x41> don't", "a" * 5000, " " * 5000, "\n\n\t x " * 500, "ﬁ é  x"]


def test_texts_equal_brute_force(pair, documents):
    texts = ODD + [r[0] for r in documents.limit(60).select("text").collect()]
    found = align(pair, pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        n_a, n_b, groups, links = brute(pair, text)
        assert (found["n_a"][i], found["n_b"][i], found["n_groups"][i], found["n_links"][i]) == (n_a, n_b, len(groups), len(links)), text[:40]
        assert found["groups_sha256"][i] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        keys = slice(found["offsets"][i], found["offsets"][i + 1])
        assert dict(zip(found["keys"][keys], found["counts"][keys])) == Counter(x * pair.b.size + y for x, y in links)


@pytest.mark.parametrize("lane", [1, 3, 7, 64, 10_000])
def test_lockstep_on_random_cuts(lane):
    """Stretches of any length give the links of a plain merge, once each."""
    r = np.random.default_rng(lane)
    sizes = r.integers(1, 200, 20)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = [np.unique(np.concatenate([starts[1:], r.integers(1, starts[-1], n)])) for n in (300, 500)]
    a, b, cut_a, cut_b = lockstep(*ends, starts, lane)
    begin = [np.concatenate([[0], e[:-1]]) for e in ends]
    want = [
        (i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
        if begin[0][i] < ends[1][j] and begin[1][j] < ends[0][i]
    ]
    assert list(zip(a.tolist(), b.tolist())) == want
    both = set(ends[0].tolist()) & set(ends[1].tolist())
    assert cut_a.tolist() == [e in both for e in ends[0].tolist()] and cut_b.tolist() == [e in both for e in ends[1].tolist()]


def test_ranks_equal_the_library(pair, documents):
    """The faster reader is used only where it gives the library's ids."""
    r = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x180) if chr(c).isprintable()] + list("\n\t\r '' ’s t1")
    texts = ["".join(r.choice(letters, 300)) for _ in range(200)] + ["  ".join(r.choice(letters, 100)) for _ in range(50)]
    texts += [r[0] for r in documents.limit(100).select("text").collect()]
    assert pair.encode_a(texts) == [pair.library.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_hard_rows(pair, spark, hard, nothing):
    from llm.conftest import HARD

    got = align_tokenizers(hard)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(brute_rows(pair, [(r[0], r[1]) for r in HARD]))
    assert align_tokenizers(nothing).collect() == []


def test_rare_pairs_are_joined(pair, spark, documents, monkeypatch):
    """With a small table of frequent pairs the others meet their counts in a join: same rows."""
    monkeypatch.setattr(alignment, "HELD", 1000)
    some = documents.where("doc_id < 60")
    want = ordered(brute_rows(pair, [(r["doc_id"], r["text"]) for r in some.collect()]))
    for hot in (0, 50, 1 << 19):
        assert ordered(align_tokenizers(some, hot=hot).collect()) == want
    assert ordered(align_tokenizers(some, files=(*default_files()[:2], None)).collect()) == want


def test_query(spark, sf_dir, documents):
    assert QUERIES["op13_alignment"](spark, sf_dir).count() == documents.count()
