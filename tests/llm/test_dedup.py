import hashlib
import random
import re
from collections import Counter, defaultdict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rillmeter.llm import exact_dedup as ed
from rillmeter.llm import hyperminhash as hm
from rillmeter.llm.components import components
from llm.conftest import HARD


def test_pieces_combine_by_shifted_length():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé\x00") for _ in range(n)) for n in (0, 1, 5, 1023, 1024, 1025, 5000)]
    for prime in (ed.PRIME, 97):
        got = ed.hash_pieces(pa.array(texts), prime)
        for text, row in zip(texts, got):
            for base, value in zip(ed.BASES, row):
                want = 0
                for b in text.encode():
                    want = (want * base + b + 1) % prime
                assert value == want


def check_groups(rows, got):
    texts = [t or "" for _, t, *_ in rows]
    groups = Counter(texts)
    keep = defaultdict(list)
    for (i, _, *_), t in zip(rows, texts):
        keep[t].append(-1 if i is None else i)
    want = Counter(
        (i, None if max(keep[t]) < 0 else max(keep[t]), groups[t], hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(rows, texts)
    )
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_on_hard_rows_and_with_colliding_fingerprints(hard, nothing):
    check_groups(HARD, ed.exact_dedup(hard).collect())
    check_groups(HARD, ed.exact_dedup(hard, segment=1000).collect())
    check_groups(HARD, ed.exact_dedup(hard, prime=2).collect())  # nearly every fingerprint collides
    assert ed.exact_dedup(nothing).count() == 0


def test_kept_rows_keep_their_columns(hard, nothing):
    kept = ed.keep_one(hard)
    assert kept.columns == hard.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({t or "": 1 for _, t, *_ in HARD})
    assert ed.keep_one(nothing).count() == 0


def test_clashing_columns_and_ties(spark):
    rows = [(1, "same", "a", 1), (1, "same", "b", 2), (1, "same", "b", 2), (2, "other", None, None), (None, "other", "c", 5), (None, None, "d", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __Held int")
    kept = [{tuple(r) for r in ed.keep_one(d).collect()} for d in (docs, docs.orderBy(docs["__key"].desc()), docs.repartition(5, "__key"))]
    assert ed.keep_one(docs).columns == docs.columns and kept[0] == kept[1] == kept[2]
    assert sorted(k[:2] for k in kept[0] if k[0]) == [(1, "same"), (2, "other")] and kept[0] <= set(rows)
    odd = docs.withColumnRenamed("doc_id", "doc `id")
    assert hm.keep_one(odd, id_col="doc `id").columns == odd.columns


@contextmanager
def small_skew(spark):
    """Partitions of a kilobyte count as skewed and are not put together."""
    lowered = {
        "skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "1.3", "advisoryPartitionSizeInBytes": "1k", "coalescePartitions.enabled": "false",
    }
    for name, value in lowered.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        yield
    finally:
        for name in lowered:
            spark.conf.unset(f"spark.sql.adaptive.{name}")


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_group_is_split_over_tasks(spark):
    text = F.when(F.col("id") % 3 > 0, "one very common text of more than four words").otherwise(F.concat(F.lit("text number "), "id", F.lit(" of its own kind")))
    docs = spark.range(0, 9000, 1, 8).select(F.col("id").alias("doc_id"), text.alias("text"))
    with small_skew(spark):
        rows, plan = executed(ed.exact_dedup(docs))
        assert "skew=true" in plan
        assert sum(r["kept"] for r in rows) == 3001 and max(r["group_size"] for r in rows) == 6000
        rows, plan = executed(hm.near_dedup(docs, words=4))
        assert "skew=true" in plan
        assert Counter(r["component_id"] for r in rows)[1] == 6000


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute_components(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return [(i, len(s), None if i is None else find(i) if s else i) for i, s in sets]


def near_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for n in (3, 4, 6, 9, 14, 25, 40, 70, 120, 300):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 22))):
                copy[rng.randrange(n)] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(copy).title()))
    line = " ".join(rng.choice(words) for _ in range(12))
    rows += [(1000 + k, f"{line} {' '.join(rng.choice(words) for _ in range(rng.randint(2, 20)))}") for k in range(60)]
    return rows


def test_near_dedup_equals_brute_force(spark):
    rows = near_rows()
    for words in (4, 5):
        got = hm.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, words, 80))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_all_links_of_very_short_texts_are_found(spark):
    rng = random.Random(7)
    rows = []
    for k in range(15_000):
        text = [f"w{rng.randrange(10**9)}" for _ in range(8)]
        rows += [(2 * k, " ".join(text[:7])), (2 * k + 1, " ".join(text))]
    sets = list(hm.shingle_sets(pa.array([t for _, t in rows]), 4))
    at, keys = hm._band_keys(np.array([hm.registers(s) for s in sets]), np.array([len(s) for s in sets]))
    by = defaultdict(set)
    for i, key in zip(at.tolist(), keys.tolist()):
        by[i].add(key)
    assert any(not by[i] & by[i + 1] for i in range(0, len(rows), 2))  # bands alone miss some
    got = hm.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i - i % 2) for i, _ in rows}


def test_near_dedup_on_hard_rows(hard, nothing):
    got = hm.near_dedup(hard, words=4).collect()
    order = lambda x: (x[0] or 0, x[1])
    sizes = sorted(((i, len(shingles(t, 4))) for i, t, *_ in HARD), key=order)
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=order) == sizes
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(4, 4), (5, 4), (7, 7), (8, 7), (None, None), (1, 1), (2, 2)} <= by and (8, 8) not in by
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert hm.keep_one(hard, words=4).columns == hard.columns
    assert hm.near_dedup(nothing).count() == 0


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    n = 20_000
    x, y = (np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
    share, _ = hm.estimate(hm.registers(x)[None], hm.registers(y)[None], np.array([n]), np.array([n]))
    assert share[0] < 0.02
    both = np.unique(np.concatenate([x, y[: n // 4]]))
    share, _ = hm.estimate(hm.registers(x)[None], hm.registers(both)[None], np.array([n]), np.array([len(both)]))
    assert abs(share[0] - 0.8) < 0.15


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)}


def test_crowds_of_near_copies_meet_leaders(spark, monkeypatch):
    """Copies of one text with a few changes each: most pairs lie around the threshold, few reach it with the first."""
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in r.choice(60, 1 + i % 3, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    want = {i: c for i, _, c in brute_components(rows, 5, 80)}
    assert len(set(want.values())) > 20
    for crowd, rounds in ((2, 8), (2, 1)):
        monkeypatch.setattr(hm, "CROWD", crowd)
        monkeypatch.setattr(hm, "ROUNDS", rounds)
        found = hm.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {x["doc_id"]: x["component_id"] for x in found.collect()} == want


def test_members_that_met_are_not_joined_again(spark, monkeypatch):
    """Buckets of two or three unlinked texts: all their pairs were tested, nothing is left for the prefix join."""
    r = random.Random(13)
    rows = []
    for k in range(120):
        base = [f"w{r.randrange(10**9)}" for _ in range(60)]
        for c in range(2 + k % 2):
            text = list(base)
            for at in r.sample(range(60), 3):
                text[at] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(text)))
    left = []
    whole = hm._prefix_links

    def counted(spark, sets, rest, *more):
        left.append(rest.count())
        return whole(spark, sets, rest, *more)

    monkeypatch.setattr(hm, "_prefix_links", counted)
    want = {i: c for i, _, c in brute_components(rows, 4, 80)}
    for small in (8, 0):  # with 0, only the leaders' pairs are tested before the prefix join
        monkeypatch.setattr(hm, "SMALL", small)
        found = hm.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=4)
        assert {x["doc_id"]: x["component_id"] for x in found.collect()} == want
    assert left[0] == 0 < left[1]
