"""Near-dedup by HyperMinHash registers, banding and an exact check of full shingle sets.

A shingle's fingerprint chooses one of 128 buckets with its first 7 bits. Of the smallest rest in a bucket a
register keeps the count of leading zeros and ten bits after them: 128 registers of two bytes per document.

1. Documents with equal shingle sets are one class; from here on one row stands for a class.
2. Registers are cut into bands. Documents of a band bucket are each paired with the bucket's first member
   only, so a bucket of m gives m - 1 pairs; in a bucket of at most ``SMALL`` all are paired with each other. Pairs are dropped when the sizes rule out the threshold or when
   the collision-corrected estimate is below ``cut`` (the threshold less ``SIGMAS`` standard errors); the rest
   are confirmed on full sets, and links make components.
3. Larger buckets whose members but the first are still of several components may hide links between those. They
   are joined exactly, by prefixes: two sets that reach the threshold share a shingle among the first
   ``n - ceil(t * n) + 1`` of each, in any fixed order, and its places there and the parities of
   256 cells bound what they share. Rare shingles come first (by a counting table of fixed
   size), so passages and lines that many documents share are in no prefix. Only pairs between different
   components are formed and confirmed. Where a shingle's members are of many components (a large group of near
   copies, few of which reach the threshold with the bucket's first member), they first meet one member
   a round, the one with fewest changes, and components are merged before the rest is joined.

What can be missed is a linked pair of larger sets that shares no band bucket at all; see ``BANDS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import col, id_and_text
from rillmeter.llm.components import components
from rillmeter.llm.wordhash import mix, shingle_sets
from rillmeter.session import materialise

REGISTERS = 128
MANTISSA = 10
_REST = 57
#: (smallest set, largest set, bands). Small sets fill few registers, so they get wider bands. Classes overlap
#: by a quarter: a linked pair is in one class together. With 32 bands of 4 registers a pair at 0.8 shares no
#: bucket with probability (1 - 0.8**4)**32 = 5e-8. Below 72 shingles fewer shingles differ than there are bands; sets of
#: 72 to 79 may differ in 16 shingles, which touch all 16 bands with probability 16!/16**16 = 1e-6.
#: Small sets may share no filled band. Those that can be linked with a set of fewer than ``FEW`` shingles also have a
#: bucket for each of their first shingles, as in step 3, so that none of their links is missed.
BANDS = ((1, 20, 8), (13, 80, 16), (52, 1 << 62, 32))
FEW = 20
SIGMAS = 6
#: Most members of a bucket that are all paired, which gives fewer than half as many pairs a row.
SMALL = 8
#: Counters that order shingles by frequency: 4 MB, whatever the corpus holds.
COUNTERS = 1 << 20
PARITIES = ("p0", "p1", "p2", "p3")
#: A token is crowded if its members are of more components than this; most rounds of leaders before what is left is
#: joined as it is.
CROWD, ROUNDS = 64, 8


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers of one sorted set of fingerprints; 0 marks an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(_REST)).astype(np.int64)
        first = np.ones(len(bucket), bool)
        first[1:] = bucket[1:] != bucket[:-1]
        rest = (shingles[first] & np.uint64((1 << _REST) - 1)).astype(np.float64) + 1
        fraction, exponent = np.frexp(rest)
        zeros = (_REST + 1 - exponent).astype(np.uint16)
        tail = np.minimum((fraction * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
        out[bucket[first]] = (zeros << MANTISSA | tail) + 1
    return out


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers that two disjoint sets of these sizes have equal by chance.

    The smallest of k uniform values lies in a cell of width w at x with probability about k * w * exp(-k * x);
    a count of leading zeros z fixes x up to a factor of two, the mantissa splits that range into equal cells.
    """
    z = np.arange(1, _REST + 1)
    a, b = np.asarray(n, float)[:, None] / REGISTERS, np.asarray(m, float)[:, None] / REGISTERS
    low, high = 0.5**z, 0.5 ** (z - 1)
    pa_, pb = np.exp(-a * low) - np.exp(-a * high), np.exp(-b * low) - np.exp(-b * high)
    return (pa_ * pb).sum(1) / (1 << MANTISSA)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows ``x`` and ``y`` of sets of sizes n and m, and registers in use."""
    used = ((x > 0) | (y > 0)).sum(1)
    equal = ((x == y) & (x > 0)).sum(1)
    filled = np.maximum(used, 1)
    chance = np.minimum(chance_matches(n, m) * REGISTERS / filled, 0.99)
    return np.clip((equal / filled - chance) / (1 - chance), 0, 1), used


def _band_keys(regs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and bucket keys of all filled bands of a block of documents."""
    rows, keys = [], []
    for kind, (low, high, bands) in enumerate(BANDS):
        at = np.flatnonzero((n >= low) & (n < high))
        parts = regs[at].reshape(len(at), bands, REGISTERS // bands)
        key = np.full((len(at), bands), kind + 1, np.uint64) * np.uint64(1 << 32) + np.arange(bands, dtype=np.uint64)
        for k in range(parts.shape[2]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k].astype(np.uint64))
        filled = parts.any(2)
        rows.append(np.broadcast_to(at[:, None], filled.shape)[filled])
        keys.append(key[filled])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def heads(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The least shingles of a small sorted set, one of which every set that reaches the threshold has among its own."""
    n = len(shingles)
    return shingles[: n - -(-percent * n // 100) + 1] if n and percent * n < 100 * FEW else shingles[:0]


def _sketch(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            n, h1, h2, regs, least = [], [], [], [], []
            for found in shingle_sets(part["text"], words):
                n.append(len(found))
                h1.append(mix(found + np.uint64(11)).sum(dtype=np.uint64))
                h2.append(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                regs.append(registers(found).tobytes())
                least.append(heads(found, percent).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).astype(np.int64)),
                 pa.array(np.array(h2, np.uint64).astype(np.int64)), pa.array(regs, pa.binary()), pa.array(least, pa.binary())],
                names=["doc_id", "n", "h1", "h2", "regs", "heads"],
            )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        n = batch["n"].to_numpy()
        rows, keys = _band_keys(regs, n)
        first = batch["heads"].to_pylist()
        rows = np.concatenate([rows, np.repeat(np.arange(len(first)), [len(x) // 8 for x in first])])
        keys = np.concatenate([keys, mix(np.frombuffer(b"".join(first), np.uint64) ^ np.uint64(0xA24BAED4963EE407)).astype(np.int64)])
        ids = batch["id"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[rows]), pa.array(n[rows])], names=["key", "id", "n"])


def _probable(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        share, used = estimate(x, y, batch["na"].to_numpy(), batch["nb"].to_numpy())
        keep = share >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"])):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [s.tobytes() for s in shingle_sets(part["text"], words)]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(sets, pa.binary())], names=["id", "shingles"])


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        found = np.frombuffer(b"".join(batch["shingles"].to_pylist()), np.uint64)
        slots, n = np.unique((found & np.uint64(size - 1)).astype(np.int64), return_counts=True)
        total[slots] += n
    at = np.flatnonzero(total)
    for start in range(0, len(at), 50_000):
        some = at[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, one of which every set that reaches the threshold has in its own prefix.

    Order: fewest counted first, then by value. ``counts`` may be any table: the order is the same for all.
    """
    n = len(shingles)
    length = n - -(-percent * n // 100) + 1
    often = counts[(shingles & np.uint64(len(counts) - 1)).astype(np.int64)]
    return shingles[np.lexsort((shingles, often))[:length]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 256 cells. Two sets' parities differ in at most as many cells as
    the sets differ in shingles."""
    odd = np.bincount((mix(shingles) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], counts, percent: int) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in batches:
        for i in range(batch.num_rows):
            found = np.frombuffer(batch["shingles"][i].as_py(), np.uint64)
            some = prefix(found, table, percent).astype(np.int64)
            often = table[(found & np.uint64(len(table) - 1)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *[pa.array(np.full(len(some), batch[c][i].as_py(), np.int64)) for c in ("id", "component")],
                 pa.array(np.full(len(some), len(found), np.int64)), pa.array(np.arange(len(some))),
                 *[pa.array(np.full(len(some), x, np.int64)) for x in parities(found)],
                 pa.array(np.full(len(some), np.log(np.maximum(often, 1)).mean()))],
                names=["token", "id", "component", "n", "at", *PARITIES, "common"],
            )


def _texts_of(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    wanted = texts.select(F.col("doc_id").alias("id"), "text").join(ids.select("id").distinct().hint("merge"), "id", "left_semi")
    return wanted.mapInArrow(lambda b: _full_sets(b, words), "id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")  # both sides grow with the corpus
    return met.mapInArrow(lambda b: _linked(b, percent), "a long, b long")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, counters: int = COUNTERS
) -> DataFrame:
    """For every row of ``docs``: doc_id, n_shingles, component_id, kept.

    Shingles are runs of ``words`` lower-cased words; sets with 100 * intersection >= ``percent`` * union are
    linked. A text with fewer words is one shingle; null and empty texts have no shingles and are linked with
    nothing. Rows that repeat a doc_id count as one node, so they share links; each row keeps its own
    n_shingles. A null doc_id is never linked: its component is null and it is kept.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    rows = materialise(
        texts.mapInArrow(lambda b: _sketch(b, words, percent), "doc_id long, n long, h1 long, h2 long, regs binary, heads binary"), "sketches"
    )
    by_set = ["h1", "h2", "n"]
    first = rows.where("n > 0 and doc_id is not null").groupBy(*by_set).agg(F.min("doc_id").alias("id"))
    classes = materialise(
        first.join(
            rows.select(F.col("doc_id").alias("id"), *by_set, "regs", "heads").distinct(), ["id", *by_set]
        ).select("id", *by_set, "regs", "heads"),
        "classes",
    )
    banded = classes.select("id", "n", "regs", "heads").mapInArrow(_banded, "key long, id long, n long")
    # Here and below, what is grouped by a key is stored before rows are joined back to it: adaptive execution can
    # split a hot key only where both sides of the join come straight from a shuffle.
    leaders = banded.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    leaders = materialise(leaders, "leaders")
    members = materialise(banded.join(leaders.hint("merge"), "key"), "members")

    sizes = materialise(classes.groupBy("id").agg(F.max("n").alias("n")), "sizes")
    close = f"100 * least(n, nb) >= {percent} * greatest(n, nb)"
    few = members.where(f"m between 3 and {SMALL} and id <> leader")  # with the leader they are paired below
    among = (
        few.select("key", F.col("id").alias("a"), "n").hint("merge")
        .join(few.select("key", F.col("id").alias("b"), F.col("n").alias("nb")), "key").where(f"a > b and {close}").select("a", "b")
    )
    star = (
        members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"), "n").distinct()
        .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")).hint("merge"), "b").where(close).select("a", "b")
    ).union(among).distinct()
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    probable = materialise(
        star.join(left, "a").join(right, "b").mapInArrow(lambda b: _probable(b, percent / 100), "a long, b long").distinct(),
        "probable",
    )
    crowds = members.where(f"m > {SMALL} and id <> leader").select("key", "id")
    wanted = crowds.select("id").union(probable.select("a")).union(probable.select("b"))
    sets = materialise(_texts_of(texts, wanted, words), "sets")  # the only time that texts are shuffled
    links = materialise(_confirmed(probable, sets, percent), "star-links")
    found = materialise(components(links), "components")

    labelled = crowds.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    open_keys = materialise(open_keys, "open-keys")
    rest = materialise(labelled.join(open_keys.hint("merge"), "key", "left_semi").select("id", "component").distinct(), "rest")
    more = _prefix_links(spark, sets, rest, percent, counters)
    merged = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    final = materialise(components(merged), "components")

    named = first.join(final.select(F.col("node").alias("id"), "component"), "id", "left").select(
        *by_set, F.coalesce("component", "id").alias("component")
    )
    named = materialise(named, "named")
    own = F.coalesce("component", "doc_id")
    return rows.join(named.hint("merge"), by_set, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.when(F.col("doc_id").isNull(), True).otherwise(own == F.col("doc_id")).alias("kept"),
    )


def _prefix_links(spark, sets: DataFrame, rest: DataFrame, percent: int, counters: int) -> DataFrame:
    """Links between different components of ``rest`` (id, component), found by an exact prefix join."""
    counted = sets.select("shingles").mapInArrow(lambda b: _counted(b, counters), "slot long, n long")
    found = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most ``counters`` rows
    table = np.zeros(counters, np.int32)
    table[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.int32).max)
    shared = spark.sparkContext.broadcast(table)
    schema = "token long, id long, component long, n long, at long, " + ", ".join(f"{p} long" for p in PARITIES) + ", common double"
    tokens = materialise(sets.join(rest, "id").mapInArrow(lambda b: _prefixes(b, shared, percent), schema).distinct(), "prefixes")
    met, links = _open_tokens(tokens), []
    for _ in range(ROUNDS):
        large = _crowded(met)
        if not large.head(1):
            break
        met, found = _led(met, large, sets, percent)
        links.append(found.select("a", "b"))
        if not found.head(1):  # the leaders are apart from all others
            break
    other = met.select("token", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("bt"), *[F.col(p).alias(f"b{p}") for p in PARITIES])
    pairs = met.join(other, "token").where(f"component < cb and {_close(percent)}").select(F.col("id").alias("a"), "b").distinct()
    return reduce(DataFrame.union, links, _confirmed(pairs, sets, percent))


def _close(percent: int) -> str:
    """Whether two rows of a token can reach the threshold. Before a pair's first common shingle nothing is shared, so at
    most min(n - at, nb - bt) shingles are. A pair that reaches it differs in at most (100 - t) / (100 + t) of (n + nb) shingles."""
    differ = " + ".join(f"bit_count({p} ^ b{p})" for p in PARITIES)
    return (
        f"{100 + percent} * least(n - at, nb - bt) >= {percent} * (n + nb) and {100 + percent} * ({differ}) <= {100 - percent} * (n + nb)"
    )


def _open_tokens(tokens: DataFrame) -> DataFrame:
    """Rows of the tokens that still hold several components."""
    several = tokens.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    return materialise(tokens.join(materialise(several, "several").hint("merge"), "token", "left_semi"), "met")


def _crowded(met: DataFrame) -> DataFrame:
    """Tokens with more than CROWD components. In any other, a row has fewer partners than CROWD times the token's rows."""
    by = met.select("token", "component").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    return materialise(by.where(f"c > {CROWD}").select("token"), "crowded")


def _led(met: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """A round: in each crowded token all members meet one of them, the one with the most common shingles, which of a
    group of near copies is the one with fewest changes. Returns the rows that have still not met and the links found.

    A component that is linked with a leader's takes its name. Names are equal only within a component, so no pair is
    left out for them; that some of a component may keep two names costs pairs, not links.
    """
    # Stored, so that the join can be split at a hot token and the leader is chosen from partial maxima, not from whole tokens in one task.
    crowd = materialise(met.join(large.hint("merge"), "token", "left_semi"), "crowd")
    row = F.struct(F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("bt"), *[F.col(p).alias(f"b{p}") for p in PARITIES])
    leader = crowd.groupBy("token").agg(F.max_by(row, F.struct("common", -F.col("id"))).alias("l")).select("token", "l.*")
    leader = materialise(leader, "token-leaders")
    beside = met.join(leader.hint("merge"), "token", "left")
    pairs = beside.where(f"b is not null and component <> cb and {_close(percent)}").select(F.col("id").alias("a"), "b", "component", "cb").distinct()
    pairs = materialise(pairs, "led-pairs")
    found = materialise(_confirmed(pairs.select("a", "b").distinct(), sets, percent).join(pairs, ["a", "b"]), "led-links")
    named = materialise(found.groupBy("component").agg(F.min("cb").alias("new")), "led-names")
    left = beside.where("b is null or id <> b").select(*met.columns).join(named.hint("merge"), "component", "left")
    return _open_tokens(left.withColumn("component", F.coalesce("new", "component")).select(*met.columns)), found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the smallest of its component."""
    gone = materialise(near_dedup(docs, id_col, text_col, words, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, col(id_col).cast("long") == gone["__gone"], "left_anti")
