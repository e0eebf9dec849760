"""Many k-means fits over one table, advancing together: a pass over the rows moves the centres of every fit.

A fit is a group (hemisphere), a subset of the features, a number of clusters and a start. In a pass every task adds up,
for each fit, the rows of each cluster; what leaves it is a row per fit and cluster, and so is what reaches the driver. The number
of passes is that of the slowest fit, whatever the number of starts, subsets and groups. Fits that have come to rest are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmeter.session import materialise

#: Rows of a group that starts are drawn from, most passes, and the squared move below which centres are at rest.
START_ROWS, MOST_PASSES, AT_REST = 1_000, 100, 1e-8
#: Rows of a cluster that stand for it in a Euclidean silhouette, and the batches its error is told from.
ANCHORS, BATCHES = 128, 8
#: Rows worked on at once.
BLOCK = 4_096


@dataclass(frozen=True)
class Fit:
    """One fit; ``columns`` are positions in the feature list. ``cost`` is the sum of squared distances."""

    group: str
    columns: tuple[int, ...]
    k: int
    start: int = 0
    centres: np.ndarray | None = None
    cost: float = float("nan")
    sizes: np.ndarray | None = None


def _vectors(df: DataFrame, by: str, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(group, key, point) of the rows in which all features are known."""
    point = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    known = ~F.exists(point, lambda x: x.isNull() | F.isnan(x))
    return df.where(known & F.col(by).isNotNull()).select(F.col(by).cast("string").alias("group"), F.xxhash64(*ids).alias("key"), point.alias("point"))


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every centre, by differences: no cancellation."""
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _plus_plus(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = [points[rng.integers(len(points))]]
    while len(centres) < k:
        away = _squared(points, np.array(centres)).min(axis=1)
        total = away.sum()
        centres.append(points[rng.choice(len(points), p=away / total) if total > 0 else rng.integers(len(points))])
    return np.array(centres)


def _settled(points: np.ndarray, centres: np.ndarray, most: int = MOST_PASSES) -> np.ndarray:
    """Centres after Lloyd's iteration over a bounded sample: the passes over all rows begin close to rest."""
    for _ in range(most):
        near = _squared(points, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, d], minlength=len(centres)) for d in range(points.shape[1])], axis=1)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if ((moved - centres) ** 2).sum() <= AT_REST:
            return moved
        centres = moved
    return centres


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Group, keys and points of the rows of each group of a block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        points = batch["point"].flatten().to_numpy().reshape(batch.num_rows, -1)
        groups, keys = np.array(batch["group"].to_pylist()), batch["key"].to_numpy()
        for at in range(0, len(points), BLOCK):
            part = slice(at, at + BLOCK)
            for group in np.unique(groups[part]):
                own = groups[part] == group
                yield str(group), keys[part][own], points[part][own]


def _moved(batches: Iterator[pa.RecordBatch], fits: list[Fit]) -> Iterator[pa.RecordBatch]:
    sums = [np.zeros((f.k, len(f.columns) + 2)) for f in fits]  # rows, cost, coordinates
    for group, _, points in _blocks(batches):
        for f, total in zip(fits, sums):
            if f.group != group:
                continue
            own = points[:, f.columns]
            away = _squared(own, f.centres)
            near = away.argmin(axis=1)
            total[:, 0] += np.bincount(near, minlength=f.k)
            total[:, 1] += np.bincount(near, away[np.arange(len(own)), near], minlength=f.k)
            for d in range(own.shape[1]):
                total[:, d + 2] += np.bincount(near, own[:, d], minlength=f.k)
    rows = [(i, c, row.tolist()) for i, total in enumerate(sums) for c, row in enumerate(total) if row[0]]
    yield pa.RecordBatch.from_pylist([{"fit": i, "cluster": c, "sums": s} for i, c, s in rows], schema=_SUMS)


_SUMS = pa.schema([("fit", pa.int32()), ("cluster", pa.int32()), ("sums", pa.list_(pa.float64()))])


def _pass(rows: DataFrame, fits: list[Fit]) -> list[np.ndarray]:
    """For every fit: rows, cost and coordinate sums of each cluster. The centres travel with the tasks."""
    width = max(len(f.columns) for f in fits) + 2
    partial = rows.mapInArrow(lambda b: _moved(b, fits), "fit int, cluster int, sums array<double>")
    at = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = [np.zeros((f.k, len(f.columns) + 2)) for f in fits]
    for r in partial.groupBy("fit", "cluster").agg(*at).collect():  # a row per fit and cluster
        f = fits[r["fit"]]
        out[r["fit"]][r["cluster"]] = [r[f"s{i}"] for i in range(len(f.columns) + 2)]
    return out


def fit_together(
    df: DataFrame, fits: Sequence[Fit], features: Sequence[str], ids: Sequence[str], by: str = "hemisphere", seed: int = 42,
    most_passes: int = MOST_PASSES,
) -> tuple[list[Fit], int]:
    """Every fit with centres, cost and cluster sizes, and the number of passes over ``df`` (a stored table).

    Centres start by k-means++ and Lloyd's iteration on at most ``START_ROWS`` rows of the group, those with the least hashed ids;
    from there on every pass reads all rows. A cluster that loses all its
    rows keeps its centre. Rows with a missing feature take no part; a group without rows keeps its fits without centres.
    """
    rows = materialise(_vectors(df, by, features, ids), "points")
    first = Window.partitionBy("group").orderBy("key", "point")
    sample: dict[str, list] = {}
    for r in rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= START_ROWS).orderBy("group", "rank").collect():
        sample.setdefault(r["group"], []).append(r["point"])
    begun = []
    for f in fits:
        if f.group in sample:
            rng = np.random.default_rng([seed, f.start, f.k, *f.columns])
            own = np.array(sample[f.group])[:, f.columns]
            f = replace(f, centres=_settled(own, _plus_plus(own, f.k, rng)))
        begun.append(f)
    done, active, passes = list(begun), [i for i, f in enumerate(begun) if f.centres is not None], 0
    while active and passes < most_passes:
        passes += 1
        moved = _pass(rows, [done[i] for i in active])
        still = []
        for i, sums in zip(active, moved):
            n = sums[:, 0]
            centres = np.where(n[:, None] > 0, sums[:, 2:] / np.maximum(n, 1)[:, None], done[i].centres)
            if ((centres - done[i].centres) ** 2).sum() > AT_REST:
                still.append(i)
            done[i] = replace(done[i], centres=centres, cost=float(sums[:, 1].sum()), sizes=n.astype(np.int64))
        active = still
    return done, passes


def best_starts(fits: Sequence[Fit]) -> list[Fit]:
    """Of the starts of each group, subset and k the one with the least cost, the first of ties."""
    best: dict = {}
    for f in fits:
        held = best.get((f.group, f.columns, f.k))
        if held is None or f.cost < held.cost:
            best[f.group, f.columns, f.k] = f
    return list(best.values())


def _anchors(batches: Iterator[pa.RecordBatch], fits: list[Fit], most: int) -> Iterator[pa.RecordBatch]:
    """Of each cluster the rows with the least keys, and the sums that the squared silhouette needs."""
    held: dict = {}
    sums = [np.zeros((f.k, 2 + len(f.columns))) for f in fits]  # rows, squared lengths, coordinates
    for group, keys, points in _blocks(batches):
        for i, f in enumerate(fits):
            if f.group != group:
                continue
            own = points[:, f.columns]
            near = _squared(own, f.centres).argmin(axis=1)
            for c in np.unique(near):
                some = own[near == c] - f.centres[c]  # about the centre, so that squares do not cancel
                sums[i][c] += np.concatenate([[len(some), (some * some).sum()], some.sum(axis=0)])
                k, p = held.get((i, c), (np.zeros(0, np.int64), np.zeros((0, own.shape[1]))))
                k, p = np.concatenate([k, keys[near == c]]), np.concatenate([p, own[near == c]])
                least = np.argsort(k, kind="stable")[:most]
                held[i, c] = k[least], p[least]
    out = [
        {"fit": i, "cluster": int(c), "key": int(key), "point": point.tolist(), "sums": sums[i][c].tolist() if j == 0 else None}
        for (i, c), (k, p) in held.items() for j, (key, point) in enumerate(zip(k, p))
    ]
    yield pa.RecordBatch.from_pylist(out, schema=_ANCHOR)


_ANCHOR = pa.schema(
    [("fit", pa.int32()), ("cluster", pa.int32()), ("key", pa.int64()), ("point", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))]
)


def _score(away: np.ndarray, near: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Silhouettes from mean distances to every cluster (the own one without the row itself); 0 for a row alone."""
    rows = np.arange(len(near))
    inner = away[rows, near]
    others = away.copy()
    others[rows, near] = np.inf
    outer = others.min(axis=1)
    top = np.maximum(inner, outer)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(alone, 0.0, np.nan_to_num((outer - inner) / top))


def _scored(batches: Iterator[pa.RecordBatch], fits: list[Fit], anchors: list, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(fits), 3 + BATCHES))  # rows, squared, Euclidean, Euclidean without each batch
    for group, keys, points in _blocks(batches):
        for i, f in enumerate(fits):
            if f.group != group:
                continue
            own = points[:, f.columns]
            near = _squared(own, f.centres).argmin(axis=1)
            n = sums[i][:, 0]
            alone = n[near] == 1
            squared = np.full((len(own), f.k), np.inf)
            part, count = np.zeros((len(own), f.k, BATCHES)), np.zeros((len(own), f.k, BATCHES))
            for c in range(f.k):
                if not n[c]:
                    continue
                from_centre = own - f.centres[c]
                mean = ((from_centre**2).sum(axis=1) * n[c] + sums[i][c, 1] - 2 * from_centre @ sums[i][c, 2:])
                squared[:, c] = np.maximum(mean, 0) / np.maximum(n[c] - (near == c), 1)
                k, p = anchors[i][c]
                gap = np.sqrt(_squared(own, p))
                self_ = keys[:, None] == k[None, :]
                for g in range(BATCHES):
                    chosen = np.arange(len(k)) % BATCHES == g
                    part[:, c, g] = gap[:, chosen].sum(axis=1)
                    count[:, c, g] = (~self_[:, chosen]).sum(axis=1)
            whole, rows = part.sum(axis=2), count.sum(axis=2)

            def mean_of(distance: np.ndarray, number: np.ndarray) -> np.ndarray:
                return np.where(number > 0, distance / np.maximum(number, 1), np.where(n > 0, 0.0, np.inf))

            total[i, 0] += len(own)
            total[i, 1] += _score(squared, near, alone).sum()
            total[i, 2] += _score(mean_of(whole, rows), near, alone).sum()
            for g in range(BATCHES):
                total[i, 3 + g] += _score(mean_of(whole - part[:, :, g], rows - count[:, :, g]), near, alone).sum()
    yield pa.RecordBatch.from_pylist([{"fit": i, "cluster": 0, "sums": row.tolist()} for i, row in enumerate(total) if row[0]], schema=_SUMS)


@dataclass(frozen=True)
class Silhouette:
    """Mean squared silhouette (exact) and mean Euclidean one with its standard error (0: every row was an anchor)."""

    squared: float | None
    euclidean: float | None
    error: float | None


def silhouettes_together(
    df: DataFrame, fits: Sequence[Fit], features: Sequence[str], ids: Sequence[str], by: str = "hemisphere", anchors: int = ANCHORS
) -> list[Silhouette]:
    """Silhouettes of every fit over all rows, in two passes.

    Euclidean distances are taken to ``anchors`` rows of each cluster, those with the least hashed ids, of which the mean distance
    stands for that to the whole cluster; a cluster of no more rows is taken whole. The error is the jackknife's over eight batches of
    anchors, and the value is corrected for its bias. A fit with fewer than two clusters in use has none.
    """
    rows, fits = materialise(_vectors(df, by, features, ids), "points"), list(fits)
    chosen = rows.mapInArrow(
        lambda b: _anchors(b, fits, anchors), "fit int, cluster int, key long, point array<double>, sums array<double>"
    )
    width = max((len(f.columns) for f in fits), default=0) + 2
    added = F.array(*[F.sum(F.get("sums", F.lit(i))).over(Window.partitionBy("fit", "cluster")) for i in range(width)])
    order = Window.partitionBy("fit", "cluster").orderBy("key", "point")
    kept = chosen.withColumns({"total": added, "rank": F.row_number().over(order)}).where(F.col("rank") <= anchors)
    held: list = [[(np.zeros(0, np.int64), np.zeros((0, len(f.columns)))) for _ in range(f.k)] for f in fits]
    sums = [np.zeros((f.k, 2 + len(f.columns))) for f in fits]
    found: dict = {}
    for r in kept.collect():  # at most ``anchors`` rows per fit and cluster
        found.setdefault((r["fit"], r["cluster"]), []).append((r["rank"], r["key"], r["point"]))
        sums[r["fit"]][r["cluster"]] = r["total"][: 2 + len(fits[r["fit"]].columns)]
    for (i, c), some in found.items():
        some.sort()
        held[i][c] = np.array([k for _, k, _ in some]), np.array([p for _, _, p in some])
    scored = rows.mapInArrow(lambda b: _scored(b, fits, held, sums), "fit int, cluster int, sums array<double>")
    at = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(3 + BATCHES)]
    totals = {r["fit"]: np.array([r[f"s{i}"] for i in range(3 + BATCHES)]) for r in scored.groupBy("fit").agg(*at).collect()}
    out = []
    for i, f in enumerate(fits):
        if i not in totals or (sums[i][:, 0] > 0).sum() < 2:
            out.append(Silhouette(None, None, None))
            continue
        n, squared, whole, *without = totals[i] / totals[i][0]
        if sums[i][:, 0].max() <= anchors:
            out.append(Silhouette(float(squared), float(whole), 0.0))
            continue
        without = np.array(without)
        value = BATCHES * whole - (BATCHES - 1) * without.mean()
        error = np.sqrt((BATCHES - 1) / BATCHES * ((without - without.mean()) ** 2).sum())
        out.append(Silhouette(float(squared), float(value), float(error)))
    return out
