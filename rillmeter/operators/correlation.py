"""Pearson and Spearman matrices in long form ``(by..., a, b, r)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.operators.ranking import average_ranks


class _Moments:
    """Mergeable co-moments of all pairs of columns, each over the rows where both are known.

    Of the pair (i, j) the k x k matrices hold rows, mean of i, squares of i about it, products of i and j about
    their means, and the least and largest i, by which a constant side is told.
    """

    def __init__(self, parts: np.ndarray) -> None:
        self.n, self.mean, self.squares, self.products, self.least, self.most = parts

    @classmethod
    def of(cls, values: np.ndarray) -> _Moments:
        known = ~np.isnan(values)
        first = np.array([c[k][0] if k.any() else 0.0 for c, k in zip(values.T, known.T)])
        x, m = np.where(known, values - first, 0.0), known.astype(float)
        n, sums = m.T @ m, x.T @ m
        filled = np.maximum(n, 1)
        # (the matrix is small and the block bounded, so a column of limits at a time)
        least = np.stack([np.where(known & known[:, [j]], values, np.inf).min(axis=0) for j in range(values.shape[1])], axis=1)
        most = np.stack([np.where(known & known[:, [j]], values, -np.inf).max(axis=0) for j in range(values.shape[1])], axis=1)
        squares = np.maximum((x * x).T @ m - sums * sums / filled, 0)
        return cls(np.array([n, sums / filled + first[:, None], squares, x.T @ x - sums * sums.T / filled, least, most]))

    def add(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        share = self.n * other.n / np.maximum(n, 1)
        gap = np.where(share > 0, other.mean - self.mean, 0.0)
        mean = np.where(self.n == 0, other.mean, self.mean + gap * other.n / np.maximum(n, 1))
        return _Moments(np.array([
            n, mean, self.squares + other.squares + gap * gap * share, self.products + other.products + gap * gap.T * share,
            np.minimum(self.least, other.least), np.maximum(self.most, other.most),
        ]))

    def flat(self) -> list[float]:
        return np.array([self.n, self.mean, self.squares, self.products, self.least, self.most]).ravel().tolist()

    def correlations(self) -> np.ndarray:
        """NaN where a side is constant or no row knows both."""
        varied = (self.most > self.least) & (self.most > self.least).T
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(varied, self.products / np.sqrt(self.squares * self.squares.T), np.nan)


def _group_codes(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    codes = np.zeros(batch.num_rows, np.int64)
    for name in by:
        coded = batch[name].dictionary_encode(null_encoding="encode")
        codes = codes * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    return codes


def _moments(batches: Iterator[pa.RecordBatch], by: Sequence[str], columns: int) -> Iterator[pa.RecordBatch]:
    """One row of co-moments per group of the task."""
    held: dict[tuple, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = _group_codes(batch, by)
        values = batch["values"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, columns)
        for code, first in zip(*np.unique(codes, return_index=True)):
            key = batch.slice(int(first), 1).select(list(by))
            name = tuple(tuple(c.to_pylist()) for c in key.columns)
            found = _Moments.of(values[codes == code])
            held[name] = [held[name][0].add(found), key] if name in held else [found, key]
    for found, key in held.values():
        yield pa.RecordBatch.from_arrays([*key.columns, pa.array([found.flat()], pa.list_(pa.float64()))], names=[*by, "moments"])


def _merged(table: pa.Table, by: Sequence[str], columns: Sequence[str]) -> pa.Table:
    """Correlations of a group from the rows of its tasks."""
    parts = [_Moments(np.array(x).reshape(6, len(columns), len(columns))) for x in table["moments"].to_pylist()]
    matrix = reduce(_Moments.add, parts).correlations()
    pairs = [(a, b, None if np.isnan(r) else float(r)) for a, row in zip(columns, matrix) for b, r in zip(columns, row)]
    a, b, r = zip(*pairs)
    keys = [pa.concat_arrays([table[k].slice(0, 1).combine_chunks()] * len(pairs)) for k in by]
    return pa.table([*keys, pa.array(a), pa.array(b), pa.array(r, pa.float64())], names=[*by, "a", "b", "r"])


def pearson(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("hemisphere",)) -> DataFrame:
    """All pairs over the rows where both are known; both triangles are returned.

    A row is read once: each task holds one set of mergeable co-moments per group, by matrix products over its batches,
    and a group's sets, one a task, are merged. NaN counts as missing. A pair with a constant side gives NULL.
    """
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])
    keys = [f"{b} {df.schema[b].dataType.simpleString()}" for b in by]
    names, k = list(columns), len(columns)
    sets = df.select(*by, values.alias("values")).mapInArrow(lambda b: _moments(b, by, k), ", ".join([*keys, "moments array<double>"]))
    return sets.groupBy(*by).applyInArrow(lambda t: _merged(t, by, names), ", ".join([*keys, "a string, b string, r double"]))


def rank_columns(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], by: Sequence[str] = ("hemisphere",),
    partitions: int | None = None,
) -> DataFrame:
    """Replace each column by its average rank within the group."""
    ranks = average_ranks(df, by, ids, columns, partitions)
    return ranks.groupBy(*by, *ids).agg(
        *[F.max(F.when(F.col("column") == c, F.col("rank"))).alias(c) for c in columns]
    )


def spearman(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], by: Sequence[str] = ("hemisphere",),
    partitions: int | None = None,
) -> DataFrame:
    """Pearson of average ranks. ``ids`` name the row, so ranks can be brought back together."""
    return pearson(rank_columns(df, columns, ids, by, partitions), columns, by)


def collinear_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Advisory: distinct column pairs whose absolute correlation exceeds ``threshold``."""
    return matrix.where((F.col("a") < F.col("b")) & (F.abs("r") > threshold))
