"""Feature selection: variance filter, collinearity reduction, silhouette ablation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.operators.lloyd import ANCHORS, Fit, best_starts, fit_together, silhouettes_together
from rillmeter.operators.ranking import local_table
from rillmeter.schemas import COLLINEAR_COLUMNS, KEYS

# A column must vary more than this to stay.
VARIANCE_THRESHOLD = 0.01


def variance_table(df: DataFrame, columns: Sequence[str], threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """Population variance per hemisphere and column, and whether the column stays there."""
    wide = df.groupBy("hemisphere").agg(*[F.var_pop(c).alias(c) for c in columns])
    return wide.unpivot(["hemisphere"], list(columns), "column", "variance").withColumn(
        "kept", F.col("variance") > F.lit(threshold)
    )


def variance_filter(df: DataFrame, columns: Sequence[str], threshold: float = VARIANCE_THRESHOLD) -> dict[str, list[str]]:
    """Surviving columns per hemisphere, in input order."""
    kept = variance_table(df, columns, threshold).where("kept").collect()
    names = sorted({r["hemisphere"] for r in kept})
    survivors = {h: {r["column"] for r in kept if r["hemisphere"] == h} for h in names}
    return {h: [c for c in columns if c in survivors[h]] for h in names}


def keep_columns(df: DataFrame, kept: dict[str, list[str]], columns: Sequence[str]) -> DataFrame:
    """Drop columns no hemisphere keeps; blank a column only where its hemisphere dropped it."""
    out = df
    for c in columns:
        keepers = [h for h, names in kept.items() if c in names]
        if not keepers:
            out = out.drop(c)
        elif len(keepers) < len(kept):
            out = out.withColumn(c, F.when(F.col("hemisphere").isin(keepers), F.col(c)))
    return out


def reduce_collinear(df: DataFrame) -> DataFrame:
    """Drop the six collinear columns; the final four remain."""
    return df.drop(*COLLINEAR_COLUMNS)


def silhouette_ablation(
    df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 42, n_starts: int = 10, anchors: int = ANCHORS,
) -> DataFrame:
    """How much the silhouette falls when each feature is left out: ``(hemisphere, position, feature, drop_euclidean,
    euclidean_error, drop_squared)``.

    All hemispheres, subsets and starts are fitted in the same passes over ``df`` (a stored table), and scored in two
    more. The squared silhouettes are exact; a Euclidean one comes from ``anchors`` rows of each cluster, and the error is the standard
    error of its drop, 0 where every cluster was small enough to be taken whole.
    """
    whole = tuple(range(len(columns)))
    subsets = [whole] + [tuple(i for i in whole if i != left_out) for left_out in whole]
    groups = [r["hemisphere"] for r in df.select("hemisphere").where("hemisphere IS NOT NULL").distinct().orderBy("hemisphere").collect()]
    asked = [Fit(h, subset, k, start) for h in groups for subset in subsets for start in range(n_starts)]
    fits, _ = fit_together(df, asked, columns, KEYS, seed=seed)
    best = [f for f in best_starts(fits) if f.centres is not None]
    scores = {(f.group, f.columns): s for f, s in zip(best, silhouettes_together(df, best, columns, KEYS, anchors=anchors))}
    rows: list[tuple] = []
    for h in groups:
        base = scores.get((h, whole))
        for i, name in enumerate(columns):
            part = scores.get((h, subsets[i + 1]))
            if base is None or part is None or base.squared is None or part.squared is None:
                rows.append((h, i, name, None, None, None))
            else:
                error = math.hypot(base.error, part.error)
                rows.append((h, i, name, base.euclidean - part.euclidean, error, base.squared - part.squared))
    names = ("hemisphere", "position", "feature", "drop_euclidean", "euclidean_error", "drop_squared")
    return local_table(
        df.sparkSession, {n: [r[i] for r in rows] for i, n in enumerate(names)},
        "hemisphere STRING, position INT, feature STRING, drop_euclidean DOUBLE, euclidean_error DOUBLE, drop_squared DOUBLE",
    )
