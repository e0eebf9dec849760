"""Score profiles against fitted centroids: nearest cluster, distances, anomaly flag.

A handful of centroids become literals and scoring is a pure projection; more of them
meet the profiles as arrays. Either way it runs unchanged over a batch or a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmeter.schemas import FINAL_FEATURES

# A profile farther than this from every centroid is an anomaly.
ANOMALY_DISTANCE = 5.0
#: Most centroids that become literals, and most of a hemisphere that meet a profile as one array.
MAX_CENTROIDS = 1_000


@dataclass(frozen=True)
class Scorer:
    """Centroids, archetype names and training bounds per hemisphere, held as plain numbers."""

    centroids: dict[str, list[list[float]]]
    archetypes: dict[str, list[str | None]] = field(default_factory=dict)
    bounds: dict[str, list[tuple[float, float]]] = field(default_factory=dict)


def training_bounds(df: DataFrame, features: Sequence[str] = FINAL_FEATURES) -> DataFrame:
    """Minimum and maximum of every training feature, long form."""
    wide = df.groupBy("hemisphere").agg(
        *[F.struct(F.min(c).alias("lower"), F.max(c).alias("upper")).alias(c) for c in features]
    )
    return wide.unpivot(["hemisphere"], list(features), "feature", "range").select(
        "hemisphere", "feature", "range.lower", "range.upper"
    )


@dataclass(frozen=True)
class CentroidTable:
    """Centroids that are too many for literals: parts of a broadcast row per hemisphere, with training bounds as numbers.

    ``parts``: tables ``(hemisphere, part ARRAY<STRUCT<cluster_id, centroid, archetype>>)``, in order of cluster ids.
    """

    parts: list[DataFrame]
    bounds: dict[str, list[tuple[float, float]]] = field(default_factory=dict)


def _bounds(bounds: DataFrame | None, features: Sequence[str], hemispheres: Sequence[str]) -> dict:
    if bounds is None:
        return {}
    found = {(r["hemisphere"], r["feature"]): (r["lower"], r["upper"]) for r in bounds.where(F.col("hemisphere").isin(list(hemispheres))).collect()}
    return {h: [found[h, f] for f in features] for h in hemispheres}


def load_scorer(
    centroids: DataFrame, bounds: DataFrame | None = None, features: Sequence[str] = FINAL_FEATURES, most_literals: int = MAX_CENTROIDS
) -> Scorer | CentroidTable:
    """Read the centroid table (and bounds). Up to ``most_literals`` centroids become literals on the driver; more stay a
    table, of which ``most_literals`` per hemisphere at a time meet the profiles as one array.

    Cluster ids of a hemisphere must be 0, 1, 2, ...
    """
    rows = centroids.orderBy("hemisphere", "cluster_id").limit(most_literals + 1).collect()
    if len(rows) > most_literals:
        named = centroids if "archetype" in centroids.columns else centroids.withColumn("archetype", F.lit(None).cast("string"))
        named = named.select("hemisphere", "cluster_id", F.col("centroid").cast("array<double>").alias("centroid"), "archetype")
        last = named.agg(F.max("cluster_id")).first()[0]
        piece = F.floor(F.col("cluster_id") / F.lit(most_literals))
        parts = [
            named.where(piece == i).groupBy("hemisphere").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid", "archetype"))).alias("part"))
            for i in range(last // most_literals + 1)
        ]
        hemispheres = [r["hemisphere"] for r in named.select("hemisphere").distinct().collect()]
        return CentroidTable(parts, _bounds(bounds, features, hemispheres))
    points: dict = {}
    names: dict = {}
    for r in rows:
        points.setdefault(r["hemisphere"], []).append([float(x) for x in r["centroid"]])
        names.setdefault(r["hemisphere"], []).append(r["archetype"] if "archetype" in centroids.columns else None)
    return Scorer(points, names, _bounds(bounds, features, list(points)))


def _by_hemisphere(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for hemisphere, value in values.items():
        out = F.when(F.col("hemisphere") == hemisphere, value).otherwise(out)
    return out


def euclidean(features: Sequence[str], centroid: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for name, c in zip(features, centroid):
        gap = F.col(name).cast("double") - F.lit(c)
        total = total + gap * gap
    return F.sqrt(total)


def distance_columns(scorer: Scorer, features: Sequence[str] = FINAL_FEATURES) -> Column:
    """Array of distances to the centroids of the row's hemisphere."""
    return _by_hemisphere(
        {h: F.array(*[euclidean(features, c) for c in points]) for h, points in scorer.centroids.items()}
    )


def nearest(distances: Column) -> Column:
    """0-based position of the smallest distance; the first of ties. NULL if any distance is NULL."""
    complete = ~F.exists(distances, lambda d: d.isNull())
    return F.when(complete, (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def is_anomaly(min_distance: Column, threshold: float = ANOMALY_DISTANCE) -> Column:
    return min_distance > F.lit(threshold)


def _against_literals(profiles: DataFrame, scorer: Scorer, features: Sequence[str]) -> tuple[DataFrame, Column]:
    """Profiles with all distances, and the name of the nearest centroid."""
    names = _by_hemisphere(
        {h: F.get(F.array(*[F.lit(n) for n in labels]), F.col("nearest")) for h, labels in scorer.archetypes.items()}
    )
    return profiles.withColumn("distances", distance_columns(scorer, features)), names


def _against_table(profiles: DataFrame, table: CentroidTable, features: Sequence[str]) -> tuple[DataFrame, Column]:
    """As :func:`_against_literals`, part after part: each adds its distances by a function over the array."""
    point = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    out = profiles.withColumns({"distances": F.lit(None).cast("array<double>"), "names": F.lit(None).cast("array<string>")})

    def distance(c: Column) -> Column:
        gaps = F.zip_with(point, c["centroid"], lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap))

    for part in table.parts:
        away, named = F.transform("part", distance), F.transform("part", lambda c: c["archetype"])
        add = lambda old, new: F.when(F.col(old).isNull(), new).when(F.col("part").isNull(), F.col(old)).otherwise(F.concat(old, new))
        out = out.join(F.broadcast(part), "hemisphere", "left").withColumns({"distances": add("distances", away), "names": add("names", named)}).drop("part")
    return out, F.get("names", F.col("nearest"))


def score_profiles(
    profiles: DataFrame, scorer: Scorer | CentroidTable, threshold: float = ANOMALY_DISTANCE,
    features: Sequence[str] = FINAL_FEATURES,
) -> DataFrame:
    """Add label, archetype, distances, anomaly flag and features outside the training range.

    Other columns pass through. A profile with a missing feature gets NULLs. Literals and table give the same rows.
    """
    against = _against_literals if isinstance(scorer, Scorer) else _against_table
    measured, names = against(profiles, scorer, features)
    scored = measured.withColumns(
        {
            "nearest": nearest(F.col("distances")),
            "min_distance": F.array_min("distances"),
        }
    )
    complete = F.col("nearest").isNotNull()
    out = scored.withColumns(
        {
            "cluster_id": F.col("nearest").cast("string"),
            "archetype": names.cast("string"),
            "min_distance": F.when(complete, F.col("min_distance")),
            "is_anomaly": F.when(complete, is_anomaly(F.col("min_distance"), threshold)),
        }
    ).drop("nearest", *([] if isinstance(scorer, Scorer) else ["names"]))
    if not scorer.bounds:
        return out
    outside = {
        h: F.filter(
            F.array(*[
                F.when((F.col(f) < F.lit(low)) | (F.col(f) > F.lit(high)), F.lit(f))
                for f, (low, high) in zip(features, ranges)
            ]),
            lambda x: x.isNotNull(),
        )
        for h, ranges in scorer.bounds.items()
    }
    return out.withColumn("out_of_range", _by_hemisphere(outside))
