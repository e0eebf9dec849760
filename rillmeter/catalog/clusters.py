"""K: clustering, scoring and anomalies."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import r, with_tables
from rillmeter.operators import clustering as cl, lloyd
from rillmeter.operators.sampling import sample_per_group
from rillmeter.operators.scaling import fit_robust, scale
from rillmeter.operators.scoring import score_profiles, training_bounds
from rillmeter.operators.selection import variance_table
from rillmeter.plans.clustering import archetype_profiles, cluster
from rillmeter.plans.scoring import score_households
from rillmeter.schemas import FINAL_FEATURES, HEMISPHERES, KEYS
from rillmeter.session import materialise, scratch_path
from rillmeter.sources.layout import save_fitted
from rillmeter.streaming.scoring import read_profiles, score_stream, write_scores

_HID = "hemisphere, household_id"


def _scored(spark, sf_dir, bounds=False):
    final = t.stored_final(spark, sf_dir)
    return score_profiles(final, t.class_scorer(spark, sf_dir, final, bounds))


@query("K1_kmeans_fit")
def kmeans_fit(spark, sf_dir):
    """Named centroids with the size of each cluster."""
    done = cluster(t.stored_final(spark, sf_dir))
    sizes = done.assignments.groupBy("hemisphere", F.col("cluster_id").cast("int").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    coordinates = {f: F.col("centroid")[i] for i, f in enumerate(FINAL_FEATURES)}
    return done.centroids.withColumns(coordinates).drop("centroid").join(sizes, ["hemisphere", "cluster_id"])


def _sums_of_squares(final, k, seed):
    """Scatter around the fitted centroids plus that of the centroids around the mean.

    Equals the total scatter only if every centroid is the mean of the rows nearest to it.
    """
    done = cluster(final, k, seed)
    within = F.sum(F.pow("min_distance", F.lit(2)))
    sizes = done.assignments.groupBy("hemisphere", F.col("cluster_id").cast("int").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n"), within.alias("within")
    )
    middle = final.groupBy("hemisphere").agg(F.array(*[F.avg(f) for f in FINAL_FEATURES]).alias("middle"))
    gaps = F.zip_with("centroid", "middle", lambda x, y: (x - y) * (x - y))
    between = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)
    parts = sizes.join(done.centroids, ["hemisphere", "cluster_id"]).join(middle, "hemisphere")
    return parts.groupBy("hemisphere").agg(
        F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_rows"),
        F.round(F.sum(F.col("within") + F.col("n") * between), 4).alias("sum_of_squares"),
    )


def _total_scatter(k):
    total = "count(*) * (" + " + ".join(f"var_pop({f})" for f in FINAL_FEATURES) + ")"
    return (
        f"SELECT hemisphere, CAST({k} AS INT) AS k, CAST({k} AS BIGINT) AS n_clusters, count(*) AS n_rows, "
        f"{r(digits=4, sum_of_squares=total)} FROM scaled GROUP BY 1"
    )


@query("K1_sums_of_squares", with_tables("scaled", _total_scatter(cl.CLUSTERS)))
def sums_of_squares(spark, sf_dir):
    return _sums_of_squares(t.stored_final(spark, sf_dir), cl.CLUSTERS, cl.TRAINING_SEED)


@query("K7_sums_of_squares_by_k", with_tables("scaled", " UNION ALL ".join(_total_scatter(k) for k in range(2, 9))))
def sums_of_squares_by_k(spark, sf_dir):
    final = t.stored_final(spark, sf_dir)
    parts = [_sums_of_squares(final, k, cl.STUDY_SEED) for k in range(2, 9)]
    return reduce(DataFrame.unionByName, parts)


@query("K2_cluster_labels")
def cluster_labels(spark, sf_dir):
    final = t.stored_final(spark, sf_dir)
    return cl.assign_clusters(final, cl.train_models(final))


@query("K3_predict", with_tables("scored", f"SELECT {_HID}, cluster_id FROM scored"))
def predict(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, "cluster_id")


_DISTANCES = [f"distance_{i}" for i in range(4)]


@query("K4_distances", with_tables("scored", f"SELECT {_HID}, {r(*_DISTANCES)} FROM scored"))
def distances(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, *[F.col("distances")[i].alias(n) for i, n in enumerate(_DISTANCES)])


@query(
    "K5_anomalies",
    with_tables(
        "scored",
        f"SELECT {_HID}, {r('min_distance')}, min_distance > 5.0 AS is_anomaly, min_distance > 0.5 AS is_far FROM scored",
    ),
)
def anomalies(spark, sf_dir):
    final = t.stored_final(spark, sf_dir)
    scorer = t.class_scorer(spark, sf_dir, final)
    return score_profiles(final, scorer).select(*KEYS, "min_distance", "is_anomaly", (F.col("min_distance") > 0.5).alias("is_far"))


@query("K6_archetypes", with_tables("scored", "SELECT hemisphere, cluster_id, archetype FROM named"))
def archetypes(spark, sf_dir):
    centroids = t.class_centroids(t.scaled(spark, sf_dir), t.panel(spark, sf_dir).household)
    return cl.name_archetypes(centroids).select("hemisphere", "cluster_id", "archetype")


def _suitability(*metrics):
    def build(spark, sf_dir):
        return cl.cluster_suitability(t.stored_final(spark, sf_dir), metrics=metrics)

    return build


_COVARIANCES = " UNION ALL ".join(
    f"SELECT hemisphere, {i} AS a, {j} AS b, covar_pop({x}, {y}) AS c FROM scaled GROUP BY 1"
    for i, x in enumerate(FINAL_FEATURES) for j, y in enumerate(FINAL_FEATURES)
)


@query(
    "K9_pca_power_sums",
    with_tables(
        "scaled",
        f"SELECT hemisphere, 1 AS power, {r(value='sum(c)')} FROM ratio WHERE a = b GROUP BY 1 "
        f"UNION ALL SELECT hemisphere, 2, {r(value='sum(c)')} FROM squared WHERE a = b GROUP BY 1 "
        f"UNION ALL SELECT s.hemisphere, 3, {r(value='sum(s.c * u.c)')} FROM squared s JOIN ratio u ON s.hemisphere = u.hemisphere AND s.a = u.b AND s.b = u.a GROUP BY 1 "
        f"UNION ALL SELECT s.hemisphere, 4, {r(value='sum(s.c * u.c)')} FROM squared s JOIN squared u ON s.hemisphere = u.hemisphere AND s.a = u.b AND s.b = u.a GROUP BY 1",
        f"covariances AS ({_COVARIANCES})",
        "traces AS (SELECT hemisphere, sum(c) AS trace FROM covariances WHERE a = b GROUP BY 1)",
        "ratio AS (SELECT v.hemisphere, a, b, c / trace AS c FROM covariances v JOIN traces x ON v.hemisphere = x.hemisphere)",
        "squared AS (SELECT x.hemisphere, x.a, y.b, sum(x.c * y.c) AS c FROM ratio x JOIN ratio y "
        "ON x.hemisphere = y.hemisphere AND x.b = y.a GROUP BY 1, 2, 3)",
    ),
)
def pca_power_sums(spark, sf_dir):
    """Sums of the first four powers of the explained-variance ratios, which fix all four ratios: the traces of
    the powers of the covariance matrix over its own trace."""
    ratios = cl.cluster_suitability(t.stored_final(spark, sf_dir), metrics=("pca_variance_ratio",))
    powers = F.explode(F.array(*[F.lit(i + 1) for i in range(len(FINAL_FEATURES))])).alias("power")
    return ratios.select("hemisphere", "value", powers).groupBy("hemisphere", "power").agg(
        F.sum(F.pow("value", F.col("power"))).alias("value")
    )


query("K7_inertia_by_k")(_suitability("inertia"))
query("K9_pca_ratios")(_suitability("pca_variance_ratio"))
query("K10_suitability")(_suitability(*cl.STUDY_METRICS))

# Every pair of the sampled rows; the sample is the 2,000 rows the measure is defined on.
_SILHOUETTE = (
    "sampled AS (SELECT s.*, x.cluster_id FROM scaled s JOIN scored x ON s.hemisphere = x.hemisphere AND s.household_id = x.household_id "
    "QUALIFY row_number() OVER (PARTITION BY s.hemisphere ORDER BY md5(concat_ws('|', '42', s.hemisphere, CAST(s.household_id AS VARCHAR)))) <= 2000)",
    "sizes AS (SELECT hemisphere, cluster_id, count(*) AS size FROM sampled GROUP BY 1, 2)",
    "sums AS (SELECT a.hemisphere, a.household_id, a.cluster_id AS own, b.cluster_id AS other, sum(sqrt("
    + " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in FINAL_FEATURES)
    + ")) AS total FROM sampled a JOIN sampled b ON a.hemisphere = b.hemisphere GROUP BY 1, 2, 3, 4)",
    "inner_outer AS (SELECT s.hemisphere, household_id, max(CASE WHEN own = other THEN size END) AS own_size, "
    "max(CASE WHEN own = other AND size > 1 THEN total / (size - 1) END) AS a, min(CASE WHEN own <> other THEN total / size END) AS b "
    "FROM sums s JOIN sizes z ON s.hemisphere = z.hemisphere AND s.other = z.cluster_id GROUP BY 1, 2)",
)


@query(
    "K8_silhouette",
    with_tables(
        "scored",
        "SELECT hemisphere, count(*) AS n, " + r(silhouette="avg(CASE WHEN own_size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)")
        + " FROM inner_outer GROUP BY 1",
        *_SILHOUETTE,
    ),
)
def silhouette(spark, sf_dir):
    labelled = _scored(spark, sf_dir).select(*KEYS, *FINAL_FEATURES, F.col("cluster_id").alias("label"))
    sample = sample_per_group(labelled, "hemisphere", HEMISPHERES, KEYS, cl.SILHOUETTE_SAMPLE)
    return cl.silhouettes(sample, FINAL_FEATURES, ["hemisphere"])


query("K8_silhouette_by_k")(_suitability("silhouette", "squared_silhouette"))


@query(
    "K11_training_bounds",
    with_tables(
        "scaled",
        " UNION ALL ".join(
            f"SELECT hemisphere, '{f}' AS feature, {r(lower_bound=f'min({f})', upper_bound=f'max({f})')} FROM scaled GROUP BY 1"
            for f in FINAL_FEATURES
        ),
    ),
)
def bounds(spark, sf_dir):
    return training_bounds(t.scaled(spark, sf_dir)).withColumnsRenamed({"lower": "lower_bound", "upper": "upper_bound"})


_SCORE_COLUMNS = ("hemisphere", "household_id", "cluster_id", "archetype", "min_distance", "is_anomaly", "n_out_of_range")


def _score_report(scored):
    return scored.withColumn("n_out_of_range", F.size("out_of_range")).select(*_SCORE_COLUMNS)


_SCORES = with_tables(
    "scored",
    f"SELECT s.hemisphere, s.household_id, s.cluster_id, archetype, {r(min_distance='s.min_distance')}, "
    "s.min_distance > 5 AS is_anomaly, CAST(0 AS INT) AS n_out_of_range "
    "FROM scored s JOIN named n ON s.hemisphere = n.hemisphere AND s.cluster_id = CAST(n.cluster_id AS VARCHAR)",
)


@query("K12_score_profiles", _SCORES)
def score_table(spark, sf_dir):
    return _score_report(_scored(spark, sf_dir, bounds=True))


@query("K12_score_saved_state", _SCORES)
def score_saved(spark, sf_dir):
    """Save everything fitted, load it and score raw usage with it."""
    path, p = scratch_path(spark, "state"), t.panel(spark, sf_dir)
    unscaled = t.stored_features(spark, sf_dir)
    params = fit_robust(unscaled, FINAL_FEATURES)
    final = materialise(scale(unscaled, params, FINAL_FEATURES), "final")
    save_fitted(f"{path}/fitted", t.flags(spark, sf_dir), params, variance_table(final, FINAL_FEATURES))
    cl.name_archetypes(t.class_centroids(final, p.household)).write.parquet(f"{path}/centroids")
    training_bounds(final).write.parquet(f"{path}/training_bounds")
    return _score_report(score_households(spark, path, p))


# Events as profiles: value and user drive the four features, the event type the hemisphere.
_PROFILE_SQL = (
    "profiles AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'north' ELSE 'south' END AS hemisphere, "
    "ln(1 + value) - 4 AS log_per_capita_usage, value / 100 - 1 AS dry_day_spike_factor, "
    "(user_id % 17) / 16.0::DOUBLE - 0.5 AS efficiency_penalty_ratio, length(event_type) / 4.0::DOUBLE - 1 AS landscape_demand_index "
    "FROM events WHERE value >= 0)"
)
_EVENT_DISTANCE = " + ".join(f"pow(p.{f} - c.{f}, 2)" for f in FINAL_FEATURES)


def _event_profiles(events):
    return events.where(F.col("value") >= 0).select(
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "north").otherwise("south").alias("hemisphere"),
        (F.ln(1 + F.col("value")) - 4).alias("log_per_capita_usage"),
        (F.col("value") / 100 - 1).alias("dry_day_spike_factor"),
        ((F.col("user_id") % 17) / F.lit(16.0) - 0.5).alias("efficiency_penalty_ratio"),
        (F.length("event_type") / F.lit(4.0) - 1).alias("landscape_demand_index"),
    )


@query(
    "K12_score_stream",
    with_tables(
        "scored",
        "SELECT event_id, hemisphere, CAST(arg_min(cluster_id, distance) AS VARCHAR) AS cluster_id, "
        + r(min_distance="min(distance)")
        + ", min(distance) > 5 AS is_anomaly FROM "
        f"(SELECT p.event_id, p.hemisphere, c.cluster_id, sqrt({_EVENT_DISTANCE}) AS distance FROM profiles p JOIN centroids c ON p.hemisphere = c.hemisphere) "
        "GROUP BY 1, 2",
        _PROFILE_SQL,
    ),
)
def score_events(spark, sf_dir):
    """Score the event table as a stream of files, run until it has caught up."""
    final = t.stored_final(spark, sf_dir)
    scorer = t.class_scorer(spark, sf_dir, final)
    schema = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"
    events = read_profiles(spark, sf_dir, schema, files="events.parquet")
    scored = score_stream(_event_profiles(events), scorer).select(
        "event_id", "hemisphere", "cluster_id", "min_distance", "is_anomaly"
    )
    out = scratch_path(spark, "stream-scores")
    write_scores(scored, out, scratch_path(spark, "stream-checkpoint"), available_now=True).awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


@query("K12_archetype_profiles")
def profiles_by_archetype(spark, sf_dir):
    """Unscaled features by fitted cluster, named by archetype."""
    final = t.stored_final(spark, sf_dir)
    done = cluster(final)
    boxes = archetype_profiles(t.stored_features(spark, sf_dir), done.assignments)
    names = done.centroids.select("hemisphere", F.col("cluster_id").cast("string").alias("cluster_id"), "archetype")
    return boxes.join(names, ["hemisphere", "cluster_id"])


_WIDTH = 64


@query(
    "K7_embedding_sums_of_squares",
    # Whatever the clusters, what lies inside and between them adds up to the scatter about the mean.
    "WITH cells AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE len(embedding) = 64 AND vec_id IS NOT NULL), "
    "total AS (SELECT sum(v) AS s, any_value(n) AS n FROM (SELECT var_pop(x) * count(*) AS v, count(*) AS n FROM cells GROUP BY d)) "
    "SELECT k::INTEGER AS k, round(s, 3) AS total, n FROM total, (VALUES (2), (4), (8), (16)) t(k)",
)
def embedding_sums_of_squares(spark, sf_dir):
    """Fits of a table of real width, all in the same passes."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") == _WIDTH)
    names = [f"x{i}" for i in range(_WIDTH)]
    wide = materialise(vectors.select("vec_id", F.lit("all").alias("hemisphere"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), "wide")
    asked = [lloyd.Fit("all", tuple(range(_WIDTH)), k, start) for k in (2, 4, 8, 16) for start in range(2)]
    rows = []
    for f in lloyd.best_starts(lloyd.fit_together(wide, asked, names, ["vec_id"])[0]):
        if f.centres is not None:
            mean = f.sizes @ f.centres / f.sizes.sum()
            rows.append((f.k, round(float(f.cost + f.sizes @ ((f.centres - mean) ** 2).sum(axis=1)), 3), int(f.sizes.sum())))
    return spark.createDataFrame(rows, "k INT, total DOUBLE, n BIGINT")
