import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmeter.operators import clustering as cl
from rillmeter.operators import lloyd
from rillmeter.operators.scoring import Scorer, load_scorer, score_profiles, training_bounds
from rillmeter.operators.selection import silhouette_ablation
from rillmeter.plans.clustering import archetype_profiles, cluster
from rillmeter.schemas import FINAL_FEATURES, KEYS
from rillmeter.streaming.scoring import read_profiles, score_stream, write_scores

DDL = "hemisphere STRING, household_id STRING, " + ", ".join(f"{f} DOUBLE" for f in FINAL_FEATURES)
CENTRES = [[-2, 0, 0, 0], [2, 0, 0, 0], [0, 1, 1, 2], [0, -1, -1, -2]]
NAMES = [cl.LOW_VOLUME, cl.HIGH_VOLUME, cl.OUTDOOR, cl.STANDARD]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for h, n in (("north", 60), ("south", 40)):
        for i, centre in enumerate(CENTRES):
            points = rng.normal(centre, 0.15, (n, 4))
            rows += [(h, f"{i}-{j}", *map(float, p)) for j, p in enumerate(points)]
    df = spark.createDataFrame(rows, DDL).persist()
    yield df
    df.unpersist()


def test_well_separated_blobs_are_found_and_named(blobs):
    done = cluster(blobs)
    assert set(done.models) == {"north", "south"}
    rows = done.assignments.select("hemisphere", "household_id", "archetype", "is_anomaly", "out_of_range").collect()
    assert len(rows) == 400
    for r in rows:
        assert r["archetype"] == NAMES[int(r["household_id"][0])] and not r["is_anomaly"] and r["out_of_range"] == []
    profiles = archetype_profiles(blobs, done.assignments)
    assert profiles.groupBy("hemisphere", "column").agg(F.sum("n").alias("n")).where("n NOT IN (240, 160)").count() == 0


def test_fit_is_repeatable(blobs):
    first, second = (sorted(cluster(blobs).assignments.select(*KEYS, "cluster_id").collect()) for _ in range(2))
    assert first == second


def test_centroids_are_the_means_of_their_members(blobs):
    models = cl.train_models(blobs)
    labelled = cl.assign_clusters(blobs, models)
    means = labelled.groupBy("hemisphere", "cluster_id").agg(*[F.avg(f).alias(f) for f in FINAL_FEATURES]).collect()
    for r in means:
        centre = models[r["hemisphere"]].clusterCenters()[int(r["cluster_id"])]
        assert np.allclose([r[f] for f in FINAL_FEATURES], centre, atol=1e-9)


def test_archetype_tie_goes_to_the_later_cluster(spark):
    rows = [("north", 0, [0.0, 0.0, 0.0, 1.0]), ("north", 1, [-1.0, 0.0, 0.0, 0.0]), ("north", 2, [0.5, 0.0, 0.0, 1.0]), ("north", 3, [2.0, 0.0, 0.0, 9.0])]
    named = cl.name_archetypes(spark.createDataFrame(rows, cl.CENTROIDS_DDL)).orderBy("cluster_id").collect()
    assert [r["archetype"] for r in named] == [cl.STANDARD, cl.LOW_VOLUME, cl.OUTDOOR, cl.HIGH_VOLUME]


def scorer():
    centroids = {"north": [[0.0, 0.0, 0.0, 0.0], [10.0, 0.0, 0.0, 0.0]]}
    return Scorer(centroids, {"north": ["low", "high"]}, {"north": [(-1.0, 11.0)] * 4})


def profiles(spark, *points, hemisphere="north"):
    return spark.createDataFrame([(hemisphere, str(i), *p) for i, p in enumerate(points)], DDL)


def test_anomaly_threshold_is_strict(spark):
    rows = score_profiles(profiles(spark, (0.0, 5.0, 0.0, 0.0), (0.0, 5.001, 0.0, 0.0), (60.0, 9.0, 9.0, 9.0)), scorer()).orderBy("household_id").collect()
    assert [r["is_anomaly"] for r in rows] == [False, True, True]
    assert rows[0]["min_distance"] == 5.0 and rows[0]["distances"][1] == pytest.approx(125**0.5)
    assert rows[2]["cluster_id"] == "1" and rows[2]["archetype"] == "high"
    assert rows[2]["out_of_range"] == ["log_per_capita_usage"]


def test_tie_goes_to_the_first_centroid_and_gaps_give_null(spark):
    tie, gap = score_profiles(profiles(spark, (5.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)), scorer()).orderBy("household_id").collect()
    assert tie["cluster_id"] == "0" and tie["is_anomaly"] is False
    assert gap["cluster_id"] is None and gap["min_distance"] is None and gap["is_anomaly"] is None
    other = score_profiles(profiles(spark, (5.0, 0.0, 0.0, 0.0), hemisphere="equator"), scorer()).first()
    assert other["cluster_id"] is None and other["archetype"] is None


def test_scorer_from_tables(spark, blobs):
    rows = [("north", i, [float(x) for x in c]) for i, c in enumerate(CENTRES)] + [("south", i, [float(x) for x in c]) for i, c in enumerate(CENTRES)]
    made = load_scorer(cl.name_archetypes(spark.createDataFrame(rows, cl.CENTROIDS_DDL)), training_bounds(blobs))
    assert made.archetypes["north"] == NAMES and len(made.bounds["south"]) == 4


def test_stream_scores_like_a_batch(spark, tmp_path):
    points = [(float(i % 13), float(i % 7), float(i % 3), 0.0) for i in range(200)]
    batch = profiles(spark, *points)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch.repartition(4).write.parquet(source)
    scored = score_stream(read_profiles(spark, source, batch.schema, files_per_trigger=1), scorer())
    write_scores(scored, out, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    columns = ["household_id", "cluster_id", "min_distance", "is_anomaly"]
    streamed = spark.read.parquet(out).select(*columns)
    assert sorted(streamed.collect()) == sorted(score_profiles(batch, scorer()).select(*columns).collect())


def brute_silhouette(points, labels):
    scores = []
    for i, p in enumerate(points):
        d = np.linalg.norm(points - p, axis=1)
        own = (labels == labels[i]) & (np.arange(len(points)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a = d[own].mean()
        b = min(d[labels == c].mean() for c in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(4)
    points, labels = rng.normal(size=(80, 4)), rng.integers(0, 3, 80)
    labels[0] = 7
    df = spark.createDataFrame([("n", int(c), *map(float, p)) for c, p in zip(labels, points)], "g STRING, label INT, " + ", ".join(f"{f} DOUBLE" for f in FINAL_FEATURES))
    row = cl.silhouettes(df, FINAL_FEATURES, ["g"]).first()
    assert row["n"] == 80 and row["silhouette"] == pytest.approx(brute_silhouette(points, labels))
    assert cl.silhouettes(df.withColumn("label", F.lit(1)), FINAL_FEATURES, ["g"]).first()["silhouette"] is None


def test_suitability(blobs):
    rows = {(r["hemisphere"], r["metric"], r["k"]): r["value"] for r in cl.cluster_suitability(blobs, max_k=5).collect()}
    pdf = blobs.where("hemisphere = 'north'").toPandas()[list(FINAL_FEATURES)].to_numpy()
    eigen = np.sort(np.linalg.eigvalsh(np.cov(pdf.T)))[::-1]
    for i, v in enumerate(eigen / eigen.sum()):
        assert rows["north", "pca_variance_ratio", i + 1] == pytest.approx(v, abs=1e-9)
    centred = sum(((pdf[i * 60:(i + 1) * 60] - pdf[i * 60:(i + 1) * 60].mean(axis=0)) ** 2).sum() for i in range(4))
    assert rows["north", "inertia", 4] == pytest.approx(centred)
    assert rows["north", "silhouette", 4] == pytest.approx(brute_silhouette(pdf, np.repeat(range(4), 60)))
    assert max((rows["north", "squared_silhouette", k], k) for k in range(2, 6))[1] == 4


def test_ablation(blobs):
    north = blobs.where("hemisphere = 'north'")
    rows = silhouette_ablation(north, FINAL_FEATURES, n_starts=2).orderBy("position").collect()
    assert [r["feature"] for r in rows] == list(FINAL_FEATURES)
    pdf = north.toPandas()[list(FINAL_FEATURES)].to_numpy()
    base = brute_silhouette(pdf, np.repeat(range(4), 60))
    without = brute_silhouette(pdf[:, [0, 2, 3]], np.repeat(range(4), 60))
    assert rows[1]["drop_euclidean"] == pytest.approx(base - without)
    assert all(r["euclidean_error"] == 0 for r in rows)  # clusters of 60 rows are taken whole
    assert {r["hemisphere"] for r in silhouette_ablation(blobs, FINAL_FEATURES, n_starts=1).collect()} == {"north", "south"}
    assert silhouette_ablation(blobs.limit(0), FINAL_FEATURES).collect() == []


def spread_blobs(spark, n, seed=6):
    r = np.random.default_rng(seed)
    points = r.normal(size=(4, 4))[r.integers(0, 4, n)] * 1.5 + r.normal(size=(n, 4))
    rows = [("north" if i % 3 else "south", f"h{i}", *map(float, p)) for i, p in enumerate(points)]
    rows += [("north", "missing", None, 1.0, 1.0, 1.0), (None, "nowhere", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "hemisphere STRING, household_id STRING, " + ", ".join(f"{f} DOUBLE" for f in FINAL_FEATURES))
    return points, df


def test_fits_advance_together_and_come_to_rest(spark):
    """Each fit ends where a plain Lloyd iteration from its centres ends, and passes do not grow with the number of fits."""
    points, df = spread_blobs(spark, 900)
    asked = [lloyd.Fit(h, columns, k, start) for h in ("north", "south") for columns in ((0, 1, 2, 3), (0, 2)) for k in (2, 5) for start in range(3)]
    fits, passes = lloyd.fit_together(df, asked, FINAL_FEATURES, ["household_id"])
    alone = [lloyd.fit_together(df, [f], FINAL_FEATURES, ["household_id"]) for f in asked[:4]]
    assert passes <= 3 and passes >= max(n for _, n in alone)  # a sample of 1,000 rows a group holds them all
    for f, ((single,), _) in zip(fits, alone):
        assert np.allclose(f.centres, single.centres) and f.cost == pytest.approx(single.cost)
    place = np.arange(900) % 3 > 0
    for f in fits:
        own = points[place if f.group == "north" else ~place][:, f.columns]
        away = ((own[:, None] - f.centres[None]) ** 2).sum(2)
        near = away.argmin(1)
        assert f.cost == pytest.approx(away.min(1).sum()) and f.sizes.tolist() == np.bincount(near, minlength=f.k).tolist()
        assert np.allclose(f.centres, [own[near == c].mean(0) for c in range(f.k)], atol=1e-4)
    few, passes = lloyd.START_ROWS, 0
    lloyd.START_ROWS = 40
    try:
        again, passes = lloyd.fit_together(df, asked[:4], FINAL_FEATURES, ["household_id"])
    finally:
        lloyd.START_ROWS = few
    for f in again:
        own = points[place if f.group == "north" else ~place][:, f.columns]
        near = ((own[:, None] - f.centres[None]) ** 2).sum(2).argmin(1)
        assert np.allclose(f.centres, [own[near == c].mean(0) for c in range(f.k)], atol=1e-4)
    assert passes > 3
    best = lloyd.best_starts(fits)
    assert len(best) == 8 and all(b.cost == min(f.cost for f in fits if (f.group, f.columns, f.k) == (b.group, b.columns, b.k)) for b in best)
    nothing, passes = lloyd.fit_together(df, [lloyd.Fit("east", (0,), 2)], FINAL_FEATURES, ["household_id"])
    assert nothing[0].centres is None and passes == 0


@pytest.mark.parametrize("anchors", [16, 64, 10_000])
def test_euclidean_silhouettes_are_within_their_error(spark, anchors):
    points, df = spread_blobs(spark, 1500)
    fits, _ = lloyd.fit_together(df, [lloyd.Fit("north", c, 4) for c in ((0, 1, 2, 3), (1, 2))], FINAL_FEATURES, ["household_id"])
    own = points[np.arange(1500) % 3 > 0]
    for f, s in zip(fits, lloyd.silhouettes_together(df, fits, FINAL_FEATURES, ["household_id"], anchors=anchors)):
        some = own[:, f.columns]
        labels = ((some[:, None] - f.centres[None]) ** 2).sum(2).argmin(1)
        true = brute_silhouette(some, labels)
        if anchors > 1000:
            assert s.error == 0 and s.euclidean == pytest.approx(true)
        else:
            assert 0 < s.error < 0.1 and abs(s.euclidean - true) < 4 * s.error
        squared = []
        for i, p in enumerate(some):
            d = ((some - p) ** 2).sum(1)
            means = [d[labels == c].sum() / max((labels == c).sum() - (c == labels[i]), 1) for c in range(4)]
            a, b = means[labels[i]], min(m for c, m in enumerate(means) if c != labels[i])
            squared.append((b - a) / max(a, b))
        assert s.squared == pytest.approx(np.mean(squared))


def test_one_cluster_has_no_silhouette(spark):
    _, df = spread_blobs(spark, 60)
    fits, _ = lloyd.fit_together(df, [lloyd.Fit("north", (0, 1), 1)], FINAL_FEATURES, ["household_id"])
    assert lloyd.silhouettes_together(df, fits, FINAL_FEATURES, ["household_id"]) == [lloyd.Silhouette(None, None, None)]
