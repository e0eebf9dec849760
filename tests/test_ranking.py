import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillmeter.operators.correlation import pearson, spearman
from rillmeter.operators.ranking import average_ranks, exact_quantiles, ordered_positions
from rillmeter.operators.sampling import sample_per_group, sample_rows

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One value holds a third of the rows, two neighbours another fifth, and outliers are far off."""
    rng = np.random.default_rng(0)
    n = 6000
    x = rng.normal(size=n)
    x[:2000], x[2000:2600], x[2600:3200], x[3200:3205] = 0.25, 0.5, 0.75, 1e12
    pdf = pd.DataFrame(
        {"g": np.where(np.arange(n) % 3 == 0, "a", "b"), "id": np.arange(n), "x": x, "y": rng.integers(0, 5, n).astype(float)}
    )
    df = spark.createDataFrame(pdf).persist()
    yield pdf, df
    df.unpersist()


@pytest.mark.parametrize("direct_rows", [10**6, 300, 10])
def test_quantiles_equal_numpy_however_often_they_narrow(skewed, direct_rows):
    pdf, df = skewed
    for (group, column), values in exact_quantiles(df, ["g"], ["x", "y"], PROBS, direct_rows).items():
        assert np.allclose(values, np.quantile(pdf[pdf.g == group[0]][column], PROBS), rtol=1e-12, atol=0)


def test_quantiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([("a", None), ("b", 3.0)], "g STRING, x DOUBLE")
    assert exact_quantiles(df, ["g"], ["x"], [0.5]) == {(("a",), "x"): [None], (("b",), "x"): [3.0]}


@pytest.mark.parametrize("partitions", [1, 13, 120])
def test_ranks_equal_pandas(skewed, partitions):
    pdf, df = skewed
    ranks = average_ranks(df, ["g"], ["id"], ["x", "y"], partitions).toPandas()
    for column in ("x", "y"):
        got = ranks[ranks.column == column].set_index("id")["rank"].sort_index()
        assert (got.to_numpy() == pdf.groupby("g")[column].rank().to_numpy()).all()


@pytest.mark.parametrize("partitions", [1, 13, 120])
def test_positions_are_a_permutation_in_value_order(skewed, partitions):
    _, df = skewed
    placed = ordered_positions(df, ["g"], ["id"], ["x", "y"], partitions).toPandas()
    for _, part in placed.groupby(["g", "column"]):
        part = part.sort_values("position")
        assert part.position.tolist() == list(range(1, len(part) + 1))
        assert (np.diff(part.value) >= 0).all() and (part.n == len(part)).all()


def test_runs_of_equal_values_cross_ranges(spark):
    """Every value is one of three, and the ranges are more: ranks and positions go on from range to range."""
    df = spark.range(900).select(F.lit(None).cast("string").alias("g"), "id", (F.col("id") % 3).cast("double").alias("x"))
    df = df.withColumn("x", F.when(F.col("id") == 0, -0.0).otherwise(F.col("x")))
    ranks = {(r["x"], r["rank"]) for r in average_ranks(df, ["g"], ["id"], ["x"], 40).selectExpr("value AS x", "rank").collect()}
    assert ranks == {(0.0, 150.5), (1.0, 450.5), (2.0, 750.5)}
    placed = ordered_positions(df, ["g"], ["id"], ["x"], 40).collect()
    assert sorted(r["position"] for r in placed) == list(range(1, 901)) and {r["n"] for r in placed} == {900}
    assert all(r["value"] == (r["position"] - 1) // 300 for r in placed)
    assert average_ranks(df.limit(0), ["g"], ["id"], ["x"]).collect() == []


def test_co_moments_of_parts_merge(spark):
    """However rows are dealt to tasks: gaps, a third of them far from zero, a group under NULL, sides constant where both are known."""
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3)) + [1e6, 0.0, 3.0]
    x[:, 1] += x[:, 0]
    rows = [(["a", None][i % 2], *[None if r.random() < 0.2 else float(v) for v in p], 4.0 if i % 5 else None) for i, p in enumerate(x)]
    rows += [("b", 1.0, 2.0, None, 5.0), ("b", 1.0, 3.0, None, 6.0), ("b", 2.0, None, None, 7.0)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE, z DOUBLE, c DOUBLE")
    for parts in (1, 7, 60):
        found = {(v["g"], v["a"], v["b"]): v["r"] for v in pearson(df.repartition(parts), ["x", "y", "z", "c"], ["g"]).collect()}
        assert len(found) == 48
        for g in ("a", None):
            own = pd.DataFrame([v[1:4] for v in rows if v[0] == g], columns=["x", "y", "z"], dtype=float)
            for a in "xyz":
                for b in "xyz":
                    assert found[g, a, b] == pytest.approx(own[a].corr(own[b]), abs=1e-8)
            assert found[g, "x", "c"] is None and found[g, "c", "c"] is None
        assert found["b", "x", "y"] is None and found["b", "x", "z"] is None  # x is 1 wherever y is known
        assert found["b", "y", "c"] == pytest.approx(1.0)
    assert pearson(df.limit(0), ["x", "y"], ["g"]).collect() == []


def test_correlations_equal_pandas(skewed):
    pdf, df = skewed
    for ours, method in ((pearson(df, ["x", "y"], ["g"]), "pearson"), (spearman(df, ["x", "y"], ["id"], ["g"], 30), "spearman")):
        rows = {(r["g"], r["a"], r["b"]): r["r"] for r in ours.collect()}
        assert len(rows) == 8
        for g, part in pdf.groupby("g"):
            assert rows[g, "x", "y"] == pytest.approx(part[["x", "y"]].corr(method).iloc[0, 1], abs=1e-9)
            assert rows[g, "y", "x"] == rows[g, "x", "y"] and rows[g, "x", "x"] == pytest.approx(1.0)


def test_correlation_with_gaps_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 4.5, 5.0), ("a", 3.0, 5.0, 5.0), ("a", 9.0, None, 5.0)], "g STRING, x DOUBLE, y DOUBLE, c DOUBLE")
    rows = {(r["a"], r["b"]): r["r"] for r in pearson(df, ["x", "y", "c"], ["g"]).collect()}
    assert rows["x", "y"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1])
    assert rows["x", "c"] is None and rows["c", "c"] is None


def test_sample_is_exact_and_independent_of_partitions(skewed):
    _, df = skewed
    first = sorted(r["id"] for r in sample_rows(df, ["id"], 100, 7).collect())
    again = sorted(r["id"] for r in sample_rows(df.repartition(11, F.rand(1)), ["id"], 100, 7).collect())
    assert len(set(first)) == 100 and first == again
    assert first != sorted(r["id"] for r in sample_rows(df, ["id"], 100, 8).collect())
    assert sample_per_group(df, "g", ["a", "b"], ["id"], 50).count() == 100
    assert sample_rows(df, ["id"], 10**6).count() == 6000


def test_sample_of_a_large_table_is_cut_first_and_stays_the_same(spark):
    df = spark.range(50_000)
    chosen = sorted(r["id"] for r in sample_rows(df, ["id"], 40, 3).collect())
    token = F.md5(F.concat_ws("|", F.lit("3"), F.col("id").cast("string")))
    assert chosen == sorted(r["id"] for r in df.orderBy(token).limit(40).collect())


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", float("nan")), ("g", None)], "g string, x double")
    for rows in (250_000, 1):
        assert exact_quantiles(df, ["g"], ["x"], [0.5], direct_rows=rows) == {(("g",), "x"): [1.5]}
