"""The fitted steps as Spark ML stages: scaler, variance filter, k-means with archetypes, in one savable pipeline.

Estimators fit on a DataFrame of unscaled features of both hemispheres; what they fit is a few numbers per hemisphere and
column, held as params, so a ``PipelineModel`` of them is written and read by Spark ML's own writers and a new session
loads it as one object.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmeter.functions.calendar import env_flags
from rillmeter.operators.clustering import CLUSTERS, TRAINING_SEED, centroid_table, name_archetypes, train_models
from rillmeter.operators.ranking import local_table
from rillmeter.operators.scaling import PARAMS_DDL, fit_scaler, scale
from rillmeter.operators.scoring import ANOMALY_DISTANCE, load_scorer, score_profiles, training_bounds
from rillmeter.operators.selection import VARIANCE_THRESHOLD, keep_columns, reduce_collinear, variance_table
from rillmeter.schemas import FINAL_FEATURES, SCALED_ORDER
from rillmeter.session import materialise


class _Fitted(Params):
    """A small fitted table as a param: its columns as JSON lists."""

    fitted = Param(Params._dummy(), "fitted", "columns of the fitted table", TypeConverters.toString)

    def _keep(self, table: DataFrame):
        held = table.toArrow().to_pydict()  # one row per hemisphere and column, cluster or day
        return self._set(fitted=json.dumps(held))

    def _rows(self, spark: SparkSession, ddl: str) -> DataFrame:
        return local_table(spark, json.loads(self.getOrDefault(self.fitted)), ddl)


class DayFlagsModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Day masks learned from the weather; marks readings, leaving out days the weather does not know."""

    ddl = Param(Params._dummy(), "ddl", "columns of the day table", TypeConverters.toString)

    def table(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, self.getOrDefault(self.ddl))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(F.broadcast(self.table(dataset.sparkSession)), ["hemisphere", "day_index"])


class DayFlags(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`DayFlagsModel` on the weather table, a row per hemisphere and day."""

    def _fit(self, dataset: DataFrame) -> DayFlagsModel:
        flags = env_flags(dataset)
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flags.schema)
        return DayFlagsModel()._set(ddl=ddl)._keep(flags)


class ScalerModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Robust and power scaling by fitted centres, spreads and lambdas per hemisphere."""

    def table(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, PARAMS_DDL)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return scale(dataset, self.table(dataset.sparkSession))


class Scaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`ScalerModel`. Several passes read the dataset, so it is stored first."""

    def _fit(self, dataset: DataFrame) -> ScalerModel:
        return ScalerModel()._keep(fit_scaler(materialise(dataset, "unscaled")))


class VarianceMaskModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the columns that no hemisphere keeps, and blanks a column where its own does not."""

    def table(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "hemisphere STRING, column STRING, variance DOUBLE, kept BOOLEAN")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = json.loads(self.getOrDefault(self.fitted))
        kept: dict[str, list[str]] = {h: [] for h in held["hemisphere"]}
        for h, c, yes in zip(held["hemisphere"], held["column"], held["kept"]):
            if yes:
                kept[h].append(c)
        return keep_columns(dataset, kept, [c for c in SCALED_ORDER if c in dataset.columns])


class VarianceMask(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`VarianceMaskModel` with a ``threshold`` on the population variance."""

    threshold = Param(Params._dummy(), "threshold", "least variance of a column that stays", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, threshold: float = VARIANCE_THRESHOLD) -> None:
        super().__init__()
        self._setDefault(threshold=VARIANCE_THRESHOLD)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VarianceMaskModel:
        columns = [c for c in SCALED_ORDER if c in dataset.columns]
        return VarianceMaskModel()._keep(variance_table(dataset, columns, self.getOrDefault(self.threshold)))


class FinalFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the collinear columns."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return reduce_collinear(dataset)


class ArchetypesModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Named centroids and training bounds; scores profiles by the nearest one."""

    bounds = Param(Params._dummy(), "bounds", "columns of the training bounds", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "distance beyond which a profile is an anomaly", TypeConverters.toFloat)

    def table(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "hemisphere STRING, cluster_id INT, centroid ARRAY<DOUBLE>, archetype STRING")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        bounds = local_table(spark, json.loads(self.getOrDefault(self.bounds)), "hemisphere STRING, feature STRING, lower DOUBLE, upper DOUBLE")
        return score_profiles(dataset, load_scorer(self.table(spark), bounds), self.getOrDefault(self.threshold))


class Archetypes(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`ArchetypesModel`: k-means per hemisphere, clusters named by their centroids."""

    k = Param(Params._dummy(), "k", "clusters of a hemisphere", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the first start", TypeConverters.toInt)
    starts = Param(Params._dummy(), "starts", "starts of which the best counts", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "distance beyond which a profile is an anomaly", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, k: int = CLUSTERS, seed: int = TRAINING_SEED, starts: int = 1, threshold: float = ANOMALY_DISTANCE) -> None:
        super().__init__()
        self._setDefault(k=CLUSTERS, seed=TRAINING_SEED, starts=1, threshold=ANOMALY_DISTANCE)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ArchetypesModel:
        spark = dataset.sparkSession
        final = materialise(dataset, "final")
        models = train_models(final, FINAL_FEATURES, *(self.getOrDefault(p) for p in (self.k, self.seed, self.starts)))
        centroids = name_archetypes(centroid_table(spark, models)).select("hemisphere", "cluster_id", "centroid", "archetype")
        bounds = training_bounds(final).toArrow().to_pydict()  # one row per hemisphere and feature
        return ArchetypesModel()._set(bounds=json.dumps(bounds), threshold=self.getOrDefault(self.threshold))._keep(centroids)


def archetype_pipeline(k: int = CLUSTERS, seed: int = TRAINING_SEED, starts: int = 1) -> Pipeline:
    """From unscaled features to archetypes: fit, save and load as one object."""
    return Pipeline(stages=[Scaler(), VarianceMask(), FinalFeatures(), Archetypes(k=k, seed=seed, starts=starts)])
