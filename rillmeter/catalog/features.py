"""F: the ten behavioural features."""

from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import r, with_tables
from rillmeter.operators.features import extract_features
from rillmeter.operators.ranking import local_table
from rillmeter.schemas import FEATURES, KEYS
from rillmeter.session import materialise

_HID = "hemisphere, household_id"


def _one(name):
    def build(spark, sf_dir):
        return t.features(spark, sf_dir).select(*KEYS, name)

    return build


for _i, _name in enumerate(FEATURES):
    query(f"F{_i + 1}_{_name}", with_tables("features", f"SELECT {_HID}, {r(_name)} FROM feat"))(_one(_name))


@query("F_all_features", with_tables("features", f"SELECT {_HID}, {r(*FEATURES)} FROM feat"))
def all_features(spark, sf_dir):
    return t.features(spark, sf_dir)


@query("F11_fit_transform", with_tables("features", f"SELECT {_HID}, {r(*FEATURES)} FROM feat"))
def fit_transform(spark, sf_dir):
    fitted = materialise(t.flags(spark, sf_dir), "flags")
    p = t.panel(spark, sf_dir)
    return extract_features(p.household, p.usage, fitted)


@query(
    "F12_feature_names",
    with_tables(
        "features",
        " UNION ALL ".join(f"SELECT {i} AS position, '{f}' AS feature, count({f}) AS n_values FROM feat" for i, f in enumerate(FEATURES)),
    ),
)
def feature_names(spark, sf_dir):
    names = local_table(
        spark, {"position": list(range(len(FEATURES))), "feature": list(FEATURES)}, "position INT, feature STRING"
    )
    counts = t.features(spark, sf_dir).agg(*[F.count(f).alias(f) for f in FEATURES]).withColumn("whole", F.lit(1))
    return names.join(counts.unpivot(["whole"], list(FEATURES), "feature", "n_values").drop("whole"), "feature").select(
        "position", "feature", "n_values"
    )
