"""Session helpers: checkpoint folder, written intermediates, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a per-day table that may be broadcast (ten years, both hemispheres).
DAY_TABLE_LIMIT = 7_320


#: Settings the package is tuned for; a cluster session should carry them too. The
#: last one lets a task gather this many household years before it sorts instead.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def local_session(cores: int | str = "*", app: str = "rillmeter", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster job brings its own session."""
    width = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rillmeter-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/rillmeter/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used before iterative work: it cuts the lineage, survives lost executors
    and, being Parquet, lets later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = DAY_TABLE_LIMIT, known_rows: int | None = None) -> DataFrame:
    """Hint ``df`` for broadcast only if it has at most ``max_rows`` rows.

    ``known_rows`` is a bound the caller can prove; without one the rows are
    counted (at most ``max_rows + 1`` of them). Beyond the limit the table is
    returned unhinted and the join shuffles both sides.
    """
    rows = df.limit(max_rows + 1).count() if known_rows is None else known_rows
    return F.broadcast(df) if rows <= max_rows else df


def pin_small(df: DataFrame, max_rows: int = DAY_TABLE_LIMIT) -> DataFrame:
    """Compute a small table once and hint it for broadcast as a local relation.

    For per-group statistics that the same rows are joined back to. A table
    with more than ``max_rows`` rows is returned as it is, unhinted.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
