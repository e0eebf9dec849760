"""Exact order statistics and ranks for a few very large groups.

``F.percentile`` keeps every distinct value of a group in one buffer. That is
right for a household's year and wrong for a hemisphere, so the functions here
work by narrowing: a mergeable sketch proposes splitters, a counted pass tells
between which splitters a rank lies, and only that sliver is looked at again.
What reaches the driver is counts per splitter, never rows of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmeter.functions.expressions import array_of, names_of, nan_to_null
from rillmeter.session import materialise

#: A slice with at most this many rows is sorted inside one task.
DIRECT_ROWS = 250_000
#: Splitters proposed per pass, and the rank error (1/accuracy) of the sketch.
GRID = 1_000
ACCURACY = 10_000
#: Most (group, column) pairs the driver keeps brackets for.
MAX_SLICES = 20_000


def local_table(spark: SparkSession, columns: dict[str, list], ddl: str) -> DataFrame:
    """A driver-side table as a local relation, whose size Catalyst knows."""
    names = [part.split()[0] for part in ddl.split(", ")]
    empty = spark.createDataFrame([], ddl)
    if not columns or not columns[names[0]]:
        return empty
    return spark.createDataFrame(pa.table({n: columns[n] for n in names}), empty.schema)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form ``(ids..., column, value DOUBLE)`` of numeric columns, without NULL and NaN."""
    return (
        df.select(*ids, F.posexplode(array_of(columns)).alias("i", "value"))
        .where(nan_to_null(F.col("value")).isNotNull())
        .select(*ids, F.get(names_of(columns), F.col("i")).alias("column"), "value")
    )


def splitters_below(value: Column, splitters: Column, size: int) -> Column:
    """How many entries of a sorted array are below ``value`` (binary search)."""
    steps = [F.lit(1 << i) for i in reversed(range(max(size, 1).bit_length()))]
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda pos, step: F.when(F.get(splitters, pos + step - 1) < value, pos + step).otherwise(pos),
    )


def bucket_of(value: Column, splitters: Column, size: int) -> Column:
    """Even bucket: strictly between two splitters. Odd bucket: equal to a splitter."""
    below = splitters_below(value, splitters, size)
    equal = F.coalesce(F.get(splitters, below) == value, F.lit(False))
    return 2 * below + F.when(equal, 1).otherwise(0)


@dataclass
class _Slice:
    """Rows of one group and column between two values, and the ranks wanted from them."""

    group: tuple
    column: str
    lower: float
    upper: float
    before: int
    rows: int
    ranks: list[int] = field(default_factory=list)


def _group_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> list[tuple[tuple, str, int]]:
    """Known values per group and column; a group without any still counts, as zero."""
    cells = df.select(*by, F.posexplode(array_of(columns)).alias("i", "value"))
    rows = cells.groupBy(*by, "i").agg(F.count(nan_to_null(F.col("value"))).alias("n")).limit(MAX_SLICES + 1).collect()
    if len(rows) > MAX_SLICES:
        raise ValueError("too many groups for a global quantile; use percentile() per group")
    return [(tuple(r[b] for b in by), columns[r["i"]], r["n"]) for r in rows]


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _join_slices(
    df: DataFrame, by: Sequence[str], cells: DataFrame, slices: list[_Slice], extra: dict[str, list], extra_ddl: str
) -> DataFrame:
    """Cells inside each slice, with the slice number; the slice table is MAX_SLICES rows at most."""
    ddl = ", ".join([f"g_{b} {_type_of(df, b)}" for b in by] + ["slice INT", "g_column STRING", "lower DOUBLE", "upper DOUBLE"])
    data = {f"g_{b}": [s.group[i] for s in slices] for i, b in enumerate(by)}
    data |= {
        "slice": list(range(len(slices))),
        "g_column": [s.column for s in slices],
        "lower": [s.lower for s in slices],
        "upper": [s.upper for s in slices],
    } | extra
    table = local_table(df.sparkSession, data, f"{ddl}, {extra_ddl}" if extra_ddl else ddl)
    on = F.col("column") == F.col("g_column")
    for b in by:
        on &= F.col(b).eqNullSafe(F.col(f"g_{b}"))
    inside = (F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper"))
    return cells.join(F.broadcast(table), on & inside)


def _narrow(df: DataFrame, by: Sequence[str], cells: DataFrame, slices: list[_Slice], found: dict) -> list[_Slice]:
    """One round: propose splitters, count between them, keep the slivers that hold a wanted rank."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketched = (
        _join_slices(df, by, cells, slices, {}, "")
        .groupBy("slice")
        .agg(F.percentile_approx("value", grid, F.lit(ACCURACY)).alias("q"))
        .collect()
    )
    splitters: list[list[float]] = [[] for _ in slices]
    for row in sketched:
        s = slices[row["slice"]]
        near = {
            row["q"][min(max(math.floor((r - s.before) / s.rows * GRID) + d, 0), GRID)]
            for r in s.ranks
            for d in (-1, 0, 1, 2)
        }
        splitters[row["slice"]] = sorted(near)
    size = max(len(x) for x in splitters)
    counted = (
        _join_slices(df, by, cells, slices, {"splitters": splitters}, "splitters ARRAY<DOUBLE>")
        .withColumn("bucket", bucket_of(F.col("value"), F.col("splitters"), size))
        .groupBy("slice", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        .orderBy("slice", "bucket")
        .collect()
    )
    remaining = []
    before = {i: s.before for i, s in enumerate(slices)}
    for row in counted:
        s, start = slices[row["slice"]], before[row["slice"]]
        before[row["slice"]] = start + row["n"]
        ranks = [r for r in s.ranks if start <= r < start + row["n"]]
        if not ranks:
            continue
        if row["lo"] == row["hi"]:
            found.update({(s.group, s.column, r): row["lo"] for r in ranks})
        else:
            remaining.append(_Slice(s.group, s.column, row["lo"], row["hi"], start, row["n"], ranks))
    return remaining


def order_statistics(
    df: DataFrame, by: Sequence[str], wanted: dict[tuple[tuple, str], list[int]],
    counts: dict[tuple[tuple, str], int], direct_rows: int = DIRECT_ROWS,
) -> dict[tuple[tuple, str, int], float]:
    """Values at 0-based ranks, exact, keyed by ``(group, column, rank)``."""
    found: dict = {}
    inf = float("inf")
    slices = [
        _Slice(group, column, -inf, inf, 0, counts[group, column], sorted(set(ranks)))
        for (group, column), ranks in wanted.items() if ranks
    ]
    if not slices:
        return found
    cells = melt(df, by, sorted({s.column for s in slices}))
    while any(s.rows > direct_rows for s in slices):
        big = [s for s in slices if s.rows > direct_rows]
        small = [s for s in slices if s.rows <= direct_rows]
        slices = small + _narrow(df, by, cells, big, found)
    if slices:
        ranks = {"ranks": [[r - s.before for r in s.ranks] for s in slices]}
        picked = (
            _join_slices(df, by, cells, slices, ranks, "ranks ARRAY<INT>")
            .groupBy("slice")
            .agg(F.sort_array(F.collect_list("value")).alias("sorted"), F.first("ranks").alias("ranks"))
            .select("slice", F.transform("ranks", lambda r: F.get("sorted", r)).alias("picked"))
            .collect()
        )
        for row in picked:
            s = slices[row["slice"]]
            found.update({(s.group, s.column, r): v for r, v in zip(s.ranks, row["picked"])})
    return found


def exact_quantiles(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float], direct_rows: int = DIRECT_ROWS
) -> dict[tuple[tuple, str], list[float | None]]:
    """Linearly interpolated quantiles per group and column, exact at any size.

    NULLs are left out; a group without values yields ``None``. Groups must be
    few (labels, not households). Several passes read ``df``, so hand in a
    stored table rather than a long plan.
    """
    counts = {(g, c): n for g, c, n in _group_counts(df, by, columns)}
    wanted = {}
    for key, n in counts.items():
        positions = [p * (n - 1) for p in probs] if n else []
        wanted[key] = sorted({r for x in positions for r in (math.floor(x), math.ceil(x))})
    values = order_statistics(df, by, wanted, counts, direct_rows)
    out: dict = {}
    for (group, column), n in counts.items():
        row = []
        for p in probs:
            if not n:
                row.append(None)
                continue
            x = p * (n - 1)
            lo, hi = values[group, column, math.floor(x)], values[group, column, math.ceil(x)]
            row.append(lo + (hi - lo) * (x - math.floor(x)))
        out[group, column] = row
    return out


def quantile_table(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float], direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """:func:`exact_quantiles` as a small table ``(by..., column, quantiles ARRAY<DOUBLE>)``."""
    result = exact_quantiles(df, by, columns, probs, direct_rows)
    data = {b: [group[i] for group, _ in result] for i, b in enumerate(by)}
    data |= {"column": [c for _, c in result], "quantiles": list(result.values())}
    ddl = ", ".join([f"{b} {_type_of(df, b)}" for b in by] + ["column STRING", "quantiles ARRAY<DOUBLE>"])
    return local_table(df.sparkSession, data, ddl)


def _ranged(df: DataFrame, by: Sequence[str], ids: Sequence[str], columns: Sequence[str], partitions: int | None) -> DataFrame:
    """Cells dealt to a fixed number of value ranges by one range exchange, with what the driver adds up per range.

    The key of the row is the last part of the range key, so a value that holds many rows is spread over several
    ranges. Columns added: ``part`` (the range), ``before`` (rows of the group in former ranges), ``n`` (rows of the
    group), and for the least and the largest value of the range, which alone can go on in another, where its run begins and
    how long it is (``lo``, ``lo_before``, ``lo_rows``, ``hi``, ...). A range and group is one row on the driver.
    """
    names = [*by, "column"]
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = melt(df, [*by, *ids], columns).withColumn("value", F.col("value") + F.lit(0.0))  # one zero
    dealt = cells.repartitionByRange(partitions, *names, "value", F.xxhash64(*ids)).withColumn("part", F.spark_partition_id())
    ranged = materialise(dealt, "ranged")  # the ranges come from a sample: they must not be drawn twice
    keys = ["part", *names]
    ends = ranged.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("rows"))
    ends = materialise(ends, "range-ends")
    known = ranged.join(F.broadcast(ends), _same(ranged, ends, keys))
    runs = known.groupBy(*[ranged[k] for k in keys]).agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("rows").alias("rows"),
        F.count_if(F.col("value") == F.col("lo")).alias("at_lo"), F.count_if(F.col("value") == F.col("hi")).alias("at_hi"),
    )
    found = sorted((r.asDict() for r in runs.collect()), key=lambda r: r["part"])
    total: dict = {}
    begin: dict = {}
    length: dict = {}
    for r in found:
        group = tuple(r[k] for k in names)
        r["before"] = total.get(group, 0)
        total[group] = r["before"] + r["rows"]
        for end, count, start in (("lo", "at_lo", r["before"]), ("hi", "at_hi", total[group] - r["at_hi"])):
            if end == "hi" and r["hi"] == r["lo"]:
                continue
            begin.setdefault((group, r[end]), start)
            length[group, r[end]] = length.get((group, r[end]), 0) + r[count]
    for r in found:
        group = tuple(r[k] for k in names)
        r["n"] = total[group]
        for end in ("lo", "hi"):
            r[f"{end}_before"], r[f"{end}_rows"] = begin[group, r[end]], length[group, r[end]]
    more = ["before", "n", "lo_before", "lo_rows", "hi_before", "hi_rows"]
    ddl = ["part INT", *[f"{b} {_type_of(df, b)}" for b in by], "column STRING", "lo DOUBLE", "hi DOUBLE", *[f"{m} BIGINT" for m in more]]
    table = local_table(spark, {k: [r[k] for r in found] for k in [*keys, "lo", "hi", *more]}, ", ".join(ddl))
    return ranged.join(F.broadcast(table), _same(ranged, table, keys)).select(
        *[ranged[c] for c in ranged.columns], "lo", "hi", *more
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition &= left[k].eqNullSafe(right[k])
    return condition


def average_ranks(
    df: DataFrame, by: Sequence[str], ids: Sequence[str], columns: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """1-based ranks with ties averaged, long form ``(by..., ids..., column, value, rank)``.

    Rows are ordered inside value ranges, never in one partition per group; a run of equal values that crosses
    ranges is ranked as one. ``partitions``: number of ranges, by default that of shuffles.
    """
    order = Window.partitionBy("part", *by, "column").orderBy("value")
    inside = F.col("before") + (F.rank().over(order) + F.count(F.lit(1)).over(order)) / 2
    run = lambda end: F.col(f"{end}_before") + (F.col(f"{end}_rows") + 1) / 2
    return (
        _ranged(df, by, ids, columns, partitions)
        .withColumn("inside", inside)
        .select(
            *by, *ids, "column", "value",
            F.when(F.col("value") == F.col("lo"), run("lo")).when(F.col("value") == F.col("hi"), run("hi")).otherwise(F.col("inside")).alias("rank"),
        )
    )


def ordered_positions(
    df: DataFrame, by: Sequence[str], ids: Sequence[str], columns: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """1-based position of every row in value order (ties in any order), with the group size.

    Long form ``(by..., ids..., column, value, position, n)``.
    """
    order = Window.partitionBy("part", *by, "column").orderBy("value")
    return _ranged(df, by, ids, columns, partitions).withColumn("inside", F.row_number().over(order)).select(
        *by, *ids, "column", "value", (F.col("before") + F.col("inside")).alias("position"), "n"
    )
