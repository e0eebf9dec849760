"""Column expressions shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound ``x``; NULL and NaN pass through (``greatest``/``least`` would replace them)."""
    out = x
    if lower is not None:
        out = F.when(out < F.lit(lower), F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when((out > F.lit(upper)) & ~F.isnan(out), F.lit(upper)).otherwise(out)
    return out


def guarded_ratio(numerator: Column, denominator: Column, default: float) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``default``.

    A NULL denominator (no rows behind it) takes the default as well.
    """
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default))


def nan_to(x: Column, default: float) -> Column:
    """Replace NaN and NULL."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(default))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    """Map labels to numbers through a literal map; unknown labels take ``default``."""
    pairs = [F.lit(item) for entry in table.items() for item in entry]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def one_hot(df: DataFrame, column: str, levels: Iterable[str], drop_first: bool = True) -> DataFrame:
    """Add one 0/1 column per level, named ``column_level``; levels sort ascending."""
    kept = sorted(levels)[1 if drop_first else 0:]
    return df.withColumns(
        {f"{column}_{level}": F.when(F.col(column) == level, 1).otherwise(0) for level in kept}
    )


def select_distinct_names(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Select ``names`` keeping the first of every repeated name."""
    return df.select(*dict.fromkeys(names))


def strip_prefixes(df: DataFrame, separator: str = "__") -> DataFrame:
    """Rename ``step__name`` columns to ``name``."""
    return df.withColumnsRenamed({c: c.split(separator)[-1] for c in df.columns if separator in c})


def cast_to(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Select the named columns, cast to the declared types."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def publish_float(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Down-cast computed columns to float32 for publication."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def rounded(x: Column, digits: int = 6) -> Column:
    """Round for publication; negative zero becomes zero, as adding zero makes it."""
    return F.round(x, digits) + F.lit(0.0)


def array_of(columns: Iterable[str], element: str = "DOUBLE") -> Column:
    """The columns as one array. Written as SQL text: wide tables make hundreds of column objects costly."""
    return F.expr(f"CAST(array({', '.join(f'`{c}`' for c in columns)}) AS ARRAY<{element}>)")


def names_of(columns: Iterable[str]) -> Column:
    """The column names as a literal array."""
    return F.expr("array(" + ", ".join(f"'{c}'" for c in columns) + ")")
