"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
FLOATING = (T.FloatType, T.DoubleType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> Column:
    """Column by exact name, even when the name holds dots or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value: str | Column) -> Column:
    return q(value) if isinstance(value, str) else value


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; NULL when the quotient is not a finite number."""
    return finite(F.try_divide(as_column(a).cast("double"), as_column(b).cast("double")))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One meaning of "missing": NaN in float columns becomes NULL."""
    return df.select(
        *[
            F.when(~F.isnan(q(f.name)), q(f.name)).alias(f.name)
            if isinstance(f.dataType, FLOATING)
            else q(f.name)
            for f in df.schema.fields
        ]
    )


def right_closed_index(x: Column, edges: Sequence[float]) -> Column:
    """Bin number of x among right-closed bins whose first edge is included."""
    below = [F.when(x > F.lit(e), 1).otherwise(0) for e in edges[1:-1]]
    index = sum(below, F.lit(0))
    return F.when(x.isNotNull() & (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), index)


def left_closed_index(x: Column, splits: Sequence[float]) -> Column:
    """Bin number of x among left-closed bins; NULL stays NULL."""
    return F.when(x.isNotNull(), sum([F.when(x >= F.lit(s), 1).otherwise(0) for s in splits], F.lit(0)))


def by_index(index: Column, labels: Sequence[str], default: str | None = None) -> Column:
    """Text for a bin number."""
    out = F.when(index == 0, labels[0]) if labels else F.when(F.lit(False), "")
    for i, label in enumerate(labels[1:], start=1):
        out = out.when(index == i, label)
    return out if default is None else out.otherwise(default)


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown, as a byte so that it never becomes a numeric feature."""
    return F.when(condition, 1).otherwise(0).cast("byte")


def key_hash(*keys: str) -> Column:
    """Non-negative pseudo-random number of a row key, stable under repartitioning."""
    return F.pmod(F.xxhash64(*[q(k) for k in keys]), F.lit(2147483647))


def hours_between(a: str | Column, b: str | Column) -> Column:
    def micros(c: str | Column) -> Column:
        return F.unix_micros(as_column(c).cast("timestamp"))

    return F.abs(micros(a) - micros(b)) / F.lit(3.6e9)


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: Pearson r over rows where both are present; NULL when either is constant."""
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), spread)
