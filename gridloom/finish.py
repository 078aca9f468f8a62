"""Output columns that compare alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finish(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Whole numbers as BIGINT, floating ones rounded (and never -0), times as dates in text."""
    out = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType
        x = F.col(c)
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            x = F.round(x.cast("double"), digits) + 0.0
        elif isinstance(kind, T.IntegralType):
            x = x.cast("long")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            x = F.date_format(x, "yyyy-MM-dd 00:00:00")
        out.append(x.alias(c))
    return df.select(*out)


def r(expression: str, name: str, digits: int = 9) -> str:
    """The same rounding in SQL."""
    return f"round(({expression})::double, {digits}) + 0.0 {name}"


def t(expression: str, name: str = "time") -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') {name}"


def n(expression: str, name: str | None = None) -> str:
    return f"({expression})::bigint {name or expression}"
