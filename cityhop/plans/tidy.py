"""Output normalisation for cross-engine comparison.

Compared results use only STRING, BIGINT and DOUBLE rounded to 6 digits;
dates become ``yyyy-MM-dd`` and instants ``yyyy-MM-dd HH:mm:ss`` (UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityhop.functions.timefmt import instant_to_local


def tidy(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.TimestampType):
            c = instant_to_local(c, F.lit("UTC")).cast("string")
        elif isinstance(t, T.TimestampNTZType):
            c = c.cast("string")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)
