"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so both engines print the same value."""
    return df.select(
        *[
            (F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
