"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITIONS = "spark.unveil.input.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals ``df`` over as many partitions as the session setting
    ``spark.unveil.input.partitions`` says, by hash of ``keys`` or round-robin.

    Unset (the default) leaves the layout of the scan alone. The setting is
    for inputs that come in fewer splits than there are cores, such as one
    small Parquet file; nothing here looks at the data.
    """
    parts = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(parts), *keys) if parts else df
