"""Bounds of what Python workers are sent at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTES, OUR_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on its session sends Arrow batches of about OUR_BYTES, unless it was told a size: 10,000
    rows of whole texts, which Spark sends else, grow with the texts."""
    conf = df.sparkSession.conf
    if conf.get(BYTES, None) is None:
        conf.set(BYTES, str(OUR_BYTES))
    return df
