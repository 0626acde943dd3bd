"""Size of the batches in which rows go to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

RECORDS = 1_000


def short_batches(df: DataFrame) -> DataFrame:
    """Texts are long rows: send fewer of them at a time than Spark does by default, unless the session asks for fewer still."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= RECORDS:
        conf.set(key, str(RECORDS))
    return df
