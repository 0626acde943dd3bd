"""Results that several later steps read, written once to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clickloom.session import fresh_dir


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str, drop_shuffles: bool = False) -> DataFrame:
    """Write the rows as parquet under the shared folder and read them back.

    This cuts the lineage, survives lost executors, and lets each reader take only its columns. With ``drop_shuffles`` the shuffle
    files of the write are removed with its end, not whenever the driver collects its garbage.
    """
    path, conf = fresh_dir(df.sparkSession, purpose), df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES)
    conf.set(DROP_SHUFFLES, str(drop_shuffles or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
