"""Session settings that the library's jobs assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for calendar work, AQE for runtime re-planning; nothing here grows with the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark script; on a cluster use the cluster's own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cairnlake")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
