"""Session defaults; a caller's own session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "quirelake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; ``partitions`` only where the cluster's default does not fit."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
