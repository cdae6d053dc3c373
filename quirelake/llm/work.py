"""Shared working tables.

Intermediate results are written as Parquet under ``spark.checkpoint.dir``, which every executor and
the driver share, so a lost executor costs a re-read and never a broken lineage.  Only where that
setting is absent (unit tests on one machine) a temporary folder is chosen instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_SCOPES: list[list[str]] = []
#: While a table is stored: shuffle files go when its query ends, since the table doesn't need them any more; and joins
#: hash instead of sorting where every partition of the smaller side has turned out to fit.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session: ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="quirelake-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder under the shared one; the folder goes when the driver's JVM ends."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quirelake-{spark.sparkContext.applicationId}")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        store.mkdirs(root)
        store.deleteOnExit(root)
    path = f"{store.makeQualified(root).toString()}/{name}-{uuid.uuid4().hex[:12]}"  # with its scheme, for readers outside the JVM
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go at the end, but for those stored with ``outer``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and pins non-repeatable choices."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if len(_SCOPES) > outer:
        _SCOPES[-1 - outer].append(path)
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
