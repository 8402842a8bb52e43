"""Tables written once in the folder that driver and executors share, and read again.

A node table that many steps read is written rather than cached: plans stay small, filters reach the scan, and a lost
executor costs its running tasks only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[tuple, tuple[SparkSession, str, DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local session without the setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="arbordf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/arbordf-tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written at the first call with this key in the session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _TABLES:
        path, df = shared_folder(spark), build()
        df.write.parquet(path)
        _TABLES[key] = spark, path, spark.read.schema(df.schema).parquet(path)
    return _TABLES[key][2]


def release(spark: SparkSession) -> None:
    """Delete the tables this session's application has written."""
    for key, (own, path, _) in list(_TABLES.items()):
        if key[0] == spark.sparkContext.applicationId:
            jvm = own.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            del _TABLES[key]


@atexit.register
def _release_all() -> None:
    for spark, _, _ in list(_TABLES.values()):
        if spark.sparkContext._jsc is not None:
            try:
                release(spark)
            except Exception:  # the JVM may be gone at interpreter exit
                pass
