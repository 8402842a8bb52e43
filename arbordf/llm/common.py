"""Shared folders, table reading and small helpers used by every operator in this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session leaves it unset (tests) a temporary folder is chosen once and stored in the session, so later
    calls agree. On a cluster executors would not see such a folder: there the setting is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="arbordf-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/arbordf-{spark.sparkContext.applicationId}"
    _ROOTS.setdefault(root, spark)
    return root


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables materialised inside are deleted at the end, but for those marked ``keep``: what leaves the scope must
    rest on kept ones alone."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def materialize(df: DataFrame, tag: str, keep: bool = False, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs its running tasks only, as finished parts lie in shared storage. The commit
    protocol keeps partial output of failed or speculative tasks out of the table.
    """
    path = fresh_path(df.sparkSession, tag)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this session materialised."""
    delete(spark, shared_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _release_all() -> None:
    for root, spark in _ROOTS.items():
        if spark.sparkContext._jsc is not None:
            try:
                delete(spark, root)
            except Exception:  # the JVM may be gone at interpreter exit
                pass


def text_runs(texts, limit: int):
    """(index of the first text, list of texts) for runs of at most ``limit`` bytes, or one longer text.

    ``texts`` is an Arrow string array or a list; of an array only one run at a time becomes Python strings, and null
    counts as empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    array = texts if isinstance(texts, pa.Array) else None
    sizes = pc.fill_null(pc.binary_length(array), 0).to_pylist() if array is not None else [len(t or "") for t in texts]
    start = size = 0
    for i, n in enumerate([*sizes, limit + 1]):
        if i > start and size + n > limit:
            yield start, [t or "" for t in (array.slice(start, i - start).to_pylist() if array is not None else texts[start:i])]
            start, size = i, 0
            pa.default_memory_pool().release_unused()
        size += n
