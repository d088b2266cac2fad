"""Cutting lineage through tables written to the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder.  It is read from the session; only where a session does
not set it (unit tests, a laptop) is a temporary local folder chosen, and only in local mode.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="corpusmill-ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables, without a trailing slash."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="corpusmill-")
    return _own[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below :func:`shared_dir`, removed when the session's process ends."""
    path = f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def local_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder of the shared mount, as a path of the operating system."""
    path = new_dir(spark, label)
    return "/" + path.removeprefix("file:").lstrip("/")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet and return it reread: what follows does not depend on executors."""
    spark = df.sparkSession
    ship_package(spark)
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> Iterator[None]:
    """Within it, jobs hand rows to Python in batches of at most ``rows`` rows and about ``size`` bytes.

    For operators whose rows are large; what is not run within it, such as a result that is still lazy, is not
    concerned, and the session's own settings are put back.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt_out(df: DataFrame, by: str, rows: int = 20_000) -> DataFrame:
    """Narrow rows on which there is much work, with about ``rows`` of them a task, whatever the splits of their files."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, by) if tasks > 1 else df


def join_side(table: DataFrame, most: int) -> DataFrame:
    """A staged table of narrow rows as a side of a join: broadcast if it is counted to have at most ``most`` rows,
    else left to a shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def release(spark: SparkSession) -> None:
    """Remove every staged table of this session (results that still read them become invalid)."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            release(spark)
        except Exception:  # the JVM may already be gone
            pass
