"""What an operator needs from the cluster: shared storage and code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a staged job hands to a Python worker at once.
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()
#: Staged tables that are still there, by path, in the order of their making.
_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests), a folder of this driver.

    Raises where it is unset and executors run elsewhere: they could not see
    a folder of the driver.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "spantable-shared"))
    return sc._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. What is there goes when the driver's JVM ends, if not freed before."""
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    _staged[path] = spark
    return path


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within, rows go to Python workers in batches of about `size` bytes at most; both sides hold one or two of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage with a copy that survives the loss of executors, keeps
    column pruning for later readers, and gives the planner the true size, so
    that it broadcasts a small table and shuffles a large one. The table goes
    at the end of the scratch() around it, or with the driver's JVM.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with batches_of(spark, BATCH_BYTES):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def free(*tables: DataFrame | str | None) -> None:
    """Delete staged tables, given as stage() returned them or by path; others are left alone."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_staged_at", None)
        spark = _staged.pop(path, None)
        if spark is not None:
            fs, p = _path(spark, path)
            fs.delete(p, True)


def staged() -> list[str]:
    """Paths of all staged tables that are still there."""
    return list(_staged)


@contextmanager
def scratch() -> Iterator[list]:
    """Tables staged inside are freed at the end, but for those appended to the list that this yields."""
    before, keep = set(_staged), []
    try:
        yield keep
    finally:
        kept = {getattr(t, "_staged_at", t) for t in keep}
        free(*[p for p in list(_staged) if p not in before and p not in kept])


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers (once per application)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # executors fetch the archive from the driver while the application runs
    folder = tempfile.mkdtemp(prefix="spantable-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "spantable.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "spantable")):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(at, x), os.path.relpath(os.path.join(at, x), root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
