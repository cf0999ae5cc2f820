"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_temporary: dict[str, str] = {}  # by application
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share. It has to be set, but where everything is one local process, which then gets a temporary one."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(app)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _temporary[app] = "file://" + tempfile.mkdtemp(prefix="quire-")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at; what is written there is deleted with the stored tables."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_sweep)
        _sweep_at_stop()
    _written.append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before this table. What was shuffled for it is deleted as soon as it is written. Tables are deleted by free(), and when the driver ends or the session stops.
    """
    path = new_folder(df.sparkSession, name)
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """What is run in here has its shuffle files deleted at its end; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def free(df: DataFrame) -> None:
    """Delete the table that store() wrote for `df`; of any other table nothing."""
    files = df.inputFiles()[:1]
    for entry in [x for x in _written if files and f"/{x[1].rsplit('/', 2)[1]}/" in files[0]]:
        _delete(*entry)
        _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    while _written:
        with contextlib.suppress(Exception):  # the JVM is gone: whoever owns the folder clears it
            _delete(*_written.pop())


def _sweep_at_stop() -> None:
    """Sweep when a session is stopped, as its JVM is needed for that."""
    stop = SparkSession.stop

    def swept(self):
        _sweep()
        stop(self)

    if not getattr(stop, "sweeps_scratch", False):
        swept.sweeps_scratch = True
        SparkSession.stop = swept
