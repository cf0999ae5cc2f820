"""What the training-data operators share: the shared folder, written intermediate tables, row packing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_temporary: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share. It has to be set, but where everything is one local process, which then gets a temporary one."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(app)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _temporary[app] = "file://" + tempfile.mkdtemp(prefix="quire-")
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before this table. Tables are deleted by free(), and when the driver ends or the session stops.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep)
        _sweep_at_stop()
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


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

    if not getattr(stop, "sweeps", False):
        swept.sweeps = True
        SparkSession.stop = swept


def with_outputs(row: str, df: DataFrame, **out: Column) -> DataFrame:
    """The fields of struct column `row`, then `out`; an output replaces an input column of the same name."""
    fields = [f for f in df.schema[row].dataType.names if f.lower() not in {k.lower() for k in out}]
    return df.select(*[F.col(row)[f].alias(f) for f in fields], *[c.alias(k) for k, c in out.items()])


def unclashed(columns: list[str], outputs: tuple[str, ...]) -> list[str]:
    """The columns that no output replaces (names are compared without case, as Spark does)."""
    return [c for c in columns if c.lower() not in {o.lower() for o in outputs}]


def commonest(counts: DataFrame, most: int, top: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(the rows with the highest `n`, the rest): all rows with some least `n` or more, `most` at the most.

    Counts from `top` on are alike. The driver gets the number of rows for each count up to `top`.
    """
    at = F.least("n", F.lit(top))
    rows = {r["n"]: r["rows"] for r in counts.groupBy(at.alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    least, held = top + 1, 0
    for n in sorted(rows, reverse=True):
        held += rows[n]
        if held > most:
            break
        least = n
    return counts.where(at >= least), counts.where(at < least)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", merge: bool = False) -> DataFrame:
    """Equi-join on long columns `keys` that AQE can split where a key is hot.

    `right` often comes out of an aggregation on the same keys; joining on the
    keys as they are would reuse that partitioning, and then no partition could
    be split. Joining on their complements makes Spark deal out both sides anew.
    `merge` asks for a shuffled join whatever the size of `right`, for tables that grow with the input.
    """
    turned = {f"_turned{i}": F.bitwise_not(F.col(k)) for i, k in enumerate(keys)}
    other = right.withColumns(turned).drop(*keys)
    return left.withColumns(turned).join(other.hint("merge") if merge else other, list(turned), how).drop(*turned)


def slices(batch, column: str, most: int = 8 << 20):
    """Consecutive slices of an Arrow batch whose `column` holds about `most` bytes at the most, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def map_texts(docs: DataFrame, work, outputs: dict[str, str], text_col: str = "text", carry: list[str] | None = None, most: int = 8 << 20) -> DataFrame:
    """Run `work(texts)` over slices of about `most` bytes of the texts in Arrow batches and add its columns.

    `work` is made once a task by calling it without arguments and then gets
    lists of strings (None for null) and returns {column: list or Arrow array}.
    `carry`: the input columns to keep (default: all).
    """
    from pyspark.sql.types import StructType

    carry = docs.columns if carry is None else carry
    packed = docs.select(F.col(text_col).alias("_text"), F.struct(*carry, F.lit(0).alias("_pad")).alias("_row"))
    names = list(outputs)
    schema = StructType([packed.schema["_row"], *StructType.fromDDL(", ".join(f"_o_{n} {kind}" for n, kind in outputs.items())).fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        do = work()
        for batch in batches:
            for part in slices(batch, "_text", most):
                got = do(part.column("_text").to_pylist())
                cols = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], kinds.field(f"_o_{n}").type) for n in names]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *cols], names=["_row", *[f"_o_{n}" for n in names]])

    out = packed.mapInArrow(run, schema)
    return with_outputs("_row", out, **{n: F.col(f"_o_{n}") for n in names}).drop("_pad")
