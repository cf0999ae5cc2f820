"""Session defaults for local runs and tests; on a cluster the submitter's own settings win."""

from pyspark.sql import SparkSession

LOCAL = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.shuffle.partitions": "8",
}


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A `local[cpus]` session with LOCAL settings; keyword arguments (dots written as `__`) override them."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quire")
    for key, value in (LOCAL | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables of less than this many bytes are left in the partitions in which they are read; fine parts are of so many bytes, of which there are so many a core at the most.
SMALL, PART, PARTS = 1 << 20, 2 << 20, 8


def table(spark: SparkSession, sf_dir: str, name: str, fine: bool = False):
    """The Parquet table `name` of a data folder, by Spark's own reader (any file system).

    A file of one row group is read by one task, whatever the number of cores. Where a table has fewer partitions than there are
    cores it is dealt out over them; a table of many files or row groups is left as it is, so at scale nothing is shuffled here.
    `fine`: for rows that cost much more than their reading: dealt out in parts of PART bytes, PARTS a core at the most, so that no task gets a core's share of a larger table in one piece.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(max(cores, size // PART), cores * PARTS) if fine else cores
    if df.rdd.getNumPartitions() < parts and size >= SMALL:
        df = df.repartition(parts)
    return df
