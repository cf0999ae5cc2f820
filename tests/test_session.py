"""How tables are dealt out over tasks."""

from pyspark.sql import functions as F

from quire.session import PART, table


def test_fine_parts_grow_in_number_with_the_table(spark, tmp_path):
    spark.range(4_000_000).select("id", F.rand(1).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    cores = spark.sparkContext.defaultParallelism
    df = table(spark, str(tmp_path), "t", fine=True)
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    assert size // PART > cores and df.rdd.getNumPartitions() >= min(size // PART, 8 * cores)
    assert df.count() == 4_000_000 and table(spark, str(tmp_path), "t").rdd.getNumPartitions() >= cores
