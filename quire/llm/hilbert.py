"""Sharding in Hilbert order of quantised metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import skew_join, store, unclashed

#: Bits of each dimension.
BITS = 6
#: Groups of equal texts with more than 1/WHOLE of a shard's bytes are cut between shards; smaller ones stay together.
WHOLE = 20
#: Rows of a group that are numbered together, and the most parts in which a group is numbered.
SALTED, SALTS = 4096, 4096


def hilbert_index(dims: list, bits: int = BITS):
    """Index on the Hilbert curve through a cube of 2**bits cells a side; `dims`: arrays of cell numbers, one per dimension.

    Walks down the levels of the curve: at each, the bits of the coordinates, with the exchanges and inversions
    of the levels above undone, are the Gray code of the next digit of the index.
    """
    import numpy as np

    x = [np.array(d, np.int64) for d in dims]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            set_here = (x[i] >> level) & 1 == 1
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | ((x[i] ^ turn) >> level) & 1
    return index


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Add `size`, `text_crc32` long, `hilbert` long, `law` string, `shard` int, `slot` long, `grown_shard` int (null).

    Law `bytes`: the groups of equal texts are put in Hilbert order of three quantised dimensions (length in half powers of
    two, language and source by hash), and the order is cut into runs of near equal bytes, so a file or row group of a shard covers a
    compact part of all three dimensions. size: UTF-8 bytes of the text plus 1 (null: 1). A group takes the least language and
    source of its rows and goes to the shard in which its middle falls; only where the law of near equal bytes leaves no other
    way, in a group of more than 1/WHOLE of a shard's bytes, each row goes by its own middle. slot counts from 0 in each shard along the order.
    Null texts are one group with crc 0; null languages and sources are values of their own. Rows of a group are in order of a hash of the id.
    `carry`: the input columns to keep (default: all but the text). Columns named as outputs are replaced. No rows: no rows.

    The texts themselves are never shuffled: rows are the carried columns and numbers. Positions of groups come from a distributed
    scan: a range partitioning, a sum per partition, and a window inside each partition. A group's rows are numbered in up to
    SALTS parts of about SALTED rows, so no task holds a large group.
    """
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    spark = docs.sparkSession
    text = F.col(text_col)
    facts = docs.select(
        F.struct(*carry).alias("_row"),
        F.xxhash64(F.col(id_col)).alias("_id"),
        F.monotonically_increasing_id().alias("_nth"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.crc32(text.cast("binary"))).cast("long").alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("_h1"),
        F.xxhash64(F.lit(7), text).alias("_h2"),
        F.coalesce(F.concat(F.lit("v"), F.col(lang_col)), F.lit("")).alias("_lang"),
        F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("")).alias("_source"),
    )
    facts = store(facts, "facts")
    groups = facts.groupBy("_h1", "_h2").agg(F.min("_lang").alias("_lang"), F.min("_source").alias("_source"), F.count(F.lit(1)).alias("_rows"), F.max("size").alias("_size"))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            index = hilbert_index([c.to_numpy() for c in b.columns[4:]])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(index.astype(np.int64))], names=["_h1", "_h2", "_rows", "_size", "hilbert"])

    cells = F.lit((1 << BITS) - 1)
    hashed = lambda c: F.pmod(F.xxhash64(c), cells + 1).cast("long")
    placed = groups.select("_h1", "_h2", "_rows", "_size", F.least(F.floor(F.log2(F.col("_size")) * 2), cells).cast("long").alias("d0"), hashed("_lang").alias("d1"), hashed("_source").alias("d2"))
    placed = placed.mapInArrow(place, "_h1 long, _h2 long, _rows long, _size long, hilbert long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["hilbert", "_h1", "_h2"]
    dealt = store(placed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    # What lies before each partition: one row a partition, whatever the number of documents.
    each = dealt.groupBy("_part").agg(F.sum(F.col("_rows") * F.col("_size")).alias("_b"), F.sum("_rows").alias("_n"))
    past = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    each = store(each.select("_part", F.coalesce(F.sum("_b").over(past), F.lit(0)).alias("_bytes0"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_rows0"), "_b"), "parts")
    total = each.agg(F.coalesce(F.sum("_b"), F.lit(0))).first()[0]
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranged = dealt.join(F.broadcast(each.drop("_b")), "_part").select(
        "_h1", "_h2", "hilbert", "_rows",
        (F.col("_bytes0") + F.coalesce(F.sum(F.col("_rows") * F.col("_size")).over(inside), F.lit(0))).alias("_start"),
        (F.col("_rows0") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_first"),
        "_size",
    )
    group = F.col("_rows") * F.col("_size")
    ranged = store(ranged.withColumn("_whole", group * (shards * WHOLE) <= F.lit(total)), "groups")
    # The shard of what has its middle at m / 2 of `total` bytes; all in whole numbers.
    at = lambda m: F.expr(f"least(({m}) * {shards} div {2 * max(total, 1)}, {shards - 1})").cast("int")
    own = "2 * _start + (2 * _k + 1) * _size"
    # The first row of each shard: the first of a whole group, or the first of a cut group that falls there.
    cut = ranged.where(~F.col("_whole")).select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    need = F.expr(f"(2L * {total} * shard - 2 * _start * {shards} + _size * {shards} - 1) div (_size * {shards})")
    cut = cut.withColumn("_k", F.greatest(F.floor(need / 2).cast("long"), F.lit(0))).where((F.col("_k") < F.col("_rows")) & (F.col("shard") == at(own)))
    firsts = ranged.where("_whole").select(at("2 * _start + _rows * _size").alias("shard"), "_first").unionByName(cut.select("shard", (F.col("_first") + F.col("_k")).alias("_first")))
    firsts = store(firsts.groupBy("shard").agg(F.min("_first").alias("_shard_first")), "firsts")

    rows = store(skew_join(facts.drop("_lang", "_source"), ranged.drop("_size"), ["_h1", "_h2"]), "placed")
    salts = F.least(F.ceil(F.col("_rows") / SALTED), F.lit(SALTS))
    many = rows.where("_rows > 1").withColumn("_salt", F.pmod(F.xxhash64("_id", "_nth"), salts))
    counts = many.groupBy("_h1", "_h2", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select("_h1", "_h2", "_salt", F.coalesce(F.sum("_c").over(W.partitionBy("_h1", "_h2").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_h1", "_h2", "_salt").orderBy("_id", "_nth")) - 1
    many = many.withColumn("_within", inner).join(counts, ["_h1", "_h2", "_salt"]).withColumn("_k", F.col("_within") + F.col("_before")).drop("_salt", "_within", "_before")
    out = rows.where("_rows = 1").withColumn("_k", F.lit(0).cast("long")).unionByName(many).withColumn("_size", F.col("size"))
    out = out.withColumn("shard", F.when(F.col("_whole"), at("2 * _start + _rows * _size")).otherwise(at(own)))
    out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_first") + F.col("_k") - F.col("_shard_first"))
    outputs = ("size", "text_crc32", "hilbert", "law", "shard", "slot", "grown_shard")
    done = out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return done.select(*[F.col("_row")[c].alias(c) for c in unclashed(carry, outputs)], *outputs)
