"""Centroid clustering: k-means in exact integers, filtered through kd-trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import store, unclashed

#: Vectors of a tree and of a leaf.
TREE, LEAF = 4096, 64
#: Components from here on, either way, would overflow the long that holds a squared distance.
LIMIT = 1 << 27
PARTS = ("lo", "hi", "sums", "counts", "left", "first", "last", "points")


def integer_vectors(vectors: Column, dim: int, scale: int) -> tuple[Column, Column]:
    """(condition: takes part, floor(scale * x) of each component, x as double)."""
    wide = F.transform(vectors, lambda x: x.cast("double") * scale)
    whole = (F.size(vectors) == dim) & F.forall(wide, lambda x: F.coalesce(F.abs(x) < LIMIT, F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True)))
    return F.coalesce(whole, F.lit(False)), F.transform(wide, lambda x: F.floor(x).cast("int"))


def grow(points, leaf: int = LEAF):
    """(order of the points, tree) of a kd-tree: nodes halve their points along the widest side of their box.

    tree: arrays by node: `lo`, `hi` (the box), `sums`, `counts`, `first`, `last` (places in the order), `left` (the left child; the right one comes after it; -1: a leaf).
    """
    import numpy as np

    order = np.arange(len(points))
    spans, left = [(0, len(points))], [-1]
    at = 0
    while at < len(spans):
        a, b = spans[at]
        some = points[order[a:b]]
        side = int(np.argmax(some.max(axis=0).astype(np.int64) - some.min(axis=0)))
        if b - a > leaf and some[:, side].min() < some[:, side].max():
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(some[:, side], half)]
            left[at] = len(spans)
            spans += [(a, a + half), (a + half, b)]
            left += [-1, -1]
        at += 1
    put = points[order]
    each = [put[a:b] for a, b in spans]
    return order, {
        "lo": np.stack([x.min(axis=0) for x in each]).astype(np.int32), "hi": np.stack([x.max(axis=0) for x in each]).astype(np.int32),
        "sums": np.stack([x.sum(axis=0, dtype=np.int64) for x in each]), "counts": np.array([len(x) for x in each], np.int64),
        "left": np.array(left, np.int32), "first": np.array([a for a, _ in spans], np.int32), "last": np.array([b for _, b in spans], np.int32),
        "points": put.astype(np.int32),
    }


def products(a, b):
    """Exact inner products of the rows of two integer arrays, in floating point where that is exact."""
    import numpy as np

    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def settle(tree, centres):
    """(nodes, centroid of each) assigned whole, and (points, centroid of each) of the leaves that had to be resolved.

    A level of the tree at a time. Of the centroids that a node still has, the one nearest to the middle of its box is held against each other
    one: if even the corner of the box that lies furthest towards the other is strictly nearer to the first, the other goes. A node with one centroid left is done.
    """
    import numpy as np

    norms = (centres * centres).sum(axis=1)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(centres)), bool)
    whole, owners, leaves, left_open = [], [], [], []
    while len(nodes):
        lo, hi = tree["lo"][nodes].astype(np.int64), tree["hi"][nodes].astype(np.int64)
        middle = lo + hi
        far = 4 * norms[None] - 4 * products(middle, centres)  # four times the distance to the middle, less a part that is the same for all
        best = np.where(open_, far, np.iinfo(np.int64).max).argmin(axis=1)
        ahead = centres[None] - centres[best][:, None]
        corner = np.maximum(ahead * lo[:, None], ahead * hi[:, None]).sum(axis=2)
        open_ = open_ & (norms[None] - norms[best][:, None] - 2 * corner <= 0)
        done = open_.sum(axis=1) == 1
        whole.append(nodes[done])
        owners.append(best[done])
        end = ~done & (tree["left"][nodes] < 0)
        leaves.append(nodes[end])
        left_open.append(open_[end])
        on = ~done & ~end
        below = tree["left"][nodes[on]].astype(np.int64)
        nodes, open_ = np.concatenate((below, below + 1)), np.concatenate((open_[on], open_[on]))
    leaves, left_open = np.concatenate(leaves), np.concatenate(left_open)
    sizes = tree["counts"][leaves]
    at = np.repeat(tree["first"][leaves] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    far = norms[None] - 2 * products(tree["points"][at], centres)
    nearest = np.where(np.repeat(left_open, sizes, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)  # the first of equals is the smaller number
    return (np.concatenate(whole), np.concatenate(owners)), (at, nearest)


def _trees(batch, dim: int):
    import numpy as np

    kinds = {"lo": np.int32, "hi": np.int32, "sums": np.int64, "counts": np.int64, "left": np.int32, "first": np.int32, "last": np.int32, "points": np.int32}
    for i in range(batch.num_rows):
        tree = {p: np.frombuffer(batch.column(batch.schema.get_field_index(p))[i].as_buffer(), k) for p, k in kinds.items()}
        yield i, {p: x.reshape(-1, dim) if p in ("lo", "hi", "sums", "points") else x for p, x in tree.items()}


def plant(rows: DataFrame, dim: int) -> DataFrame:
    """Trees over `_v` array<int>, TREE vectors each, as they lie in the partitions: PARTS binary, `rows`: the structs `_row` in the order of the tree."""
    from pyspark.sql.types import ArrayType, StructType

    schema = StructType([*StructType.fromDDL(", ".join(f"{p} binary" for p in PARTS)).fields])
    schema = schema.add("rows", ArrayType(rows.schema["_row"].dataType))

    def build(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field("rows").type

        def made(held):
            table = pa.Table.from_batches(held).combine_chunks()
            points = table.column("_v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            order, tree = grow(points)
            carried = table.column("_row").chunk(0).take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), carried).cast(kind)
            return pa.RecordBatch.from_arrays([*[pa.array([np.ascontiguousarray(tree[p]).tobytes()], pa.binary()) for p in PARTS], lists], names=schema.names)

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, TREE - n)
                batch = batch.slice(some.num_rows)
                held.append(some)
                n += some.num_rows
                if n == TREE:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    return store(rows.select("_row", "_v").mapInArrow(build, schema), "trees")


def move(trees: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """One round: the floors of the means of the vectors nearest to each centroid. Tasks hand on a sum and a count for each centroid."""
    dim = len(centres[0])

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centres, np.int64)
        sums, counts = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            for _, tree in _trees(batch, dim):
                (nodes, owners), (at, nearest) = settle(tree, c)
                np.add.at(sums, owners, tree["sums"][nodes])
                np.add.at(counts, owners, tree["counts"][nodes])
                for j in np.unique(nearest).tolist():
                    mine = tree["points"][at[nearest == j]]
                    sums[j] += mine.sum(axis=0, dtype=np.int64)
                    counts[j] += len(mine)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    found = trees.select(*PARTS).mapInArrow(gather, "cluster int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    totals = found.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(exact("x").alias("x"), exact("n").alias("n"))
    moved = [list(c) for c in centres]
    for r in totals.collect():  # a row for each component of each centroid
        moved[r["cluster"]][r["at"]] = int(r["x"]) // int(r["n"])
    return moved


def assign(trees: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Per vector: `_row`, `cluster` int, `distance` long (squared)."""
    from pyspark.sql.types import StructField, StructType

    dim = len(centres[0])
    schema = StructType([StructField("_row", trees.schema["rows"].dataType.elementType), *StructType.fromDDL("cluster int, distance long").fields])

    def label(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centres, np.int64)
        for batch in batches:
            for i, tree in _trees(batch, dim):
                (nodes, owners), (at, nearest) = settle(tree, c)
                cluster = np.zeros(len(tree["points"]), np.int32)
                for a, b, j in zip(tree["first"][nodes].tolist(), tree["last"][nodes].tolist(), owners.tolist(), strict=True):
                    cluster[a:b] = j
                cluster[at] = nearest
                apart = tree["points"].astype(np.int64) - c[cluster]
                carried = batch.column(batch.schema.get_field_index("rows")).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([carried, pa.array(cluster), pa.array((apart * apart).sum(axis=1))], names=["_row", "cluster", "distance"])

    return trees.select(*PARTS, "rows").mapInArrow(label, schema)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """Per vector that takes part: `carry` columns (default: the id), `cluster` int, `distance` long (squared), `cluster_inertia`, `inertia` long, `centroid_sha256` string.

    Vectors of exactly `dim` components, none null or non-finite, take part, as integers floor(scale * x); so do not those with an integer of LIMIT (2**27) or more
    in size, whose squared distances no long could hold. The first centroids are the `k` vectors with the least lower-case hex SHA-256 of `<seed>:<id>` (ids in decimal; null ids
    come last, equal ids go by their vectors), in that order; fewer vectors than k: as many centroids. Each round assigns every vector to its nearest centroid (ties: the smaller number) and moves
    non-empty centroids to the floors of their means; after the last one vectors are assigned once more. Repeated rows count each. No vectors: no rows.
    Columns named as outputs are replaced.

    Trees are written once, next to the rows they came from. A round reads them, and shuffles one sum a task, centroid and component. The driver holds the k centroids.
    """
    import hashlib

    spark = vectors.sparkSession
    carry = unclashed([id_col] if carry is None else carry, ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
    whole, ints = integer_vectors(F.col(vec_col), dim, scale)
    rows = vectors.where(whole).select(F.struct(*carry, F.lit(0).alias("_pad")).alias("_row"), ints.alias("_v"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("_draw"))
    trees = plant(rows, dim)
    centres = [list(r["_v"]) for r in rows.orderBy(F.col("_draw").asc_nulls_last(), "_v").select("_v").limit(k).collect()]
    names = ["cluster", "cluster_inertia", "inertia", "centroid_sha256"]
    if not centres:
        return rows.where("false").select(*[F.col("_row")[c].alias(c) for c in carry], F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *[F.lit(0).cast("long").alias(n) for n in names[1:3]], F.lit("").alias(names[3]))
    for _ in range(rounds):
        centres = move(trees, centres)
    found = store(assign(trees, centres), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    known = [(j, sums.get(j, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centres)]
    about = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(*[F.col("_row")[c].alias(c) for c in carry], "cluster", "distance", *names[1:])
