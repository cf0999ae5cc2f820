"""Approximate nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import store

#: Queries that are held at once, and vectors that they are compared with at once.
QUERIES, PIECE, TOGETHER = 8192, 4096, 256
#: Width of the error bound, in standard deviations of the estimate.
SIGMAS = 2.4
SEED = 20


def rotation(dim: int, seed: int = SEED):
    """A random orthogonal matrix, the same for a seed and size everywhere."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors, turn):
    """(codes, norms, factors) of the rows of `vectors`.

    codes: the signs of the rotated row, packed 64 to a word. factor: the inner product of the unit row
    with its code as a unit vector; an estimate of <row, q> is norm / factor * <code, q>.
    """
    import numpy as np

    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ turn
    dim = vectors.shape[1]
    signs = np.zeros((len(vectors), -(-dim // 64) * 64), np.uint8)
    signs[:, :dim] = turned >= 0
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64), norms, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def estimates(codes, dim: int, queries, turn):
    """<code, q / |q|> for each query and code, from packed bits: [query, code].

    The rotated query is rounded to 6 bits a component; its bit planes are compared with the codes by AND and popcount.
    """
    import numpy as np

    unit = queries @ turn
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    low, high = unit.min(axis=1, keepdims=True), unit.max(axis=1, keepdims=True)
    width = np.maximum((high - low) / 63, 1e-12)
    level = np.rint((unit - low) / width).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    dot = np.zeros((len(queries), len(codes)), np.int32)
    wide = np.zeros((len(queries), codes.shape[1] * 64), np.uint8)
    for bit in range(6):
        wide[:, :dim] = (level >> bit) & 1
        plane = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
        for word in range(codes.shape[1]):
            dot += np.bitwise_count(plane[:, word, None] & codes[None, :, word]).astype(np.int32) << bit
    # <s, u> with s = 2 bits - 1 and u = low + width * level
    return ((2 * dot - level.sum(axis=1, dtype=np.int32)[:, None]) * width + low * (2 * ones[None, :] - dim)) / np.sqrt(dim)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(`_id` long, `_v` array<double>) of the rows that take part: an id, and a vector that isn't empty, zero or holding null or non-finite components."""
    v = F.col("_v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(F.col("_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sigmas: float = SIGMAS) -> DataFrame:
    """The k nearest of all rows to each row whose id is divisible by `every`: `query_id` long, `rank` int, `vec_id` long, `score` double.

    Nearness is the inner product in double precision; ties go to the smaller id; rows with the query's own id are no
    candidates. Rows with repeated ids are candidates each for itself; of queries with the same id the one with the least vector counts. Rows with a null id or a vector that
    is null, empty, zero or not finite take no part, and vectors of different lengths are never compared. No queries or no candidates: no rows.

    The index, written once, has the one-bit code of every row with its norm and factor. Queries come in blocks
    of QUERIES, one after another: each is broadcast, compared with all codes, and what could be among the k nearest by its estimate and error bound
    is scored exactly; the block's results are written before the next block is fetched, so the driver and the tasks hold one block at a time. A task hands on k rows a query,
    which the last step merges. Every query meets every code, so the work grows with queries times rows.
    """
    spark = vectors.sparkSession
    usable = valid(vectors, id_col, vec_col)
    index = store(usable.mapInArrow(_encoded, "_id long, _v array<double>, _code binary, _norm double, _factor double"), "index")
    asked = index.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    sums = index.where(F.col("_id") % every == 0).agg(F.count_distinct("_id").alias("n")).first()
    blocks = -(-sums["n"] // QUERIES)
    numbered = store(asked.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(max(blocks, 1))).cast("int")), "queries")
    found = None
    for b in range(blocks):
        block = numbered.where(F.col("_block") == b).select("_id", "_v").toArrow()
        shipped = spark.sparkContext.broadcast((block.column(0).to_pylist(), block.column(1).to_pylist()))
        part = store(_against(index, shipped, k, sigmas), "found")
        shipped.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(lists, rows=None):
    """(rows, matrix of their lists) for each length among the lists of an Arrow column."""
    import numpy as np
    import pyarrow as pa

    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        if rows is None or dim in rows:
            some = np.flatnonzero(sizes == dim)
            yield dim, some, lists.take(pa.array(some)).flatten().to_numpy().reshape(-1, dim)


def _encoded(batches):
    """The rows of (id, vector) with code, norm and factor."""
    import numpy as np
    import pyarrow as pa

    turns: dict = {}
    for batch in batches:
        n = batch.num_rows
        codes, norms, factors = [b""] * n, np.zeros(n), np.zeros(n)
        for dim, rows, matrix in _by_length(batch.column(1)):
            turn = turns[dim] = turns[dim] if dim in turns else rotation(dim)
            for at in range(0, len(rows), PIECE):
                some = rows[at : at + PIECE]
                c, norms[some], factors[some] = encode(matrix[at : at + PIECE], turn)
                for i, code in zip(some.tolist(), c, strict=True):
                    codes[i] = code.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(norms), pa.array(factors)], names=["_id", "_v", "_code", "_norm", "_factor"])


def _against(index: DataFrame, shipped, k: int, sigmas: float) -> DataFrame:
    """The k nearest in each task's rows to each query of a block."""

    def run(batches):
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa

        by_dim = defaultdict(lambda: ([], []))
        for i, v in zip(*shipped.value, strict=True):
            by_dim[len(v)][0].append(i)
            by_dim[len(v)][1].append(v)
        blocks = {d: (np.array(i), np.array(v, float), rotation(d)) for d, (i, v) in by_dim.items()}
        best = {d: (np.full((len(i), k), -np.inf), np.full((len(i), k), np.iinfo(np.int64).max)) for d, (i, _, _) in blocks.items()}
        for batch in batches:
            ids, norms, factors = (batch.column(i).to_numpy() for i in (0, 3, 4))
            for dim, rows, matrix in _by_length(batch.column(1), blocks):
                codes = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1)
                for at in range(0, len(rows), PIECE):
                    part, some = slice(at, at + PIECE), rows[at : at + PIECE]
                    _piece(blocks[dim], best[dim], ids[some], matrix[part], codes[part], norms[some], factors[some], k, sigmas)
        for d, (asked, _, _) in blocks.items():
            scores, who = best[d]
            q, j = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(who[q, j]), pa.array(scores[q, j])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def _piece(block, best, ids, vectors, codes, norms, factors, k: int, sigmas: float) -> None:
    """Bring `best` (scores and ids, sorted) up to date with some more vectors."""
    import numpy as np

    asked, queries, turn = block
    dim = queries.shape[1]
    slack = norms * np.sqrt(np.maximum(1 - factors**2, 0)) / factors * (sigmas / np.sqrt(max(dim - 1, 1)))
    for at in range(0, len(asked), TOGETHER):
        part = slice(at, at + TOGETHER)
        size = np.linalg.norm(queries[part], axis=1)[:, None]
        guess = estimates(codes, dim, queries[part], turn) * (norms / factors) * size
        own = asked[part][:, None] == ids[None, :]
        guess[own] = -np.inf
        scores, who = best[0][part], best[1][part]
        # First the likeliest, so that there is a k-th score to beat; then all that may beat or tie it.
        m = min(k, len(ids))
        first = np.zeros(guess.shape, bool)
        np.put_along_axis(first, np.argpartition(-guess, m - 1, axis=1)[:, :m], True, axis=1)
        _rerank(scores, who, first & ~own, queries[part], vectors, ids, k)
        more = ~first & ~own & (guess + slack * size >= scores[:, -1:])
        _rerank(scores, who, more, queries[part], vectors, ids, k)


def _rerank(scores, who, chosen, queries, vectors, ids, k: int) -> None:
    """Merge the exact scores of the chosen (query, vector) pairs into the sorted best."""
    import numpy as np

    q, v = np.nonzero(chosen)
    if not len(q):
        return
    exact = np.concatenate([(queries[q[i : i + 65536]] * vectors[v[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)])
    starts = np.searchsorted(q, np.arange(len(queries) + 1))
    for i in np.unique(q).tolist():
        s = np.concatenate((scores[i], exact[starts[i] : starts[i + 1]]))
        w = np.concatenate((who[i], ids[v[starts[i] : starts[i + 1]]]))
        top = np.lexsort((w, -s))[:k]
        scores[i], who[i] = s[top], w[top]
