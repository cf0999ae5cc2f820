"""SimHash near-dedup: fingerprints of word shingles, compared bit plane by bit plane."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, skew_join, store, unclashed
from quire.llm.components import components

#: Words in a shingle, and the most differing bits of a link.
SHINGLE, RADIUS = 4, 4
#: Fingerprints of a bucket that are compared in one piece; larger buckets are cut into chunks and all pairs of chunks compared.
CHUNK = 2048
#: Blocks of a fingerprint by the number of fingerprints: more blocks mean more tables and longer keys. Any choice finds every link.
PLANS = ((1 << 24, 6), (1 << 32, 7), (1 << 63, 8))


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Add `fp` long: the 64-bit SimHash of the text's word shingles, as a signed long.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles of `shingle` words,
    repeats included, are hashed by XXH64 with seed 42; a bit is 1 if over half of the hashes
    have it. Fewer words: the whole sequence is the one shingle. No words or null: 0.
    """

    def work():
        import numpy as np
        import xxhash

        hashed = xxhash.xxh64_intdigest

        def one(text):
            words = text.encode().translate(UPPER).split() if text else []
            if not words:
                return 0
            joined = b" ".join(words)
            if len(words) <= shingle:
                return hashed(joined, 42)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-shingle])).tolist()
            ends = (ends[shingle - 1 :] - 1).tolist()
            n, ones = len(starts), np.zeros(64, np.int64)
            for at in range(0, n, 1 << 16):
                h = np.array([hashed(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])

        def do(texts):
            return {"fp": [v - (1 << 64) if v >> 63 else v for v in map(one, texts)]}

        return do

    return map_texts(docs, work, {"fp": "long"}, text_col, carry)


UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def planes_of(fps):
    """Bit planes of an array of 64-bit values: row k holds bit k of each, packed into 64-bit words, and a word of zeros."""
    import numpy as np

    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    wide = np.zeros((64, (n // 64 + 2) * 64), np.uint8)
    wide[:, :n] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def within(planes, lag: int, alive):
    """For positions i with a bit in `alive`: a bit if values i and i + lag differ in RADIUS (4) bits or fewer.

    `alive` holds packed words of candidate positions. The planes are compared with
    themselves, shifted by `lag`; the differences are added into bit-sliced counters
    (ones, twos, fours, and a sticky bit from eight on) with carry-save adders,
    and every few planes the words in which no position is within the radius are dropped.
    """
    import numpy as np

    out = np.zeros_like(alive)
    words = np.flatnonzero(alive)
    skip, turn = divmod(lag, 64)
    last = planes.shape[1] - 1
    ones = np.zeros(len(words), np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    good = alive[words]
    for k in range(0, 64, 2):
        diffs = []
        for plane in (planes[k], planes[k + 1]):
            other = plane[np.minimum(words + skip, last)]
            if turn:
                other = (other >> np.uint64(turn)) | (plane[np.minimum(words + skip + 1, last)] << np.uint64(64 - turn))
            diffs.append(plane[words] ^ other)
        a, b = diffs
        # Full adder of the two planes and the ones, then half adders upwards.
        half = a ^ b
        carry = (a & b) | (ones & half)
        ones = ones ^ half
        up = twos & carry
        twos = twos ^ carry
        over |= fours & up
        fours = fours ^ up
        if k % 8 == 6:
            good = alive[words] & ~(over | (fours & (ones | twos)))  # counts of 5, 6, 7 and more
            live = good != 0
            if not live.all():
                words, ones, twos, fours, over, good = (x[live] for x in (words, ones, twos, fours, over, good))
                if not len(words):
                    return out
    out[words] = good
    return out


def spanning_links(keys, fps):
    """Links (as index pairs) that connect, inside each run of equal `keys`, what distances up to RADIUS connect.

    Rows are sorted by key. All pairs of a run are compared, by lag; a pair gives a link only if its
    ends are not connected yet, so a run of n values gives n - 1 links at most.
    """
    import numpy as np

    n = len(keys)
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], edges))
    sizes = np.diff(np.concatenate((starts, [n])))
    after = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # values after this one in its run
    planes = planes_of(fps)
    parent = np.arange(n)
    links = []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for lag in range(1, int(sizes.max(initial=1))):
        flags = np.zeros(planes.shape[1] * 64, np.uint8)
        flags[:n] = after >= lag
        hits = within(planes, lag, np.packbits(flags, bitorder="little").view(np.uint64))
        words = np.flatnonzero(hits)
        if not len(words):
            continue
        bits = np.unpackbits(hits[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        left = words[at] * 64 + bit
        new = parent[left] != parent[left + lag]
        for i in left[new].tolist():
            a, b = find(i), find(i + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, i + lag))
        if new.any():
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return links


def bucket_links(fps: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """Links (`a`, `b`) among distinct fingerprints `fp` that connect what Hamming distances up to RADIUS connect.

    The 64 bits are cut into m blocks; two values within the radius agree in at least m - RADIUS
    of them, so each choice of m - RADIUS blocks is a table keyed by their bits, and
    every link shows up in one. m follows the count `n` (see PLANS). A bucket of more
    than 2 * `chunk` values is cut by a hash into chunks and each pair of chunks is a bucket of its own: n values of one bucket
    cost (n / chunk)**2 / 2 comparisons of chunks, each value n / chunk rows; exact, but dear where very many different texts agree in whole blocks.
    """
    m = next(m for most, m in PLANS if n < most)
    cuts = [round(64 * i / m) for i in range(m + 1)]
    keys = []
    for t, blocks in enumerate(combinations(range(m), m - RADIUS)):
        mask = 0
        for b in blocks:
            mask |= ((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1)
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 2 * chunk)
    large = store(large, "large")
    if large.limit(1).count():
        c = F.ceil(F.col("_c") / chunk).cast("int")
        mine = F.pmod(F.xxhash64("fp", F.lit("chunk")), c).cast("int")
        units = F.filter(F.sequence(F.lit(0), c - 1), lambda j: j != mine)
        cut = skew_join(keyed, large, ["key"], "left")
        keyed = cut.select("fp", F.explode(F.when(F.col("_c").isNull(), F.array("key")).otherwise(F.transform(units, lambda j: F.xxhash64("key", F.least(j, mine), F.greatest(j, mine))))).alias("key"))

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def links(keys, fps):
            found = spanning_links(keys, fps)
            ends = fps.view(np.int64)[np.array(found, np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            held_k = np.concatenate((held_k, batch.column(0).to_numpy()))
            held_f = np.concatenate((held_f, batch.column(1).to_numpy().view(np.uint64)))
            if not len(held_k):
                continue
            upto = int(np.searchsorted(held_k, held_k[-1]))  # the last run may go on
            if upto:
                yield links(held_k[:upto], held_f[:upto])
                held_k, held_f = held_k[upto:], held_f[upto:]
        if len(held_k):
            yield links(held_k, held_f)

    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return keyed.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: `carry` columns (default: the id), `fp` long, `root` long (the least fingerprint of the component), `component_id` (the least id that links reach, itself included).

    Links are between fingerprints with RADIUS or fewer differing bits, and components are their transitive closure. Only distinct fingerprints are compared, so exact
    copies cost nothing, and no pair of documents is ever written. Null ids are passed over by the minimum; a component
    of null ids alone has a null id; ids that repeat can name two components alike, roots can't. Columns named as outputs are replaced. Texts without words have fingerprint 0 and link like any other. Empty table: no rows.
    """
    carry = unclashed([id_col] if carry is None else carry, ("fp", "root", "component_id"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.struct(*carry, F.lit(0).alias("_pad")).alias("_carried"))
    marked = store(fingerprints(rows, "_t", ["_id", "_carried"]), "fingerprints")
    nodes = store(marked.groupBy("fp").agg(F.min("_id").alias("_least")), "nodes")
    found = components(bucket_links(nodes.select("fp"), nodes.count()))
    rooted = skew_join(nodes, found.select(F.col("node").alias("fp"), "root"), ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("_component"))
    by_fp = skew_join(rooted.select("fp", "root"), least, ["root"]).select("fp", "root", "_component")
    out = skew_join(marked, by_fp, ["fp"])
    return out.select(*[F.col("_carried")[c].alias(c) for c in carry], "fp", "root", F.col("_component").alias("component_id"))
