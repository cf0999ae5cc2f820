"""N-gram Jaccard join: size-aware, subsets of small sets and inverted lists of large ones."""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, skew_join, slices, store, unclashed
from quire.llm.components import components

#: Words in a shingle.
SHINGLE = 3
#: Sets and shingles of a chunk: larger candidate groups are cut into chunks, and each pair of chunks is scanned.
CHUNK, TOKENS = 2048, 1 << 21
#: Mean length that the cost model gives to an inverted list.
LISTS = 2.0
#: A link: 100 * intersection >= 90 * union, so intersection >= 9 / 19 of both sizes together.
NUM, DEN = 9, 19
UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def overlap(x: int, y: int) -> int:
    """The least intersection with which sets of x and y elements link."""
    return -(-NUM * (x + y) // DEN)


@cache
def families(n: int) -> tuple[tuple[int, int, int], ...]:
    """(x, y, size of the common subset) for each pair of sizes x <= y that can link and has n for one of them."""
    smaller = [(n, y) for y in range(n, 10 * n // 9 + 1)]
    larger = [(x, n) for x in range(-(-9 * n // 10), n)]
    return tuple((x, y, overlap(x, y)) for x, y in smaller + larger)


@cache
def classes(most: int) -> list[int]:
    """The largest size of each class up to that of size `most`: sets that can link are of one class or of neighbours."""
    out, low = [], 1
    while low <= most:
        out.append(10 * low // 9)
        low = out[-1] + 1
    return out


@cache
def class_of(n: int) -> tuple[tuple[int, int, int], ...]:
    """(class, parts, empty parts that are passed over) for the class of size n and for the one after it, in which n meets larger sets.

    Sets that link differ in at most d = 2 * size / 19 elements, so of d + 1 + e parts of their elements, e + 1 are the same in both; if no more than e parts are empty, one of
    those has elements.
    """
    ends = classes(10 * n // 9 + 2)
    c = next(i for i, end in enumerate(ends) if n <= end)
    out = []
    for at in (c, c + 1):
        end = ends[at] if at < len(ends) else 10 * (ends[-1] + 1) // 9
        spare = 1 + end // 1000
        out.append((at, 2 * end // DEN + 1 + spare, spare))
    return tuple(out)


@cache
def boundary(lists: float = LISTS) -> int:
    """The largest size whose sets are small: up to it, making all subsets costs no more than parts, shipping the set and scanning a list for each element."""
    n = 1
    while sum(comb(n, o) for _, _, o in families(n)) <= sum(k for _, k, _ in class_of(n)) + n * (1 + lists):
        n += 1
    return n - 1


def _mixed(x, by: int):
    """Scrambled 64-bit values."""
    import numpy as np

    x = x * np.uint64(by)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class Shingler:
    """Texts to sets of 64-bit shingles, as sorted arrays. The hashes of words are remembered, ROOM of them."""

    ROOM = 1 << 18

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, {}

    def __call__(self, text: str | None):
        import numpy as np
        import xxhash

        words = text.encode("utf-8", "replace").translate(UPPER).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
        known = self.known
        if len(known) > self.ROOM:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + _mixed(h[i : i + n], 0x9E3779B97F4A7C15 + 2 * i)
        return np.unique(_mixed(out, 0xC2B2AE3D27D4EB4F))


def print_of(tokens) -> tuple[int, int]:
    """Two 64-bit hashes of a set, signed."""
    import numpy as np

    sums = np.array([_mixed(tokens, 0xA0761D6478BD642F).sum(), _mixed(tokens, 0xE7037ED1A0B428DB).sum()], np.uint64) + np.uint64(len(tokens))
    return tuple(_mixed(sums, 0x8EBC6AF09C88C6E3).view(np.int64).tolist())


def subset_keys(tokens):
    """(keys, sides) of a small set: a key for each of its subsets that a set with which it links has too. Side 1: as the smaller one of a pair or one of equals, 2: as the larger."""
    import numpy as np

    n = len(tokens)
    mixed = _mixed(tokens, 0x589965CC75374CC3)
    total = mixed.sum(dtype=np.uint64)
    keys, sides = [], []
    for x, y, o in families(n):
        gone = list(combinations(range(n), n - o))
        sums = total - mixed[np.array(gone, np.int64).reshape(len(gone), n - o)].sum(axis=1, dtype=np.uint64)
        keys.append(_mixed(sums + np.uint64(x * 131 + y), 0x1D8E4E27C47D124F))
        sides.append(np.full(len(gone), 1 if n == x else 2, np.int32))
    return np.concatenate(keys), np.concatenate(sides)


def part_keys(tokens):
    """Keys of a large set: in each class in which it can link, the hash of each part of its elements; empty parts only where there are more than are passed over."""
    import numpy as np

    mixed = _mixed(tokens, 0xEB44ACCAB455D165)
    keys = []
    for c, k, spare in class_of(len(tokens)):
        part = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # rises with the element
        starts = np.flatnonzero(np.diff(part, prepend=np.uint64(k)))
        sums, at = np.add.reduceat(mixed, starts), part[starts]
        if k - len(at) > spare:
            none = np.setdiff1d(np.arange(k, dtype=np.uint64), at)
            sums, at = np.concatenate((sums, np.zeros(len(none), np.uint64))), np.concatenate((at, none))
        keys.append(_mixed(sums + at * np.uint64(0x9E3779B97F4A7C15) + np.uint64((c + 1) * 0xD6E8FEB86659FD93 % (1 << 64)), 0x589965CC75374CC3))
    return np.concatenate(keys)


def _edges_of_runs(keys, sides, ids):
    """(edges, which rows to keep) of rows sorted by key, side and id: the others of a run hang on its first row, unless it has larger sets only."""
    import numpy as np

    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    head = np.repeat(first, np.diff(np.append(first, len(keys))))
    hung = (sides[head] != 2) & (np.arange(len(keys)) != head)
    other = hung & (ids != ids[head])
    return np.stack((ids[other], ids[head[other]])), ~hung


def candidate_edges(docs: DataFrame, text_col: str, width: int, limit: int) -> DataFrame:
    """Edges (`a`, `b`: first hashes of sets) such that all sets that link are connected by them.

    Sets that link have a key in common. Rows of a key become edges to the first of them: first among the texts that a task has
    in hand, so that a hot key leaves it once, then where the keys of all tasks meet.
    """

    def make(batches):
        import numpy as np
        import pyarrow as pa

        shingle = Shingler(width)

        def rows(keys, sides, ids):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sides), pa.array(ids)], names=["key", "side", "id"])

        for batch in batches:
            for part in slices(batch, "_text"):
                seen, keys, sides, ids = set(), [], [], []
                for text in part.column(0).to_pylist():
                    tokens = shingle(text)
                    n = len(tokens)
                    name = print_of(tokens)[0] if n else None
                    if not n or name in seen:
                        continue
                    seen.add(name)
                    made = [subset_keys(tokens)] if n <= limit else []
                    if 10 * n // 9 > limit:
                        parts = part_keys(tokens)
                        made.append((parts, np.zeros(len(parts), np.int32)))
                    for k, s in made:
                        keys.append(k)
                        sides.append(s)
                        ids.append(np.full(len(k), name, np.int64))
                if not keys:
                    continue
                keys, sides, ids = np.concatenate(keys).view(np.int64), np.concatenate(sides), np.concatenate(ids)
                order = np.lexsort((ids, sides, keys))
                keys, sides, ids = keys[order], sides[order], ids[order]
                (a, b), keep = _edges_of_runs(keys, sides, ids)
                yield rows(keys[keep], sides[keep], ids[keep])
                yield rows(a, np.full(len(a), -1, np.int32), b)  # edges travel as rows of side -1

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        held = None  # the first row of the run that the batch before ended with
        for batch in batches:
            keys, sides, ids = (batch.column(i).to_numpy() for i in range(3))
            edge = sides < 0
            a, b = keys[edge], ids[edge]
            keys, sides, ids = keys[~edge], sides[~edge], ids[~edge]
            if held is not None:
                keys, sides, ids = (np.concatenate((np.array([h], x.dtype), x)) for h, x in zip(held, (keys, sides, ids), strict=True))
            if len(keys):
                (c, d), _ = _edges_of_runs(keys, sides, ids)
                a, b = np.concatenate((a, c)), np.concatenate((b, d))
                at = int(np.searchsorted(keys, keys[-1]))
                held = (keys[at], sides[at], ids[at])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    many = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = docs.select(F.col(text_col).alias("_text")).mapInArrow(make, "key long, side int, id long")
    return keyed.repartition(many, "key").sortWithinPartitions("key", "side", "id").mapInArrow(meet, "a long, b long")


def links_of(sizes, sets):
    """Links (as index pairs) that connect what links connect, among sets of rising size.

    Each set scans the inverted lists of its elements for the sets before it, which gives every intersection. While all sets so far
    are connected, a set that links with the first or with the last one is not scanned, as no link of it could connect anything else.
    """
    import numpy as np

    m = len(sets)
    parent = list(range(m))
    links = []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def enough(o, x, y):
        return 100 * o >= 90 * (x + y - o)

    which = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    lists = owner[np.argsort(which, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(which))))
    filled = np.zeros(len(begin) - 1, np.int64)
    ends = np.cumsum(sizes)
    groups = 0
    for i in range(m):
        mine = which[ends[i] - sizes[i] : ends[i]]
        groups += 1
        done = False
        if groups == 2 and i:
            for j in dict.fromkeys((0, i - 1)):
                if enough(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), sizes[i], sizes[j]):
                    parent[i] = find(j)
                    links.append((i, j))
                    groups, done = 1, True
                    break
        if not done and i:
            lens = filled[mine]
            total = int(lens.sum())
            if total:
                at = np.repeat(begin[mine] - (np.cumsum(lens) - lens), lens) + np.arange(total)
                both = np.bincount(lists[at], minlength=i)
                for j in np.flatnonzero(enough(both, sizes[i], sizes[:i])).tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        parent[a] = b
                        links.append((i, j))
                        groups -= 1
        filled[mine] += 1
    return links


def verified(sets: DataFrame) -> DataFrame:
    """Links (`a`, `b`) among `node`, `n`, `tokens` of each `unit` that connect what all links within it connect."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        unit, nodes, sizes, held = None, [], [], []

        def found():
            links = links_of(np.array(sizes, np.int64), held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for u, node, n, tokens in zip(*[batch.column(i) for i in range(4)], strict=True):
                u, node = u.as_py(), node.as_py()
                if u != unit:
                    if held:
                        yield found()
                    unit, nodes, sizes, held = u, [], [], []
                if nodes and nodes[-1] == node:
                    continue  # a row that stands in the input twice
                nodes.append(node)
                sizes.append(n.as_py())
                held.append(np.frombuffer(tokens.as_buffer(), np.uint64).copy())
        if held:
            yield found()

    many = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return sets.select("unit", "node", "n", "tokens").repartition(many, "unit").sortWithinPartitions("unit", "n", "node").mapInArrow(scan, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, width: int = SHINGLE, limit: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per document: `carry` columns (default: the id), `n_shingles` long, `component_id` (the least id that links reach, itself included).

    A-Z are lower-cased; words are runs of anything but ASCII white space; a document's set has its distinct shingles of `width` words, or its whole
    sequence as the one element if it has fewer words. Documents link when 100 * intersection >= 90 * union. Null texts and texts without words have an empty set and
    link with nothing. Repeated ids and rows are documents each; null ids are passed over by the minimum, and a component of null ids alone has a null id. Columns
    named as outputs are replaced. No rows: no rows.

    Equal sets are one set. Small sets (up to `limit` elements, by default the boundary at which the cost of subsets passes that of lists) give a key for each subset of the size that a pair has
    to share, so a key stands for a link; large sets give keys of parts, and as sets that link have a part in common, connected candidates are brought together and the inverted lists of
    their elements scanned. A candidate group of more than `chunk` sets or TOKENS elements is cut into chunks, and each pair of chunks scanned: exact, but of a cost that
    grows with the square of such a group's chunks. Pairs are not written out: each scan gives at most one link less than it has sets.

    Elements and sets are known by 64-bit hashes: two different sets are taken for one with a chance of n * n / 2**65 in n sets.
    """
    limit = boundary() if limit is None else limit
    carry = unclashed([id_col] if carry is None else carry, ("n_shingles", "component_id"))

    def work():
        shingle = Shingler(width)

        def do(texts):
            sets = [shingle(t) for t in texts]
            return {"n": [len(s) for s in sets], "h": [print_of(s)[0] if len(s) else None for s in sets]}

        return do

    prints = {"_t1": F.xxhash64("_t"), "_t2": F.xxhash64(F.lit(7), "_t")}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.struct(*carry, F.lit(0).alias("_pad")).alias("_carried"))
    marked = store(map_texts(rows.withColumns(prints), work, {"n": "long", "h": "long"}, "_t", ["_id", "_carried", *prints]), "sets")
    one = F.min(F.struct("_t1", "_t2", F.col("_id").isNull().alias("none"), "_id")).alias("one")
    nodes = store(marked.where("n > 0").groupBy("h").agg(F.min("_id").alias("_least"), F.min("n").alias("n"), one), "nodes")
    found = components(candidate_edges(rows, "_t", width, limit))
    found = skew_join(found, nodes.select(F.col("h").alias("node"), "n", "one"), ["node"])
    found = store(found.select("node", "root", "n", "one"), "candidates")
    sizes = found.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / TOKENS)).cast("int").alias("chunks"))
    placed = skew_join(found, sizes, ["root"])
    mine = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 2), lambda j: F.when(j < mine, j).otherwise(j + 1))
    units = F.when(F.col("chunks") == 1, F.array("root")).otherwise(F.transform(pairs, lambda j: F.xxhash64("root", F.least(j, mine), F.greatest(j, mine))))
    wanted = placed.select("node", F.col("one._t1").alias("_t1"), F.col("one._t2").alias("_t2"), F.col("one._id").alias("_of"), units.alias("_units"))
    texts = skew_join(rows.select("_id", "_t").withColumns(prints), wanted, ["_t1", "_t2"]).where(F.col("_id").eqNullSafe(F.col("_of")))

    def again():
        shingle = Shingler(width)

        def do(texts):
            sets = [shingle(t) for t in texts]
            return {"n": [len(s) for s in sets], "tokens": [s.tobytes() for s in sets]}

        return do

    sets = map_texts(texts, again, {"n": "long", "tokens": "binary"}, "_t", ["node", "_units"], 1 << 20)
    links = verified(sets.select(F.explode("_units").alias("unit"), "node", "n", "tokens"))
    joined = components(links)
    rooted = skew_join(nodes.select("h", "_least"), joined.select(F.col("node").alias("h"), "root"), ["h"], "left").withColumn("root", F.coalesce("root", "h"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("_component"))
    by_set = skew_join(rooted.select("h", "root"), least, ["root"]).select("h", "_component")
    out = skew_join(marked.withColumn("h", F.coalesce("h", F.xxhash64("_id", F.lit("none")))), by_set, ["h"], "left")
    return out.select(*[F.col("_carried")[c].alias(c) for c in carry], F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("_component")).alias("component_id"))
