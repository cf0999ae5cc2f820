"""Centroid clustering, conversation repair and the Jaccard join against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import jaccard, kmeans, repair

VECTORS = "vec_id long, embedding array<float>, cluster string"


def brute_kmeans(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in draw[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        mine = [nearest(v) for _, v in kept]
        for j in range(len(centres)):
            some = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if some:
                centres[j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out = [(i, nearest(v), far(v, centres[nearest(v)])) for i, v in kept]
    inertia = {j: sum(d for _, m, d in out if m == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, m, d, inertia[m], sum(inertia.values()), sha[m]) for i, m, d in out), key=str)


def vector_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        centre = np.zeros(64)
        centre[i % 5] = 3.0
        rows.append((i, [float(np.float32(x)) for x in centre + rng.normal(0, 0.05, 64)]))
    rows += [(1, rows[1][1]), (2, rows[2][1]), (2, rows[2][1])]  # repeats, ties
    rows += [(None, rows[0][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [1.0] * 63 + [float("inf")])]
    return rows


def told(rows):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in rows), key=str)


def test_kmeans(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS).repartition(3)
    assert told(kmeans.cluster(df).collect()) == brute_kmeans(rows)
    assert kmeans.cluster(df, carry=["vec_id", "cluster"]).columns.count("cluster") == 1


def test_kmeans_of_few_and_none(spark):
    rows = vector_rows()[:3]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    assert told(kmeans.cluster(df).collect()) == brute_kmeans(rows)
    none = kmeans.cluster(df.where("false"))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # Components from LIMIT on don't take part.
    wide = spark.createDataFrame([(1, [2.0**17] * 64, None), (2, [1.0] * 64, None)], VECTORS)
    assert [r["vec_id"] for r in kmeans.cluster(wide).collect()] == [2]


def test_filtering_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-4, 4, (800, 6)) + 1000 * c for c in (0, 1, 5)]).astype(np.int32)
    order, tree = kmeans.grow(points, leaf=16)
    centres = np.array([[0] * 6, [1000] * 6, [5000] * 6, [1000] * 6, [3000] * 6], np.int64)
    (nodes, owners), (at, nearest) = kmeans.settle(tree, centres)
    got = np.full(len(points), -1)
    for n, j in zip(nodes, owners, strict=True):
        got[tree["first"][n] : tree["last"][n]] = j
    got[at] = nearest
    want = ((points[order][:, None].astype(np.int64) - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (got == want).all() and (got != 3).all()
    assert len(at) < len(points) / 2  # the clusters apart from the double centroid go by whole nodes
    assert (tree["sums"][0] == points.sum(axis=0)).all() and tree["counts"][0] == len(points)
    big = np.array([[2**26, -(2**26)]] * 3, np.int64)
    assert (kmeans.products(big, big) == [[2 * 2**52] * 3] * 3).all()


def brute_edits(initials, faults):
    """All lists of edits by rising cost, with at most two inserts in one place."""
    best = None
    n = len(initials)
    for choice in itertools.product("DKR", repeat=n):
        for gaps in itertools.product(range(3), repeat=n + 1):
            cost = 2 * sum(gaps)
            out = ""
            roles = [""]
            for i in range(n + 1):
                roles = [r + x for r in roles for x in map("".join, itertools.product("ua", repeat=gaps[i]))]
                out += "I" * gaps[i]
                if i == n:
                    break
                e = choice[i]
                out += e
                if e == "D":
                    cost += 3
                    continue
                if faults[i] in "12":
                    cost = 10**9
                    break
                cost += (faults[i] == "3") + (2 if e == "R" else 0)
                roles = [r + x for r in roles for x in ("ua" if e == "R" else initials[i])]
            if (best is None or (cost, out) < best) and any(re.fullmatch("(s?(ua)+)?", r) for r in roles):
                best = (cost, out)
    return best


def test_layers_against_every_list_of_edits():
    draw = random.Random(4)
    for _ in range(60):
        n = draw.randrange(0, 4)
        initials = "".join(draw.choice("suat") for _ in range(n))
        faults = "".join(draw.choice("000123") for _ in range(n))
        assert repair.cheapest(initials, faults) == brute_edits(initials, faults), (initials, faults)


def test_parts_give_the_edits_of_the_whole():
    draw = random.Random(5)
    for _ in range(200):
        n = draw.randrange(1, 12)
        initials = "".join(draw.choice("suuaat") for _ in range(n))
        faults = "".join(draw.choice("0000123") for _ in range(n))
        cuts = sorted({0, n, *(draw.randrange(n) for _ in range(3))})
        parts = [repair.edits_between(initials[a:b], faults[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        pairs, paths = repair.joined(parts)
        cost, _, end = repair.best_end(pairs)
        path = paths[repair.NOTHING, end]
        edits = "".join(p[s, t][1] for p, s, t in zip(parts, path, path[1:], strict=False)) + repair.CLOSING[end]
        assert (cost, edits) == repair.cheapest(initials, faults)


def brute_repair(rows):
    """rows: (conv, turn, role, text) before damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = "", set()
        for _, role, text in kept:
            bare = text.strip("\t\n\v\f\r ")
            faults += "1" if not bare else "2" if (role, text) in seen else "0" if bare[-1] in ".!?" else "3"
            seen.add((role, text))
        initials = "".join(r[1][:1] or "?" for r in kept)
        cost, audit = repair.cheapest(initials, faults)
        turns = {r[0] for r in kept if r[0] is not None}
        told = "\n".join(f"{a}:{b}" for a, b in repair.repaired(repair.NOTHING, audit, [r[1:] for r in kept]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("1"), faults.count("2"), faults.count("3"), repair.illegal_pairs(initials), cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, cost string"


def turn_rows():
    draw = random.Random(6)
    rows = []
    for conv in [*range(20), None]:
        n = 60 if conv == 3 else draw.randrange(1, 9)
        for turn in range(n):
            role = draw.choice(["system"] if turn == 0 else ["user", "assistant", "assistant", "tool", None, ""])
            rows.append((conv, draw.choice([turn, turn, turn, None]), role, draw.choice(["Hello there.", "What is it?", "no end", "", "  ", None, "Yes!", "x " * 2000 + "."])))
    return rows + rows[:4]


@pytest.mark.parametrize("most,fan", [(4096, 256), (4, 2)])
def test_repair(spark, most, fan):
    rows = turn_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(3)
    got = repair.repair(repair.damaged(df).withColumnsRenamed({"conv": "conv_id"}), df, most=most, fan=fan).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in got} == brute_repair(rows) and len(got) == 21


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair(empty).collect() == []
    kept = spark.createDataFrame([(5, 0, "user", "a.", None)], TURNS)
    row = repair.repair(empty, kept).first()
    assert (row["conv_id"], row["cost"], row["audit"], row["repaired_sha256"]) == (5, 0, "", hashlib.sha256(b"").hexdigest())


def brute_jaccard(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), ids.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def set_rows():
    draw = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "two one"), (7, "one two three"), (None, "one two three"), (None, "alone in the world here"), (None, None)]
    n = 8
    for size in (6, 11, 12, 19, 20, 21, 22, 23, 24, 30, 60, 120, 400):
        for _ in range(3):
            base = [draw.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 4, 6):
                text = list(base)
                for _ in range(edits):
                    kind = draw.random()
                    at = draw.choice((0, len(text) - 1, draw.randrange(len(text))))
                    if kind < 0.4:
                        text[at] = draw.choice(words)
                    elif kind < 0.7 and len(text) > 4:
                        del text[at]
                    else:
                        text.insert(at, draw.choice(words))
                rows.append((n, " ".join(text)))
                n += 1
    passage = " ".join(draw.choice(words) for _ in range(100))
    rows += [(n + i, passage + " " + " ".join(draw.choice(words) for _ in range(draw.choice((4, 8, 12, 200))))) for i in range(60)]
    return rows + [rows[20], (n + 100, "long word " * 30_000)]


SETS = "doc_id long, text string, component_id string"


@pytest.mark.parametrize("limit,chunk", [(None, 2048), (0, 2048), (23, 16)])
def test_jaccard(spark, limit, chunk):
    rows = set_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SETS).repartition(3)
    got = jaccard.jaccard_components(df, limit=limit, chunk=chunk)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_jaccard(rows)


def test_jaccard_of_none(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SETS)).collect() == []


def test_sets_that_link_share_a_key():
    draw = random.Random(8)
    for _ in range(400):
        n = draw.randrange(1, 200)
        a = np.unique(np.array([draw.getrandbits(64) for _ in range(n)], np.uint64))
        gone = draw.randrange(0, max(n // 10, 1) + 1)
        b = np.unique(np.concatenate((a[: n - gone], np.array([draw.getrandbits(64) for _ in range(draw.randrange(0, max(n // 12, 1) + 1))], np.uint64))))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 90 * (len(a) + len(b) - same):
            assert set(jaccard.part_keys(a).tolist()) & set(jaccard.part_keys(b).tolist())
            if max(len(a), len(b)) <= 22:
                shared = set(jaccard.subset_keys(a)[0].tolist()) & set(jaccard.subset_keys(b)[0].tolist())
                sides = [s for k, s in zip(*map(np.ndarray.tolist, jaccard.subset_keys(min(a, b, key=len))), strict=True) if k in shared]
                assert 1 in sides


def test_links_connect_what_links_connect():
    draw = random.Random(9)
    pool = [draw.getrandbits(64) for _ in range(60)]
    for _ in range(30):
        sets = sorted((np.unique(np.array(draw.sample(pool, draw.choice((10, 40, 50, 55, 57, 58))), np.uint64)) for _ in range(25)), key=len)
        sizes = np.array([len(s) for s in sets])
        root = list(range(len(sets)))
        find = lambda i: i if root[i] == i else find(root[i])  # noqa: B023, E731
        for i, j in itertools.combinations(range(len(sets)), 2):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
        want = {frozenset(i for i in range(len(sets)) if find(i) == r) for r in map(find, range(len(sets)))}
        links = jaccard.links_of(sizes, sets)
        root = list(range(len(sets)))
        for i, j in links:
            root[find(i)] = find(j)
        assert {frozenset(i for i in range(len(sets)) if find(i) == r) for r in map(find, range(len(sets)))} == want and len(links) == len(sets) - len(want)


def test_the_boundary_follows_the_cost():
    assert jaccard.boundary() == 19 and jaccard.boundary(lists=100) > 19
