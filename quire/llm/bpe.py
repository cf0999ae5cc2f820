"""Byte-level BPE: merges replayed in rank order over an inverted index from pairs to word positions."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import commonest, map_texts, slices, store

#: Most words that are merged once for the corpus and broadcast, and rarer words whose ids a task remembers.
TABLE, CACHE = 120_000, 60_000
#: Bytes of text that a task works on at once, and bytes of words that are merged together.
SLICE, TOGETHER = 2 << 20, 1 << 20
#: Bytes of the longest pieces that are merged in waves; and the rank of a pair that doesn't merge.
SHORT, NEVER = 48, (1 << 31) - 1
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank: lines of base64 and rank, the ranks without gaps from 0."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class MergeReplay:
    """Encodes many distinct words together.

    The words stand one after another in linked lists of symbols. `waiting` maps the
    rank of a mergeable pair to the positions where the pair stands; ranks are taken in
    order from a heap, and each merge touches the two neighbours only. If a merge makes
    a pair of lower rank than its own, that rank goes first, as in a word-by-word encoder.
    """

    def __init__(self, tokens: list[bytes]):
        import numpy as np

        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.first = np.full((256, 256), -1, np.int32)
        for t, i in self.rank.items():
            if len(t) == 2:
                self.first[t[0], t[1]] = i
        self.pairs: dict[int, int] = {}

    def pair_rank(self, a: int, b: int) -> int:
        key = a << 32 | b
        r = self.pairs.get(key)
        if r is None:
            r = self.pairs[key] = self.rank.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, which must not be empty."""
        import numpy as np

        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(data)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate(([0], ends[:-1]))] = -1
        rank_at = np.full(n, -1, np.int32)
        rank_at[:-1] = self.first[data[:-1], data[1:]]
        rank_at[ends - 1] = -1
        where = np.flatnonzero(rank_at >= 0)
        where = where[np.argsort(rank_at[where], kind="stable")]
        ranks, starts = np.unique(rank_at[where], return_index=True)
        waiting = {int(r): p.tolist() for r, p in zip(ranks, np.split(where, starts[1:]), strict=True)} if len(where) else {}
        heap = list(waiting)
        symbols, after, before, rank_at = self.single[data].tolist(), after.tolist(), before.tolist(), rank_at.tolist()
        pair_rank, push = self.pair_rank, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            todo = waiting.pop(r, None)
            if todo is None:
                continue
            todo.sort()
            for k, i in enumerate(todo):
                if rank_at[i] != r:
                    continue  # a neighbour's merge has changed or taken this pair
                j = after[i]
                symbols[i], rank_at[j] = r, -1
                m = after[i] = after[j]
                new, lower = -1, False
                if m >= 0:
                    before[m] = i
                    new = pair_rank(r, symbols[m])
                    if new >= 0:
                        if new in waiting:
                            waiting[new].append(i)
                        elif new != r:
                            waiting[new] = [i]
                            push(heap, new)
                        lower = new < r
                rank_at[i] = new
                if new == r:
                    waiting.setdefault(r, []).append(i)
                    push(heap, r)
                p = before[i]
                if p >= 0:
                    new = rank_at[p] = pair_rank(symbols[p], r)
                    if new >= 0:
                        if new in waiting:
                            waiting[new].append(p)
                        else:
                            waiting[new] = [p]
                            push(heap, new)
                        lower |= new < r
                if lower:
                    waiting.setdefault(r, []).extend(todo[k + 1 :])
                    push(heap, r)
                    break
        out, at = [], 0
        for end in ends.tolist():
            ids, i = [], at
            while i >= 0:
                ids.append(symbols[i])
                i = after[i]
            out.append(ids)
            at = end
        return out


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """How often each word after a space stands in the texts that can be cut there: `word` string, `n` long."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()

        def flush():
            words = list(seen)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[w] for w in some], pa.int64())], names=["word", "n"])
            seen.clear()

        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                for text in part.column("_text").to_pylist():
                    seen.update(spaced(text)[1:])
                if len(seen) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_LOOSE = re.compile(r"\s ").search


def spaced(text: str | None) -> list[str]:
    """What stands between the spaces of a text in which no space follows white space; else nothing."""
    return text.split(" ") if text and not _LOOSE(text) else []


def pair_table(tokens: list[bytes]):
    """(keys, ranks): an open-addressing hash table of the pairs of tokens that merge, keyed by left << 32 | right; -1 where empty."""
    import numpy as np

    rank = {t: i for i, t in enumerate(tokens)}
    pairs = [(rank[t[:k]] << 32 | rank[t[k:]], r) for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
    size = 1 << max(4, (3 * len(pairs)).bit_length())
    keys, ranks = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
    new = np.array([p[0] for p in pairs], np.int64)
    values = np.array([p[1] for p in pairs], np.int32)
    at = slot_of(new, size)
    while len(new):
        # Of those that want the same free slot the first gets it; the others look one further.
        free = keys[at] == -1
        _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
        won = first[free[first]]
        keys[at[won]], ranks[at[won]] = new[won], values[won]
        rest = np.ones(len(new), bool)
        rest[won] = False
        new, values, at = new[rest], values[rest], (at[rest] + 1) & (size - 1)
    return keys, ranks


def slot_of(keys, size: int):
    """Where the search for each key begins in a table of `size` slots (a power of two)."""
    import numpy as np

    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def merge_waves(words: list[bytes], single, table):
    """(ids of all words one after another, where each word's begin and the end): the leftmost lowest-ranked pair of every word is merged in each wave.

    `single`: the ids of the 256 bytes. A wave gives new ranks only to the pairs on either side of a merge; words without a pair
    that merges leave. The waves are as many as the most merges of a word, so long words are better left to MergeReplay.
    """
    import numpy as np

    keys, ranks = table
    size = len(keys)

    def rank_of(left, right):
        want = left.astype(np.int64) << 32 | right
        at = slot_of(want, size)
        out = np.full(len(want), NEVER, np.int32)
        todo = np.arange(len(want))
        while len(todo):
            here = keys[at]
            hit = here == want
            out[todo[hit]] = ranks[at[hit]]
            go = ~hit & (here != -1)
            todo, want, at = todo[go], want[go], (at[go] + 1) & (size - 1)
        return out

    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols, word = single[data], np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    pairs = np.full(len(symbols), NEVER, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    pairs[inner] = rank_of(symbols[inner], symbols[inner + 1])
    done_ids, done_words = [], []
    while len(symbols):
        starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)[:-1]))
        least = np.minimum.reduceat(pairs, starts)
        over = least == NEVER
        if over.any():
            out = np.repeat(over, sizes)
            done_ids.append(symbols[out])
            done_words.append(word[out])
            symbols, word, pairs = symbols[~out], word[~out], pairs[~out]
            sizes, least = sizes[~over], least[~over]
            if not len(symbols):
                break
        hits = np.flatnonzero(pairs == np.repeat(least, sizes))
        owner = word[hits]
        at = hits[np.concatenate(([True], owner[1:] != owner[:-1]))]  # the leftmost of each word
        symbols[at] = least
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word, pairs = symbols[keep], word[keep], pairs[keep]
        sizes = sizes - 1
        at = at - np.arange(len(at))
        for left in (at[at > 0] - 1, at[at + 1 < len(symbols)]):
            left = left[word[left] == word[left + 1]]
            pairs[left] = rank_of(symbols[left], symbols[left + 1])
        ends = np.cumsum(sizes) - 1  # the last symbol of each word begins no pair
        pairs[ends] = NEVER
    ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
    owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int32)
    return ids[np.argsort(owner, kind="stable")], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(owner, minlength=len(words)))))


class Words:
    """Encodes words by the pattern and the merges, many at a time; what it makes of a word is (ids in decimal, their count, decoded bytes[, int32 bytes])."""

    def __init__(self, tokens: list[bytes], pattern: str, table=None, packing: bool = True):
        import regex

        self.packing = packing
        self.tokens = tokens
        self.decimal = list(map(str, range(len(tokens))))
        self.replay = MergeReplay(tokens)
        self.table = table
        self.split = regex.compile(pattern).findall
        self.held: dict[str, tuple] = {}

    def pieces(self, pieces) -> dict[str, tuple]:
        """What is made of distinct pieces: one that is a token takes its id, all others are merged over one index (TOGETHER bytes at a time), or in waves if there is a pair table."""
        rank, out, some, short, size = self.replay.rank, {}, [], [], 0
        for piece in pieces:
            raw = piece.encode()
            r = rank.get(raw)
            if r is not None:
                out[piece] = self.entry([r])
            elif self.table is not None and len(raw) <= SHORT:
                short.append((piece, raw))
            else:
                some.append((piece, raw))
                size += len(raw)
                if size >= TOGETHER:
                    out |= zip([p for p, _ in some], map(self.entry, self.replay.encode([b for _, b in some])), strict=True)
                    some, size = [], 0
        out |= zip([p for p, _ in some], map(self.entry, self.replay.encode([b for _, b in some])), strict=True)
        if short:
            ids, ends = merge_waves([b for _, b in short], self.replay.single, self.table)
            packed, flat, ends = ids.tobytes(), ids.tolist(), ends.tolist()
            decimal, tokens = [self.decimal[i] for i in flat], [self.tokens[i] for i in flat]
            for (p, _), a, b in zip(short, ends, ends[1:], strict=False):
                made = " ".join(decimal[a:b]), b - a, b"".join(tokens[a:b])
                out[p] = (*made, packed[4 * a : 4 * b]) if self.packing else made
        return out

    def entry(self, ids: list[int]):
        made = " ".join([self.decimal[i] for i in ids]), len(ids), b"".join([self.tokens[i] for i in ids])
        return (*made, array("i", ids).tobytes()) if self.packing else made

    def learn(self, words, known: dict, front: str = "") -> dict:
        """What is made of each of the words with `front` before it; `known` (words after a space) and `held` are looked up for their pieces first."""
        held = self.held
        cut = {w: self.split(front + w) for w in words}
        held |= self.pieces({p for c in cut.values() for p in c if not (p[0] == " " and p[1:] in known) and p not in held})
        out = {}
        for w, c in cut.items():
            got = [held.get(p) or known[p[1:]] for p in c]
            if len(got) > 1:
                ids, n, *parts = zip(*got, strict=True)
                out[w] = (" ".join(ids), sum(n), *map(b"".join, parts))
            else:
                out[w] = got[0] if got else self.entry([])
        return out


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, outputs: tuple[str, ...] = ("ids",), text_col: str = "text", carry: list[str] | None = None, by_space: bool = True, table: int = TABLE) -> DataFrame:
    """Encode every whole text; each match of `pattern` is encoded on its own, without special tokens.

    `outputs` chooses from OUTPUTS: the ids, their count, the SHA-256 of the
    decimal ids joined by a space, and the bytes that those ids decode to, or
    their SHA-256. Null text counts as empty: no ids. `carry` lists the
    input columns to keep (default: all); columns named as outputs are replaced. No rows: no rows.

    The distinct words of the corpus are counted, and the commonest (`table` at the most) are merged once for the corpus, many
    together over one index in rank order, and broadcast with their ids and decoded bytes. Words beyond that table are rare: each task merges
    the pieces of its own slices that the table lacks, all words together in waves, and remembers CACHE of them. A bound on what is broadcast is the reason for
    the second half; the ids are the same.

    `by_space` says that in the pattern a space before a character that isn't white space starts a match
    and that no other match takes in a space and what follows it; texts in which no space follows white space are then cut
    there into words first. Other texts are cut by the pattern alone.
    Only words and counts are shuffled, no texts. The vocabulary is broadcast; its size does not depend on the data.
    """
    spark = docs.sparkSession
    shipped, pairs = spark.sparkContext.broadcast(tokens), spark.sparkContext.broadcast(pair_table(tokens))
    packing, made = "ids" in outputs, {}
    if by_space and table:
        counts = store(word_counts(docs, text_col), "words")

        def merge(batches):
            import pyarrow as pa

            words = Words(shipped.value, pattern)
            for batch in batches:
                words.held.clear()
                got = words.learn(batch.column(0).to_pylist(), {}, " ")
                cols = zip(*got.values(), strict=True) if got else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)]], names=["word", "ids", "n", "decoded", "packed"])

        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        found = commonest(counts, table)[0].select("word").repartition(parts).mapInArrow(merge, "word string, ids string, n long, decoded binary, packed binary")
        found = (found if packing else found.drop("packed")).toArrow()
        made = dict(zip(found.column(0).to_pylist(), zip(*[c.to_pylist() for c in found.columns[1:]], strict=True), strict=True))
    common = spark.sparkContext.broadcast(made)

    def work():
        import numpy as np
        import pyarrow as pa

        words, known = Words(shipped.value, pattern, pairs.value, packing), common.value
        held = dict(known)  # and the rare words
        gc.freeze()  # the table is not to be searched for garbage again and again

        def do(texts):
            if len(held) - len(known) + len(words.held) > CACHE:
                words.held.clear(), held.clear()
                held.update(known)
            cuts = [spaced(t) if by_space else [] for t in texts]
            held.update(words.learn(set().union(*[c[1:] for c in cuts]).difference(held), held, " "))
            heads = words.learn({c[0] for c in cuts if c}, held)
            wild = [words.split(t) if t and not c else () for t, c in zip(texts, cuts, strict=True)]
            pieces = words.pieces(set().union(*wild))
            ids, count, back, packed = [], [], [], []
            for c, w in zip(cuts, wild, strict=True):
                if c:
                    got = [heads[c[0]], *map(held.__getitem__, c[1:])]
                else:
                    got = [*map(pieces.__getitem__, w)]
                parts = [*zip(*got, strict=True)] or [()] * 4
                ids.append(" ".join(parts[0]) if c and c[0] or not c else " ".join(parts[0][1:]))
                count.append(sum(parts[1]))
                back.append(b"".join(parts[2]))
                if packing:
                    packed.append(b"".join(parts[3]))
            out = {"n_tokens": count, "decoded": back}
            if packing:
                ends = np.cumsum([0, *count]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            if "ids_sha256" in outputs:
                out["ids_sha256"] = [hashlib.sha256(s.encode()).hexdigest() for s in ids]
            if "decoded_sha256" in outputs:
                out["decoded_sha256"] = [hashlib.sha256(b).hexdigest() for b in back]
            return {k: out[k] for k in outputs}

        return do

    return map_texts(docs, work, {k: OUTPUTS[k] for k in outputs}, text_col, carry, SLICE)


def decode(rows: DataFrame, tokens: list[bytes], ids_col: str = "ids") -> DataFrame:
    """Add `text`: the ids of `ids_col` decoded as UTF-8, wrong bytes replaced. Null ids: null."""
    shipped = rows.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("string")
    def joined(ids):
        t = shipped.value
        return ids.map(lambda x: None if x is None else b"".join(t[i] for i in x).decode("utf-8", "replace"))

    return rows.withColumn("text", joined(F.col(ids_col)))
