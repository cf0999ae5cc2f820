"""LM scoring: online logistic context mixing over the bits of a text, and a unigram base."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import commonest, slices, store, unclashed

#: Contexts whose counts are taken from the whole corpus, each a predictor: (name, slots). The bytes cross words; the last two are whole-word contexts. Counts are hashed into `slots` rows of 64 symbols.
CONTEXTS = (("three bytes", 1 << 15), ("five bytes", 1 << 17), ("word so far", 1 << 17), ("word before and word so far", 1 << 17))
#: The context by whose counts weights are chosen.
BY_WORD = 2
#: Inputs of the mixer: the contexts, the match, and the predictor that learns from the text alone.
INPUTS = len(CONTEXTS) + 2
#: Logits are kept as logit * SCALE in 8 bits.
SCALE = 14.0
#: The gate: weights are chosen by how often the word so far has been seen (below 1, 8, 512, ...) and by whether the match foretells.
GATE = (1, 8, 512)
GATES = 2 * (len(GATE) + 1)
#: Weights at the start of a text, one for each input, and the rate at which they move.
STARTS = (0.25, 0.25, 0.4, 0.3, 0.5, 0.3)
RATE = 0.01
#: Bits that are coded with the same weights.
STEP = 4
#: The refinement: cells by mixed logit, cells a unit of logit, and the rate at which they learn.
CELLS, FINE, REFINE = 33, 4 / 3, 0.02
#: The predictor that learns in the text: slots by word so far and bit node, and its rate.
SLOTS, PACE = 1 << 11, 0.8
#: The match: logit of what it foretells, by the words foretold in a row (0 to 3).
MATCH = (0.5, 2.0, 3.5, 4.5)
#: Bytes of text laid out at a time, and bytes coded one after another: longer texts go on side by side in runs of SPAN, each from the starting weights.
PIECE, SPAN = 3 << 19, 4096
#: Bytes of texts whose contexts are hashed at a time; steps whose inputs are looked up at a time.
LAY, BLOCK = 1 << 18, 32
#: The commonest tokens, HEAVY at the most, are broadcast; the others are looked up by a join.
HEAVY = 100_000
#: Distinct tokens that a task counts before it hands them on.
FLUSH = 300_000
#: Model rows that are handed on as one row.
ROWS = 1 << 10

#: The end of a text, as a token: no word has this byte.
END = b"\n"
#: Symbols: the 63 commonest bytes have one each, and the last symbol comes before any other byte.
CELL = 64
_SIZES = [slots for _, slots in CONTEXTS]
_OFFSETS = [sum(_SIZES[:i]) for i in range(len(_SIZES))]
TOTAL = sum(_SIZES)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text in bytes, A-Z lower-cased; without the end."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def spelled(words: list[bytes]):
    """(bytes, where each word begins, sizes): each word as it is scored, with a space after it; the end has none."""
    import numpy as np

    each = [w if w == END else w + b" " for w in words]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes


def context_rows(data, begin, sizes, opens):
    """Where the model row of each byte of spelled words begins in the table: one array per context. `opens`: the words that begin a text."""
    import numpy as np

    n = len(data)
    first = np.repeat(begin, sizes)
    into = np.arange(n) - first
    start = np.maximum.accumulate(np.where(opens, begin, 0))
    since = np.arange(n) - np.repeat(start, sizes)
    wide = data.astype(np.uint32) + np.uint32(1)
    last = []
    for back in range(1, 6):
        x = np.zeros(n, np.uint32)
        x[back:] = wide[:-back]
        x[since < back] = 0
        last.append(x)
    put = lambda h, i: ((((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (_SIZES[i].bit_length() - 1))) + np.uint32(_OFFSETS[i])) * np.uint32(CELL)
    out = []
    h = (last[0] * np.uint32(0x9E3779B1) + last[1]) * np.uint32(0x9E3779B1) + last[2]
    out.append(put(h * np.uint32(0x85EBCA6B), 0))
    h = (h * np.uint32(0x9E3779B1) + last[3]) * np.uint32(0x9E3779B1) + last[4]
    out.append(put(h * np.uint32(0x85EBCA6B), 1))
    # The word so far: sums of bytes times powers, as differences of running sums modulo 2**32.
    powers = np.cumprod(np.full(int(into.max(initial=0)) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    runs = np.concatenate((np.zeros(1, np.uint32), np.cumsum(wide * powers[into], dtype=np.uint32)))
    so_far = (runs[:n] - runs[first]) * np.uint32(0xC2B2AE35) + into.astype(np.uint32)
    out.append(put(so_far, 2))
    whole = runs[begin + sizes] - runs[begin]
    before = np.concatenate((np.zeros(1, np.uint32), whole[:-1]))[: len(whole)]
    before[opens] = 0
    before = (before ^ (before >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    out.append(put((so_far ^ np.repeat(before, sizes)) * np.uint32(0x85EBCA6B), 3))
    return out


def alphabet_of(counts) -> dict:
    """The symbols and their Huffman code from the counts of 256 bytes.

    symbol: of each byte. cost: log2 of the chance of a byte after the last symbol. length, node, bit: of each symbol the bits of its
    code and the tree node at which each is decided. ones, zeros: 64 x 64 matrices of which symbols lie on each side of a node.
    """
    import numpy as np

    counts = np.asarray(counts, float)
    order = np.argsort(-counts, kind="stable")
    symbol = np.full(256, CELL - 1, np.int64)
    symbol[order[: CELL - 1]] = np.arange(CELL - 1)
    rare = symbol == CELL - 1
    cost = np.zeros(256)
    cost[rare] = np.log2((counts[rare] + 1.0) / (counts[rare] + 1.0).sum())
    weight = np.bincount(symbol, counts, CELL)
    weight += weight.sum() / 4096 + 1  # no code is much longer than 12 bits
    heap = [(w, s, None) for s, w in enumerate(weight.tolist())]
    heapq.heapify(heap)
    node = CELL - 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        node -= 1
        heapq.heappush(heap, (a[0] + b[0], CELL + node, (node, a, b)))
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(heap[0], [])]
    while stack:
        (_, s, inner), path = stack.pop()
        if inner is None:
            paths[s] = path
        else:
            at, a, b = inner
            stack += [(a, [*path, (at, 0)]), (b, [*path, (at, 1)])]
    most = max(map(len, paths.values()))
    out = {"symbol": symbol, "cost": cost, "length": np.array([len(paths[s]) for s in range(CELL)]), "node": np.zeros((CELL, most), np.uint8), "bit": np.zeros((CELL, most), np.uint8), "ones": np.zeros((CELL, CELL)), "zeros": np.zeros((CELL, CELL))}
    for s, path in paths.items():
        for i, (at, bit) in enumerate(path):
            out["node"][s, i], out["bit"][s, i] = at, bit
            out["ones" if bit else "zeros"][s, at] = 1
    return out


def logits_of(counts, alphabet):
    """Rows of symbol counts as rows of bit nodes of the code, and each row's gate."""
    import numpy as np

    counts = counts.astype(np.float64)
    logit = np.log((counts @ alphabet["ones"] + 0.3) / (counts @ alphabet["zeros"] + 0.3))
    return np.clip(np.rint(logit * SCALE), -127, 127).astype(np.int8), np.searchsorted(GATE, counts.sum(axis=1), side="right").astype(np.uint8)


class Laid:
    """Texts laid out to be counted or coded: bytes, context rows, what the match foretells, and the runs of bytes of each text.

    `texts`: (owner, words, words at the front that only give contexts). A run has SPAN bytes at the most.
    """

    def __init__(self, texts):
        import numpy as np

        words = [w for _, t, _ in texts for w in t]
        self.data, begin, sizes = spelled(words)
        counts = np.fromiter((len(t) for _, t, _ in texts), np.int64, len(texts))
        at = np.cumsum(counts) - counts
        opens = np.zeros(len(words), bool)
        opens[at] = True
        ends = np.append(begin, len(self.data))
        self.rows = np.empty((len(CONTEXTS), len(self.data)), np.int32)
        # A group of texts at a time, as the hashing takes many times their bytes.
        groups = np.flatnonzero(np.diff(ends[at] // LAY, prepend=-1)) if len(at) else []
        marks = [*at[groups].tolist(), len(words)]
        for a, b in zip(marks, marks[1:], strict=False):
            self.rows[:, ends[a] : ends[b]] = context_rows(self.data[ends[a] : ends[b]], begin[a:b] - begin[a], sizes[a:b], opens[a:b])
        lead = np.fromiter((x for _, _, x in texts), np.int64, len(texts))
        starts, stops = ends[at + lead], ends[at + counts]
        runs = -(-(stops - starts) // SPAN)
        which = np.repeat(np.arange(len(texts)), runs)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
        self.begin = starts[which] + nth * SPAN
        self.length = np.minimum(stops[which] - self.begin, SPAN)
        self.owner = np.fromiter((i for i, _, _ in texts), np.int64, len(texts))[which]
        self.coded = np.ones(len(self.data), bool)
        for i in np.flatnonzero(lead):
            self.coded[ends[at[i]] : starts[i]] = False
        self._words, self._begin, self._sizes, self._texts = words, begin, sizes, texts

    def guesses(self):
        """(byte foretold, level) by byte: 0 without a match, else 1 + the words foretold in a row; up to and with the first wrong byte of a word.

        After two words that have come before in the text, the word is foretold that followed them last.
        """
        import numpy as np

        level, wrong, i = bytearray(len(self._words)), [], 0
        for _, t, _ in self._texts:
            seen: dict = {}
            one, two, run = b"", b"", 0
            for w in t:
                key = (two, one)
                was = seen.get(key)
                if was is None:
                    run = 0
                else:
                    level[i] = run + 1
                    if was == w:
                        run = min(run + 1, 3)
                    else:
                        wrong.append((i, was))
                        run = 0
                seen[key] = w
                two, one = one, w
                i += 1
        guess, levels = self.data.copy(), np.repeat(np.frombuffer(level, np.uint8), self._sizes)
        for i, was in wrong:
            said = was if was == END else was + b" "
            at, size = int(self._begin[i]), int(self._sizes[i])
            came = self.data[at : at + size].tobytes()
            m = 1
            while m < min(len(said), size) and said[m - 1] == came[m - 1]:
                m += 1
            guess[at : at + m] = np.frombuffer(said[:m], np.uint8)
            levels[at + m : at + size] = 0
        return guess, levels


def laid_out(texts, most: int | None = None):
    """The texts (None for null) as Laid, of about `most` (PIECE) bytes each. Of a longer text each part but the first has the six words before it in front."""
    most = PIECE if most is None else most
    held, size = [], 0
    for i, text in enumerate(texts):
        words = [*tokens_of(text), END]
        n = len(text or "") + 1
        if n <= most:
            parts = [(words, 0)]
        else:
            cuts, n = [0], 0
            for k, w in enumerate(words):
                n += len(w) + 1
                if n > most:
                    cuts.append(k + 1)
                    n = 0
            cuts = sorted({*cuts, len(words)})
            parts = [(words[max(a - 6, 0) : b], min(a, 6)) for a, b in zip(cuts, cuts[1:], strict=False)]
        for part, lead in parts:
            long = sum(map(len, part)) + len(part)
            if held and size + long > most:
                yield Laid(held)
                held, size = [], 0
            held.append((i, part, lead))
            size += long
    if held:
        yield Laid(held)


def bits_of(laid: Laid, alphabet: dict):
    """The bits of the laid-out bytes by their codes, one after another.

    (first bit of each byte and the end, byte of each bit, node, bit, logit of the match in 8 bits)
    """
    import numpy as np

    symbols = alphabet["symbol"].astype(np.int32)[laid.data]
    sizes = alphabet["length"][symbols]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    most = alphabet["node"].shape[1]
    byte = np.repeat(np.arange(len(symbols), dtype=np.int32), sizes)
    place = np.arange(len(byte), dtype=np.int32)
    place += np.repeat((symbols * most - ends[:-1]).astype(np.int32), sizes)
    node, bit = alphabet["node"].ravel()[place], alphabet["bit"].ravel()[place]
    del place
    guess, level = laid.guesses()
    match = np.zeros(len(byte), np.int8)
    at = np.flatnonzero(level)
    if len(at):
        at = np.repeat(at, sizes[at])
        said = np.arange(len(at)) + np.repeat(*_shifts(ends, sizes, np.flatnonzero(level)))
        other = alphabet["symbol"][guess[at]]
        into = said - ends[at]
        here = other * most + into
        same = (into < alphabet["length"][other]) & (alphabet["node"].ravel()[here % (CELL * most)] == node[said])
        strength = np.rint(np.array((0.0, *MATCH)) * SCALE).astype(np.int8)[level[at]]
        match[said] = np.where(same, np.where(alphabet["bit"].ravel()[here % (CELL * most)] == 1, strength, -strength), 0)
    return ends, byte, node, bit, match


def _shifts(ends, sizes, some):
    """For the bits of the bytes `some`, one after another: how far each byte's bits stand from their place in all bits, and how many there are."""
    import numpy as np

    n = sizes[some]
    return ends[some] - (np.cumsum(n) - n), n


def code_runs(laid: Laid, alphabet: dict, table, gates):
    """log2 of the probability of each run of bytes, bit by bit.

    Runs stand side by side, longest first, and go on together by STEP bits. Each context row, the match and the predictor that
    learns from the text give a logit for a bit; the weights of the gate mix them; the refinement maps the mixed logit
    to how such bits have come out in this run, and the mean of both is the prediction. After every step the weights, the refinement and that predictor
    move towards what came; a run has its own.
    """
    import numpy as np

    f32 = np.float32
    ends, byte_of, node_of, bit_of, match_of = bits_of(laid, alphabet)
    rows = laid.rows
    gate_of = gates[rows[BY_WORD] >> 6]
    gate_of += np.where(match_of[ends[:-1]] != 0, len(GATE) + 1, 0).astype(np.uint8)
    starts, stops = ends[laid.begin], ends[laid.begin + laid.length]
    order = np.argsort(starts - stops, kind="stable")
    starts, stops = starts[order], stops[order]
    lengths = stops - starts
    lanes, steps = len(order), -(-int(lengths[0]) // STEP) if len(order) else 0
    alive = np.searchsorted(-lengths, -np.arange(0, (steps + 1) * STEP, STEP), side="left").tolist()  # runs with more bits than that
    lane = np.arange(lanes)
    weights = np.repeat(np.tile(np.array(STARTS, f32)[:, None] / f32(SCALE), (1, GATES)), lanes, axis=1)
    centres = (np.arange(CELLS, dtype=f32) - (CELLS - 1) // 2) / f32(FINE)
    refined = np.tile(1 / (1 + np.exp(-centres)), lanes).astype(f32)
    own = np.zeros(lanes * SLOTS, f32)
    rate, pace = f32(RATE / SCALE / SCALE), f32(PACE * SCALE)
    total = np.zeros(lanes)
    each = np.arange(STEP)[None, :, None]
    edge, fine = f32((CELLS - 1) // 2 / FINE), f32(FINE)
    home = lane * CELLS + (CELLS - 1) // 2
    for t0 in range(0, steps, BLOCK):
        n0, many = alive[t0], min(BLOCK, steps - t0)
        at = np.minimum(starts[:n0] + (np.arange(t0, t0 + many)[:, None, None] * STEP + each), stops[:n0] - 1)
        byte, node, bits = byte_of[at], node_of[at].astype(np.int32), bit_of[at].astype(f32)
        x = np.empty((many, INPUTS, STEP, n0), f32)
        for k in range(len(CONTEXTS)):
            x[:, k] = table[rows[k][byte] + node]
        x[:, -2] = match_of[at]
        slot = ((rows[BY_WORD][byte].view(np.uint32) + node.view(np.uint32)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (SLOTS.bit_length() - 1))
        slot = slot.astype(np.int64) + lane[:n0] * SLOTS
        gated = gate_of[byte[:, 0]].astype(np.int64) * lanes + lane[:n0]
        for i in range(many):
            n, whole = alive[t0 + i], alive[t0 + i + 1]
            if not n:
                break
            here, known, mine, g = x[i, :, :, :n], bits[i, :, :n], slot[i, :, :n], gated[i, :n]
            learned = own[mine]
            here[-1] = learned
            w = weights[:, g]
            mixed = (here * w[:, None, :]).sum(axis=0)
            np.clip(mixed, -edge, edge, out=mixed)
            p = 1 / (1 + np.exp(-mixed))
            cell = home[:n] + np.rint(mixed * fine).astype(np.int64)
            r = refined[cell]
            chance = np.abs((1 - known) - (p + r) * f32(0.5))
            wrong = known - p
            if whole < n:  # runs that end within this step
                past = (starts[whole:n] + (t0 + i) * STEP + each[0]) >= stops[whole:n]
                chance[:, whole:][past] = 1
                wrong[:, whole:][past] = 0
            total[:n] += np.log2(chance.prod(axis=0))
            refined[cell] = r + (known - r) * f32(REFINE)
            own[mine] = np.clip(learned + (known - 1 / (1 + np.exp(learned * f32(-1 / SCALE)))) * pace, -127, 127)
            weights[:, g] = w + (here * (wrong * rate)).sum(axis=1)
    out = np.empty(lanes)
    out[order] = total
    costs = np.concatenate((np.zeros(1), np.cumsum(alphabet["cost"][laid.data])))
    return out + costs[laid.begin + laid.length] - costs[laid.begin]


def code_texts(texts, alphabet: dict, table, gates):
    """log2 of the probability of each text; equal texts are coded once."""
    import numpy as np

    distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    bits = np.zeros(len(distinct))
    for laid in laid_out(distinct):
        np.add.at(bits, laid.owner, code_runs(laid, alphabet, table, gates))
    return bits[[distinct[t] for t in texts]]


def count_tokens(docs: DataFrame) -> DataFrame:
    """Every token of all `_text`, ends included, with how often it stands in training texts (`_taught`): `token` binary, `n` long."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen, other = Counter(), set()

        def flush():
            words = list(other.union(seen))
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([seen[w] for w in some], pa.int64())], names=["token", "n"])
            seen.clear()
            other.clear()

        for batch in batches:
            for part in slices(batch, "_text"):
                for text, taught in zip(part.column("_text").to_pylist(), part.column("_taught").to_pylist(), strict=True):
                    (seen if taught else other).update([*tokens_of(text), END])
                if len(seen) + len(other) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("_text", "_taught").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def bytes_of(tokens: DataFrame):
    """How often each byte stands in the spelled training tokens."""
    import numpy as np

    def count_bytes(batches):
        import pyarrow as pa

        sums = np.zeros(256)
        for batch in batches:
            data, _, sizes = spelled(batch.column(0).to_pylist())
            sums += np.bincount(data, np.repeat(batch.column(1).to_numpy(), sizes), 256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(sums.astype(np.int64))], names=["byte", "n"])

    out = np.zeros(256)
    for r in tokens.where("n > 0").select("token", "n").mapInArrow(count_bytes, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def count_contexts(docs: DataFrame, alphabet: dict) -> DataFrame:
    """Logits and gates of the context counts over all training texts: `row` int, `table`, `gates` binary.

    Tasks are two for each core, each over many partitions, as what a task hands on is up to the size of the table.
    """
    import numpy as np
    import zstandard

    wide = ROWS * CELL
    cell_of = np.dtype([("at", "<u2"), ("n", "<u4")])
    symbol = alphabet["symbol"].astype(np.int32)

    def count(batches):
        import pyarrow as pa

        cells, held, pack = np.zeros(TOTAL * CELL, np.uint32), 0, zstandard.ZstdCompressor(1).compress

        def flush():
            for row in range(-(-TOTAL // ROWS)):
                some = cells[row * wide : (row + 1) * wide]
                at = np.flatnonzero(some)
                if len(at):
                    packed = np.empty(len(at), cell_of)
                    packed["at"], packed["n"] = at, some[at]
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([pack(packed["at"].tobytes() + packed["n"].tobytes())], pa.binary())], names=["row", "cells"])
            cells.fill(0)

        for batch in batches:
            for part in slices(batch, "_text", LAY * 4):
                for laid in laid_out(part.column("_text").to_pylist(), LAY * 2):
                    symbols = symbol[laid.data]
                    some = slice(None) if laid.coded.all() else laid.coded
                    for rows in laid.rows:
                        np.add.at(cells, (rows + symbols)[some], np.uint32(1))
                    held += len(laid.data)
                    if held >= 1 << 31:
                        yield from flush()
                        held = 0
        yield from flush()

    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, 1)
    found = docs.where("_taught").select("_text").coalesce(tasks).mapInArrow(count, "row int, cells binary")
    gathered = found.groupBy("row").agg(F.collect_list("cells").alias("parts"))

    def shrink(batches):
        import pyarrow as pa

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                sums = np.zeros(wide)
                for cells in batch.column(1)[i].values:
                    raw = unpack(cells.as_py())
                    n = len(raw) // 6
                    sums[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)
                made = [x.tobytes() for x in logits_of(sums.reshape(-1, CELL), alphabet)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([m], pa.binary()) for m in made]], names=["row", "table", "gates"])

    return store(gathered.mapInArrow(shrink, "row int, table binary, gates binary"), "contexts")


def tables_of(contexts: DataFrame):
    """(table of logits, gates) of count_contexts() on the driver: TOTAL rows of CELL bytes, whatever the size of the corpus."""
    import numpy as np

    size = -(-TOTAL // ROWS) * ROWS
    table, gates = np.zeros(size * CELL, np.int8), np.zeros(size, np.uint8)
    for r in contexts.toLocalIterator():
        table[r["row"] * ROWS * CELL : (r["row"] + 1) * ROWS * CELL] = np.frombuffer(r["table"], np.int8)
        gates[r["row"] * ROWS : (r["row"] + 1) * ROWS] = np.frombuffer(r["gates"], np.uint8)
    return table, gates


def score(docs: DataFrame, training, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add to every document `n_tokens`, `n_known`, `train_tokens` long, `base_score`, `score`, `bits_per_byte` double.

    `training` is a condition (null counts as false) on rows to learn from. A text is its lower-cased words and an end.
    base_score: log10 of its unigram probability with add-one smoothing over the training tokens and one unknown token.
    score: log10 of the probability that the mixer gives the bits of the same tokens, every word of every text spelled in its place: counts of
    contexts that cross words, of the word so far (the words' own counts), and of it after the word before, the match with
    what came earlier in the text, and a predictor that learns from the text are mixed; weights, refinement and that predictor go on learning as the text is coded.
    bits_per_byte: the same by the bytes of the tokens, a space after each word.
    Null text counts as empty: an end only. Nothing to learn from: N = V = 0, every token unknown, no context counts. No rows: no rows. A text's score
    depends on the text and the counts alone, so equal texts have equal scores.
    `carry`: the input columns to keep (default: all); columns named as outputs are replaced.

    Counts are gathered over all training texts. Texts longer than SPAN bytes are coded in runs of SPAN
    side by side, each with all of its contexts, its weights starting anew.

    The texts are not shuffled, only tokens and context counts are, and the lookup of tokens that are not among the HEAVY
    commonest (which are broadcast, as is the model).
    """
    from math import log10

    import numpy as np

    spark = docs.sparkSession
    outputs = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    carry = unclashed(docs.columns if carry is None else carry, outputs)
    texts = docs.select(F.col(text_col).alias("_text"), F.coalesce(training, F.lit(False)).alias("_taught"))
    tokens = store(count_tokens(texts), "tokens")
    sums = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("V")).first()
    n_all, n_distinct = int(sums["n"]), int(sums["V"])
    alphabet = alphabet_of(bytes_of(tokens))
    model = spark.sparkContext.broadcast((alphabet, *tables_of(count_contexts(texts, alphabet))))
    words = tokens.withColumn("base", F.log10((F.col("n") + 1) / F.lit(float(n_all + n_distinct + 1))))
    heavy, light = commonest(words, HEAVY)
    found = heavy.select("token", "base", "n").toArrow()
    common = spark.sparkContext.broadcast(({w: i for i, w in enumerate(found.column(0).to_pylist())}, found.column(1).to_numpy(), found.column(2).to_numpy() > 0))
    del found
    packed = docs.select(F.col(text_col).alias("_text"), F.struct(*carry, F.lit(0).alias("_pad")).alias("_row"))
    from pyspark.sql.types import StructType

    schema = StructType([packed.schema["_row"], *StructType.fromDDL("n_tokens long, n_known long, base double, bits double, bytes long, rest array<binary>, times array<int>").fields])

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        index, base, met = common.value
        coded = model.value
        kinds = [f.type for f in list(to_arrow_schema(schema))[1:]]
        for batch in batches:
            for part in slices(batch, "_text"):
                cols = [[] for _ in kinds]
                texts = part.column("_text").to_pylist()
                for text, told in zip(texts, code_texts(texts, *coded).tolist(), strict=True):
                    words = [*tokens_of(text), END]
                    at = [index.get(w, -1) for w in words]
                    known = np.array(at)
                    rest = Counter([w for w, i in zip(words, at, strict=True) if i < 0])
                    known = known[known >= 0]
                    row = (len(words), int(met[known].sum()), float(base[known].sum()), told, sum(map(len, words)) + len(words) - 1, list(rest), list(rest.values()))
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([part.column("_row"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names)

    scored = store(packed.mapInArrow(run, schema).withColumn("_at", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_at", F.explode(F.arrays_zip("rest", "times")).alias("_x")).select("_at", F.col("_x.rest").alias("token"), F.col("_x.times").alias("times"))
    looked = rare.join(light, "token")  # every token is in the table, so no row is lost
    sums = looked.groupBy("_at").agg(F.sum(F.col("base") * F.col("times")).alias("_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"))
    out = scored.join(sums, "_at", "left")
    return out.select(
        *[F.col("_row")[c].alias(c) for c in carry],
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("bits") * F.lit(log10(2))).alias("score"),
        (-F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )
