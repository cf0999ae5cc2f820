"""The parts that need no Spark, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from quire.llm import ann, bpe, hilbert, iso, langid, licences, lm, simhash


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_merge_replay_is_the_reference_encoding(vocabulary):
    import regex
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    replay, split = bpe.MergeReplay(vocabulary), regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(1)
    alphabet = "aab bzZ09 \n\t  éüß''sll!!…\x1c\x85中😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["abcdefg" * 3000]
    for t in texts:
        pieces = [w.encode() for w in split(t)]
        rest = iter(replay.encode([w for w in pieces if w not in replay.rank]))
        ids = [i for w in pieces for i in ([replay.rank[w]] if w in replay.rank else next(rest))]
        assert ids == enc.encode_ordinary(t)
    assert replay.encode([]) == []


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bit_sliced_links_connect_what_brute_force_connects(seed):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    f[50:200] = f[50]
    for i in range(50, 200):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f[i] ^= np.uint64(1) << np.uint64(b)
    keys = np.sort(rng.integers(0, 4, 300))
    brute = [(i, j) for i in range(300) for j in range(i + 1, 300) if keys[i] == keys[j] and int(f[i] ^ f[j]).bit_count() <= 4]
    got = simhash.spanning_links(keys, f)
    assert all(int(f[a] ^ f[b]).bit_count() <= 4 and keys[a] == keys[b] for a, b in got)
    assert components(300, got) == components(300, brute) and len(got) < 300


def test_every_close_pair_shares_a_block_choice():
    for most, m in simhash.PLANS:
        cuts = [round(64 * i / m) for i in range(m + 1)]
        rng = random.Random(m)
        for _ in range(300):
            bits = rng.sample(range(64), 4)
            assert sum(not any(cuts[i] <= b < cuts[i + 1] for b in bits) for i in range(m)) >= m - 4


def test_media_round_trip_and_damage():
    for n in (1, 2, 25, 26, 51):
        payload = random.Random(n).randbytes(iso.FRAME * n)
        data = iso.build(payload)
        found = iso.describe(data)
        assert iso.payload_of(data) == payload and found["samples"] == n and found["seconds"] == n / 25
        assert [data[o : o + s] for o, s in found["keyframes"]] == [payload[i * 192 : (i + 1) * 192] for i in range(0, n, 25)]
    for cut in range(0, len(data), 211):
        iso.describe(data[:cut]), iso.describe(data[cut:])
    assert iso.describe(b"")["codec"] == "" and iso.payload_of(b"junk junk junk") == b""
    with pytest.raises(ValueError):
        iso.build(b"x")


def test_hilbert_curve_is_one_path():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1)
        index = hilbert.hilbert_index(list(grid), bits)
        assert sorted(index) == list(range(1 << dims * bits))
        assert (np.abs(np.diff(grid[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


def test_estimates_are_close_and_bounded():
    rng = np.random.default_rng(5)
    v, q, turn = rng.standard_normal((500, 64)), rng.standard_normal((20, 64)), ann.rotation(64)
    codes, norms, factors = ann.encode(v, turn)
    size = np.linalg.norm(q, axis=1)[:, None]
    guess = ann.estimates(codes, 64, q, turn) * norms / factors * size
    slack = norms * np.sqrt(1 - factors**2) / factors * 2.4 / np.sqrt(63) * size
    assert (np.abs(guess - q @ v.T) <= slack).mean() > 0.95
    assert np.allclose(turn @ turn.T, np.eye(64))


def brute_licences(scanner, text):
    words = licences.words_of(text)
    pairs = list(zip(words, words[1:], strict=False))
    out = {}
    for name, own in scanner.bigrams.items():
        size = sum(own.values())
        wide = min(size, len(pairs))
        best = max((sum((Counter(pairs[s : s + wide]) & own).values()) for s in range(len(pairs) - wide + 1)), default=0) if pairs else 0
        if wide and 2 * best / (size + wide) >= 0.8:
            out[name] = 2 * best / (size + wide)
    return out


def test_licence_scan_is_the_best_window():
    scanner, rng = licences.Scanner(licences.TEMPLATES), random.Random(3)
    vocabulary = sorted({w for t in licences.TEMPLATES.values() for w in licences.words_of(t)})[:60] + ["x"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            t = licences.words_of(rng.choice(list(licences.TEMPLATES.values())))
            for _ in range(rng.randint(0, len(t) // 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            parts += t[rng.randint(0, 1) :] + rng.choices(vocabulary, k=rng.randint(0, 6))
        text = " ".join(parts)
        assert {n: d for n, d, _, _ in scanner.scan(text)} == brute_licences(scanner, text)
    assert scanner.scan(None) == scanner.scan("") == scanner.scan("one") == []


def test_licences_and_versions_are_told_apart():
    scanner = licences.Scanner(licences.all_templates())
    best = lambda t: (scanner.scan(t) or [(None, 0)])[0][:2]
    for name, text in licences.all_templates().items():
        found = scanner.scan(f"Some words first. {text} And some after.")
        assert (name, 1.0) in [f[:2] for f in found]
        kind = re.sub("-(text|header|notice|short)$", "", name)
        assert re.sub("-(text|header|notice|short)$", "", found[0][0]) == kind
    assert best("Licensed under CC BY 4.0.")[0] == "CC-BY-4.0-short"
    assert best("This work is licensed under the GNU General Public License, version 2.")[0] == "GPL-2.0"
    whole = {n.removesuffix("-text") for n in licences.all_templates() if n.endswith("-text")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "MIT", "Unlicense", "CC0-1.0", "ISC"} <= whole


def test_filters_give_every_language_of_a_gram():
    planes = langid.filled({0: [1, 2, 3], 1: [3, 4], 70: [3]}, 71)
    slots = langid.slots_of(np.array([3], np.uint32), planes.shape[1])
    masks = [int(p[slots[0][0]] & p[slots[1][0]]) for p in planes]
    assert masks[0] & 3 == 3 and masks[1] >> 6 & 1
    grams = lambda t: langid.grams_of(langid.fold(t)).tolist()
    filters = langid.Filters(["x", "y"], langid.filled({0: grams("alpha beta"), 1: grams("gamma delta")}, 2))
    got = filters.decide(["ALPHA, beta", "gamma", "", None, "123 !!", "qqqq", "alpha " * 600_000, "\u00b2 \u00bd \u2167", "\u4e2d"], "x")
    assert [g[0] for g in got] == ["x", "y", "und", "und", "und", "x", "x", "und", "x"] and all(0 <= g[1] <= 1 for g in got)
    assert langid.Filters([], langid.filled({}, 0)).decide(["text"], "und") == [("und", 0.0)]


def test_popcounts_are_what_counting_gram_by_gram_gives(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(50)]
    grams = {i: [int(g) for t in texts[i::7] for g in langid.grams_of(langid.fold(t))] for i in range(70)}
    filters = langid.Filters([f"l{i:02d}" for i in range(70)], langid.filled(grams, 70, 1 << 12))
    slots = [{tuple(int(s[0]) for s in langid.slots_of(np.array([g], np.uint32), 1 << 12)) for g in some} for some in grams.values()]
    bits = [{x for s in some for x in s} for some in slots]
    for piece in (1 << 21, 64):  # the second cuts texts into pieces
        monkeypatch.setattr(langid, "PIECE", piece)
        total, hits = filters.hits([langid.fold(t) for t in texts])
        for t, n, row in zip(texts, total, hits, strict=True):
            each = langid.grams_of(langid.fold(t)).tolist()
            assert n == len(each)
            where = [tuple(int(s[0]) for s in langid.slots_of(np.array([g], np.uint32), 1 << 12)) for g in each]
            assert row.tolist() == [sum(a in b and c in b for a, c in where) for b in bits]


def model_of(texts):
    """(alphabet, table, gates) of the contexts of some texts, counted one byte at a time."""
    words = [w for t in texts for w in [*lm.tokens_of(t), lm.END]]
    alphabet = lm.alphabet_of(np.bincount(lm.spelled(words)[0], minlength=256))
    cells = np.zeros((lm.TOTAL, lm.CELL))
    for t in texts:
        for byte, rows, _ in slow_bytes(t):
            for r in rows:
                cells[r // lm.CELL, alphabet["symbol"][byte]] += 1
    table, gates = lm.logits_of(cells, alphabet)
    return alphabet, table.ravel(), gates


def slow_bytes(text):
    """(byte, its context rows, (byte foretold, level) or None) of each byte of a text, one after another."""
    words, m32 = [*lm.tokens_of(text), lm.END], 0xFFFFFFFF
    put = lambda h, i: (((((h ^ h >> 15) * 0x2C1B3C6D) & m32) >> (32 - (lm.CONTEXTS[i][1].bit_length() - 1))) + sum(n for _, n in lm.CONTEXTS[:i])) * lm.CELL
    gone, seen, before, run = [], {}, 0, 0
    for n, w in enumerate(words):
        came = w if w == lm.END else w + b" "
        key = (words[n - 2] if n > 1 else b"", words[n - 1] if n else b"")
        was = seen.get(key)
        level = 0 if was is None else run + 1
        said = b"" if was is None else was if was == lm.END else was + b" "
        run = min(run + 1, 3) if was == w else 0
        seen[key] = w
        so_far, right = 0, True
        for i, byte in enumerate(came):
            last = [gone[-k] + 1 if k <= len(gone) else 0 for k in range(1, 6)]
            h = ((last[0] * 0x9E3779B1 + last[1]) * 0x9E3779B1 + last[2]) & m32
            rows = [put(h * 0x85EBCA6B & m32, 0)]
            h = ((h * 0x9E3779B1 + last[3]) * 0x9E3779B1 + last[4]) & m32
            rows.append(put(h * 0x85EBCA6B & m32, 1))
            word = (so_far * 0xC2B2AE35 + i) & m32
            rows.append(put(word, 2))
            rows.append(put((word ^ before) * 0x85EBCA6B & m32, 3))
            yield byte, rows, (said[i], level) if level and right and i < len(said) else None
            right = right and i < len(said) and said[i] == byte
            so_far = (so_far + (byte + 1) * pow(0x01000193, i + 1, 1 << 32)) & m32
            gone.append(byte)
        before = ((so_far ^ so_far >> 13) * 0x27D4EB2F) & m32


def slow_score(text, alphabet, table, gates):
    """The same model bit by bit, in plain Python."""
    from math import exp, log2

    out, weights, refined, own, step = 0.0, None, None, None, []

    def learn():
        moves = {}
        for g, x, p, known, cell, slot in step:
            for k in range(lm.INPUTS):
                moves[k] = moves.get(k, 0) + (known - p) * x[k]
        for k, d in moves.items():
            weights[step[0][0]][k] += d * lm.RATE / lm.SCALE**2
        old_r, old_o = {c[4]: refined[c[4]] for c in step}, {c[5]: own.get(c[5], 0.0) for c in step}
        for _, _, _, known, cell, slot in step:
            refined[cell] = old_r[cell] + (known - old_r[cell]) * lm.REFINE
            own[slot] = max(-127, min(127, old_o[slot] + (known - 1 / (1 + exp(-old_o[slot] / lm.SCALE))) * lm.PACE * lm.SCALE))
        step.clear()

    edge = (lm.CELLS - 1) // 2 / lm.FINE
    for n, (byte, rows, told) in enumerate(slow_bytes(text)):
        if n % lm.SPAN == 0:
            step.clear()
            weights = [[w / lm.SCALE for w in lm.STARTS] for _ in range(lm.GATES)]
            refined = [1 / (1 + exp(-(c - (lm.CELLS - 1) // 2) / lm.FINE)) for c in range(lm.CELLS)]
            own = {}
        s = alphabet["symbol"][byte]
        out += alphabet["cost"][byte]
        gate = int(gates[rows[lm.BY_WORD] // lm.CELL]) + (len(lm.GATE) + 1 if told else 0)
        path = {}
        if told:
            other = alphabet["symbol"][told[0]]
            path = {int(alphabet["node"][other, i]): int(alphabet["bit"][other, i]) for i in range(alphabet["length"][other])}
        for i in range(alphabet["length"][s]):
            node, bit = int(alphabet["node"][s, i]), int(alphabet["bit"][s, i])
            slot = ((rows[lm.BY_WORD] + node) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - (lm.SLOTS.bit_length() - 1))
            match = round(lm.MATCH[told[1] - 1] * lm.SCALE) * (2 * path[node] - 1) if node in path else 0
            x = [float(table[r + node]) for r in rows] + [match, own.get(slot, 0.0)]
            g = step[0][0] if step else gate
            mixed = max(-edge, min(edge, sum(a * b for a, b in zip(weights[g], x, strict=True))))
            p = 1 / (1 + exp(-mixed))
            cell = round(mixed * lm.FINE) + (lm.CELLS - 1) // 2
            out += log2(abs(1 - bit - (p + refined[cell]) / 2))
            step.append((g, x, p, bit, cell, slot))
            if len(step) == lm.STEP:
                learn()
    return out


def test_scores_are_those_of_a_slow_byte_by_byte_model(monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "Beta", "g\u00e4mma", "delta!", "x", "\U0001f600"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 3, 30, 31, 60, 25)] + ["a\tb  c\n" * 9, None, "q" * 70]
    model = model_of(texts[:5])
    for span in (4096, 50):  # the second codes texts in runs
        monkeypatch.setattr(lm, "SPAN", span)
        got = lm.code_texts([*texts, texts[3]], *model)
        assert got[-1] == got[3]
        for t, bits in zip(texts, got, strict=False):
            assert bits == pytest.approx(slow_score(t, *model), rel=2e-3, abs=0.02), t


def test_the_mixer_makes_the_score():
    """Without what the contexts have counted, a text that is like the others costs far more."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["lorem", "ipsum", "dolor", "amet", "elit"], k=40)) for _ in range(12)]
    alphabet, table, gates = model_of(texts[:10])
    flat = lm.code_texts(texts[10:], alphabet, np.zeros_like(table), np.zeros_like(gates))
    assert (lm.code_texts(texts[10:], alphabet, table, gates) > 0.6 * flat).all()


def test_bits_are_probabilities():
    """The chances of all symbols at the start of a text, and of all bytes after the last symbol, sum to one."""
    alphabet, table, gates = model_of(["ab ab ba a", "b"])
    length = alphabet["length"].astype(float)
    assert np.exp2(-length).sum() == pytest.approx(1)
    assert np.exp2(alphabet["cost"][alphabet["symbol"] == lm.CELL - 1]).sum() == pytest.approx(1)
    assert 0 < np.exp2(lm.code_texts([""], alphabet, table, gates)[0]) < 1
    assert lm.tokens_of(None) == [] and lm.tokens_of("\t \x0b") == [] and lm.tokens_of("A b") == [b"a", b"b"]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


FINGERPRINT = fingerprint
