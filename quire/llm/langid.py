"""Language ID: bit-sliced Bloom filters give, for each n-gram, the mask of all languages that contain it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, slices, store

#: Bytes in an n-gram of the folded text.
GRAM = 4
#: Expected training documents of a language; above, documents are drawn by a hash of the id.
SAMPLE = 4000
#: An n-gram belongs to every language in which it is at least this share as frequent as in the language that has it most.
SHARED = 0.25
#: Slots of a filter: a power of two, ROOM for each n-gram of the richest language, and from LEAST to MOST; a filter that is fuller for that passes more
#: n-grams that its language lacks, for which the counts are corrected.
ROOM, LEAST, MOST = 8, 1 << 18, 1 << 22
#: Slots set for an n-gram.
HASHES = 2
#: Multipliers of the hashes: odd 64-bit numbers.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of folded text worked on at once.
PIECE = 1 << 21
UND = "und"

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str) -> bytes:
    """Lower case as UTF-8; ASCII characters other than letters become single spaces; a space at either end."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b"   "


def grams_of(folded: bytes):
    """All GRAM-byte windows as 32-bit numbers, but those that begin with the closing spaces."""
    import numpy as np

    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    n = max(len(b) - GRAM, 0)
    return b[:n] | b[1 : n + 1] << 8 | b[2 : n + 2] << 16 | b[3 : n + 3] << 24


def slots_of(grams, size: int):
    """The HASHES slots of each n-gram among `size`."""
    import numpy as np

    wide, shift = grams.astype(np.uint64), np.uint64(65 - size.bit_length())
    return [(wide * np.uint64(m)) >> shift for m in MULTIPLIERS[:HASHES]]


def filled(grams: dict[int, list[int]], languages: int, size: int = LEAST):
    """The filters of languages (by number) over n-grams, stored slot by slot: bit l of plane p is language 64p + l."""
    import numpy as np

    planes = np.zeros(((languages + 63) // 64, size), np.uint64)
    for i, some in grams.items():
        for slots in slots_of(np.asarray(some, np.uint32), size):
            planes[i // 64, slots] |= np.uint64(1 << i % 64)
    return planes


class Filters:
    """One Bloom filter per language over the same slots (see filled())."""

    def __init__(self, languages: list[str], planes):
        import numpy as np
        import regex

        self.languages, self.planes = languages, planes
        self.letter = regex.compile(r"\p{L}").search
        full = [((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        #: Chance that an n-gram that a language lacks passes its filter; below 1, as a filter that passes all tells nothing.
        self.false = np.minimum(np.array(full), 0.999) ** HASHES

    def hits(self, texts: list[bytes]):
        """(n-grams, n-grams per language) of folded texts: popcounts of the masks' bits."""
        import numpy as np

        total = np.zeros(len(texts), np.int64)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= PIECE):
                size += len(texts[upto])
                upto += 1
            for base in range(0, size, PIECE) if upto == at + 1 else (0,):
                part = [texts[at][base : base + PIECE + GRAM]] if upto == at + 1 else texts[at:upto]
                self._count(part, total[at:upto], out[at:upto])
            at = upto
        return total, out

    def _count(self, texts, total, out):
        import numpy as np

        each = [grams_of(t) for t in texts]
        sizes = np.array([len(g) for g in each])
        if not sizes.any():
            return
        slots = slots_of(np.concatenate(each), self.planes.shape[1])
        some = np.flatnonzero(sizes)
        starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        total += sizes
        for p, plane in enumerate(self.planes):
            masks = plane[slots[0]]
            for s in slots[1:]:
                masks &= plane[s]
            for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                bit = ((masks >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int32)
                out[some, i] += np.add.reduceat(bit, starts)

    def decide(self, texts: list[str | None], default: str):
        """(language, score) of each text."""
        import numpy as np

        folded = [fold(t) if t else b"" for t in texts]
        total, hits = self.hits(folded)
        # Of n n-grams, h pass; h = c + (n - c) f, so c of them are expected to be in the language.
        real = np.maximum((hits - total[:, None] * self.false) / (1 - self.false), 0)
        best = real.argmax(axis=1) if len(self.languages) else np.zeros(len(texts), int)
        out = []
        for t, i, row in zip(texts, best.tolist(), real, strict=True):
            if not t or not self.letter(t) or not self.languages:
                out.append((UND, 0.0))
            elif row[i] <= 0:
                out.append((default, 0.0))
            else:
                second = np.partition(row, -2)[-2] if len(row) > 1 else 0.0
                out.append((self.languages[i], float(row[i] / (row[i] + second))))
        return out


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple:
    """(languages in code point order, their filters, the commonest language (ties: the first in code point order)) from labelled rows.

    Of a language with more than SAMPLE documents about SAMPLE are drawn by a hash of the id; all languages and all n-grams of what is drawn count. Rows with null text or language teach nothing.
    The driver gets a row per language and the filters: up to MOST numbers for 64 languages, whatever the number of documents.
    """
    import numpy as np

    spark = rows.sparkSession
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_t"))
    counts = store(rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_docs")), "languages")
    found = sorted((r["_lang"], r["_docs"]) for r in counts.collect())
    if not found:
        return [], np.zeros((0, LEAST), np.uint64), UND
    languages = [lang for lang, _ in found]
    default = min(found, key=lambda x: (-x[1], x[0]))[0]
    numbered = spark.createDataFrame([(lang, i) for i, lang in enumerate(languages)], "_lang string, _at int")
    drawn = F.pmod(F.xxhash64("_id", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.join(F.broadcast(counts), "_lang").where(drawn < F.lit(float(SAMPLE)) / F.col("_docs")).join(F.broadcast(numbered), "_lang")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "_t", PIECE):
                texts: dict[int, list[bytes]] = {}
                for at, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.setdefault(at, []).append(fold(t))
                for at, some in texts.items():
                    windows = [t[i : i + PIECE + GRAM] for t in some for i in range(0, len(t), PIECE)]
                    for group in [[w] for w in windows] if len(windows) > len(some) else [windows]:
                        grams, n = np.unique(np.concatenate([grams_of(w) for w in group]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), at, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["at", "gram", "n"])

    grams = store(sample.select("_at", "_t").mapInArrow(count, "at int, gram long, n long").groupBy("at", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = grams.groupBy("at").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("grams"))
    richest = totals.agg(F.coalesce(F.max("grams"), F.lit(0))).first()[0]
    size = min(max(1 << (ROOM * richest).bit_length(), LEAST), MOST)
    rated = grams.join(F.broadcast(totals), "at").select("at", "gram", (F.col("n") / F.col("total")).alias("rate"))
    kept = rated.groupBy("gram").agg(F.collect_list(F.struct("at", "rate")).alias("all"), F.max("rate").alias("most"))
    kept = kept.select("gram", F.filter("all", lambda x: x["rate"] >= F.col("most") * SHARED)["at"].alias("in"))

    def fill(batches):
        import pyarrow as pa

        planes = filled({}, len(languages), size)
        for batch in batches:
            lists = batch.column(1)
            at, gram = lists.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            for slots in slots_of(gram, size):
                np.bitwise_or.at(planes, (at // 64, slots), np.uint64(1) << (at % 64).astype(np.uint64))
        plane, slot = np.nonzero(planes)
        for i in range(0, len(slot), 1 << 16):
            p, s = plane[i : i + (1 << 16)], slot[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(planes[p, s].view(np.int64))], names=["plane", "slot", "mask"])

    masks = kept.mapInArrow(fill, "plane int, slot int, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    planes = filled({}, len(languages), size)
    planes[masks.column(0).to_numpy(), masks.column(1).to_numpy()] = masks.column(2).to_numpy().view(np.uint64)
    return languages, planes, default


def identify(docs: DataFrame, model: tuple, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add `lang_pred` string and `score` double to every document; only the text is looked at. `model`: of learn().

    For each language, the n-grams that pass its filter are counted (one lookup gives the
    mask of all languages) and corrected for false positives; the most decides,
    ties to the first language in code point order. score: best / (best + second), 0.5 to 1, or 0
    for a default. Null text or one without a letter (of any script; numerals are none): `und`, 0. No n-gram known: the
    commonest language, 0. Very long texts are counted in pieces. `carry`: the input columns to keep (default: all); columns named as outputs are replaced.
    No rows: no rows. No shuffle; the filters are broadcast (MOST * 8 bytes for 64 languages at the most) as plain arrays.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        languages, planes, default = shipped.value
        filters = Filters(languages, planes)

        def do(texts):
            got = filters.decide(texts, default)
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return do

    return map_texts(docs, work, {"lang_pred": "string", "score": "double"}, text_col, carry)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """True if the CRC-32 of the id as text leaves `part`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
