"""Media columns: ISO base media files built, walked and described without decoding their payloads."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

from pyspark.sql import DataFrame

from quire.llm.common import map_texts

#: A frame: 16 x 12 samples of 8 bits.
WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
#: Frames a second, which are also the frames of a chunk; each chunk begins with a key frame.
RATE = 25
#: Boxes that hold boxes.
HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"moof", b"traf", b"mvex", b"udta")
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def build(payload: bytes) -> bytes:
    """A file with one track of uncompressed 8-bit frames: `payload`, a positive multiple of FRAME bytes, is its samples."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    chunks = -(-frames // RATE)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    data = box(b"mdat", payload)
    start = len(head) + len(data) - len(payload)
    offsets = [start + i * RATE * FRAME for i in range(chunks)]
    wide = offsets[-1] >= 1 << 32
    runs = [(1, RATE if chunks > 1 else frames, 1)]
    if chunks > 1 and frames % RATE:
        runs.append((chunks, frames % RATE, 1))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, frames, 1)),
        full(b"stss", struct.pack(f">{chunks + 1}I", chunks, *range(1, frames + 1, RATE))),
        full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        full(b"stsz", struct.pack(">II", FRAME, frames)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
    )
    moov = box(
        b"moov",
        full(b"mvhd", struct.pack(">IIIIIHHII", 0, 0, RATE, frames, 0x10000, 0x100, 0, 0, 0), MATRIX, bytes(24), struct.pack(">I", 2)),
        box(
            b"trak",
            full(b"tkhd", struct.pack(">IIIIIIIHHHH", 0, 0, 1, 0, frames, 0, 0, 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3),
            box(
                b"mdia",
                full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
                full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
                box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
            ),
        ),
    )
    return head + data + moov


def walk(data, start: int = 0, end: int | None = None, path: tuple = (), depth: int = 0):
    """(path, start, end) of each box's body, nested boxes after their holders.

    Sizes 0 (to the end) and 1 (64 bits) are understood; a box that says it is longer than its
    holder ends with the holder, and one too short for its header ends the walk there.
    """
    end = len(data) if end is None else end
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and end - start >= 16:
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start:
            return
        stop = min(start + size, end)
        yield (*path, kind), body, stop
        if kind in HOLDERS and depth < 16:
            yield from walk(data, body, stop, (*path, kind), depth + 1)
        start += size


def tracks(data) -> list[dict]:
    """Per track: codec, width, height, timescale, duration, `samples`, and arrays of sample offsets, sizes and key frames.

    From the sample tables alone: stsd, stts, stss (absent: every sample is a key frame), stsc, stsz, stco or co64.
    """
    import numpy as np

    out, cur = [], None
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            cur = {"codec": "", "width": 0, "height": 0, "timescale": 0, "duration": 0, "sizes": np.zeros(0, np.int64), "keys": None, "runs": [], "chunks": np.zeros(0, np.int64)}
            out.append(cur)
        if cur is None or b"trak" not in path or end - at < 8:
            continue
        count = struct.unpack_from(">I", data, at + 4)[0]
        ints = lambda code, n, off: np.frombuffer(data, f">{code}", min(n, max(0, (end - at - off) // int(code[1]))), at + off).astype(np.int64)
        if kind == b"mdhd":
            cur["timescale"], cur["duration"] = struct.unpack_from(">IQ" if data[at] == 1 else ">II", data, at + (20 if data[at] == 1 else 12))
        elif kind == b"stsd" and end - at >= 16:
            cur["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1").strip()
            if end - at >= 44:
                cur["width"], cur["height"] = struct.unpack_from(">HH", data, at + 40)
        elif kind == b"stts":
            pairs = ints("u4", 2 * count, 8)
            cur["ticks"] = int((pairs[0::2][: len(pairs) // 2] * pairs[1::2]).sum())
        elif kind == b"stss":
            cur["keys"] = ints("u4", count, 8) - 1
        elif kind == b"stsc":
            cur["runs"] = ints("u4", 3 * count, 8).reshape(-1, 3).tolist()
        elif kind == b"stsz":
            n = struct.unpack_from(">I", data, at + 8)[0]
            cur["sizes"] = np.full(n, count, np.int64) if count else ints("u4", n, 12)
        elif kind in (b"stco", b"co64"):
            cur["chunks"] = ints("u8" if kind == b"co64" else "u4", count, 8)
    for t in out:
        n, chunks = len(t["sizes"]), t["chunks"]
        per = np.zeros(len(chunks), np.int64)
        for i, (first, each, _) in enumerate(t["runs"]):
            upto = t["runs"][i + 1][0] - 1 if i + 1 < len(t["runs"]) else len(chunks)
            per[first - 1 : upto] = each
        chunk_of = np.repeat(np.arange(len(chunks)), per)[:n]
        sizes = t["sizes"] = t["sizes"][: len(chunk_of)]
        ends = np.cumsum(sizes)
        firsts = np.minimum(np.cumsum(per) - per, max(len(sizes) - 1, 0))
        into = ends - sizes
        t["offsets"] = chunks[chunk_of] + into - (into[firsts][chunk_of] if len(sizes) else 0)
        t["samples"] = len(sizes)
        keys = np.arange(len(sizes)) if t["keys"] is None else t["keys"]
        t["keys"] = keys[(keys >= 0) & (keys < len(sizes))]
    return out


def describe(data: bytes) -> dict:
    """codec, width, height, seconds, samples and key frame byte ranges [offset, size] of the first track; zeros and none without a track."""
    found = tracks(data)
    if not found:
        return {"codec": "", "width": 0, "height": 0, "seconds": 0.0, "samples": 0, "keyframes": []}
    t = found[0]
    ranges = [[int(o), int(s)] for o, s in zip(t["offsets"][t["keys"]], t["sizes"][t["keys"]], strict=True)]
    return {"codec": t["codec"], "width": t["width"], "height": t["height"], "seconds": t["duration"] / t["timescale"] if t["timescale"] else 0.0, "samples": t["samples"], "keyframes": ranges}


def payload_of(data: bytes) -> bytes:
    """The sample bytes of the first track, read through its tables; neighbouring samples are read together."""
    import numpy as np

    found = tracks(data)
    if not found or not found[0]["samples"]:
        return b""
    o, s = found[0]["offsets"], found[0]["sizes"]
    cuts = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    return b"".join(data[o[a] : o[b - 1] + s[b - 1]] for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(o)])), strict=True))


OUTPUTS = {"media": "binary", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def media_columns(docs: DataFrame, outputs: tuple[str, ...] = ("media", "feature"), text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Store each whole text as the frames of an ISO media file and describe the file; `outputs` chooses from OUTPUTS.

    The UTF-8 bytes (null: none) are padded with spaces to a positive multiple of FRAME. `media` is the
    file; `feature` a JSON object of describe()'s values; the digests of the payload are of the bytes read back
    through the sample tables. Equal texts give equal values. Rows stay where they are: no shuffle, one row at
    a time in memory next to its slice of some MB. Input columns with the names of outputs are replaced.
    """

    def one(text):
        raw = text.encode() if text else b""
        data = build(raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME)))
        back = payload_of(data)
        return (data, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), json.dumps(describe(data), separators=(",", ":")))

    def work():
        def do(texts):
            cols = list(zip(*map(one, texts), strict=True)) or [()] * len(OUTPUTS)
            return {k: list(v) for k, v in zip(OUTPUTS, cols, strict=True) if k in outputs}

        return do

    return map_texts(docs, work, {k: OUTPUTS[k] for k in outputs}, text_col, carry)


def scan_media(files: DataFrame, content_col: str = "content", carry: list[str] | None = None) -> DataFrame:
    """Describe stored files: adds codec, width, height, seconds, samples and `keyframes` array<struct<offset,size>>.

    Works on any binary column, such as that of Spark's binaryFile source. Null or other bytes: an empty codec and no frames.
    """
    from pyspark.sql import functions as F

    carry = [c for c in files.columns if c != content_col] if carry is None else carry
    kinds = "codec string, width int, height int, seconds double, samples long, keyframes array<struct<offset:long,size:long>>"
    packed = files.select(F.struct(*carry, F.lit(0).alias("_pad")).alias("_row"), F.col(content_col).alias("_c"))
    from pyspark.sql.types import StructType

    schema = StructType([packed.schema["_row"], *StructType.fromDDL(kinds).fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            got = [describe(c or b"") for c in batch.column(1).to_pylist()]
            cols = [pa.array([[{"offset": o, "size": s} for o, s in g[f.name]] if f.name == "keyframes" else g[f.name] for g in got], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=arrow.names)

    return packed.mapInArrow(run, schema).select("_row.*", *StructType.fromDDL(kinds).names).drop("_pad")
