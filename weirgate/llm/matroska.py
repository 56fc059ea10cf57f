"""Media columns: Matroska files in a binary column, parsed into packet tables.

`write` stores frames of 8-bit samples as A_PCM/INT/LIT audio: EBML header, Info, Tracks, Clusters of SimpleBlocks with
lacing, Cues. `packets` reads any such file: variable-length element ids and sizes, unknown sizes, SimpleBlocks and
BlockGroups, no, Xiph, fixed-size and EBML lacing, and cues; it yields one packet per frame with track, timestamp, byte
range and key flag. `samples` puts the stored payload together again from those byte ranges.

Defined results: a null text is the empty one, whose payload is one frame of spaces; equal texts give equal files; a null
or malformed file gives no packets (ParseError is raised by `parse`, and recorded as null by the columns made here).
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_column, text_of

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Samples of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, PER_BLOCK, PER_CLUSTER, HERTZ = 192, 8, 32, 8000
_MS = FRAME * 1000 // HERTZ


class ParseError(ValueError):
    pass


# ---- writing


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return _element(ident, struct.pack(">d", x))


def _lace(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """Flag bits and lacing header of a block's frames."""
    if len(frames) == 1 or lacing == "none":
        return 0, b""
    head, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if lacing == "fixed":
        return 0x04, head
    if lacing == "xiph":
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    deltas = [b - a for a, b in zip(sizes, sizes[1:-1])]
    return 0x06, head + _size(sizes[0]) + b"".join(_size(d + (1 << 7 * w - 1) - 1, w) for d in deltas for w in [next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)])


_HEADER = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING, 1) + _uint(DEFAULT_DURATION, _MS * 1_000_000) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _float(RATE, HERTZ) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))))


def write(frames: list[bytes], lacing: str = "fixed", per_block: int = PER_BLOCK, per_cluster: int = PER_CLUSTER) -> bytes:
    """A file of one audio track; fixed lacing needs frames of equal size."""
    info = _element(INFO, _uint(SCALE, 1_000_000) + _float(DURATION, float(len(frames) * _MS)) + _element(MUXER, b"weirgate") + _element(WRITER, b"weirgate"))
    body, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = 1 if lacing == "none" else per_block
    for first in range(0, len(frames), step * per_cluster):
        parts = [_uint(TIMESTAMP, first * _MS)]
        for i in range(first, min(first + step * per_cluster, len(frames)), step):
            block = frames[i : i + step]
            flags, head = _lace(block, lacing)
            parts.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (i - first) * _MS, 0x80 | flags) + head + b"".join(block)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * _MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster := _element(CLUSTER, b"".join(parts)))
        at += len(cluster)
    return _HEADER + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


# ---- reading


@dataclass
class Media:
    """What a file holds: tracks by number, packets (track, milliseconds, offset, bytes, key), cues (ms, track, offset of the cluster)."""

    doc_type: str = ""
    duration: float = 0.0
    scale: int = 1_000_000
    clusters: int = 0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def _vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, bool]:
    """A variable-length number at `at`: (value, next place, whether it says unknown). keep leaves the length marker in, as ids do."""
    if at >= end or data[at] == 0:
        raise ParseError(f"no number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ParseError(f"number cut off at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep else value), at + width, value == (1 << 7 * width) - 1


#: What an element of unknown size ends at: one that can't be inside it.
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}


def _children(data: bytes, at: int, end: int, inside: int = 0):
    """(id, start, end) of each element; one of unknown size lasts until an element that ends it."""
    while at < end:
        ident, at, _ = _vint(data, at, end, keep=True)
        if inside == CLUSTER and ident in _TOP:
            return
        n, at, unknown = _vint(data, at, end)
        stop = end if unknown else at + n
        if stop > end:
            raise ParseError(f"element {ident:x} cut off at {at}")
        if unknown and ident == CLUSTER:
            stop = at
            for _, _, stop in _children(data, at, end, CLUSTER):
                pass
        yield ident, at, stop
        at = stop


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _real(data: bytes, at: int, end: int) -> float:
    if end == at:
        return 0.0
    if end - at not in (4, 8):
        raise ParseError(f"float of {end - at} bytes")
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0]


def _block(data: bytes, at: int, end: int, base: int, media: Media, key: bool | None) -> None:
    track, at, _ = _vint(data, at, end)
    if at + 3 > end:
        raise ParseError(f"block cut off at {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing, key = flags >> 1 & 3, bool(flags & 0x80) if key is None else key
    if lacing == 0:
        sizes = [end - at]
    else:
        if at >= end:
            raise ParseError("no lace count")
        count = data[at] + 1
        at += 1
        if lacing == 2:
            if (end - at) % count:
                raise ParseError("fixed lacing doesn't divide the block")
            sizes = [(end - at) // count] * count
        else:
            sizes, last = [], 0
            for k in range(count - 1):
                if lacing == 1:
                    n = 0
                    while True:
                        if at >= end:
                            raise ParseError("lace size cut off")
                        n += data[at]
                        at += 1
                        if data[at - 1] != 255:
                            break
                else:
                    first = at
                    n, at, _ = _vint(data, at, end)
                    if k:
                        n += last - ((1 << 7 * (at - first) - 1) - 1)
                sizes.append(last := n)
            sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ParseError("lace sizes exceed the block")
    each = media.tracks.get(track, {}).get("default_ns", 0)
    for k, n in enumerate(sizes):
        media.packets.append((track, (base + relative) * media.scale // 1_000_000 + k * each // 1_000_000, at, n, key))
        at += n


def parse(data: bytes) -> Media:
    """Raises ParseError where the bytes aren't a Matroska file."""
    media, end = Media(), len(data)
    for top, a, b in _children(data, 0, end):
        if top == EBML:
            media.doc_type = next((data[x:y].rstrip(b"\0").decode("ascii", "replace") for i, x, y in _children(data, a, b) if i == DOC_TYPE), "")
        elif top == SEGMENT:
            for ident, c, d in _children(data, a, b):
                if ident == INFO:
                    for i, x, y in _children(data, c, d):
                        if i == SCALE:
                            media.scale = _number(data, x, y)
                        elif i == DURATION:
                            media.duration = _real(data, x, y)
                elif ident == TRACKS:
                    for i, x, y in _children(data, c, d):
                        if i == TRACK_ENTRY:
                            _track(data, x, y, media)
                elif ident == CLUSTER:
                    _cluster(data, c, d, media)
                elif ident == CUES:
                    _cues(data, c, d, media)
    if media.doc_type not in ("matroska", "webm"):
        raise ParseError("no Matroska header")
    return media


def _track(data: bytes, at: int, end: int, media: Media) -> None:
    track: dict = {"number": 0}
    for i, x, y in _children(data, at, end):
        if i in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns"}[i]] = _number(data, x, y)
        elif i == CODEC:
            track["codec"] = data[x:y].decode("ascii", "replace")
        elif i == AUDIO:
            for j, s, t in _children(data, x, y):
                if j == RATE:
                    track["rate"] = _real(data, s, t)
                elif j in (CHANNELS, DEPTH):
                    track["channels" if j == CHANNELS else "depth"] = _number(data, s, t)
    media.tracks[track["number"]] = track


def _cluster(data: bytes, at: int, end: int, media: Media) -> None:
    base = 0
    media.clusters += 1
    for i, x, y in _children(data, at, end, CLUSTER):
        if i == TIMESTAMP:
            base = _number(data, x, y)
        elif i == SIMPLE_BLOCK:
            _block(data, x, y, base, media, None)
        elif i == BLOCK_GROUP:
            inner = list(_children(data, x, y))
            key = all(j != REFERENCE for j, _, _ in inner)
            for j, s, t in inner:
                if j == BLOCK:
                    _block(data, s, t, base, media, key)


def _cues(data: bytes, at: int, end: int, media: Media) -> None:
    for i, x, y in _children(data, at, end):
        if i == CUE_POINT:
            when, where = 0, []
            for j, s, t in _children(data, x, y):
                if j == CUE_TIME:
                    when = _number(data, s, t)
                elif j == CUE_POSITIONS:
                    got = {k: _number(data, u, v) for k, u, v in _children(data, s, t) if k in (CUE_TRACK, CUE_CLUSTER)}
                    where.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
            media.cues += [(when, *x) for x in where]


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    view = memoryview(data)
    return b"".join(view[at : at + n] for t, _, at, n, _ in media.packets if t == track)


def features(media: Media, payload: bytes) -> str:
    """packets:clusters:cues:milliseconds of the last packet:mean:standard deviation:crossings of the mean, the reals with 4 places."""
    if not payload:
        return f"{len(media.packets)}:{media.clusters}:{len(media.cues)}:0:0.0000:0.0000:0"
    x = np.frombuffer(payload, np.uint8)
    above = x > x.mean()
    return f"{len(media.packets)}:{media.clusters}:{len(media.cues)}:{media.packets[-1][1]}:{x.mean():.4f}:{x.std():.4f}:{np.count_nonzero(above[1:] != above[:-1])}"


# ---- columns


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME))


def store_texts(df: DataFrame, id_col="doc_id", text_col="text", lacing="fixed") -> DataFrame:
    """doc_id, n_bytes of the text, and the Matroska file that holds its padded bytes as samples."""

    def make():
        def apply(texts):
            made = [padded(x) for x in texts]
            return {"n_bytes": [n for n, _ in made], "media": [write([p[i : i + FRAME] for i in range(0, len(p), FRAME)], lacing) for _, p in made]}

        return apply

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], text_of(df, text_col), make, pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())]))


def read_media(df: DataFrame, id_col="doc_id", media_col="media", keep=(), track: int = 1) -> DataFrame:
    """doc_id, the payload of one track read back from the file, and its features; null where the file can't be parsed."""

    def make():
        def apply(files):
            out = {"payload": [], "feature": []}
            for data in files:
                try:
                    media = parse(data or b"")
                    payload = samples(data, media, track)
                    found = payload, features(media, payload)
                except ParseError:
                    found = None, None
                out["payload"].append(found[0])
                out["feature"].append(found[1])
            return out

        return apply

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id"), *keep], F.col(media_col), make, pa.schema([("payload", pa.binary()), ("feature", pa.string())]))


def packet_table(df: DataFrame, id_col="doc_id", media_col="media") -> DataFrame:
    """One row per packet: doc_id, packet, track, timestamp_ms, byte_start, n_bytes, key."""

    def make():
        def apply(files):
            out = []
            for data in files:
                try:
                    out.append(parse(data or b"").packets)
                except ParseError:
                    out.append([])
            return {k: [[int(p[i]) for p in x] for x in out] for i, k in enumerate(("track", "timestamp_ms", "byte_start", "n_bytes", "key"))}

        return apply

    names = ("track", "timestamp_ms", "byte_start", "n_bytes", "key")
    table = map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], F.col(media_col), make, pa.schema([(n, pa.list_(pa.int64())) for n in names]))
    rows = table.select("doc_id", F.posexplode(F.arrays_zip(*names)).alias("packet", "p"))
    return rows.select("doc_id", F.col("packet").cast("bigint").alias("packet"), *(F.col(f"p.{n}").alias(n) for n in names[:-1]), (F.col("p.key") == 1).alias("key"))


_DIGEST = pa.schema([("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string())])


def store_and_read(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """store_texts and read_media in one pass: n_bytes, the file, the payload read back from the file, features."""

    def make():
        def apply(texts):
            out = {k: [] for k in _DIGEST.names}
            for x in texts:
                n, p = padded(x)
                data = write([p[i : i + FRAME] for i in range(0, len(p), FRAME)])
                media = parse(data)
                back = samples(data, media)
                for k, v in (("n_bytes", n), ("payload", back), ("media", data), ("feature", features(media, back))):
                    out[k].append(v)
            return out

        return apply

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], text_of(df, text_col), make, _DIGEST)


_SUMS = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64()), ("packets_sha256", pa.string())])


def digest(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """store_and_read, and the packet table's digest (track:timestamp:start:bytes:key of each, comma-joined), hashed where they are made: neither file nor payload leaves the task."""

    def make():
        def apply(texts):
            out = {k: [] for k in _SUMS.names}
            for x in texts:
                n, p = padded(x)
                data = write([p[i : i + FRAME] for i in range(0, len(p), FRAME)])
                media = parse(data)
                back = samples(data, media)
                packets = ",".join(":".join(str(int(v)) for v in packet) for packet in media.packets)
                made = (n, len(back), sha256(back).hexdigest(), crc32(back[-16:]), len(data), sha256(data).hexdigest(), features(media, back), len(media.packets), sha256(packets.encode()).hexdigest())
                for k, v in zip(_SUMS.names, made):
                    out[k].append(v)
            return out

        return apply

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], text_of(df, text_col), make, _SUMS)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
