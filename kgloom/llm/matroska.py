"""Media columns in Matroska: reading files into packet tables, and writing them.

``packets`` parses a column of Matroska bytes: variable-length EBML elements,
clusters with SimpleBlocks and BlockGroups, Xiph, EBML and fixed lacing, and
cues, to one row for each frame with track, timestamp and byte range.
``mux_samples`` writes bytes as a track of unsigned 8-bit PCM samples, which
``packets`` reads back without loss.  ``store_texts`` does both for a text column.

Defined results: a null file gives no packets, a broken one those before the break, the
last of them with an error (``strict`` makes it an error of the query); null text counts as empty; repeated rows and null keys pass through; the
bytes of equal texts are equal.  Memory is bounded by one Arrow batch of rows
and the largest single value.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
DEFAULT_DURATION, TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD = 0x23E383, 0x1254C367, 0x1043A770, 0x1941A469, 0x114D9B74
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
#: Elements that end a cluster of unknown size.
LEVEL_1 = {INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD, SEGMENT, EBML}
MASTERS = {SEGMENT, TRACKS, INFO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, TRACK_ENTRY, AUDIO, EBML}

PACKET = "track long, timestamp_ns long, start long, length long, keyframe boolean, lacing string, cued boolean, codec string, error string"


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    start: int
    length: int
    keyframe: bool
    lacing: str
    cued: bool
    codec: str | None = None
    error: str | None = None


# Reading


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length number, where it ends, and whether all its bits are set (unknown size)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no EBML number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    low = value & ((1 << 7 * width) - 1)
    return (value if keep_marker else low), at + width, low == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, body start and body end of the elements between two places.

    A segment of unknown size reaches to the end of its parent, a cluster of
    unknown size to the next element that cannot be inside one.
    """
    while at < end:
        ident, at, _ = vint(data, at, keep_marker=True)
        size, at, unknown = vint(data, at)
        stop = end if unknown else at + size
        if unknown and ident == CLUSTER:
            stop = cluster_end(data, at, end)
        if stop > end:
            raise ValueError(f"element {ident:x} ends beyond its parent")
        yield ident, at, stop
        at = stop


def cluster_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends whose body begins at ``at``; a broken element is left to its reader."""
    while at < end:
        try:
            ident, body, _ = vint(data, at, keep_marker=True)
            if ident in LEVEL_1:
                return at
            size, body, unknown = vint(data, body)
        except (ValueError, IndexError):
            return end
        if unknown or body + size > end:
            return end
        at = body + size
    return end


@dataclass
class Track:
    """What a track's entry says about the time of its frames."""

    codec: str | None = None
    duration_ns: int | None = None
    rate: float = 8000.0
    channels: int = 1
    bits: int | None = None

    def spans(self, sizes: list[int], block_ns: int | None) -> list[int]:
        """When each frame of a block begins after the first, in nanoseconds.

        By the frames' default duration, for PCM by their samples, else by an even
        part of the block's own duration; 0 where the file says nothing of these.
        """
        if self.duration_ns:
            return [n * self.duration_ns for n in range(len(sizes))]
        width = (self.bits or 0) * self.channels
        if (self.codec or "").startswith("A_PCM/") and width and self.rate > 0:
            before, out = 0, []
            for size in sizes:
                out.append(round(before * 8 * 1_000_000_000 / (width * self.rate)))
                before += size
            return out
        return [n * block_ns // len(sizes) if block_ns else 0 for n in range(len(sizes))]


def read_track(data: bytes, at: int, end: int) -> tuple[int, Track]:
    number, track = 0, Track()
    for ident, x, y in elements(data, at, end):
        if ident == TRACK_NUMBER:
            number = unsigned(data, x, y)
        elif ident == CODEC_ID:
            track.codec = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif ident == DEFAULT_DURATION:
            track.duration_ns = unsigned(data, x, y)
        elif ident == AUDIO:
            for i, a, b in elements(data, x, y):
                if i == SAMPLING_FREQUENCY and b - a in (4, 8):
                    track.rate = struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]
                elif i == CHANNELS:
                    track.channels = unsigned(data, a, b)
                elif i == BIT_DEPTH:
                    track.bits = unsigned(data, a, b)
    return number, track


def unsigned(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def laced_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames in a block's payload and where the first begins."""
    if kind == 0:
        return [end - at], at
    count = data[at] + 1
    at += 1
    if kind == 2:  # all of one size
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError("fixed lacing of frames of unequal size")
        return [size] * count, at
    sizes = []
    if kind == 1:  # Xiph: sums of bytes up to one below 255
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    else:  # EBML: the first size, then signed differences
        for n in range(count - 1):
            before = at
            value, at, _ = vint(data, at)
            sizes.append(value if n == 0 else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    return [*sizes, end - at - sum(sizes)], at


def read_packets(data: bytes, strict: bool = True) -> list[Packet]:
    """The frames of a file in the order of their bytes.

    Where the file breaks off, an error; without ``strict`` the frames before the
    break, the last of them with the ``error``.
    """
    scale, out, cues, tracks = 1_000_000, [], set(), {}
    places: list[int] = []  # the cluster of each packet, from the segment's body on

    def block(at: int, end: int, cluster_at: int, cluster_time: int, key: bool | None, lasts: int | None = None) -> None:
        number, at, _ = vint(data, at)
        offset, flags = struct.unpack_from(">hB", data, at)
        kind = flags >> 1 & 3
        sizes, at = laced_sizes(data, at + 3, end, kind)
        if min(sizes) < 0:
            raise ValueError("a laced frame ends before it begins")
        track = tracks.get(number, Track())
        for size, after in zip(sizes, track.spans(sizes, None if lasts is None else lasts * scale), strict=True):
            if not -(1 << 63) <= (cluster_time + offset) * scale + after < 1 << 63:
                raise ValueError("a time has more than 64 bits")
            out.append(Packet(number, (cluster_time + offset) * scale + after, at, size, bool(flags & 0x80) if key is None else key, ("none", "xiph", "fixed", "ebml")[kind], False, track.codec))
            places.append(cluster_at)
            at += size

    def open_end(ident: int, at: int, end: int) -> tuple[int, bool]:
        """The end of an element's body, cut at its parent's, and whether it was cut."""
        size, body, unknown = vint(data, at)
        stop = cluster_end(data, body, end) if unknown and ident == CLUSTER else end if unknown else body + size
        return min(stop, end), stop > end

    def children(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Elements, of which the last may be a cluster or segment that is cut off; its own good elements come before the error."""
        while at < end:
            ident, after, _ = vint(data, at, keep_marker=True)
            stop, cut = open_end(ident, after, end)
            if cut and ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {ident:x} ends beyond its parent")
            yield ident, vint(data, after)[1], stop
            if cut:
                raise ValueError(f"element {ident:x} ends beyond its parent")
            at = stop

    def cluster(at: int, end: int, own: int) -> None:
        time = 0
        for ident, x, y in elements(data, at, end):
            if ident == TIMESTAMP:
                time = unsigned(data, x, y)
            elif ident == SIMPLE_BLOCK:
                block(x, y, own, time, None)
            elif ident == BLOCK_GROUP:
                parts = {i: (a, b) for i, a, b in elements(data, x, y)}
                if BLOCK in parts:
                    block(*parts[BLOCK], own, time, REFERENCE_BLOCK not in parts, unsigned(data, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None)

    def segment(at: int, end: int) -> None:
        nonlocal scale
        from_here = begin = at
        for child, x, y in children(at, end):
            if child == INFO:
                scale = next((unsigned(data, a, b) for i, a, b in elements(data, x, y) if i == TIMESTAMP_SCALE), scale)
            elif child == TRACKS:
                tracks.update(read_track(data, a, b) for i, a, b in elements(data, x, y) if i == TRACK_ENTRY)
            elif child == CLUSTER:
                cluster(x, y, from_here - begin)
            elif child == CUES:
                for i, a, b in elements(data, x, y):
                    if i == CUE_POINT:
                        cues.update(unsigned(data, c, d) for j, e, f in elements(data, a, b) if j == CUE_TRACK_POSITIONS for k, c, d in elements(data, e, f) if k == CUE_CLUSTER_POSITION)
            from_here = y

    error = None
    try:
        for ident, at, end in children(0, len(data)):
            if ident == SEGMENT:
                segment(at, end)
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        if strict:
            raise
        error = str(e) or type(e).__name__
    firsts = {p: n for n, p in reversed(list(enumerate(places)))}
    for p, n in firsts.items():
        if p in cues:
            out[n] = out[n]._replace(cued=True)
    if error and out:
        out[-1] = out[-1]._replace(error=error)
    return out


# Writing


def number(value: int) -> bytes:
    """An EBML size of the least width."""
    width = 1
    while value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def simple_block(track: int, offset: int, frames: list[bytes]) -> bytes:
    """A key block; several frames are laced, fixed if of one size, else by EBML."""
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, number(track) + struct.pack(">hB", offset, 0x80) + frames[0])
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        flags = 0x80 | 2 << 1
    else:
        flags = 0x80 | 3 << 1
        head += number(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = 1
            while not -((1 << 7 * width - 1) - 1) <= b - a <= (1 << 7 * width - 1) - 1:
                width += 1
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return element(SIMPLE_BLOCK, number(track) + struct.pack(">hB", offset, flags) + head + b"".join(frames))


def mux_samples(payload: bytes, rate: int = 8000, frame: int = 1024, lace: int = 8, cluster_bytes: int = 65_536) -> bytes:
    """A Matroska file with one track of unsigned 8-bit PCM samples, with cues.

    Timestamps are in milliseconds; the same payload gives the same bytes.
    """
    header = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)) + element(MUXING_APP, b"kgloom") + element(WRITING_APP, b"kgloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    body = [info, element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))]
    at, points = sum(map(len, body)), []
    for x in range(0, len(payload), cluster_bytes):
        time, end = x * 1000 // rate, min(len(payload), x + cluster_bytes)
        blocks = [simple_block(1, y * 1000 // rate - time, [payload[z : min(z + frame, end)] for z in range(y, min(y + frame * lace, end), frame)]) for y in range(x, end, frame * lace)]
        body.append(element(CLUSTER, uint(TIMESTAMP, time) + b"".join(blocks)))
        points.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        at += len(body[-1])
    return header + element(SEGMENT, b"".join(body) + element(CUES, b"".join(points)))


# Operators


def packets(df: DataFrame, media: str = "media", key: str = "doc_id", strict: bool = False) -> DataFrame:
    """``key, packet`` and the fields of ``PACKET``: one row for each frame of each file.

    ``start`` and ``length`` are the frame's bytes in the file, ``packet`` counts
    from 0 in a file.  ``codec`` is the track's; ``error`` says on the last packet
    before it why the file could not be read on.
    """

    @F.pandas_udf(f"array<struct<{PACKET.replace(' ', ':').replace(',:', ', ')}>>")
    def parse(files):
        import pandas as pd

        out = []
        for data in files:
            out.append([] if data is None else [p._asdict() for p in read_packets(data, strict)])
        return pd.Series(out, dtype=object)

    rows = df.select(F.col(key).alias("_key"), parse(F.col(media)).alias("_p"))
    return rows.select("_key", F.posexplode("_p").alias("packet", "_f")).select(F.col("_key").alias(key), "packet", "_f.*")


def sample_features(samples: bytes, found: list[Packet]) -> str:
    """Packet counts, end time and mean, deviation, zero-crossing rate and peak of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128))) if n > 1 else 0
    # sums are of integers, so the text does not hang on the order of additions
    return f"packets={len(found)};blocks_cued={sum(p.cued for p in found)};last_ms={found[-1].timestamp_ns // 1_000_000 if found else 0};mean={total / max(n, 1):.6f};power={squares / max(n, 1):.6f};crossings={crossings};peak={int(x.max()) if n else 0}"


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", pad: int = 64, media: bool = False) -> DataFrame:
    """``key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    A text is padded with bytes 0 to a positive multiple of ``pad``, muxed, and
    read back through the packet table, from which all columns but ``n_bytes``
    derive.  ``media`` adds the file itself.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * media]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * media]

    def run(batches):
        for batch in batches:
            at, held, cols = 0, 0, [[] for _ in types]
            for n, t in enumerate(batch.column(1)):
                data = t.as_py() or b""
                payload = data + bytes(-len(data) % pad if data else pad)
                stored = mux_samples(payload)
                found = read_packets(stored)
                back = b"".join([stored[p.start : p.start + p.length] for p in found])
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-pad:]), len(stored), hashlib.sha256(stored).hexdigest(), sample_features(back, found), stored)
                for c, v in zip(cols, row, strict=False):
                    c.append(v)
                held += len(stored) * media
                if held > 8_000_000 or n + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n + 1 - at), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], names)
                    at, held, cols = n + 1, 0, [[] for _ in types]

    schema = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media
    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
