"""Media columns: Matroska files as columns, parsed into packet tables.

``store`` writes a byte payload losslessly as one 8-bit PCM track: EBML header, Segment with Info,
Tracks, Clusters of SimpleBlocks and Cues. ``packet_table`` parses any Matroska bytes: variable-length
element ids and sizes (unknown sizes of Segment and Cluster included), clusters, simple blocks and block
groups, all four lacings and cues, into one row per packet with track, timestamp, byte range and, where its
block group tells it, duration, and into a table of tracks. Times are nanoseconds: ticks times the timestamp
scale of the segment, wherever in it the scale stands.

Each file is handled inside one row, in runs of about ``RUN_BYTES``; nothing is gathered.

Defined results: a null or empty payload becomes 64 zero bytes; null or broken media gives the packets
read up to the break and its ``error``, so does nesting deeper than ``DEEPEST`` and a number that its column
cannot hold; equal payloads give equal media; columns named like the added ones are replaced, other columns stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import flat, lean, pieces

ALIGN, FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER, RATE = 64, 1024, 8, 8, 8000
DEEPEST, RUN_BYTES = 32, 4 << 20

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION = 0x4282, 0x4287
FIELDS = {BLOCK, BLOCK_DURATION, REFERENCE_BLOCK, CUE_TIME, CUE_TRACK, CUE_CLUSTER, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, SAMPLING, CHANNELS, BIT_DEPTH}
MASTERS = {SEGMENT, TRACKS, TRACK, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, INFO, AUDIO}

PACKET = pa.struct([("track", pa.int32()), ("packet", pa.int32()), ("timestamp", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("cluster", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("duration", pa.int64())])
CUE = pa.struct([("time", pa.int64()), ("track", pa.int32()), ("position", pa.int64())])
TRACK_ROW = pa.struct([("number", pa.int32()), ("uid", pa.string()), ("type", pa.int32()), ("codec", pa.string()), ("sampling", pa.float64()), ("channels", pa.int32()), ("bit_depth", pa.int32())])
PACKETS_DDL = "array<struct<track:int,packet:int,timestamp:bigint,keyframe:boolean,lacing:string,cluster:int,offset:bigint,size:bigint,duration:bigint>>"
CUES_DDL = "array<struct<time:bigint,track:int,position:bigint>>"
TRACKS_DDL = "array<struct<number:int,uid:string,type:int,codec:string,sampling:double,channels:int,bit_depth:int>>"


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """Lacing bits of the flags, and the lace header."""
    sizes = [len(f) for f in frames]
    if lacing == "none":
        return 0, b""
    count = bytes([len(frames) - 1])
    if lacing == "fixed":
        return 0x04, count
    if lacing == "xiph":
        return 0x02, count + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    head = [_size(sizes[0])]
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = 1
        while abs(b - a) >= (1 << (7 * width - 1)) - 1:
            width += 1
        head.append((b - a + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big"))
    return 0x06, count + b"".join(head)


def mux(payload: bytes, lacing: str | None = None) -> bytes:
    """One PCM track. lacing: that of blocks of several frames, by default fixed where sizes are equal, else EBML."""
    header = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000))
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + audio))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    step = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, len(frames), step):
        start = first * FRAME * 1000 // RATE
        cluster = [_uint(CLUSTER_TIME, start)]
        for k in range(first, min(first + step, len(frames)), FRAMES_PER_BLOCK):
            own = frames[k : min(k + FRAMES_PER_BLOCK, first + step)]
            kind = "none" if len(own) == 1 else lacing or ("fixed" if len(own[0]) == len(own[-1]) else "ebml")
            flags, head = _laced(own, kind)
            cluster.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", k * FRAME * 1000 // RATE - start) + bytes([0x80 | flags]) + head + b"".join(own)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(_element(CLUSTER, b"".join(cluster)))
        at += len(body[-1])
    return header + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """Value, next position, width."""
    lead = data[at]
    if lead == 0:
        raise ValueError(f"no length marker at byte {at}")
    width = 9 - lead.bit_length()
    if at + width > len(data):
        raise ValueError(f"number cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if keep_marker else value & ~(1 << (7 * width))), at + width, width


def _frames(data: bytes, at: int, end: int, flags: int) -> tuple[str, list[tuple[int, int]]]:
    """The lacing's name and the byte range of each frame of a block."""
    kind = (flags >> 1) & 3
    if kind == 0:
        return "none", [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError(f"fixed lacing does not divide the block at byte {at}")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        sizes = []
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        sizes = []
        for k in range(n - 1):  # the first size, then differences; the last frame has none
            size, at, width = _vint(data, at)
            sizes.append(sizes[-1] + size - ((1 << (7 * width - 1)) - 1) if k else size)
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    found = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError(f"lace sizes exceed the block at byte {at}")
        found.append((at, size))
        at += size
    return ("", "xiph", "fixed", "ebml")[kind], found


def _held(n: int, bits: int, what: str) -> int:
    """``n``, if a signed column of so many bits holds it."""
    if not -(1 << bits - 1) <= n < 1 << bits - 1:
        raise ValueError(f"{what} {n} is out of range")
    return n


class Parse:
    """One pass over a file: packets and cues in ticks with their segment, tracks, and each segment's scale."""

    def __init__(self, data: bytes):
        self.data, self.packets, self.cues, self.tracks = data, [], [], []
        self.time, self.cluster, self.segment, self.scales = 0, -1, 0, [1_000_000]

    def number(self, span: tuple[int, int]) -> int:
        if span[1] - span[0] > 8:
            raise ValueError(f"number of {span[1] - span[0]} bytes at byte {span[0]}")
        return int.from_bytes(self.data[slice(*span)], "big")

    def real(self, span: tuple[int, int]) -> float:
        raw = self.data[slice(*span)]
        return struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if raw else 0.0

    def block(self, at: int, end: int, simple: bool, keyframe: bool, duration: int | None = None) -> None:
        track, at, _ = _vint(self.data, at)
        _held(track, 32, "track number")
        if at + 3 > end:
            raise ValueError(f"block header cut off at byte {at}")
        offset, flags = struct.unpack_from(">hB", self.data, at)
        lacing, frames = _frames(self.data, at + 3, end, flags)
        for start, size in frames:
            self.packets.append((track, len(self.packets), self.time + offset, bool(flags & 0x80) if simple else keyframe, lacing, self.cluster, start, size, None if duration is None else (duration, len(frames)), len(self.scales) - 1))

    def track(self, found: dict) -> None:
        numbers = [_held(self.number(found[i]), 32, "track field") if i in found else None for i in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH)]
        uid = str(self.number(found[TRACK_UID])) if TRACK_UID in found else None
        codec = self.data[slice(*found[CODEC])].rstrip(b"\0").decode("ascii", "replace") if CODEC in found else None
        self.tracks.append((numbers[0], uid, numbers[1], codec, self.real(found[SAMPLING]) if SAMPLING in found else None, numbers[2], numbers[3]))

    def walk(self, at: int, end: int, into: dict, depth: int) -> None:
        if depth > DEEPEST:
            raise ValueError(f"elements nested deeper than {DEEPEST} at byte {at}")
        while at < end:
            ident, at, _ = _vint(self.data, at, True)
            size, at, width = _vint(self.data, at)
            unknown = size == (1 << (7 * width)) - 1
            stop = end if unknown else at + size
            if stop > end:
                raise ValueError(f"element {ident:#x} exceeds its parent at byte {at}")
            if ident == SEGMENT:
                self.segment = at
                self.scales.append(1_000_000)
            elif ident == CLUSTER:
                self.cluster += 1
                if unknown:
                    continue  # its children follow on this level until the next cluster
            elif ident == CLUSTER_TIME:
                self.time = self.number((at, stop))
            elif ident == TIMESTAMP_SCALE:
                self.scales[-1] = self.number((at, stop))
            elif ident == SIMPLE_BLOCK:
                self.block(at, stop, True, False)
            elif ident in FIELDS:
                into[ident] = (at, stop)
            if ident in MASTERS:
                inner = into if ident in (CUE_POSITIONS, AUDIO) else {}
                self.walk(at, stop, inner, depth + 1)
                if ident == BLOCK_GROUP and BLOCK in inner:
                    self.block(*inner[BLOCK], False, REFERENCE_BLOCK not in inner, self.number(inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None)
                elif ident == TRACK:
                    self.track(inner)
                elif ident == CUE_POINT and CUE_TIME in inner and CUE_CLUSTER in inner:
                    time, track, position = (self.number(inner[i]) if i in inner else 0 for i in (CUE_TIME, CUE_TRACK, CUE_CLUSTER))
                    self.cues.append((time, _held(track, 32, "track number"), _held(self.segment + position, 64, "position"), len(self.scales) - 1))
            at = stop

    def timed(self) -> str | None:
        """Ticks to nanoseconds in packets and cues; what cannot be held ends the list, and the error is given."""
        packets, cues, error = [], [], None
        try:
            for *row, duration, segment in self.packets:
                scale = self.scales[segment]
                row[2] = _held(row[2] * scale, 64, "timestamp")
                packets.append((*row, None if duration is None else _held(duration[0] * scale // duration[1], 64, "duration")))
            for time, track, position, segment in self.cues:
                cues.append((_held(time * self.scales[segment], 64, "cue time"), track, position))
        except ValueError as e:
            error = str(e)
        self.packets, self.cues = packets, cues
        return error


def parsed(data: bytes) -> tuple[list[tuple], list[tuple], list[tuple], str | None]:
    """Packets, cues (positions from the start of the file), tracks and the error that ended the parse, if any."""
    file, error = Parse(data), None
    try:
        file.walk(0, len(data), {}, 0)
    except (ValueError, IndexError, struct.error) as e:
        error = str(e)
    late = file.timed()
    return file.packets, file.cues, file.tracks, error or late


def demux(data: bytes) -> tuple[list[tuple], list[tuple], str | None]:
    packets, cues, _, error = parsed(data)
    return packets, cues, error


def store(df: DataFrame, column: str, media: str = "media") -> DataFrame:
    """``df`` with ``media``: the UTF-8 or binary column, zero-padded to a positive multiple of 64 bytes, as Matroska."""
    kept = [c for c in df.columns if c != media]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, own in pieces(*flat(batch.column(0)), RUN_BYTES):
                raw, made = data.tobytes(), []
                for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
                    text = raw[a:b]
                    made.append(mux(text + b"\0" * ((-len(text)) % ALIGN or (ALIGN if not text else 0))))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[1:]], pa.array(made, pa.binary())], names=[*kept, media])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(df[column].alias("__payload"), *kept).mapInArrow(lean(batches), f"{fields}, `{media}` binary")


def packet_table(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``packets``, ``cues``, ``tracks`` and ``error``; explode ``packets`` for a row each."""
    added = ("packets", "cues", "tracks", "error")
    kept = [c for c in df.columns if c not in added]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in it for part in _runs(whole, kept.index(media))):
            found = [parsed(x) if x is not None else ([], [], [], "no media") for x in batch.column(kept.index(media)).to_pylist()]
            kinds = (PACKET, CUE, TRACK_ROW)
            lists = [pa.array([[dict(zip([f.name for f in t], row, strict=True)) for row in p[k]] for p in found], pa.list_(t)) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array([p[3] for p in found], pa.string())], names=[*kept, *added])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept).mapInArrow(lean(batches), f"{fields}, packets {PACKETS_DDL}, cues {CUES_DDL}, tracks {TRACKS_DDL}, error string")


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about ``RUN_BYTES`` of media each."""
    for i, j, _, _ in pieces(*flat(batch.column(column)), RUN_BYTES):
        yield batch.slice(i, j - i)


def payload_digests(df: DataFrame, media: str = "media") -> DataFrame:
    """The key columns with digests and features of the payload, read back through the packets' byte ranges."""
    dropped = (media, "packets", "cues", "tracks", "error")
    kept = [c for c in df.columns if c not in dropped]
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_packets int, n_cues int, feature string"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            offsets = batch.column("packets")
            flat = offsets.flatten()
            starts, sizes = flat.field("offset").to_numpy(), flat.field("size").to_numpy()
            at = 0
            counts = [len(x) if x is not None else 0 for x in offsets]
            for blob, n, cues in zip(batch.column(media), counts, batch.column("cues"), strict=True):
                view = memoryview(blob.as_buffer()) if blob.is_valid else memoryview(b"")
                payload = b"".join(view[s : s + z] for s, z in zip(starts[at : at + n], sizes[at : at + n], strict=True))
                at += n
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(view), hashlib.sha256(view).hexdigest(), n, len(cues) if cues.is_valid else 0, feature(payload)))
            out = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], target).combine_chunks().to_batches() if rows else []
            columns = [c for b in out for c in b.columns] or [pa.array([], f.type) for f in target]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *names])

    target = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_packets", pa.int32()), ("n_cues", pa.int32()), ("feature", pa.string())])
    names = target.names
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(*kept, media, "packets", "cues").mapInArrow(lean(batches), fields + schema)


def feature(payload: bytes) -> str:
    """Level, mean and zero-crossing rate of the 8-bit samples, to four decimals."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    if not len(x):
        return "rms=0;mean=0;zcr=0"
    crossings = float(np.mean((x[1:] >= 0) != (x[:-1] >= 0))) if len(x) > 1 else 0.0
    return f"rms={np.sqrt(np.mean(x * x)):.4f};mean={x.mean():.4f};zcr={crossings:.4f}"


def op1_matroska(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = store(own, "text").drop("text")
    found = payload_digests(packet_table(stored))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_cues")
