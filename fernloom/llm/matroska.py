"""Matroska media columns: mux bytes into an EBML file, parse one into packet tables.

``mux`` stores a payload losslessly as 8-bit PCM: EBML header, Segment with Info and
Tracks, Clusters of laced SimpleBlocks (576 samples a frame), Cues.  ``demux`` parses any
file of that kind: variable-length ids and sizes, unknown sizes, Xiph, EBML and fixed
lacing, BlockGroups with references, and returns packets with track, timestamp and byte
range.  Laced frames follow each other by the track's default duration, else by the
duration of their PCM samples, else they share their block's timestamp.

``packets`` reads a stored media column once: every file's packet list, its digests and
sums; ``packet_table`` has a row per packet, and features are worked out from the lists.

Defined cases: a null or empty text is one frame of padding; equal texts give equal
files; very long texts only add clusters; a damaged file raises ``ValueError`` in
``demux`` and gives a row with ``error`` set and the rest null in ``packets`` (no packet in
the table, null features); a null file is a damaged one; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernloom.llm.batches import small_batches
from fernloom.scratch import materialize

# Fixed values of the public Matroska specification: element ids.
EBML, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0x00, 0x02, 0x04, 0x06

FRAME, RATE, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 576, 8000, 4, 16
FRAME_MS = FRAME * 1000 // RATE


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def _size(number: int) -> bytes:
    """A variable-length size; all ones of a width stay reserved for 'unknown'."""
    width = 1
    while number >= (1 << 7 * width) - 1:
        width += 1
    return (number | 1 << 7 * width).to_bytes(width, "big")


def _element(number: int, body: bytes) -> bytes:
    return _id(number) + _size(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return _element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
TRACK = _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1)
        + _uint(TRACK_UID, 1)
        + _uint(TRACK_TYPE, 2)
        + _uint(FLAG_LACING, 1)
        + _element(CODEC_ID, b"A_PCM/INT/LIT")
        + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lacing header and frames of a block's body."""
    if kind == NO_LACING:
        return b"".join(frames)
    sizes, out = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == XIPH_LACING:
        out += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING:
        out += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while abs(b - a) > (1 << 7 * width - 1) - 2:
                width += 1
            out += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs equal frames")
    return out + b"".join(frames)


def mux(payload: bytes, lacing: int = FIXED_LACING) -> bytes:
    """A Matroska file of ``payload``, whose length is a multiple of the frame size."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(
        INFO,
        _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + _element(MUXING_APP, b"fernloom") + _element(WRITING_APP, b"fernloom"),
    )
    parts, cues, at = [info, TRACK], [], len(info) + len(TRACK)
    step = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for c in range(0, len(frames), step):
        body = [_uint(CLUSTER_TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(c + step, len(frames)), FRAMES_PER_BLOCK):
            own = frames[b : b + FRAMES_PER_BLOCK]
            kind = lacing if len(own) > 1 else NO_LACING
            body.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (b - c) * FRAME_MS, 0x80 | kind) + lace(own, kind)))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return HEAD + _element(SEGMENT, b"".join(parts))


class Packet(NamedTuple):
    track: int
    timestamp_ms: float
    keyframe: bool
    offset: int
    size: int


class Track(NamedTuple):
    codec: str
    rate: float
    channels: int
    bits: int
    frame_ms: float | None  # the default duration

    def duration_ms(self, size: int) -> float:
        """Of a packet: the default duration, else that of its PCM samples, else unknown and 0."""
        if self.frame_ms is not None:
            return self.frame_ms
        bytes_a_second = self.rate * self.channels * self.bits / 8
        return size * 1000 / bytes_a_second if self.codec.startswith("A_PCM") and bytes_a_second else 0.0


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, Track]
    clusters: int
    blocks: int
    cues: list[tuple[float, int, int]]
    duration_ms: float


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value (None: unknown size) and next position of a variable-length integer."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED_LACING:
        sizes = [(end - at) // count] * count
    elif kind == XIPH_LACING:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(count - 1):
            value, after = read_vint(data, at)
            if value is None:
                value = (1 << 7 * (after - at)) - 1
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    if kind != FIXED_LACING:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError("lacing does not fill its block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def _uint_of(body: bytes) -> int:
    return int.from_bytes(body, "big")


def _float_of(body: bytes) -> float:
    if len(body) not in (0, 4, 8):
        raise ValueError(f"float of {len(body)} bytes")
    return struct.unpack(">d" if len(body) == 8 else ">f", body)[0] if body else 0.0


#: Elements of a track entry that are kept, how their bodies are read and what holds without them.
TRACK_FIELDS = {
    TRACK_NUMBER: (_uint_of, 0),
    CODEC_ID: (bytes.decode, ""),
    SAMPLING_FREQUENCY: (_float_of, 8000.0),
    CHANNELS: (_uint_of, 1),
    BIT_DEPTH: (_uint_of, 0),
    DEFAULT_DURATION: (_uint_of, None),
}


def demux(data: bytes) -> Media:
    """Packets, tracks and cues of a Matroska file; ``ValueError`` if it is damaged."""
    try:
        return _demux(data)
    except (IndexError, OverflowError, struct.error, UnicodeDecodeError) as broken:
        raise ValueError(f"damaged file: {broken}") from broken


def _demux(data: bytes) -> Media:
    entries: list[dict] = []
    cues, blocks, clusters = [], 0, 0
    scale, ticks, cluster_time, base = 1_000_000, 0.0, 0, 0
    cue = [0, 0]
    raw: list[list] = []  # track, ticks, place in its lace, keyframe, offset, size
    group: list[list] = []
    number, at = read_vint(data, 0, True)
    if number != EBML:
        raise ValueError("no EBML header")
    size, at = read_vint(data, at)
    if size is None:
        raise ValueError("EBML header of unknown size")
    at += size
    while at < len(data):  # masters are entered, so the walk is flat and unknown sizes need no stack
        number, at = read_vint(data, at, True)
        size, at = read_vint(data, at)
        if number in MASTERS:
            if size is not None and at + size > len(data):
                raise ValueError(f"element {number:#x} runs past the end")
            if number == SEGMENT:
                base = at
            elif number == TRACK_ENTRY:
                entries.append({})
            elif number == BLOCK_GROUP:
                group = []
            clusters += number == CLUSTER
            continue
        if size is None or at + size > len(data):
            raise ValueError(f"element {number:#x} runs past the end")
        end = at + size
        if number in (SIMPLE_BLOCK, BLOCK):
            own, body = read_vint(data, at)
            if body + 3 > end:
                raise ValueError("block without a header")
            delta, flags = struct.unpack_from(">hB", data, body)
            blocks += 1
            found = [[own, cluster_time + delta, k, number == BLOCK or bool(flags & 0x80), start, length] for k, (start, length) in enumerate(_frames(data, body + 3, end, flags & 0x06))]
            raw += found
            group = found if number == BLOCK else group
        elif number == REFERENCE_BLOCK:  # what refers to another block is no keyframe, wherever it stands in its group
            for packet in group:
                packet[3] = False
        elif number in TRACK_FIELDS and entries:
            entries[-1][number] = TRACK_FIELDS[number][0](data[at:end])
        elif number == TIMESTAMP_SCALE:
            scale = _uint_of(data[at:end])
        elif number == CLUSTER_TIMESTAMP:
            cluster_time = _uint_of(data[at:end])
        elif number == CUE_TIME:
            cue[0] = _uint_of(data[at:end])
        elif number == CUE_TRACK:
            cue[1] = _uint_of(data[at:end])
        elif number == CUE_CLUSTER:
            cues.append((cue[0] * scale / 1e6, cue[1], base + _uint_of(data[at:end])))
        elif number == DURATION:
            ticks = _float_of(data[at:end])
        at = end
    tracks = {}
    for entry in entries:
        n, codec, rate, channels, bits, ns = (entry.get(f, default) for f, (_, default) in TRACK_FIELDS.items())
        tracks[n] = Track(codec, rate, channels, bits, None if ns is None else ns / 1e6)
    packets, before = [], 0.0
    for own, tick, k, key, start, length in raw:
        before = before if k else 0.0  # of the frames before it in its lace
        packets.append(Packet(own, tick * scale / 1e6 + before, key, start, length))
        before += tracks[own].duration_ms(length) if own in tracks else 0.0
    return Media(packets, tracks, clusters, blocks, cues, ticks * scale / 1e6)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * ((-len(raw) % FRAME if raw else FRAME))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's Matroska file."""
    mux_udf = F.pandas_udf(_mux_column, "binary")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), mux_udf(text).alias("media"))


def _mux_column(column: pd.Series) -> pd.Series:
    return pd.Series([mux(padded(t)[1]) for t in column], dtype=object)


PACKETS = (
    "packets array<struct<track:bigint,timestamp_ms:double,keyframe:boolean,offset:bigint,size:bigint>>, codecs map<bigint,string>, clusters long, blocks long, n_cues long, duration_ms double, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, sum long, sum_squares long, error string"
)
_PACKET = pa.list_(pa.struct([("track", pa.int64()), ("timestamp_ms", pa.float64()), ("keyframe", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64())]))
_KINDS = [_PACKET, pa.map_(pa.int64(), pa.string()), *[pa.int64()] * 3, pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def read_file(data: bytes | None) -> tuple:
    """The columns of ``PACKETS`` for one stored file; the payload is what the packets' byte ranges hold."""
    try:
        if data is None:
            raise ValueError("no file")
        media = demux(data)
    except ValueError as broken:
        return (None,) * (len(_KINDS) - 1) + (str(broken),)
    payload = b"".join(data[p.offset : p.offset + p.size] for p in media.packets)
    samples = np.frombuffer(payload, np.uint8)
    squares = int((samples.astype(np.int64) ** 2).sum())
    return (
        [p._asdict() for p in media.packets], [(n, t.codec) for n, t in media.tracks.items()], media.clusters, media.blocks, len(media.cues), media.duration_ms,
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), int(samples.sum(dtype=np.int64)), squares, None,
    )


def packets(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` without its bytes, plus the columns of ``PACKETS``; columns of these names are replaced."""
    names = [x.name for x in T.StructType.fromDDL(PACKETS)]
    taken = {n.lower() for n in names}
    own = [c for c in media.columns if c != media_col and c.lower() not in taken]
    schema = T.StructType([*media.select(*own).schema.fields, *T.StructType.fromDDL(PACKETS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_file(m.as_py()) for m in batch.column(len(own))]
            columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True))], [*own, *names])

    return small_batches(media).select(*own, media_col).mapInArrow(run, schema)


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet: ``(doc_id, seq, track, timestamp_ms, keyframe, offset, size)``."""
    return packets(media).select("doc_id", F.posexplode("packets").alias("seq", "p")).select("doc_id", F.col("seq").cast("long").alias("seq"), "p.*")


def feature() -> Column:
    """A file's feature string from the columns of ``packets``."""
    last = F.element_at("packets", -1)
    mean = F.col("sum") / F.col("payload_bytes")
    rms = F.sqrt(F.col("sum_squares") / F.col("payload_bytes"))
    keys = F.size(F.filter("packets", lambda p: p["keyframe"]))
    text = "codec=%s;clusters=%d;blocks=%d;packets=%d;keyframes=%d;cues=%d;duration_ms=%.0f;last_ms=%.0f;mean=%.4f;rms=%.4f"
    made = F.format_string(text, F.element_at("codecs", last["track"]), "clusters", "blocks", F.size("packets"), keys, "n_cues", "duration_ms", last["timestamp_ms"], mean, rms)
    return F.when(F.col("error").isNull() & (F.size("packets") > 0), made)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``: files are stored in the shared folder and read back from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = materialize(store(docs), "media", keep=True, compression="zstd")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return packets(stored).select(*names, feature().alias("feature"))
