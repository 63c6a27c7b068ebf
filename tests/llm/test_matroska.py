import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernloom.llm import matroska as mk
from tests.llm.util import TEXTS, documents


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=2, max_size=9), st.sampled_from([mk.XIPH_LACING, mk.EBML_LACING]))
def test_lacing_of_uneven_frames(frames, kind):
    body = mk.lace(frames, kind)
    ranges = mk._frames(body, 0, len(body), kind)
    assert [body[a : a + n] for a, n in ranges] == frames


@pytest.mark.parametrize("kind", [mk.NO_LACING, mk.XIPH_LACING, mk.EBML_LACING, mk.FIXED_LACING])
@pytest.mark.parametrize("n", [1, 4, 5, 64, 65, 300])
def test_round_trip_and_packets(kind, n):
    if kind == mk.NO_LACING and n > 1:
        pytest.skip("blocks of several frames need lacing")
    payload = bytes(i * 7 % 256 for i in range(n * mk.FRAME))
    data = mk.mux(payload, kind)
    media = mk.demux(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in media.packets) == payload
    assert [p.timestamp_ms for p in media.packets] == [i * mk.FRAME_MS for i in range(n)]
    assert {p.track for p in media.packets} == {1} and all(p.keyframe for p in media.packets)
    assert media.clusters == len(media.cues) == -(-n // 64)
    assert all(data[at : at + 4] == mk._id(mk.CLUSTER) for _, _, at in media.cues)


def test_unknown_sizes_block_groups_and_second_track():
    block = mk._element(mk.BLOCK, b"\x82\x00\x05\x00" + b"xy")
    simple = mk._element(mk.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + b"abc")
    cluster = mk._id(mk.CLUSTER) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + mk._uint(mk.CLUSTER_TIMESTAMP, 100) + simple + mk._element(mk.BLOCK_GROUP, block)
    void = mk._element(0xEC, b"\x00" * 9)
    data = mk.HEAD + mk._id(mk.SEGMENT) + b"\xff" + void + mk.TRACK + cluster
    media = mk.demux(data)
    assert [(p.track, p.timestamp_ms, data[p.offset : p.offset + p.size]) for p in media.packets] == [(1, 100.0, b"abc"), (2, 105.0, b"xy")]


def test_lace_times_by_the_tracks_own_rate_and_references():
    def track(number, rest):
        return mk._element(mk.TRACK_ENTRY, mk._uint(mk.TRACK_NUMBER, number) + rest)

    pcm = mk._element(mk.CODEC_ID, b"A_PCM/INT/LIT") + mk._element(mk.AUDIO, mk._element(mk.SAMPLING_FREQUENCY, struct.pack(">f", 1000)) + mk._uint(mk.CHANNELS, 2) + mk._uint(mk.BIT_DEPTH, 16))
    opus = mk._element(mk.CODEC_ID, b"A_OPUS") + mk._uint(mk.DEFAULT_DURATION, 20_000_000)
    other = mk._element(mk.CODEC_ID, b"V_VP9")
    tracks = mk._element(mk.TRACKS, track(1, pcm) + track(2, opus) + track(3, other))

    def block(number, frames, kind, flags=0):
        return bytes([0x80 | number]) + struct.pack(">hB", 0, flags | kind) + mk.lace(frames, kind)

    frames = [b"a" * 8, b"b" * 16, b"c" * 4]
    body = mk._uint(mk.CLUSTER_TIMESTAMP, 50)
    body += mk._element(mk.SIMPLE_BLOCK, block(1, frames, mk.XIPH_LACING, 0x80)) + mk._element(mk.SIMPLE_BLOCK, block(2, frames, mk.EBML_LACING))
    body += mk._element(mk.BLOCK_GROUP, mk._element(mk.BLOCK, block(3, frames, mk.XIPH_LACING)) + mk._element(mk.REFERENCE_BLOCK, b"\xff"))
    body += mk._element(mk.BLOCK_GROUP, mk._element(mk.REFERENCE_BLOCK, b"\xff")) + mk._element(mk.BLOCK_GROUP, mk._element(mk.BLOCK, block(3, [b"k"], mk.NO_LACING)))
    media = mk.demux(mk.HEAD + mk._element(mk.SEGMENT, tracks + mk._element(mk.CLUSTER, body)))
    got = [(p.track, p.timestamp_ms, p.keyframe) for p in media.packets]
    # two channels of 16 bits at 1000 Hz: four bytes a millisecond
    assert got == [(1, 50, True), (1, 52, True), (1, 56, True), (2, 50, False), (2, 70, False), (2, 90, False), (3, 50, False), (3, 50, False), (3, 50, False), (3, 50, True)]


def test_any_damaged_byte_is_refused_or_read(spark):
    data = mk.mux(bytes(range(256)) * 9)
    for at in range(len(data)):
        for value in (0, 0x40, 0xFF):
            broken = data[:at] + bytes([value]) + data[at + 1 :]
            try:
                media = mk.demux(broken)
            except ValueError:
                continue
            assert all(p.offset + p.size <= len(data) for p in media.packets)
    files = spark.createDataFrame([(1, data), (2, data[:100]), (3, None), (4, b"")], "doc_id long, media binary")
    rows = {r.doc_id: r for r in mk.packets(files).withColumn("feature", mk.feature()).collect()}
    assert rows[1].error is None and rows[1].payload_bytes == 2304 and rows[1].feature.startswith("codec=A_PCM")
    assert all(rows[i].error and rows[i].payload_sha256 is None and rows[i].packets is None and rows[i].feature is None for i in (2, 3, 4))
    assert {r.doc_id for r in mk.packet_table(files).collect()} == {1}


def plain_read(data):
    """An own small reader of what the query stores: sizes of one to eight bytes, fixed lacing; frames with their times."""

    def head(at, mask):
        width = 8 - data[at].bit_length() + 1
        value = int.from_bytes(data[at : at + width], "big")
        return (value - (1 << 7 * width) if mask else value), at + width

    frames, counts, at, time = [], {}, 0, 0
    while at < len(data):
        kind, at = head(at, False)
        size, at = head(at, True)
        counts[kind] = counts.get(kind, 0) + 1
        if kind in (0x18538067, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7):
            continue
        body = data[at : at + size]
        at += size
        if kind == 0xE7:
            time = int.from_bytes(body, "big")
        elif kind == 0xA3:
            start = time + int.from_bytes(body[1:3], "big", signed=True)
            n, own = (body[4] + 1, body[5:]) if body[3] & 6 else (1, body[4:])
            each = len(own) // n
            frames += [(start + k * 72, own[k * each : (k + 1) * each]) for k in range(n)]
    return frames, counts

@pytest.mark.parametrize("cut", [0, 3, 40, 200, 700])
def test_damaged_files_are_refused(cut):
    with pytest.raises(ValueError):
        mk.demux(mk.mux(b"z" * mk.FRAME * 2)[:cut])


def test_query_columns_against_brute_force(spark):
    media = mk.store(documents(spark))
    files = {r.doc_id: r.media for r in media.collect()}
    out = {r.doc_id: r for r in mk.packets(media).withColumn("feature", mk.feature()).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (out[i].n_bytes, out[i].payload_bytes) == (len(raw), len(payload))
        assert out[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[i].tail_crc32 == zlib.crc32(payload[-32:])
        data = files[i]
        assert (out[i].media_bytes, out[i].media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        frames, counts = plain_read(data)
        assert b"".join(f for _, f in frames) == payload and [(p.timestamp_ms, p.size) for p in out[i].packets] == [(t, len(f)) for t, f in frames]
        mean, rms = sum(payload) / len(payload), (sum(b * b for b in payload) / len(payload)) ** 0.5
        n, cues = len(frames), counts[0xBB]
        assert out[i].feature == (
            f"codec=A_PCM/INT/LIT;clusters={counts[0x1F43B675]};blocks={counts[0xA3]};packets={n};keyframes={n};cues={cues};duration_ms={n * 72};last_ms={n * 72 - 72};mean={mean:.4f};rms={rms:.4f}"
        )
    same = [out[i][1:] for i, t in enumerate(TEXTS) if t == TEXTS[6]]
    assert len({repr(x) for x in same}) == 1


def test_packet_table_nulls_and_empty(spark):
    table = mk.packet_table(mk.store(documents(spark)))
    packets = table.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in packets} == {i: max(1, -(-len((t or "").encode()) // 576)) for i, t in enumerate(TEXTS)}
    empty = documents(spark, [])
    assert mk.packets(mk.store(empty)).count() == 0 and mk.packet_table(mk.store(empty)).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert mk.packets(mk.store(df)).count() == 2
