"""Matroska files that ``mux`` does not write: block groups, unknown sizes, deep nesting, other time scales, null media."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from subtide.llm import matroska as m


def file_of(*children: bytes, scale: int = 1_000_000) -> bytes:
    info = m._element(m.INFO, m._uint(m.TIMESTAMP_SCALE, scale))
    return m._element(m.EBML, m._element(m.DOC_TYPE, b"matroska")) + m._element(m.SEGMENT, info + b"".join(children))


def test_block_groups_unknown_sizes_and_scales():
    block = m._element(m.BLOCK, b"\x82" + (5).to_bytes(2, "big") + b"\x04\x01" + b"abcd")  # track 2, fixed lacing, two frames
    group = m._element(m.BLOCK_GROUP, block + m._uint(m.BLOCK_DURATION, 8) + m._element(m.REFERENCE_BLOCK, b"\xff"))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m._uint(m.CLUSTER_TIME, 10) + group  # unknown size
    data = file_of(cluster, cluster, scale=1000)
    packets, cues, error = m.demux(data)
    assert error is None and cues == []
    assert [(p[0], p[2], p[3], p[4], p[5], data[p[6] : p[6] + p[7]], p[8]) for p in packets] == [(2, 15_000, False, "fixed", c, f, 4000) for c in (0, 1) for f in (b"ab", b"cd")]


def test_deep_nesting_ends_the_parse():
    data = b""
    for _ in range(2000):
        data = m._element(m.SEGMENT, data)
    packets, _, error = m.demux(m.mux(b"x" * 64) + data)
    assert len(packets) == 1 and "nested" in error


def test_null_media_and_long_texts(spark):
    rows = [(1, None), (2, b""), (3, b"\x1a"), (4, m.mux(b"a" * 70_000))]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, media binary, error string")
    got = {r.doc_id: r for r in m.payload_digests(m.packet_table(frame)).collect()}
    assert [got[i].payload_bytes for i in (1, 2, 3, 4)] == [0, 0, 0, 70_000]
    errors = {r.doc_id: r.error for r in m.packet_table(frame).collect()}
    assert errors[1] == "no media" and errors[2] is None and errors[3] and errors[4] is None
    empty = m.store(spark.createDataFrame([], "doc_id long, text string"), "text")
    assert m.payload_digests(m.packet_table(empty)).count() == 0


def columns_hold(data):
    packets, cues, tracks, error = m.parsed(data)
    for rows, kind in ((packets, m.PACKET), (cues, m.CUE), (tracks, m.TRACK_ROW)):
        pa.array([dict(zip([f.name for f in kind], r, strict=True)) for r in rows], kind)
    return packets, error


def test_numbers_that_no_column_holds_end_the_parse():
    block = m._element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    for bad in (m._element(m.CLUSTER_TIME, b"\xff" * 8), m._element(m.CLUSTER_TIME, b"\x01" * 9), m._element(m.SIMPLE_BLOCK, b"\x08\xff\xff\xff\xff\x00\x00\x80x"), m._element(m.SIMPLE_BLOCK, b"\x81\x00")):
        packets, error = columns_hold(file_of(m._element(m.CLUSTER, m._uint(m.CLUSTER_TIME, 1) + block + bad + block)))
        assert error and [p[7] for p in packets] == [3]
    late = m._element(m.CUES, m._element(m.CUE_POINT, m._element(m.CUE_TIME, b"\xff" * 8) + m._element(m.CUE_POSITIONS, m._uint(m.CUE_CLUSTER, 5))))
    packets, error = columns_hold(file_of(m._element(m.CLUSTER, block), late))
    assert len(packets) == 1 and "cue time" in error


def test_one_laced_frame_has_no_size():
    for flags in (0x02, 0x04, 0x06):
        data = file_of(m._element(m.CLUSTER, m._element(m.SIMPLE_BLOCK, b"\x81\x00\x00" + bytes([flags]) + b"\x00abc")))
        packets, cues, error = m.demux(data)
        assert error is None and [data[p[6] : p[6] + p[7]] for p in packets] == [b"abc"]


def test_tracks_and_a_scale_after_the_clusters():
    video = m._element(m.TRACK, m._uint(m.TRACK_NUMBER, 2) + m._uint(m.TRACK_UID, 1 << 63) + m._uint(m.TRACK_TYPE, 1) + m._element(m.CODEC, b"V_VP9\0"))
    cluster = m._element(m.CLUSTER, m._uint(m.CLUSTER_TIME, 7) + m._element(m.SIMPLE_BLOCK, b"\x82\x00\x01\x80x"))
    data = m._element(m.SEGMENT, cluster + m._element(m.TRACKS, video) + m._element(m.INFO, m._uint(m.TIMESTAMP_SCALE, 1000)))
    packets, _, tracks, error = m.parsed(m.mux(b"x" * 64) + data)
    assert error is None and tracks == [(1, "1", 2, "A_PCM/INT/LIT", 8000.0, 1, 8), (2, str(1 << 63), 1, "V_VP9", None, None, None)]
    assert [(p[0], p[2]) for p in packets] == [(1, 0), (2, 8000)]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([None, "xiph", "ebml"]), st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 255)), max_size=6), st.integers(0, 5000))
def test_altered_and_cut_files_never_raise(lacing, edits, cut):
    data = bytearray(m.mux(bytes(range(256)) * 12, lacing))
    for at, value in edits:
        data[at % len(data)] = value
    columns_hold(bytes(data[: max(1, len(data) - cut)]))
