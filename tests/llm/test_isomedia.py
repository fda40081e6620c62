import hashlib
import json
import zlib

import numpy as np
import pytest

from pulseframe.llm import isomedia as m


@pytest.mark.parametrize("n", [192, 192 * 2, 192 * 64, 192 * 65, 192 * 1000])
def test_container_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    made = m.build(data)
    (track,) = m.probe(made)
    assert m.payload(made, track) == data
    assert track["codec"] == "raw " and track["handler"] == "soun" and len(track["sizes"]) == n // 192
    assert track["duration"] == n and track["decode_time"] == n and track["timescale"] == m.RATE
    keys = track["keyframes"]
    assert keys[0, 0] == track["offsets"][0] and keys[-1, 1] == keys[0, 0] + n
    assert (keys[1:, 0] == keys[:-1, 1]).all() and len(keys) == -(-(n // 192) // m.SYNC_EVERY)


def test_boxes_nest_and_bad_sizes_are_refused():
    made = m.build(b"x" * 192)
    paths = [p for p, _, _ in m.walk(made)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd", b"raw ") in paths and paths[-1] == (b"mdat",)
    with pytest.raises(ValueError):
        list(m.walk(b"\0\0\0\x04abcd"))
    with pytest.raises(ValueError):
        m.build(b"x" * 100)


@pytest.mark.parametrize("which", ["hard_docs", "documents"])
def test_digests_equal_plain_ones(which, request):
    docs = request.getfixturevalue(which)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    got = m.describe(m.pack_documents(docs)).collect()
    assert len(got) == len(texts)
    by_text: dict = {}
    for r in got:
        padded = m.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
        assert by_text.setdefault(padded, (r.media_sha256, r.feature, r.keyframes)) == (r.media_sha256, r.feature, r.keyframes)
        told = json.loads(r.feature)
        assert len(r.keyframes) == told["keyframes"] and list(r.keyframes[0]) == told["first_range"] and list(r.keyframes[-1]) == told["last_range"]
        assert zlib.crc32(np.array([list(k) for k in r.keyframes], "<i8").tobytes()) == told["ranges_crc32"]


def test_empty_table(no_docs):
    assert m.describe(m.pack_documents(no_docs)).count() == 0


def track(*tables, track_id=3, more=b""):
    entry = m.box(b"avc1", bytes(78))
    stbl = m.box(b"stbl", m.full_box(b"stsd", (1).to_bytes(4, "big"), entry), *tables)
    head = m.full_box(b"tkhd", bytes(8), track_id.to_bytes(4, "big"), bytes(68))
    times = m.full_box(b"mdhd", bytes(8), (1000).to_bytes(4, "big"), (500).to_bytes(4, "big"), bytes(4))
    return m.box(b"trak", head, more, m.box(b"mdia", times, m.full_box(b"hdlr", bytes(4), b"vide", bytes(13)), m.box(b"minf", stbl)))


def u32(*values):
    return b"".join((v & 0xFFFFFFFF).to_bytes(4, "big") for v in values)


def test_compact_sizes_edits_and_composition_shifts():
    tables = [
        m.full_box(b"stts", u32(1, 3, 40)), m.full_box(b"ctts", u32(2, 1, 80, 2, -40)), m.full_box(b"stss", u32(2, 1, 3)), m.full_box(b"stsc", u32(1, 1, 3, 1)),
        m.full_box(b"stz2", u32(4, 3), bytes([0x5A, 0x30])), m.full_box(b"stco", u32(1, 700)),
    ]
    edits = m.box(b"edts", m.full_box(b"elst", u32(2, 10, -1, 0x10000, 500, 80, 0x10000)))
    meta = m.box(b"meta", bytes(4), m.full_box(b"hdlr", bytes(21)))
    old = m.box(b"meta", m.full_box(b"hdlr", bytes(21)))
    (t,) = m.probe(m.box(b"moov", meta, track(*tables, more=edits), m.box(b"udta", old)))
    assert t["sizes"].tolist() == [5, 10, 3] and t["offsets"].tolist() == [700, 705, 715]
    assert t["shift"].tolist() == [80, -40, -40] and t["edits"].tolist() == [[10, -1], [500, 80]]
    assert t["keyframes"].tolist() == [[700, 715], [715, 718]] and t["decode_time"] == 120 and t["codec"] == "avc1"


def test_fragments_and_tracks_without_tables():
    trex = m.full_box(b"trex", u32(3, 1, 40, 9, 0x10000))
    empty = [m.full_box(k, u32(0)) for k in (b"stts", b"stsc", b"stco")] + [m.full_box(b"stsz", u32(0, 0))]
    movie = m.box(b"ftyp", b"iso5", u32(0)) + m.box(b"moov", track(*empty), track(track_id=4), m.box(b"mvex", trex))
    run = m.full_box(b"trun", u32(2, 1000, 0, 11, 12), flags=0x1 | 0x4 | 0x200)
    more = m.full_box(b"trun", u32(1, 0x2000000), flags=0x400)
    late = m.full_box(b"trun", u32(2), flags=0)
    traf = m.box(b"traf", m.full_box(b"tfhd", u32(3), flags=m.BASE_IS_MOOF), m.full_box(b"tfdt", u32(0)), run, more)
    own = m.box(b"traf", m.full_box(b"tfhd", u32(3), (1 << 40).to_bytes(8, "big"), u32(20, 7), flags=0x1 | 0x8 | 0x10), late)
    data = movie + m.box(b"moof", m.full_box(b"mfhd", u32(1)), traf, own)
    t, none = m.probe(data)
    at = len(movie)
    assert t["sizes"].tolist() == [11, 12, 9, 7, 7] and t["times"].tolist() == [40, 40, 40, 20, 20]
    assert t["offsets"].tolist() == [at + 1000, at + 1011, at + 1023, 1 << 40, (1 << 40) + 7]
    assert t["sync"].tolist() == [True, False, True, False, False] and t["keyframes"].tolist() == [[at + 1000, at + 1023], [at + 1023, (1 << 40) + 14]]
    assert len(none["sizes"]) == 0 and none["keyframes"].shape == (0, 2) and m.payload(data, none) == b""
