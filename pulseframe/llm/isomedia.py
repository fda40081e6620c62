"""ISO base media containers: write payloads losslessly, walk boxes, read sample tables.

`build` stores bytes as the 8-bit samples of one track: fixed frames of FRAME bytes in chunks of
CHUNK_FRAMES, every SYNC_EVERY-th frame a sync sample. `probe` walks any nesting of boxes of a
file, plain or fragmented, and gives codec, duration and the byte ranges between sync samples from the tables alone; it
never looks into a payload. `payload` follows the sample offsets to the stored bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import materialise, table
from .textops import slices

FRAME, CHUNK_FRAMES, SYNC_EVERY, RATE = 192, 64, 16, 19200
#: Boxes whose content is boxes (fixed values of the format), with the bytes before the first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"edts": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0, b"dref": 8, b"stsd": 8, b"meta": 4}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(text: bytes) -> bytes:
    """The text and as many blanks as make a positive multiple of FRAME."""
    return text.ljust(max(FRAME, -(-len(text) // FRAME) * FRAME), b" ")


def _movie(frames: int, offsets: np.ndarray) -> bytes:
    """The moov box for `frames` frames whose chunks begin at `offsets`; equal inputs give equal bytes."""
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length, chunks = frames * FRAME, len(offsets)
    wide = chunks and offsets[-1] >= 1 << 32
    last = frames - (chunks - 1) * CHUNK_FRAMES
    to_chunk = [(1, CHUNK_FRAMES, 1)] if chunks > 1 or last == CHUNK_FRAMES else []
    if last != CHUNK_FRAMES:
        to_chunk.append((chunks, last, 1))
    sync = np.arange(1, frames + 1, SYNC_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    stbl = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, frames, FRAME)),
        full_box(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        full_box(b"stsc", struct.pack(">I", len(to_chunk)), b"".join(struct.pack(">III", *x) for x in to_chunk)),
        full_box(b"stsz", struct.pack(">II", FRAME, frames)),
        full_box(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full_box(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes()),
    )
    minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
    media = box(b"mdia", full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), minf)
    track = box(b"trak", full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), unity, bytes(8), version=1, flags=7), media)
    head = full_box(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, length, 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=1)
    return box(b"moov", head, track)


def build(data: bytes) -> bytes:
    """A container whose samples are `data`, a positive multiple of FRAME bytes."""
    frames, rest = divmod(len(data), FRAME)
    if rest or not frames:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    brand = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")
    chunks = np.arange(0, frames, CHUNK_FRAMES, dtype=np.uint64) * np.uint64(FRAME)
    header = 8 if len(data) + 8 < 1 << 32 else 16
    at = len(brand) + len(_movie(frames, chunks)) + header
    movie = _movie(frames, chunks + np.uint64(at))
    if len(brand) + len(movie) + header != at:  # the offsets became 64 bits wide
        at = len(brand) + len(movie) + header
        movie = _movie(frames, chunks + np.uint64(at))
    return brand + movie + box(b"mdat", data)


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, first byte of the content, end) of every box, depth first."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        begin = at + 8
        if size == 1:
            size, begin = struct.unpack_from(">Q", data, begin)[0], begin + 8
        elif size == 0:
            size = end - at
        if size < begin - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        here = (*path, kind)
        yield here, begin, at + size
        if kind in CONTAINERS:
            skip = CONTAINERS[kind]
            if kind == b"meta" and data[begin + 4 : begin + 8] == b"hdlr":
                skip = 0  # the older form without a version
            yield from walk(data, begin + skip, at + size, here)
        at += size


def _numbers(data: bytes, kind: str, count: int, at: int) -> np.ndarray:
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _fields(data: bytes, at: int, flags: int, optional: list[tuple[int, str]]) -> tuple[dict, int]:
    """The optional fields whose bit is set in `flags`, in order, and the byte after them."""
    out = {}
    for bit, form in optional:
        if flags & bit:
            out[bit] = struct.unpack_from(form, data, at)[0]
            at += struct.calcsize(form)
    return out, at


#: Optional fields of a track fragment's header and of a run, and the four of each sample of a run (fixed values of the format).
TFHD = [(0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I")]
TRUN = [(0x1, ">i"), (0x4, ">I")]
SAMPLE = (0x100, 0x200, 0x400, 0x800)
NOT_SYNC, BASE_IS_MOOF = 0x10000, 0x20000


def _run(data: bytes, at: int, fragment: dict, default: dict) -> dict:
    """One trun: sizes, durations, composition offsets, sync flags and offsets of its samples."""
    flags, count = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
    head, at = _fields(data, at + 8, flags, TRUN)
    bits = [b for b in SAMPLE if flags & b]
    rows = _numbers(data, ">u4", count * len(bits), at).reshape(count, len(bits)) if bits else np.zeros((count, 0), np.int64)
    given = {b: rows[:, i] for i, b in enumerate(bits)}
    known = {0x100: fragment.get(0x8, default.get("duration", 0)), 0x200: fragment.get(0x10, default.get("size", 0)), 0x400: fragment.get(0x20, default.get("flags", 0)), 0x800: 0}
    value = {b: given[b] if b in given else np.full(count, known[b], np.int64) for b in SAMPLE}
    if count and 0x4 in head and 0x400 not in given:
        value[0x400][0] = head[0x4]
    begin = fragment["base"] + head[0x1] if 0x1 in head else fragment["next"]
    fragment["next"] = begin + int(value[0x200].sum())
    return {"sizes": value[0x200], "times": value[0x100], "shift": value[0x800].astype(np.int32).astype(np.int64), "sync": value[0x400] & NOT_SYNC == 0, "offsets": begin + np.cumsum(value[0x200]) - value[0x200]}


def _sample_table(t: dict) -> dict:
    """The samples that a track's own tables describe; missing or empty tables mean none."""
    sizes, chunks, rows = (t.get(k) for k in ("table_sizes", "chunks", "to_chunk"))
    none = np.zeros(0, np.int64)
    if sizes is None or chunks is None or rows is None or not len(sizes) or not len(chunks) or not len(rows):
        return {"sizes": none, "times": none, "shift": none, "sync": none.astype(bool), "offsets": none}
    samples = np.repeat(rows[:, 1], np.diff(np.append(rows[:, 0] - 1, len(chunks))))  # of each chunk
    chunk_of = np.repeat(np.arange(len(samples)), samples)
    if len(chunk_of) != len(sizes):
        raise ValueError(f"the chunks hold {len(chunk_of)} samples, the sizes are of {len(sizes)}")
    before = np.cumsum(sizes) - sizes
    first = np.minimum(np.cumsum(samples) - samples, len(sizes) - 1)
    spread = lambda key: np.resize(np.append(np.repeat(t[key][:, 1], t[key][:, 0])[: len(sizes)], np.zeros(len(sizes), np.int64)), len(sizes)) if key in t else np.zeros(len(sizes), np.int64)
    sync = np.ones(len(sizes), dtype=bool)
    if t.get("sync_table") is not None:
        sync[:] = False
        sync[t["sync_table"] - 1] = True
    return {"sizes": sizes, "times": spread("time_table"), "shift": spread("shift_table").astype(np.int32).astype(np.int64), "sync": sync, "offsets": chunks[chunk_of] + before - before[first][chunk_of]}


def probe(data: bytes) -> list[dict]:
    """One dict per track: id, handler, codec, timescale, duration, edits (duration, media time), and of all its samples, those of
    the track's tables and then those of its fragments: sizes, times, composition shift, offsets, decode_time (sum of times), and
    the byte ranges (keyframes) of the groups that begin with a sync sample. A track without samples has empty ones."""
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    runs: dict[int, list[dict]] = {}
    moof, fragment = 0, {}
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"id": 0, "handler": "", "codec": "", "timescale": 0, "duration": 0, "edits": np.zeros((0, 2), np.int64)})
        elif kind == b"trex":
            n, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
            defaults[n] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            moof, fragment = at - (8 if data[at - 4 : at] == kind else 16), {}
        elif kind == b"tfhd":
            flags, n = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
            after = fragment.get("next", moof)
            fragment = _fields(data, at + 8, flags, TFHD)[0] | {"track": n}
            fragment["base"] = fragment["next"] = fragment.get(0x1, moof if flags & BASE_IS_MOOF else after)
        elif kind == b"trun" and fragment:
            runs.setdefault(fragment["track"], []).append(_run(data, at, fragment, defaults.get(fragment["track"], {})))
        if not tracks or path[0] != b"moov":
            continue
        t = tracks[-1]
        count = struct.unpack_from(">I", data, at + 4)[0] if end - at >= 8 else 0
        wide = end > at and data[at] == 1
        if kind == b"tkhd":
            t["id"] = struct.unpack_from(">I", data, at + (20 if wide else 12))[0]
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"hdlr" and path[-2] == b"mdia":
            t["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif len(path) > 1 and path[-2] == b"stsd" and not t["codec"]:
            t["codec"] = kind.decode("latin-1")
        elif kind == b"elst":
            t["edits"] = np.array([struct.unpack_from(">Qq" if wide else ">Ii", data, at + 8 + i * (20 if wide else 12)) for i in range(count)], np.int64).reshape(-1, 2)
        elif kind == b"stts":
            t["time_table"] = _numbers(data, ">u4", 2 * count, at + 8).reshape(-1, 2)
        elif kind == b"ctts":
            t["shift_table"] = _numbers(data, ">u4", 2 * count, at + 8).reshape(-1, 2)
        elif kind == b"stss":
            t["sync_table"] = _numbers(data, ">u4", count, at + 8)
        elif kind == b"stsc":
            t["to_chunk"] = _numbers(data, ">u4", 3 * count, at + 8).reshape(-1, 3)
        elif kind == b"stsz":
            n = struct.unpack_from(">I", data, at + 8)[0]
            t["table_sizes"] = np.full(n, count, np.int64) if count else _numbers(data, ">u4", n, at + 12)
        elif kind == b"stz2":
            n, width = struct.unpack_from(">I", data, at + 8)[0], data[at + 7]
            if width == 4:
                pairs = _numbers(data, ">u1", -(-n // 2), at + 12)
                t["table_sizes"] = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]
            else:
                t["table_sizes"] = _numbers(data, ">u1" if width == 8 else ">u2", n, at + 12)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _numbers(data, ">u4" if kind == b"stco" else ">u8", count, at + 8)
    for t in tracks:
        parts = [_sample_table(t), *runs.get(t["id"], [])]
        t |= {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        t["decode_time"] = int(t["times"].sum())
        t["keyframes"] = keyframe_ranges(t["offsets"], t["sizes"], np.flatnonzero(t["sync"]))
    return tracks


def keyframe_ranges(offsets: np.ndarray, sizes: np.ndarray, sync: np.ndarray) -> np.ndarray:
    """[first byte, end byte) of each run of samples from one sync sample to the next."""
    if not len(sync):
        return np.zeros((0, 2), np.int64)
    last = np.append(sync[1:], len(sizes)) - 1
    return np.stack([offsets[sync], offsets[last] + sizes[last]], axis=1)


def payload(data: bytes, track: dict) -> bytes:
    """The track's stored bytes, chunk by chunk from the offsets of its tables."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(sizes):
        return b""
    ends = offsets + sizes
    cut = np.flatnonzero(np.append(True, offsets[1:] != ends[:-1]))
    stop = np.append(cut[1:], len(sizes)) - 1
    return b"".join(data[a:b] for a, b in zip(offsets[cut].tolist(), ends[stop].tolist()))


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the container of the padded text) of every document, as written.

    A null or empty text has n_bytes 0 and one frame of blanks. Equal texts have equal media. A very long text is one
    container in a batch of its own, with 64-bit sizes and offsets where they are needed.
    Repeated rows stay, no rows give none; columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            media = pa.array([build(pad(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return materialise(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<first:long,end:long>>"


def describe(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes; as feature, the track's codec, duration, first and last keyframe range and a checksum of all; and as
    keyframes the byte range (first, end) of every keyframe in the container, so a reader can fetch it without the rest."""

    def one(doc_id, n_bytes, data: bytes) -> tuple:
        track = probe(data)[0]
        stored = payload(data, track)
        keys = track["keyframes"]
        feature = {
            "codec": track["codec"].strip(), "seconds": round(max(track["duration"], track["decode_time"]) / max(track["timescale"], 1), 6), "samples": len(track["sizes"]),
            "keyframes": len(keys), "first_range": keys[0].tolist(), "last_range": keys[-1].tolist(), "ranges_crc32": zlib.crc32(keys.astype("<i8").tobytes()),
        }
        return doc_id, n_bytes, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(data), hashlib.sha256(data).hexdigest(), json.dumps(feature, sort_keys=True), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")[:-1]]
        for batch in slices(batches, "media"):
            rows = [one(d, n, m) for d, n, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")))]
            ranges = np.concatenate([r[-1] for r in rows]).astype(np.int64)
            offsets = np.cumsum([0, *(len(r[-1]) for r in rows)])
            keyframes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(ranges[:, 0]), pa.array(ranges[:, 1])], names=["first", "end"]))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), keyframes], names=names)

    return media.mapInArrow(run, DIGEST)


def op4_iso_media(spark, sf_dir: str) -> DataFrame:
    """Digests of the containers of all `documents`, computed from the files as read back."""
    return describe(pack_documents(table(spark, sf_dir, "documents")))
