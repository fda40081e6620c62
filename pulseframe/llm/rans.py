"""Static range asymmetric numeral system for token ids.

One frequency table, counted over the whole corpus, serves every block. A block holds whole
documents and decodes alone: symbol i goes to lane i modulo the number of lanes, every lane has a
63-bit state, and all lanes of a step advance together in NumPy. Every `checkpoint_steps` steps
the block stores the states, the place in the word stream and a checksum, so that segments of one
block decode in parallel too (`read_segments`). A file set is a folder with two Parquet tables, `blocks` and the shared
`frequencies`; nothing else is needed to read it (`read_blocks`).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop_table, materialise, new_folder, table
from .token_ids import token_table, unit

SCALE = 20
LOW = np.uint64(1 << 31)
MAGIC, VERSION = b"RANSBLK1", 1
HEAD = struct.Struct("<8sIIIIII")
BLOCK_IDS, LANES, CHECKPOINT_STEPS = 1 << 18, 1024, 64
END_ID = 2


class Frequencies:
    """Counts scaled to 2**SCALE with at least 1 for every id that occurs."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        size, n = 1 << SCALE, len(counts)
        if n > size // 4:
            raise ValueError("more distinct ids than the table's scale allows")
        share = counts / max(counts.sum(), 1) * (size - n)
        freq = 1 + np.floor(share).astype(np.int64)
        left = size - int(freq.sum()) if n else 0
        freq[np.argsort(-(share - np.floor(share)), kind="stable")[:left]] += 1
        self.freq = freq
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]) if n else np.zeros(0, np.int64)
        self.key = zlib.crc32(np.concatenate([self.symbols, freq]).astype("<i8").tobytes())

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(VERSION, self.key, int(s), int(f)) for s, f in zip(self.symbols, self.freq)]

    @classmethod
    def of_rows(cls, rows: list) -> Frequencies:
        """The table as stored; rows are (version, key, id, freq). Checks version, sum and checksum."""
        rows = sorted(rows, key=lambda r: r[2])
        made = cls(np.zeros(0, np.int64), np.zeros(0))
        made.symbols, made.freq = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        made.start = np.cumsum(made.freq) - made.freq
        made.key = zlib.crc32(np.concatenate([made.symbols, made.freq]).astype("<i8").tobytes())
        if rows and ({(r[0], r[1]) for r in rows} != {(VERSION, made.key)} or made.freq.sum() != 1 << SCALE):
            raise ValueError("the frequency table is damaged or of another version")
        return made

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        top = int(self.symbols[-1]) + 1 if len(self.symbols) else 1
        freq, start = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        freq[self.symbols], start[self.symbols] = self.freq, self.start
        return freq, start

    def decoder(self) -> np.ndarray:
        return np.repeat(self.symbols, self.freq).astype(np.uint32)


def encode_block(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray], key: int, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    freq, start = table
    n = len(ids)
    lanes = max(1, min(lanes, n // 256))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words, sizes, states = [], np.zeros(steps, np.int64), {}
    shift, room, low32 = np.uint64(SCALE), np.uint64(63 - SCALE), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        f, now = freq[s], x[: len(s)]
        full = now >= (f << room)
        out = now[full] & low32
        now = np.where(full, now >> np.uint64(32), now)
        words.append(out.astype("<u4"))
        sizes[t] = len(out)
        q = now // f
        x[: len(s)] = (q << shift) + (now - q * f) + start[s]
        if t % every == 0:
            states[t] = x.copy()
    at = np.concatenate([[0], np.cumsum(sizes)])
    marks = sorted(states)
    raw = ids.astype("<u4")
    index = b"".join(struct.pack("<II", int(at[t]), zlib.crc32(raw[t * lanes : (t + every) * lanes])) for t in marks)
    body = index + b"".join(states[t].astype("<u8").tobytes() for t in marks) + b"".join(w.tobytes() for w in reversed(words))
    head = HEAD.pack(MAGIC, key, n, lanes, every, len(marks), int(at[-1]))
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def decode_segment(block: bytes, k: int, slots: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids from checkpoint `k` to the next one; checks their checksum."""
    _, _, n, lanes, every, marks, n_words = HEAD.unpack_from(block)
    at, crc = struct.unpack_from("<II", block, HEAD.size + 8 * k)
    states_at = HEAD.size + 8 * marks
    x = np.frombuffer(block, "<u8", lanes, states_at + 8 * lanes * k).copy()
    words = np.frombuffer(block, "<u4", n_words, states_at + 8 * lanes * marks).astype(np.uint64)
    freq, start = table
    first, last = k * every, min(-(-n // lanes), (k + 1) * every)
    out = np.empty(min(n, last * lanes) - first * lanes, dtype=np.uint32)
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(first, last):
        m = min(lanes, n - t * lanes)
        slot = x[:m] & mask
        s = slots[slot]
        out[(t - first) * lanes : (t - first) * lanes + m] = s
        now = freq[s] * (x[:m] >> shift) + slot - start[s]
        need = np.flatnonzero(now < LOW)
        now[need] = (now[need] << np.uint64(32)) | words[at : at + len(need)]
        at += len(need)
        x[:m] = now
    if zlib.crc32(out.astype("<u4")) != crc:
        raise ValueError(f"checksum of segment {k} differs")
    return out


def segment_block(block: bytes, k: int) -> bytes:
    """Segment `k` of a block as a block of its own, without decoding it."""
    magic, key, n, lanes, every, marks, n_words = HEAD.unpack_from(block)
    place = lambda i: struct.unpack_from("<II", block, HEAD.size + 8 * i)
    at, crc = place(k)
    end = place(k + 1)[0] if k + 1 < marks else n_words
    states = HEAD.size + 8 * marks
    words = states + 8 * lanes * marks
    ids = min(n, (k + 1) * every * lanes) - k * every * lanes
    head = HEAD.pack(magic, key, ids, lanes, every, 1, end - at)
    body = struct.pack("<II", 0, crc) + block[states + 8 * lanes * k : states + 8 * lanes * (k + 1)] + block[words + 4 * at : words + 4 * end]
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def segments_of(block: bytes) -> list[bytes]:
    return [segment_block(block, k) for k in range(HEAD.unpack_from(block)[5])]


def decode_block(block: bytes, slots: np.ndarray, table: tuple[np.ndarray, np.ndarray], key: int) -> np.ndarray:
    magic, used, n, _, _, marks, _ = HEAD.unpack_from(block)
    if magic != MAGIC or used != key:
        raise ValueError("not a block of this frequency table")
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("checksum of the block differs")
    return np.concatenate([decode_segment(block, k, slots, table) for k in range(marks)]) if n else np.zeros(0, np.uint32)


def count_ids(tokens: DataFrame, kind: str) -> Frequencies:
    """Frequencies over the whole table (ids stored as `kind`): one row per task and id, summed; the driver gets at most one
    row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            blob = batch.column("ids")
            for one in blob:
                seen = np.bincount(np.frombuffer(one.as_buffer(), kind))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Frequencies(rows["id"].to_numpy(), rows["n"].to_numpy())


BLOCK_SCHEMA = "shard int, block_no int, n_ids long, doc_ids array<long>, doc_sizes array<int>, body binary"
TABLE_SCHEMA = "version int, key long, id long, freq long"


def write_blocks(tokens: DataFrame, table: Frequencies, kind: str, name: str = "rans") -> str:
    """Writes the table's documents in ascending doc_id (equal ids: by their tokens) as blocks, and the frequencies beside
    them; the new folder. Shards are ranges of doc_id, numbered in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number = table.encoder(), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []

        def close() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            row = [[shard], [number], [len(whole)], [docs], [[len(x) for x in ids]], [encode_block(whole, coder, table.key)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["shard", "block_no", "n_ids", "doc_ids", "doc_sizes", "body"])

        held = 0
        for batch in batches:
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                one = np.frombuffer(blob.as_buffer(), kind)
                docs.append(doc)
                ids.append(one.copy())
                held += len(one)
                if held >= BLOCK_IDS:
                    yield close()
                    ids, docs, held, number = [], [], 0, number + 1
        if docs:
            yield close()

    dealt = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    spark = tokens.sparkSession
    path = new_folder(spark, name)
    spark.createDataFrame(table.rows(), TABLE_SCHEMA).coalesce(1).write.parquet(f"{path}/frequencies")
    dealt.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def open_blocks(spark, path: str) -> tuple[DataFrame, Frequencies]:
    """The blocks of a folder and its frequencies (at most one row per id of the vocabulary)."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks"), Frequencies.of_rows([tuple(r) for r in spark.read.schema(TABLE_SCHEMA).parquet(f"{path}/frequencies").collect()])


def read_segments(spark, path: str, parts: int) -> DataFrame:
    """shard, block_no, segment, ids of every segment of the folder's blocks. A block is cut at its checkpoints into
    rows that decode alone, and those are dealt to `parts` tasks."""
    blocks, table = open_blocks(spark, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = segments_of(row["body"])
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block_no"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.binary())], names=["shard", "block_no", "segment", "body"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, coder = table.decoder(), table.encoder()
        for batch in batches:
            ids = [decode_block(x.as_py(), slots, coder, table.key).astype("<u4").tobytes() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "block_no", "segment")), pa.array(ids, pa.binary())], names=["shard", "block_no", "segment", "ids"])

    rows = blocks.mapInArrow(cut, "shard int, block_no int, segment int, body binary").repartition(parts, "shard", "block_no", "segment")
    return rows.mapInArrow(decode, "shard int, block_no int, segment int, ids binary")


def read_blocks(spark, path: str) -> DataFrame:
    """shard, block_no, at (ids of the block before the document), doc_id, ids of every document of a folder."""
    blocks, table = open_blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, coder = table.decoder(), table.encoder()
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["body"], slots, coder, table.key).astype("<u4")
                sizes = np.array(row["doc_sizes"], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                n = len(sizes)
                blobs = [ids[at[i] : at[i + 1]].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block_no"]] * n, pa.int32()), pa.array(at[:-1]), pa.array(row["doc_ids"], pa.int64()), pa.array(blobs, pa.binary())],
                    names=["shard", "block_no", "at", "doc_id", "ids"],
                )

    return blocks.mapInArrow(run, "shard int, block_no int, at long, doc_id long, ids binary")


def with_starts(decoded: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before. Only block sizes are summed: within a shard by a
    window of its blocks, over shards by one row each."""
    sizes = blocks.select("shard", "block_no", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_at"))
    inside = Window.partitionBy("shard").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.select("shard", "block_no", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_at")).join(shards, "shard")
    return decoded.join(index, ["shard", "block_no"]).withColumn("start", F.col("shard_at") + F.col("block_at") + F.col("at"))


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Tokenise, write blocks and frequencies, read them back; doc_id, start and ids as stored.

    A null text is an empty one and has the end id alone; an empty table gives no rows; repeated
    doc_ids each keep a row, ordered by their tokens; a null doc_id sorts first; a very long text is one block. Columns besides doc_id and text are not read.
    """
    tokens = materialise(token_table(docs, path, end_id), "tokens")
    kind = unit(path)
    table = count_ids(tokens, kind)
    path = write_blocks(tokens, table, kind)
    drop_table(tokens)
    spark = docs.sparkSession
    return with_starts(digest(read_blocks(spark, path)), open_blocks(spark, path)[0])


def digest(decoded: DataFrame) -> DataFrame:
    """Replaces ids by their number and checksum."""
    return decoded.select("shard", "block_no", "at", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op1_rans_token_blocks(spark, sf_dir: str) -> DataFrame:
    """Starts, counts and checksums of the token ids of all `documents`, read back from the blocks."""
    import public_tokenizers

    out = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


__all__ = ["Frequencies", "encode_block", "decode_block", "decode_segment", "count_ids", "write_blocks", "open_blocks", "read_blocks", "read_segments", "segment_block", "with_starts", "round_trip", "op1_rans_token_blocks"]
