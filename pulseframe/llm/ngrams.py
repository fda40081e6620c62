"""Hashed n-gram indicators of whole texts, and the labelled sample that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import MIX1, MIX2, Words, _word_byte, buffers, mix, slices, span_hash

BITS = 20
U = np.uint64
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def _fold(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.uint32)


def _join(hashes: list[np.ndarray], salt: int) -> np.ndarray:
    total = np.full(len(hashes[0]), (salt * int(MIX2)) % (1 << 64), dtype=np.uint64)
    for h in hashes:
        total = (total ^ h) * MIX1
    return mix(total)


def skip_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text numbers, distinct features, texts) of words, neighbouring pairs, and pairs over one and two words."""
    words = Words(texts)
    h, of = words.hash, words.text_of
    found, owner = [_fold(h)], [of]
    for gap in (1, 2, 3):
        same = of[gap:] == of[:-gap]
        found.append(_fold(_join([h[:-gap][same], h[gap:][same]], gap)))
        owner.append(of[gap:][same])
    return _distinct(found, owner, words.n_texts)


def shape_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text numbers, distinct features, texts) of tokens, token pairs, and runs of one to three token shapes.

    A token is a run of word bytes or a run of other bytes that aren't white space. The shape of a word
    is whether it begins in upper case, has more upper case, has digits, and its length class; that
    of another token is its bytes.
    """
    data, offsets = buffers(texts)
    n, n_texts = len(data), len(offsets) - 1
    before = np.empty(n, dtype=np.uint8)
    if n:
        before[0], before[1:] = 0, data[:-1]
    upper = ((data >= 65) & (data <= 90)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    kind = np.where(_space[data], 0, np.where(_word_byte[data], 1, 2)).astype(np.int8)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    of = np.searchsorted(offsets, start, side="right") - 1
    h = span_hash(data + (upper * np.uint8(32)), start, end)
    capitals = np.concatenate([[0], np.cumsum(upper)])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    many = capitals[end] - capitals[start]
    first = upper[start] | ((data[start] == 0xC3) & upper[np.minimum(start + 1, n - 1)]) if n else np.zeros(0, bool)
    size = np.minimum(end - start, 24) // 6
    code = (first * 1 + (many > first) * 2 + (digits[end] > digits[start]) * 4 + size * 8).astype(np.uint64)
    shape = np.where(kind[start] == 1, mix(code + U(1)), h)
    found, owner = [_fold(h), _fold(_join([shape], 11))], [of, of]
    two = of[1:] == of[:-1]
    found += [_fold(_join([h[:-1][two], h[1:][two]], 1)), _fold(_join([shape[:-1][two], shape[1:][two]], 12))]
    owner += [of[1:][two], of[1:][two]]
    if len(of) > 2:
        three = of[2:] == of[:-2]
        found.append(_fold(_join([shape[:-2][three], shape[1:-1][three], shape[2:][three]], 13)))
        owner.append(of[2:][three])
    return _distinct(found, owner, n_texts)


def _distinct(found: list[np.ndarray], owner: list[np.ndarray], n_texts: int) -> tuple[np.ndarray, np.ndarray, int]:
    of, values = np.concatenate(owner), np.concatenate(found)
    key = np.sort((of.astype(np.uint64) << U(32)) | values)
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> U(32)).astype(np.int64), key.astype(np.uint32), n_texts


def held_out() -> F.Column:
    """True for the rows that no label may be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, grams: Callable) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most `most` labelled documents outside the held-out quarter, those with the
    smallest hashes of their doc_id. Labels that are null, and doc_ids that are null, are left out; of
    repeated doc_ids one row and the largest label count."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, values, n = grams(batch.column("text"))
            at = np.searchsorted(of, np.arange(n + 1))
            blobs = [values[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "label", "features"])

    rows = texts.mapInArrow(run, "doc_id long, label int, features binary").toArrow().sort_by([("doc_id", "ascending")])
    ids, y, blobs = rows["doc_id"].to_numpy(), rows["label"].to_numpy(), rows["features"]
    first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    x = [np.frombuffer(blobs[int(i)].as_buffer(), "<u4").copy() for i in np.flatnonzero(first)]
    return x, (y[first] > 0).astype(np.int8)


def score_documents(docs: DataFrame, grams: Callable, weigh: Callable, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. `weigh` turns (text numbers, features, texts)
    into one score per text. Null and empty texts have no features and get the score of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = weigh(*grams(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


__all__ = ["skip_grams", "shape_grams", "held_out", "labelled_sample", "score_documents", "logistic", "BITS"]
