"""Word-BPE token ids of whole texts, computed once per distinct word of a batch.

White space always separates tokens of this vocabulary and each piece between white space is encoded
by itself, so a batch's distinct pieces go through the tokenizers library and every occurrence is
a lookup. Strings of special tokens are found inside pieces as the library does by default. Pieces made of lower-case Latin letters and closing punctuation are looked up as the two
parts that the vocabulary's own splitting makes of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textops import slices

_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?|*&%$#@+=()\[\]{}<>/\"-]*)$"
CACHE_PARTS, SLICE, WORDS_A_CALL = 600_000, 8 << 20, 64


class PieceEncoder:
    """Encodes Arrow string arrays; keeps the ids of at most CACHE_PARTS parts between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        ends = [i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.model.get_vocab_size() + 1, dtype=bool)
        self.is_end[ends] = True
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ids, self.bounds = [np.zeros(0, np.uint32)], [0, 0]

    def _encode_new(self, plain: list[str], other: list[str]) -> None:
        if plain:
            calls = [" ".join(plain[i : i + WORDS_A_CALL]) for i in range(0, len(plain), WORDS_A_CALL)]
            ids = np.array([i for one in self.model.encode_batch_fast(calls, add_special_tokens=False) for i in one.ids], dtype=np.uint32)
            last = np.flatnonzero(self.is_end[ids]) + 1
            if len(last) != len(plain) or last[-1] != len(ids):
                other = plain + other  # a part that the model splits further
            else:
                self._add(plain, ids, last)
        if other:
            made = self.model.encode(other, is_pretokenized=True, add_special_tokens=False)
            of = np.array(made.word_ids, dtype=np.int64)
            self._add(other, np.array(made.ids, dtype=np.uint32), np.searchsorted(of, np.arange(len(other)), side="right"))

    def _add(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        base, first = self.bounds[-1], len(self.bounds) - 1
        self.ids.append(ids)
        self.bounds.extend((ends + base).tolist())
        self.number.update(zip(parts, range(first, first + len(parts))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the n + 1 offsets of the texts in them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        pieces = split.flatten().dictionary_encode()
        if len(self.number) > CACHE_PARTS:
            self._clear()
        found = pc.extract_regex(pieces.dictionary, _PLAIN)
        plain = pc.is_valid(found)
        words = pc.utf8_lower(pc.struct_field(found, "word").filter(plain)).dictionary_encode()
        tails = pc.struct_field(found, "tail").filter(plain).dictionary_encode()
        lists = [x.to_pylist() for x in (words.dictionary, tails.dictionary, pieces.dictionary.filter(pc.invert(plain)))]
        self._encode_new([w for part in lists[:2] for w in part if w not in self.number], [w for w in lists[2] if w and w not in self.number])
        numbers = [np.array([self.number[w] for w in part], dtype=np.int32) for part in lists]
        parts = np.zeros((len(pieces.dictionary), 2), dtype=np.int32)
        is_plain = plain.to_numpy(zero_copy_only=False)
        parts[is_plain, 0] = numbers[0][words.indices.to_numpy(zero_copy_only=False)] if len(numbers[0]) else 0
        parts[is_plain, 1] = numbers[1][tails.indices.to_numpy(zero_copy_only=False)] if len(numbers[1]) else 0
        parts[~is_plain, 0] = numbers[2]
        self.ids, bounds = [np.concatenate(self.ids)], np.array(self.bounds, dtype=np.int64)
        which = parts[pieces.indices.to_numpy(zero_copy_only=False)].ravel()
        size = np.diff(bounds)[which]
        total = np.zeros(len(which) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        at = np.repeat(bounds[which] - total[:-1], size)
        at += np.arange(total[-1])
        in_text = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return self.ids[0][at], total[in_text * 2]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def unit(path: str) -> str:
    """The NumPy type that holds every id of the vocabulary: two bytes where they suffice."""
    return "<u2" if encoder(path).model.get_vocab_size() <= 1 << 16 else "<u4"


def token_table(docs, path: str, end_id: int):
    """doc_id and ids (`unit(path)`, `end_id` last) of every document."""
    kind = unit(path)
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, most=SLICE):
            ids, at = encode(batch.column("text"))
            n = batch.num_rows
            whole = np.full(len(ids) + n, end_id, dtype=kind)
            whole[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
            offsets = ((at + np.arange(n + 1)) * size).astype(np.int64)
            blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blob.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")
