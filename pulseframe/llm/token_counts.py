"""Byte-level BPE token counts of whole texts by rank-synchronous array merging.

The distinct pre-tokens of a slice of texts lie one after another in one array of symbols. In each round every
sequence merges all places of its own lowest-rank pair at once; sequences without a mergeable pair leave. What
counts is how many symbols survive, so no id is put together. Nothing is shuffled: tasks count the texts they read.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table
from .textops import slices

#: Pre-tokens kept with their counts between slices, the longest of them in characters, and characters split in one go.
CACHE_WORDS, CACHE_LETTERS, BLOCK = 600_000, 48, 1 << 20
_CUT = regex.compile(r"(?<=\S)\s")
LIMIT = 1024
NONE = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Ranks of mergeable pairs and the number of symbols that a sequence of bytes ends with."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = np.int64(max(vocab.values()) + 1)
        self.symbol = np.array([vocab[letter] for _, letter in sorted(byte_letters().items())], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], dtype=np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.rank_of[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece when nothing merges any more."""
        left = np.array([len(p) for p in pieces], dtype=np.int64)
        live = np.flatnonzero(left > 1)
        size = left[live]
        sym = self.symbol[np.frombuffer(b"".join(pieces[i] for i in live), dtype=np.uint8)]
        last = np.cumsum(size) - 1
        rank = np.full(len(sym), NONE)
        if len(sym):
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[last] = NONE  # no pair reaches into the next sequence
        while len(live):
            best = np.minimum.reduceat(rank, last - size + 1)
            going = best < NONE
            if not going.all():
                left[live[~going]] = size[~going]
                stay = np.repeat(going, size)
                sym, rank, live, size, best = sym[stay], rank[stay], live[going], size[going], best[going]
                last = np.cumsum(size) - 1
                if not len(live):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, size))
            first = np.concatenate([[True], np.diff(chosen) != 1])  # in a run such as aaa only every second place merges
            run = np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
            at = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            in_seq = np.searchsorted(last, at)
            size = size - np.bincount(in_seq, minlength=len(size))
            sym, rank = sym[keep], rank[keep]
            last = np.cumsum(size) - 1
            at -= np.arange(len(at))  # each place moved left by the merges before it
            for p in (at, at[at > 0] - 1):  # pairs that begin at the new symbol or end with it
                nxt = np.minimum(p + 1, len(sym) - 1)
                rank[p] = self.ranks(sym[p], sym[nxt])
            rank[last] = NONE
        return left


LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point. UNKNOWN ones are new to this Python's table: there tables of Unicode may differ, and the library splits."""
    points = [cp for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000]
    every = "".join(map(chr, points))
    found = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found[[ord(c) for c in regex.findall(pattern, every)]] = kind
    found[[cp for cp in points if unicodedata.category(chr(cp)) == "Cn"]] = UNKNOWN
    return found


def token_starts(cp: np.ndarray, kind: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token; `hard` marks the first one of each part, over which nothing reaches.

    The pattern in arrays: runs of one class are tokens; of white space before something else the last character is split off, and
    if it is a blank it belongs to what follows; a contraction is an apostrophe that begins a token, with its letters.
    """
    begin = hard.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    tail = np.flatnonzero(space[:-1] & ~space[1:] & ~hard[1:])
    begin[tail] = True
    begin[tail[cp[tail] == 32] + 1] = False
    mark = np.flatnonzero((cp == 39) & begin)
    far = np.append(cp, [0, 0])
    wall = np.append(hard, [True, True])
    one, two = far[mark + 1], far[mark + 2]
    short = ~wall[mark + 1] & np.isin(one, [ord(c) for c in "stmd"])
    long = ~wall[mark + 1] & ~wall[mark + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    begin[mark[short | long] + 1] = False
    after = np.concatenate([mark[short] + 2, mark[long] + 3])
    begin[after[after < len(begin)]] = True
    return begin


class TokenCounter:
    """Counts tokens of texts as the library's encoding does, special strings inside texts included."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = {k: split.get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        flags = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if model["type"] != "BPE" or not plain or spec["normalizer"] or odd or flags:
            raise ValueError("only byte-level BPE with plain added tokens is known")
        self.merges = Merges(model["vocab"], model["merges"])
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.known: dict[str, int] = {}

    def _parts(self, text: str) -> Iterator[str]:
        """What lies between added tokens."""
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        total, waiting, letters = np.zeros(len(texts), dtype=np.int64), [], 0
        for i, text in enumerate(texts):
            for k, part in enumerate(self._parts(text) if self.special and self.special.search(text) else [text]):
                total[i] += k > 0
                at = 0
                while at < len(part):  # a long part is cut before white space, where a pre-token always ends
                    end = _CUT.search(part, at + BLOCK) if len(part) - at > BLOCK else None
                    to = end.start() if end else len(part)
                    waiting.append((i, part[at:to] if to - at < len(part) else part))
                    letters, at = letters + to - at, to
                    if letters >= BLOCK:
                        self._settle(waiting, total)
                        waiting, letters = [], 0
        self._settle(waiting, total)
        return total

    def _settle(self, waiting: list[tuple[int, str]], total: np.ndarray) -> None:
        if not waiting:
            return
        owner, parts = np.array([i for i, _ in waiting]), [p for _, p in waiting]
        data = "".join(parts).encode()
        cp = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum([0, *map(len, parts)])
        kind = _classes()[cp]
        if (kind == UNKNOWN).any():
            odd = [k for k, p in enumerate(parts) if not p.isascii() and (_classes()[np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)] == UNKNOWN).any()]
            for k in odd:
                words = [parts[k][a:b] for _, (a, b) in self.library.pre_tokenize_str(parts[k])]
                total[owner[k]] += sum(self._counts(words).tolist())
            odd = set(odd)
            return self._settle([w for k, w in enumerate(waiting) if k not in odd], total)
        hard = np.zeros(len(cp), dtype=bool)
        hard[first[:-1]] = True
        starts = np.flatnonzero(token_starts(cp, kind, hard))
        if len(data) == len(cp):
            at = starts
        else:
            width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
            at = (np.cumsum(width, dtype=np.int64) - width)[starts]
        offsets = np.append(at, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        n = self._counts(words.dictionary.to_pylist())[words.indices.to_numpy()]
        sums = np.append(0, np.cumsum(n))
        ends = sums[np.searchsorted(starts, first)]
        np.add.at(total, owner, np.diff(ends))

    def _counts(self, words: list[str]) -> np.ndarray:
        """The tokens of each pre-token; new ones are merged together, those not too long are kept."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list({w for w in words if w not in self.known})
        self.known.update(zip(new, self.merges.lengths([w.encode() for w in new]).tolist()))
        found = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        for w in new:
            if len(w) > CACHE_LETTERS:
                del self.known[w]
        return found


@functools.lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row's whole text, as the vocabulary file `path` encodes it.

    A null text counts as empty: no bytes, no tokens. Rows that share a doc_id or a text give one row each, a null doc_id
    stays null, other columns are ignored, an empty table gives no rows. A very long text is counted in blocks that end before
    white space; one pre-token without end is one array (some 60 bytes a byte of it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_string())
            sizes = pc.fill_null(pc.binary_length(texts), 0)
            counts = counter(path)([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes.cast(pa.int64()), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json; over_limit beyond 1,024."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), os.fspath(public_tokenizers.path("byte_bpe_50k.json")))
