"""Prefix trie of rebuilt conversations as a burst trie.

A conversation is the sequence of its turns' ids (128 bits of a SHA-256 each); equal sequences are counted together first. All
sequences begin in one container under the root. A container of too many suffixes or turns bursts: its head moves on over
the turns that all its suffixes share to where they fork, and the suffixes go by their next turn id into containers under
new heads. A round of joins bursts all oversized containers at once, rows of the others rest. What is left is small, is sorted and
swept into nodes in tasks, and the totals of burst heads come from those of their containers, deepest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .repair import _batches, _rows
from .store import materialise, table

#: Letters of a turn's id; a container bursts beyond so many suffixes, or so many turns of more than one suffix.
WIDTH, SUFFIXES, TURNS = 32, 256, 1 << 16
#: Conversation ids so close go into one block of a digest's input.
BLOCK_IDS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids (one text) and words of each turn's text in order of turn, nulls first, then role and id of the turn.

    Null roles and texts are empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256), 1, WIDTH)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("id"), words.alias("words")).alias("at"))
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return found.select("conv_id", F.array_join("at.id", "").alias("ids"), F.col("at.words").alias("words"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation begun with the first turns of the conversation at the last multiple of 20, and continued with its own."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    heads = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.substring("ids", 1, 3 * WIDTH).alias("base_ids"), F.slice("words", 1, 3).alias("base_words"))
    rows = own.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % 20}).join(heads, F.col("of") == F.col("base"), "left")
    ids = F.concat(F.coalesce(F.substring("base_ids", F.lit(1), F.col("h") * WIDTH), F.lit("")), F.substring("ids", F.col("h") * WIDTH + 1, F.lit(2**31 - 1)))
    words = F.concat(F.coalesce(F.slice("base_words", F.lit(1), F.col("h")), F.array().cast("array<int>")), F.slice("words", F.col("h") + 1, F.size("words")))
    return rows.select("conv_id", ids.alias("ids"), words.alias("words"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """ids, words, n (conversations of this sequence), smallest (conv_id) and ends (SHA-256 of their ids, joined in order).

    Ids are joined to blocks of neighbouring numbers first and a digest reads blocks as a stream, so a sequence may have any number of conversations.
    """
    blocks = convs.withColumns({"same": F.sha2("ids", 256), "block": F.floor(F.col("conv_id") / BLOCK_IDS)})
    blocks = blocks.groupBy("same", "block").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("smallest"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("named"), F.first("ids").alias("ids"), F.first("words").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, group in groupby(_rows(batches), itemgetter(0)):
                digest, total, begun = hashlib.sha256(), 0, None
                for _, _, n, smallest, named, ids, words in group:
                    begun, first = (begun, "," + named) if begun else ((smallest, ids, words), named)
                    digest.update(first.encode())
                    total += n
                yield begun[1], begun[2], total, begun[0], digest.hexdigest()

        yield from _batches(rows(), "ids string, words array<int>, n long, smallest long, ends string", 256)

    order = ["same", "block", "n", "smallest", "named", "ids", "words"]
    return blocks.select(*order).repartition("same").sortWithinPartitions("same", "block").mapInArrow(run, "ids string, words array<int>, n long, smallest long, ends string")


def _shared(a: str, b: str, at: int = 0) -> int:
    """Turns that two sequences share, at least `at`."""
    most = min(len(a), len(b)) // WIDTH
    while at < most and a[at * WIDTH : (at + 1) * WIDTH] == b[at * WIDTH : (at + 1) * WIDTH]:
        at += 1
    return at


def _key(depth: Column | int) -> Column:
    """The head of the sequence's container at a depth."""
    return F.sha2(F.substring("ids", F.lit(1), depth * WIDTH if isinstance(depth, Column) else F.lit(depth * WIDTH)), 256)


_BIG = "key string, level int, depth int, parent string, parent_conv long, n long, smallest long, words array<int>, fork int"


def _oversized(rows: DataFrame, suffixes: int, turns: int) -> DataFrame:
    """Containers to burst: totals, the words up to the fork, and its depth."""
    many = rows.groupBy("key").agg(
        F.count("*").alias("many"), F.sum(F.length("ids") / WIDTH - F.col("depth")).alias("turns"), F.min("ids").alias("low"), F.max("ids").alias("high"), F.sum("n").alias("n"), F.min("smallest").alias("smallest"),
        F.min_by("words", "ids").alias("words"), *(F.first(c).alias(c) for c in ("level", "depth", "parent", "parent_conv")))
    many = many.filter((F.col("many") > suffixes) | ((F.col("many") > 1) & (F.col("turns") > turns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for *row, words, low, high in _rows(batches):
                fork = _shared(low, high, row[2])
                yield *row, words[:fork], fork

        yield from _batches(found(), _BIG, 16)

    return many.select("key", "level", "depth", "parent", "parent_conv", "n", "smallest", "words", "low", "high").mapInArrow(run, _BIG)


class _Node:
    __slots__ = ("depth", "parent", "n", "smallest", "children", "leaves", "saved", "words", "ends")

    def __init__(self, depth: int, parent: _Node | None, words: int, smallest: int):
        self.depth, self.parent, self.words, self.smallest = depth, parent, words, smallest
        self.n = self.children = self.leaves = self.saved = 0
        self.ends = NOTHING

    def close(self) -> None:
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words
        if up := self.parent:
            up.n += self.n
            up.smallest = min(up.smallest, self.smallest)
            up.children += 1
            up.leaves += self.leaves
            up.saved += self.saved


def sweep(head: int, sequences: Iterable[tuple[str, list[int], int, int, str]]) -> Iterator[_Node]:
    """Nodes from depth `head` on of sorted (ids, words, n, smallest, ends) sequences that share their first `head` turns. The first one is the head."""
    nodes, path, before = [], [], None
    for ids, words, n, smallest, ends in sequences:
        keep = head - 1 if before is None else _shared(before, ids, head)
        while path and path[-1].depth > keep:
            path.pop().close()
        for depth in range(keep + 1, len(words) + 1):
            path.append(_Node(depth, path[-1] if path else None, words[depth - 1] if depth else 0, smallest))
            nodes.append(path[-1])
        path[-1].n, path[-1].ends, path[-1].smallest = n, ends, min(smallest, path[-1].smallest)
        before = ids
    while path:
        path.pop().close()
    return iter(nodes)


_SWEPT = f"{NODE}, parent string, level int"


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers; the heads name the burst head above them and its level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, group in groupby(_rows(batches), itemgetter(0)):
                first = next(group)
                _, level, depth, parent, parent_conv = first[:5]
                for node in sweep(depth, (r[5:] for r in (first, *group))):
                    top = node.depth == depth
                    up = parent_conv if top else node.parent.smallest
                    yield node.smallest, node.depth, up, node.n, node.children, node.leaves, node.saved, node.ends, parent if top else None, level if top else None

        yield from _batches(found(), _SWEPT)

    order = ["key", "level", "depth", "parent", "parent_conv", "ids", "words", "n", "smallest", "ends"]
    return rows.select(*order).repartition("key").sortWithinPartitions("key", "ids").mapInArrow(run, _SWEPT)


def _heads(big: DataFrame, ends: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of burst heads, from each container's head to its fork, out of the totals `below` and the sequences that end at a fork."""
    sums = below.groupBy("parent").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("parent", "of")
    rows = big.join(sums, F.col("key") == F.col("of")).join(ends.select(F.col("key").alias("at"), "ends"), F.col("key") == F.col("at"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for parent, level, depth, parent_conv, n, smallest, words, fork, kids, leaves, saved, ended in _rows(batches):
                for at in range(fork, depth - 1, -1):
                    saved += (n - 1) * (words[at - 1] if at else 0)
                    top = at == depth
                    yield smallest, at, parent_conv if top else smallest, n, kids if at == fork else 1, leaves, saved, ended if at == fork and ended else NOTHING, parent if top else None, level if top else None

        yield from _batches(found(), _SWEPT)

    return rows.select("parent", "level", "depth", "parent_conv", "n", "smallest", "words", "fork", "kids", "leaves", "saved", "ends").mapInArrow(run, _SWEPT)


def trie(sequences: DataFrame, suffixes: int = SUFFIXES, turns: int = TURNS) -> DataFrame:
    """One row per distinct prefix of `sequences` (ids, words, n, smallest, ends; each ids once).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Containers are bounded by `suffixes` and
    `turns`, so a first turn or a long beginning that most conversations share is no larger task; rounds follow the forks,
    not the turns. No sequences: no nodes, not even a root. An empty sequence ends at the root.
    """
    sequences = materialise(sequences, "trie-sequences")
    state = sequences.withColumns({"key": _key(0), "level": F.lit(0), "depth": F.lit(0), "parent": F.lit(None).cast("string"), "parent_conv": F.lit(None).cast("long")})
    rest, rounds = [], []
    while True:
        big = materialise(_oversized(state, suffixes, turns), "trie-heads")
        one = big.head(1)
        if not one:
            rest.append(state)
            break
        burst = F.struct("key", "fork", "smallest").alias("burst")
        if not rounds:  # the root's container is all there is
            own = state.withColumn("burst", F.struct(F.lit(one[0].key).alias("key"), F.lit(one[0].fork).alias("fork"), F.lit(one[0].smallest).alias("smallest")))
        else:
            own = materialise(state.join(big.select(F.col("key").alias("of"), burst), F.col("key") == F.col("of"), "left").drop("of"), "trie-rows")
            rest.append(own.filter("burst is null").drop("burst"))
        fork = F.col("burst.fork")
        ended = own.filter(F.length("ids") == fork * WIDTH).select("key", "ends")
        rounds.append((big, ended))
        on = own.filter(F.length("ids") > fork * WIDTH).withColumns({"parent": F.col("burst.key"), "parent_conv": F.col("burst.smallest")})
        state = on.withColumns({"depth": fork + 1, "level": F.lit(len(rounds)), "key": _key(fork + 1)}).drop("burst")
    found = materialise(_swept(reduce(DataFrame.unionByName, rest)), "trie-nodes")
    parts, above = [found], None
    for level in range(len(rounds), 0, -1):
        below = found.filter(F.col("level") == level)
        below = below if above is None else below.unionByName(above.filter(F.col("level") == level))
        above = materialise(_heads(*rounds[level - 1], below), "trie-burst")
        parts.append(above)
    return reduce(DataFrame.unionByName, parts).drop("parent", "level")


def conversation_trie(conversations: DataFrame, suffixes: int = SUFFIXES, turns: int = TURNS) -> DataFrame:
    """The trie of all rebuilt conversations of (conv_id, turn, role, text) rows.

    Rows of one turn go by role, then by the turn's id; repeated rows are turns of their own. Null roles and texts count as empty; a null turn
    comes first; rows without conv_id belong to no conversation. Very long texts are hashed and counted where they are read. A conversation is
    one row of ids (some 100 bytes a turn while it is sorted). Extra columns are ignored; an empty table has no nodes.
    """
    own = materialise(turn_sequences(conversations), "trie-turns")
    return trie(distinct_sequences(rebuilt(own)), suffixes, turns)


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the burst trie over all conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))
