"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last WINDOW bytes cuts a text wherever its low bits are zero, so the cuts
depend on nearby bytes alone and an insertion moves no cut beyond its own neighbourhood. Every chunk begins
a variable window: it and the chunks after it up to SURE words. Windows are matched by digest over the whole table, and
the first document of each digest is the source of its repeats. The windows of a document that share a source and a shift
make a candidate; its bytes and the source's are then compared, and equal stretches of WORDS words or more are
the passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop_table, materialise, table
from .textops import _word_byte, buffers, mix, prefix_hash, slices, span_hash

WINDOW, MASK_BITS, LEAST, LONGEST = 16, 4, 8, 2047
#: A passage has WORDS words or more; a window of SURE words or more lies inside it whatever its ends cut off.
WORDS, SURE = 50, 24
#: Without a cut for QUIET bytes, the places with the least hash of the last LOCAL bytes are cuts too (periodic text has no others).
QUIET, LOCAL = 256, 64
#: Where a stretch of repeated windows has several sources, each is compared this many bytes beyond its own windows first, and further in steps while bytes are equal.
REACH = 2048
#: Bytes compared beyond the chunks at both sides of a stretch of repeated windows: cuts near its ends may differ.
MARGIN = 128
U = np.uint64
_gear = (mix(np.arange(1, 257, dtype=np.uint64) * U(0x2545F4914F6CDD1D)) >> U(33)).astype(np.uint32)


def _joined(n: int, *places: np.ndarray) -> np.ndarray:
    """The distinct places (1 to n), ascending."""
    mark = np.zeros(n + 1, dtype=bool)
    for at in places:
        mark[at] = True
    return np.flatnonzero(mark)


def _spaced(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of places closer than LEAST to the one before, in chains, those LEAST or more after the last one kept."""
    if not len(at):
        return at
    of = np.searchsorted(offsets, at - 1, side="right")
    free = (np.diff(at, prepend=-LEAST) >= LEAST) | (np.diff(of, prepend=-1) != 0)
    keep = free.copy()
    begin = np.flatnonzero(free)
    until = np.append(begin[1:], len(at))
    long = until - begin > 2  # of two, the second is too close
    for s, e in zip(begin[long].tolist(), until[long].tolist()):
        chain = at[s:e].tolist()
        last = chain[0]
        for k, x in enumerate(chain):
            if x - last >= LEAST:
                keep[s + k], last = True, x
    return at[keep]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """End bytes of all chunks: content-defined cuts at character bounds, text ends, and every LONGEST bytes
    or less of a run without cuts."""
    h = _gear[data]
    span = 1
    while span < WINDOW:  # h[i] becomes the sum of gear values of the last 2 * span bytes, shifted by age
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    rolled = (h >> np.uint32(WINDOW - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1)
    whole = lambda at: at[(at - offsets[np.searchsorted(offsets, at - 1, side="right") - 1] >= WINDOW) & (at < len(data))]  # noqa: E731  no bytes of the text before
    begins = lambda at: at[(data[at] & 0xC0) != 0x80]
    at = begins(_spaced(whole(np.flatnonzero(rolled == 0) + 1), offsets))
    ends = _joined(len(data), at, offsets[1:][np.diff(offsets) > 0])
    gaps = np.diff(np.concatenate([[0], ends]))
    found, begin = [], set(offsets.tolist()) if (gaps > QUIET).any() else ()
    for e, g in zip(ends[gaps > QUIET].tolist(), gaps[gaps > QUIET].tolist()):
        part = h[e - g : e] & np.uint32(0xFFFF)
        if e - g in begin:
            part[: WINDOW - 1] = 0xFFFF  # sums that reach into the text before
        least = part
        span = 1
        while span < LOCAL:  # the least of the last 2 * span values
            least = np.minimum(least[span:], least[:-span])
            span *= 2
        found.append(np.flatnonzero(part[LOCAL - 1 :] == least) + (e - g + LOCAL))
    if found:
        more = whole(np.concatenate(found))
        ends = _joined(len(data), ends, begins(_spaced(more, offsets)))
    gaps = np.diff(np.concatenate([[0], ends]))
    if len(gaps) and gaps.max() > LONGEST:
        more = [np.arange(e - g + LONGEST - 3, e, LONGEST - 3) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST])]
        more = np.concatenate(more)
        back = more.copy()
        for _ in range(3):  # not inside a character
            back -= (data[back] & 0xC0) == 0x80
        ends = _joined(len(data), ends, back)
    return ends


def word_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inside = _word_byte[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[starts] = inside[starts]
    return begins


def chunk_windows(docs: DataFrame) -> DataFrame:
    """doc_id, other, digest, place, span of every window of every whole text (doc_id, other, text). place packs the start
    byte (31 bits), the size of its first chunk (11) and whether an earlier window of the text has the same digest
    (1); span the window's size (31) and the sizes of the chunks before and after it (11 and 11)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = buffers(batch.column("text"))
            if not len(data):
                continue
            ends = cuts(data, offsets)
            starts = np.concatenate([[0], ends[:-1]])
            of = np.searchsorted(offsets, starts, side="right") - 1
            count = np.concatenate([[0], np.cumsum(word_begins(data, offsets))])
            size = ends - starts
            last = np.searchsorted(count[ends], count[starts] + SURE, side="left")
            first = np.flatnonzero(last < len(ends))
            first = first[of[last[first]] == of[first]]
            if not len(first):
                continue
            last = last[first]
            digest = span_hash(data, starts[first], ends[last], prefix_hash(data))
            before = np.where((first > 0) & (of[first] == of[first - 1]), size[first - 1], 0)
            after = np.append(size, 0)[last + 1] * (np.append(of, -1)[last + 1] == of[first])
            order = np.lexsort((first, digest, of[first]))
            same = (np.diff(digest[order]) == 0) & (np.diff(of[first][order]) == 0)
            again = np.zeros(len(first), dtype=np.int64)
            again[order[1:][same]] = 1
            place = ((starts - offsets[of])[first] << 12) | (size[first] << 1) | again
            span = ((ends[last] - starts[first]) << 22) | (before << 11) | after
            take = pa.array(of[first])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("other").take(take), pa.array(digest.view(np.int64)), pa.array(place), pa.array(span)], names=["doc_id", "other", "digest", "place", "span"])

    return docs.select("doc_id", "other", "text").mapInArrow(run, "doc_id long, other long, digest long, place long, span long")


def _spans(column: pa.Array, lead: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of byte strings with `lead` bytes before and at most one after the inner part of `size` bytes: all bytes, where each
    inner part begins, how long it is, and whether the bytes next to it belong to words (2 x rows)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin, end = offsets[:-1] + lead, offsets[1:]
    have = np.minimum(size, np.maximum(end - begin, 0))
    word = np.append(_word_byte[data], False)
    edges = np.stack([(lead > 0) & word[offsets[:-1]], (end > begin + size) & word[np.minimum(begin + size, len(data))]])
    return data, begin, have, edges


def _stretches(batch: pa.RecordBatch, words: int) -> pa.RecordBatch:
    lo, hi, from_b = (batch.column(c).to_numpy() for c in ("lo", "hi", "from_b"))
    x_all, x_at, x_has, x_edge = _spans(batch.column("a"), np.minimum(lo, 1), hi - lo)
    y_all, y_at, y_has, y_edge = _spans(batch.column("b"), np.minimum(from_b, 1), hi - lo)
    n = np.minimum(x_has, y_has)
    some = np.flatnonzero(n > 0)
    size, row_at = n[some], np.cumsum(n[some]) - n[some]
    step = np.arange(size.sum()) - np.repeat(row_at, size)
    x, y = x_all[np.repeat(x_at[some], size) + step], y_all[np.repeat(y_at[some], size) + step]
    row_end = row_at + size - 1
    # Of each side: whether the byte before and after a place belongs to a word; the sides have one byte more.
    mine, theirs = _word_byte[x], _word_byte[y]
    around = []
    for side, edge, data, at, has in ((mine, x_edge, x_all, x_at, x_has), (theirs, y_edge, y_all, y_at, y_has)):
        before, after = np.append(False, side[:-1]), np.append(side[1:], False)
        before[row_at] = edge[0][some]
        more = has[some] > size  # the other side ends first
        after[row_end] = np.where(more, _word_byte[data[np.minimum(at[some] + size, len(data) - 1)]], edge[1][some])
        around.append((before, after))
    begins, finish = np.flatnonzero(mine & ~around[0][0]), np.flatnonzero(mine & ~around[0][1]) + 1
    same = x == y
    first, last = same.copy(), same.copy()
    first[1:] &= ~same[:-1]
    first[row_at] = same[row_at]
    last[:-1] &= ~same[1:]
    last[row_end] = same[row_end]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = e - s >= 2 * words - 1
    s, e = s[keep], e[keep]
    p, q = np.searchsorted(begins, s), np.searchsorted(finish, e, side="right") - 1
    # A word that is part of a longer one in the source does not count.
    p = p + ((p < len(begins)) & (np.append(begins, -1)[p] == s) & around[1][0][s])
    q = q - ((q >= 0) & (np.append(finish, -1)[q] == e) & around[1][1][e - 1])
    good = (p < len(begins)) & (q >= 0)
    s, p, q = s[good], p[good], q[good]
    n_words = np.searchsorted(begins, finish[q]) - p
    good = n_words >= words
    s, p, q, n_words = s[good], p[good], q[good], n_words[good]
    k = np.searchsorted(row_at, s, side="right") - 1
    take = pa.array(some[k])
    found = [lo[some[k]] + begins[p] - row_at[k], finish[q] - begins[p], n_words]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in _PAIR), *(pa.array(v.astype(np.int64)) for v in found)], names=[*_PAIR, "start", "n_bytes", "n_words"])


#: What names a compared pair and its bounds.
_PAIR = ["doc_id", "other", "first_doc_id", "src_other", "lo", "hi", "from_b", "run_lo", "run_hi"]


def equal_stretches(pairs: DataFrame, words: int) -> DataFrame:
    """_PAIR, start, n_bytes, n_words of every stretch of whole words, `words` or more, in which the
    bytes lo to hi of a text equal those of its source from from_b on; `a` and `b` hold them and the bytes next to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a"):
            yield _stretches(batch, words)

    return pairs.select(*_PAIR, "a", "b").mapInArrow(run, ", ".join(f"{c} long" for c in [*_PAIR, "start", "n_bytes", "n_words"]))


def _told_apart(docs: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """doc_id, other, text of the rows with a doc_id, their key, and the columns that make it. `other` tells texts that share a
    doc_id apart; where no doc_id is repeated it is 0 and the key is the doc_id."""
    some = docs.filter("doc_id is not null")
    if some.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return some.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("other"), "text"), F.struct("doc_id", "other"), ["doc_id", "other"]
    return some.select("doc_id", F.lit(0).cast("long").alias("other"), "text"), F.col("doc_id"), ["doc_id"]


def _verified(docs: DataFrame, words: int) -> DataFrame:
    rows, key, parts = _told_apart(docs)
    part = lambda k, name: (F.col(k) if len(parts) == 1 else F.col(f"{k}.{name}")) if name in parts else F.lit(0).cast("long")
    p, s = F.col("place"), F.col("span")
    windows = chunk_windows(rows).select(key.alias("key"), "digest", "place", "span")
    firsts = windows.filter(p.bitwiseAND(F.lit(1)) == 0).groupBy("digest").agg(F.min("key").alias("src"), F.min_by(F.shiftright(p, 12), "key").alias("src_start"), F.max("key").alias("last"))
    # Written, so that the join has a plain exchange on both sides and a very common window's rows can be split.
    firsts = materialise(firsts.filter("last > src").select("digest", "src", "src_start"), "window-firsts")
    again = windows.join(firsts, "digest").filter("key > src").select(
        "key", "src", "digest", F.shiftright(p, 12).alias("start"), F.shiftright(p, 1).bitwiseAND(F.lit(2047)).alias("chunk"), "src_start",
        F.shiftright(s, 22).alias("size"), F.shiftright(s, 11).bitwiseAND(F.lit(2047)).alias("before"), s.bitwiseAND(F.lit(2047)).alias("after"),
    )
    by = Window.partitionBy("key").orderBy("start")
    again = again.withColumn("_same", F.lag("start").over(by) == F.col("start")).filter("_same is null or not _same")  # repeated rows
    fresh = F.when(F.lag(F.col("start") + F.col("chunk")).over(by) == F.col("start"), 0).otherwise(1)
    runs = again.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    edges = Window.partitionBy("key", "run")
    end = F.col("start") + F.col("size")
    runs = runs.withColumn("run_lo", F.min(F.col("start") - F.col("before") - MARGIN).over(edges)).withColumn("run_hi", F.max(end + F.col("after") + MARGIN).over(edges))
    # A window makes a candidate once in a run: later copies have their own, periods inside a run do not.
    once = F.row_number().over(Window.partitionBy("key", "run", "digest").orderBy("start"))
    wanted = runs.withColumn("_once", once).filter("_once = 1").withColumn("shift", F.col("start") - F.col("src_start")).groupBy("key", "run", "src", "shift").agg(
        F.min("start").alias("lo"), F.max(end).alias("hi"), F.min("run_lo").alias("run_lo"), F.max("run_hi").alias("run_hi"),
    )
    many = F.count(F.lit(1)).over(edges) > 1
    first = F.greatest(F.lit(0), "shift", "run_lo")
    wanted = wanted.withColumn("far", many).withColumn("run_lo", first).select(
        "key", "src", "shift", "run_lo", "run_hi", F.when(F.col("far"), F.greatest("run_lo", F.col("lo") - REACH)).otherwise(F.col("run_lo")).alias("lo"),
        F.when(F.col("far"), F.least("run_hi", F.col("hi") + REACH)).otherwise(F.col("run_hi")).alias("hi"),
    )
    wanted = materialise(wanted, "stretches-wanted")
    drop_table(firsts)
    found, near = None, REACH // 2
    while True:
        new = materialise(_compared(rows, key, part, wanted, words), "stretches")
        found = new if found is None else found.unionByName(new)
        # Equal bytes up to a bound that is not the run's own: compare on, eight times as far.
        on = ((F.col("start") <= F.col("lo") + near) & (F.col("lo") > F.col("run_lo"))) | ((F.col("start") + F.col("n_bytes") >= F.col("hi") - near) & (F.col("hi") < F.col("run_hi")))
        step = (F.col("hi") - F.col("lo")) * 4
        named = lambda doc, other: F.col(doc) if len(parts) == 1 else F.struct(F.col(doc).alias("doc_id"), F.col(other).alias("other"))
        more = new.filter(on).select(
            named("doc_id", "other").alias("key"), named("first_doc_id", "src_other").alias("src"), (F.col("lo") - F.col("from_b")).alias("shift"), "run_lo", "run_hi",
            F.greatest("run_lo", F.col("lo") - step).alias("lo"), F.least("run_hi", F.col("hi") + step).alias("hi"),
        )
        if more.isEmpty():
            break
        wanted = materialise(more.distinct(), "stretches-wanted")
    found = found.select("doc_id", "other", "first_doc_id", "start", "n_bytes", "n_words").distinct()
    order = Window.partitionBy("doc_id", "other").orderBy("start", -F.col("n_bytes"), "first_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_reached", F.max(F.col("start") + F.col("n_bytes")).over(order)).filter(F.col("_reached").isNull() | (F.col("_reached") < F.col("start") + F.col("n_bytes"))).drop("_reached")
    return found


def _compared(rows: DataFrame, key: Column, part, wanted: DataFrame, words: int) -> DataFrame:
    """The equal stretches of every wanted pair (key, src, shift, run_lo, run_hi, lo, hi); both sides' bytes are cut out of their texts and meet."""
    same = ["key", "src", "shift", "run_lo", "run_hi", "lo", "hi"]
    size = F.col("hi") - F.col("lo")
    before = lambda c: F.least(c, F.lit(1))  # noqa: E731  the byte before, where there is one
    side = lambda k, at, c: wanted.select(*same, F.lit(k).alias("side"), F.col(at).alias("at"), (c - before(c)).alias("from"), (size + before(c) + 1).alias("size"))
    sides = side(0, "key", F.col("lo")).unionByName(side(1, "src", F.col("lo") - F.col("shift")))
    cut = F.substring(F.col("text").cast("binary"), (F.col("from") + 1).cast("int"), F.col("size").cast("int"))
    spans = materialise(rows.select(key.alias("at"), "text").join(sides, "at").select(*same, "side", cut.alias("bytes")), "spans")
    pairs = spans.filter("side = 0").withColumnRenamed("bytes", "a").join(spans.filter("side = 1").withColumnRenamed("bytes", "b"), same)
    pairs = pairs.select(part("key", "doc_id").alias("doc_id"), part("key", "other").alias("other"), part("src", "doc_id").alias("first_doc_id"), part("src", "other").alias("src_other"), "lo", "hi", (F.col("lo") - F.col("shift")).alias("from_b"), "run_lo", "run_hi", "a", "b")
    return equal_stretches(pairs, words)


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, start, n_bytes, n_words, first_doc_id: the stretches of `words` words and more that a document has in
    common, byte by byte, with the first document that has one of their windows. start and n_bytes are UTF-8 bytes and cover whole words.

    Documents are ordered by doc_id; texts that share a doc_id are told apart and ordered by their hash (first_doc_id can then be the own
    doc_id); repeated rows with the same doc_id and text count as one. A stretch inside another one of its document
    is left out; equally long ones name the smallest source. Rows with a null doc_id are left out; null and empty texts, and those of fewer
    than SURE words, have no windows; a very long text is one row of a batch of its own; an empty table gives no rows. Other columns are not read.
    """
    return _verified(docs, words).select("doc_id", "start", "n_bytes", "n_words", "first_doc_id")


def op7_gear_chunks(spark, sf_dir: str) -> DataFrame:
    """The repeated passages of all `documents`, as repeated_passages gives them."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def drop_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every repeated passage is cut from all documents but the first that has it; a document
    of which nothing is left goes. n_chars follows the text. Rows with a null doc_id or text, empty ones and those without a
    passage stay as they are; texts that share a doc_id are cut by their own passages; an empty table stays empty; further
    columns are kept, also if they are called like a helper column here."""
    found = materialise(_verified(docs, WORDS), "passages")
    spans = found.groupBy(F.col("doc_id").alias("__doc"), F.col("other").alias("__other")).agg(F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias("__spans"))
    apart = found.filter("other != 0").limit(1).count() > 0
    key = F.xxhash64(F.coalesce("d.text", F.lit(""))) if apart else F.lit(0).cast("long")
    joined = docs.alias("d").join(spans.alias("s"), (F.col("d.doc_id") == F.col("s.__doc")) & (F.col("s.__other") == key), "left")
    spans, whole = F.col("s.__spans"), F.col("s.__spans").isNull()
    text = F.col("d.text").cast("binary")
    # No stretch is inside another, so ends ascend with starts; one may begin inside the one before.
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["start"] + s["n_bytes"]))
    begins = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length("d.text").cast("bigint")))
    kept = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda x: F.substring(text, (x["a"] + 1).cast("int"), F.greatest(F.lit(0), x["b"] - x["a"]).cast("int")).cast("string")), "")
    new = {"text": F.when(whole, F.col("d.text")).otherwise(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("d.n_chars")).otherwise(F.char_length(kept).cast("long"))
    return joined.filter(whole | (F.trim(kept) != "")).select(*[new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns])


__all__ = ["cuts", "chunk_windows", "equal_stretches", "repeated_passages", "op7_gear_chunks", "drop_repeats"]
