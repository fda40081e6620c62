"""Benchmark decontamination by template windows.

Texts become token templates: numbers, units after a number, and names (title-case words inside a
sentence) are typed placeholders, other words stand lower-cased. Windows of WIDTH template tokens of
documents and benchmark items meet in a hash join. Along each alignment of a document with an
item the placeholders' values must map consistently and names one to one, so a question with other numbers or names is
found and text that merely has the same frame is not. Windows with the item's own values count whatever the rest of
the alignment does. Windows over the values themselves stand in where an
item has no template window, and at its first token, whose kind depends on the text before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, table
from .textops import MIX2, _word_byte, buffers, mix, slices, span_hash

WIDTH, LITERALS, WINDOWS, SHARE = 8, 4, 6, 0.5
SHORTEST = 5
#: Window hashes that tasks may hold as a filter before the join (16 MB); beyond it all windows are joined.
FILTER_MOST = 2_000_000
U = np.uint64
NUMBER, UNIT, NAME = 1, 2, 3
#: Words that are units when they follow a number (fixed values).
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes l ml cl liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "kmh mph kph percent pct dollar dollars cent cents euro euros usd eur gbp degree degrees c f k w kw v a hz khz mhz ghz b kb mb gb tb bytes"
).split()


def _hash_of(words: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(words))
    return span_hash(data, offsets[:-1], offsets[1:])


class Templates:
    """Template tokens of a batch: hash of the template, of the value, kind, text number, first byte."""

    def __init__(self, texts: pa.Array):
        data, offsets = buffers(texts)
        n = len(data)
        self.n_texts = len(offsets) - 1
        digit = (data >= 48) & (data <= 57)
        inside = _word_byte[data]
        point = np.zeros(n, dtype=bool)
        if n > 2:
            point[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        bounds = offsets[(offsets > 0) & (offsets < n)]
        point[bounds] = False
        point[bounds - 1] = False
        kind = np.where(digit | point, 2, np.where(inside, 1, 0)).astype(np.int8)
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[offsets] = True
        cut = np.flatnonzero(edge)
        keep = kind[cut[:-1]] > 0
        start, end = cut[:-1][keep], cut[1:][keep]
        self.of = np.searchsorted(offsets, start, side="right") - 1
        before = np.empty(n, dtype=np.uint8)
        if n:
            before[0], before[1:] = 0, data[:-1]
        upper = ((data >= 65) & (data <= 90)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
        self.value = span_hash(data + upper * np.uint8(32), start, end)
        capitals = np.concatenate([[0], np.cumsum(upper)])
        first = upper[start] | ((data[start] == 0xC3) & upper[np.minimum(start + 1, n - 1)]) if n else np.zeros(0, bool)
        title = first & (capitals[end] - capitals[start] == 1) & (end - start > 1)
        stops = np.concatenate([[0], np.cumsum(np.isin(data, (10, 13, 33, 46, 58, 59, 63)))])
        gap_from = np.concatenate([[0], end[:-1]]) if len(end) else end
        opens = np.ones(len(start), dtype=bool)
        opens[1:] = (self.of[1:] != self.of[:-1]) | (stops[start[1:]] > stops[gap_from[1:]])
        number = kind[start] == 2
        after_number = np.zeros(len(start), dtype=bool)
        after_number[1:] = number[:-1] & (self.of[1:] == self.of[:-1])
        self.kind = np.where(number, NUMBER, np.where(after_number & np.isin(self.value, _hash_of(UNITS)), UNIT, np.where(title & ~opens, NAME, 0))).astype(np.int8)
        marks = mix(np.arange(4, dtype=np.uint64) * MIX2 + U(77))
        self.token = np.where(self.kind > 0, marks[self.kind], self.value)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first token, width and literal (False) of an item's windows with LITERALS plain words; a text of
        SHORTEST to WIDTH tokens has one of its own width, with all but three tokens plain. A text without such a
        window has all its windows over values (literal) instead, others have one at the first token if it has a window."""
        n, first = len(self.token), np.searchsorted(self.of, np.arange(self.n_texts + 1))
        every = [(np.arange(max(0, n - WIDTH + 1)), WIDTH, LITERALS)]
        size = np.diff(first)
        for width in range(SHORTEST, WIDTH):
            every.append((first[:-1][size == width], width, width - 3))
        found = [self._run(*x) for x in every]
        some = np.zeros(self.n_texts, dtype=bool)
        opening = np.zeros(n + 1, dtype=bool)
        for _, at, _, _ in found:
            some[self.of[at]] = True
            opening[at[at == first[self.of[at]]]] = True
        for at, width, _ in every:
            found.append(self._run(at[~some[self.of[at]] | opening[at]], width, 0, True))
        return tuple(np.concatenate(x) for x in zip(*found))

    def windows_of(self, shapes: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As `windows`: every window of the text that has one of the shapes (width, literal)."""
        n = len(self.token)
        none = np.zeros(0, np.int64)
        found = [(none.astype(np.uint64), none, none, none.astype(bool))]
        for width, literal in shapes:
            least = 0 if literal else LITERALS if width == WIDTH else width - 3
            found.append(self._run(np.arange(max(0, n - width + 1)), width, least, literal))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _run(self, at: np.ndarray, width: int, literals: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = at[self.of[at] == self.of[at + width - 1]] if len(at) else at
        plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        at = at[plain[at + width] - plain[at] >= literals]
        token = self.value if literal else self.token
        total = np.full(len(at), U(width + 1000 * literal), dtype=np.uint64)
        keys = mix(np.arange(1, width + 1, dtype=np.uint64) * U(0x51ED270B7F3A9C25)) | U(1)
        for j in range(width):
            total += token[at + j] * keys[j]
        return mix(total), at, np.full(len(at), width), np.full(len(at), literal)


WINDOW_SCHEMA = "id long, hash long, at int, width int, literal boolean, tokens int, slots array<long>, kinds array<int>"


def template_windows(df: DataFrame, key: str, only: np.ndarray | None = None, shapes: list[tuple[int, bool]] | None = None) -> DataFrame:
    """Every window of every whole text of `df` (an item's, or a document's of `shapes`), or those whose hash is among
    `only` (sorted): id, hash, at (token number), width, literal, tokens of the text, and the value and kind of each
    token (kind 0: plain, and all of a literal window)."""
    names = [x.split()[0] for x in WINDOW_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if only is not None:
            sieve = np.zeros(1 << 22, dtype=bool)
            sieve[(only >> U(42)).astype(np.int64)] = True
        for batch in slices(batches):
            t = Templates(batch.column("text"))
            h, at, width, literal = t.windows() if shapes is None else t.windows_of(shapes)
            if only is not None:
                hit = np.flatnonzero(sieve[(h >> U(42)).astype(np.int64)])
                hit = hit[only[np.minimum(np.searchsorted(only, h[hit]), len(only) - 1)] == h[hit]] if len(only) else hit[:0]
                h, at, width, literal = h[hit], at[hit], width[hit], literal[hit]
            ids = batch.column("id").to_pylist()
            first = np.searchsorted(t.of, np.arange(t.n_texts + 1))
            size = np.diff(first)
            for begin in range(0, len(h), 20_000):
                part = slice(begin, begin + 20_000)
                own = t.of[at[part]]
                slots = [t.value[a : a + w].view(np.int64) for a, w in zip(at[part], width[part])]
                kinds = [t.kind[a : a + w].astype(np.int32) * (not x) for a, w, x in zip(at[part], width[part], literal[part])]
                cols = [pa.array([ids[i] for i in own], pa.int64()), pa.array(h[part].view(np.int64)), pa.array((at[part] - first[own]).astype(np.int32)), pa.array(width[part].astype(np.int32)), pa.array(literal[part]), pa.array(size[own].astype(np.int32)), pa.array(slots, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(F.col(key).alias("id"), "text").mapInArrow(run, WINDOW_SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, filter_most: int = FILTER_MOST) -> DataFrame:
    """doc_id, item_id, windows (different windows of the item found), of_windows (its different ones), share, kind.

    A number or unit of the item stands for the value it most often has along an alignment; windows with another one
    are left out. Two numbers may get one value. Names must map one to one along the whole alignment; else
    only its windows whose values are the item's, or that have no placeholders, count, and to SHARE alone. A pair is reported if
    alignments hold at least WINDOWS windows of the item, or SHARE of them, or all of a shorter item's. kind is `exact` if all placeholder values agree and
    `reparameterised` otherwise. Null and empty texts, texts and items under SHORTEST tokens match
    nothing. Rows that share a doc_id count as one document. Of equally frequent values the item's own counts, then the greatest hash. A very long
    text is one row of a batch of its own, all of its windows are compared. Empty tables give no rows. Other columns are not read.
    """
    # A window that an item repeats counts once, at its first place: else a repetitive item meets a repetitive
    # document in the product of their lengths.
    first = F.min(F.struct("at", "slots", "kinds")).alias("f")
    items = template_windows(benchmark, "item_id").groupBy("id", "hash", "width", "literal").agg(first).select("id", "hash", "width", "literal", "f.*")
    items = materialise(items, "item-windows")
    hashes = items.select("hash").distinct()
    only = None
    if hashes.count() <= filter_most:
        only = np.sort(hashes.toArrow()["hash"].to_numpy().astype(np.int64).view(np.uint64))
    shapes = sorted((r["width"], r["literal"]) for r in items.select("width", "literal").distinct().collect())
    found = template_windows(docs, "doc_id", only, shapes)
    sizes = items.groupBy("id").agg(F.count_distinct("at").alias("of_windows"))
    left = items.select(F.col("id").alias("item_id"), "hash", "width", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("kinds").alias("item_kinds"))
    met = found.select(F.col("id").alias("doc_id"), "hash", "width", F.col("at").alias("doc_at"), "slots").join(left, ["hash", "width"])
    values = F.filter(F.arrays_zip("item_kinds", "item_slots", "slots"), lambda x: x["item_kinds"] > 0)
    met = met.select("doc_id", "item_id", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift"), values.alias("values"))
    met = materialise(met, "template-matches")  # read three times below
    # A placeholder of kind k with the item's value i stands for the document's value d.
    key = ["doc_id", "item_id", "shift"]
    pairs = met.select(*key, F.explode("values").alias("v")).select(*key, F.col("v.item_kinds").alias("k"), F.col("v.item_slots").alias("i"), F.col("v.slots").alias("d"))
    counted = pairs.groupBy(*key, "k", "i", "d").agg(F.count(F.lit(1)).alias("n"))
    # Of each value of the item the document's most frequent one (its own of equals) and the others.
    to = F.struct("n", (F.col("i") == F.col("d")).alias("own"), "d")
    values_of = counted.groupBy(*key, "k", "i").agg(F.max(to)["d"].alias("d"), F.collect_list("d").alias("all"))
    names = F.when(F.col("k") == NAME, F.col("d"))
    mapping = values_of.groupBy(key).agg(
        F.count(names).alias("names"), F.count_distinct(names).alias("tos"), F.max(F.when(F.col("k") == NAME, F.size("all"))).alias("most"),
        F.min(((F.col("i") == F.col("d")) & (F.size("all") == 1)).cast("int")).alias("same"),
        F.flatten(F.collect_list(F.transform(F.array_remove("all", F.col("d")), lambda d: F.struct(F.col("k").alias("k"), F.col("i").alias("i"), d.alias("d"))))).alias("odd"),
    )
    mapping = mapping.select(*[F.col(c).alias(f"m_{c}") for c in key], ((F.col("names") == F.col("tos")) & (F.coalesce("most", F.lit(1)) == 1)).alias("fits"), "same", "odd")
    on = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("item_id").eqNullSafe(F.col("m_item_id")) & (F.col("shift") == F.col("m_shift"))
    own = F.forall("values", lambda x: x["item_slots"] == x["slots"])
    agrees = ~F.exists("values", lambda x: F.array_contains("odd", F.struct(x["item_kinds"].alias("k"), x["item_slots"].alias("i"), x["slots"].alias("d"))))
    # An alignment without placeholders has no mapping.
    kept = met.select(*key, "item_at", "values").join(mapping, on, "left").withColumn("fits", F.coalesce("fits", F.lit(True)))
    kept = kept.filter(own | (F.col("fits") & agrees))
    out = kept.groupBy("doc_id", "item_id").agg(F.count_distinct("item_at").alias("windows"), F.count_distinct(F.when(F.col("fits"), F.col("item_at"))).alias("firm"), F.min(F.coalesce("same", F.lit(1))).alias("same"))
    out = out.join(sizes.withColumnRenamed("id", "item_id"), "item_id").withColumn("share", F.col("windows") / F.col("of_windows"))
    out = out.filter((F.col("firm") >= F.least(F.lit(WINDOWS), "of_windows")) | (F.col("share") >= SHARE))
    return out.select("doc_id", "item_id", "windows", "of_windows", "share", F.when(F.col("same") == 1, "exact").otherwise("reparameterised").alias("kind"))


def op3_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they hold, of whole tables, as `contaminated` gives them."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item, all columns unchanged.

    Rows with a null doc_id stay, so do null and empty texts. Rows that share a doc_id count as one document and go or stay together; repeated rows are kept
    as often as they come. Very long texts are searched whole. An empty table stays empty, an empty benchmark drops nothing; further
    columns are kept, also if they are called like a column of the matches."""
    bad = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
