"""Near-duplicate documents by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A document is its multiset of five-word shingles; a shingle weighs tf * idf, with
idf = 1 + ln((1 + N) / (1 + max(df, RARE * N))): document frequencies below one in 1/RARE count
as that. So only wording that more than one in twenty documents have weighs less than other wording (a
group of copies smaller than that is compared as by plain shingles), and the shingles with an idf of their own are at most (mean shingles per document) / RARE
however large the corpus. Their exact counts are found in two passes over all documents: hashed
bucket counts rule out the rest, then the shingles of heavy buckets are counted.

Equal texts become one node. Banded ICWS samples deal the nodes into buckets. In a bucket, nodes with ALIKE equal
samples or more of BANDS * ROWS are joined (a search that meets each node once and compares it with those not
joined yet, so a dense group costs little and no pairs are written); the joined nodes of all buckets
form clouds by connected components. A cloud holds every class whole: a link of similarity 0.8 that a band
found has fewer than ALIKE equal samples with probability under 1e-8. Each cloud's texts then meet once in one task, and the
same search with the exact weighted Jaccard similarity of whole texts gives its classes. Buckets and clouds beyond
a task's size are cut into parts, every two parts meet, and connected components join the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import drop_table, materialise, table
from .textops import MIX2, Words, mix, slices, unique_in_texts

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 18, 5  # a pair of similarity 0.8 meets with probability 1 - (1 - 0.8 ** 5) ** 18 > 0.999
ALIKE = 48  # of 90 samples; fewer equal ones have a probability under 1e-8 at similarity 0.8
RARE = 1 / 20
BUCKET_BITS, BLOCKS = 20, 64
#: Most nodes of a part where a bucket or cloud is cut, and most bytes of text of a cloud's part.
BUCKET_PART, CLOUD_PART, CLOUD_BYTES = 32_768, 8_192, 8 << 20
U = np.uint64


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text number, hash, tf) of the distinct shingles of each text, and the number of texts."""
    words = Words(texts)
    h, of, _ = words.windows(SHINGLE)
    return *unique_in_texts(of, h, words.n_texts), words.n_texts


class Idf:
    """Weights of shingles: `known` (sorted) with their own df, all others at the floor."""

    def __init__(self, n_docs: int, known: np.ndarray, df: np.ndarray):
        self.known = known
        floor = RARE * n_docs
        self.base = 1 + np.log((1 + n_docs) / (1 + max(1.0, floor)))
        self.own = 1 + np.log((1 + n_docs) / (1 + np.maximum(df, floor)))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.base)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[at] == h
            out[hit] = self.own[at[hit]]
        return out


def document_frequencies(docs: DataFrame, n_docs: int) -> Idf:
    """Exact df of every shingle that at least RARE of all documents have. At most
    (mean shingles per document) / RARE rows reach the driver, whatever the number of documents."""
    least = max(1.0, RARE * n_docs)
    width = (1 << BUCKET_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in slices(batches):
            h, _, _ = Words(batch.column("text")).windows(SHINGLE)
            total += np.bincount((h >> U(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        parts = total.reshape(BLOCKS, width)
        some = np.flatnonzero(parts.any(axis=1))
        task = TaskContext.get().partitionId()
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([task // 256] * len(some), pa.int32()), pa.array([parts[i].astype("<u4").tobytes() for i in some], pa.binary())], names=["block", "part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c in rows["counts"]:
            total += np.frombuffer(c.as_buffer(), "<u4")
        return pa.table({"block": rows["block"][:1], "part": rows["part"][:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    schema = "block int, part int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, c in zip(batch.column("block").to_pylist(), batch.column("counts")):
                at = np.flatnonzero(np.frombuffer(c.as_buffer(), "<u4") >= least) + block * width
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], names=["bucket"])

    open_buckets = np.zeros(1 << BUCKET_BITS, dtype=bool)
    open_buckets[sums.mapInArrow(heavy, "bucket int").toArrow()["bucket"].to_numpy()] = True
    if not open_buckets.any():
        return Idf(n_docs, np.zeros(0, np.uint64), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(open_buckets))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_open = np.unpackbits(shared.value).astype(bool)
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h, of, _ = words.windows(SHINGLE)
            hit = is_open[(h >> U(64 - BUCKET_BITS)).astype(np.int64)]
            _, once, _ = unique_in_texts(of[hit], h[hit], words.n_texts)
            values, n = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "df"])

    known = docs.select("text").mapInArrow(exact, "hash long, df long").groupBy("hash").agg(F.sum("df").alias("df")).filter(F.col("df") >= least).toArrow()
    h, df = known["hash"].to_numpy().astype(np.int64).view(np.uint64), known["df"].to_numpy().astype(np.float64)
    order = np.argsort(h)
    return Idf(n_docs, h[order], df[order])


class Sampler:
    """ICWS with the draws (r, c, beta) of each (shingle, sample) taken from a table of 65,536 by hash; the
    rest of the hash breaks ties, so samples of shingles of equal weight are uniform."""

    def __init__(self, base: float):
        u = [((mix(np.arange(1, 65537, dtype=np.uint64) * MIX2 + U(i << 40)) >> U(11)).astype(np.float64) + 0.5) / (1 << 53) for i in range(5)]
        self.r, self.log_c, self.beta = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
        self.base = base
        self.plain = self._keys(np.arange(65536), np.full(65536, np.log(base)))

    def _keys(self, at: np.ndarray, log_w: np.ndarray) -> np.ndarray:
        r, beta = self.r[at], self.beta[at]
        t = np.floor(log_w / r + beta)
        log_a = (self.log_c[at] - r * (t - beta) - r).astype(np.float32)
        bits = log_a.view(np.uint32)
        order = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # ascends with log_a
        return (order << U(32)) | (mix(t.astype(np.int64).view(np.uint64) + U(3)) >> U(32))

    def __call__(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(BANDS * ROWS, texts) samples; `starts` are the first shingles of texts that have some."""
        out = np.empty((BANDS * ROWS, len(starts)), dtype=np.uint64)
        odd = np.flatnonzero(weight != self.base)
        log_w = np.log(weight[odd])
        salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
        a = np.empty_like(h)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(h, salts[k], out=a)
            a *= U(0xFF51AFD7ED558CCD)
            a ^= a >> U(32)
            a *= U(0xC4CEB9FE1A85EC53)
            at = (a >> U(48)).astype(np.int64)
            a &= U(0xFFFFFFFF)
            key = self.plain[at]
            if len(odd):
                key[odd] = self._keys(at[odd], log_w)
            key ^= a
            out[k] = np.minimum.reduceat(key, starts)
        return out


def node_of(text: Column) -> Column:
    """64-bit hash of the text; null counts as empty. Among ten billion texts some three pairs would agree by chance."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """doc_id, node, keys of the bands (none for a text without words), a byte of every sample, and the text's bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        sample = Sampler(weigh.base)
        for batch in slices(batches):
            of, h, tf, n = shingles(batch.column("text"))
            keys = np.zeros((0, BANDS), dtype=np.int64)
            have = np.zeros(n, dtype=np.int64)
            sketch = [b""] * n
            if len(h):
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                have[of[starts]] = BANDS
                rows = sample(h, weigh(h) * tf, starts)
                for i, one in zip(of[starts].tolist(), np.ascontiguousarray((mix(rows) >> U(56)).astype(np.uint8).T)):
                    sketch[i] = one.tobytes()
                rows = rows.reshape(BANDS, ROWS, -1)
                band = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX2)[:, None]
                for j in range(ROWS):
                    band = mix(band ^ rows[:, j])
                keys = band.T.copy().view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(have)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), bands, pa.array(sketch, pa.binary()), size], names=["doc_id", "node", "bands", "sketch", "size"])

    schema = "doc_id long, node long, bands array<long>, sketch binary, size long"
    return docs.select("doc_id", node_of(F.col("text")).alias("node"), "text").mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of `rows` rows or more that hold whole groups; the rows come sorted by the columns `by`, then node. Of adjacent
    rows with the same group and node one stays."""
    held: list[pa.RecordBatch] = []
    last = None

    def ids(batch) -> np.ndarray:
        return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in [*by, "node"]])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = ids(batch)
        fresh = np.ones(len(now), dtype=bool)
        fresh[1:] = (now[1:] != now[:-1]).any(axis=1)
        fresh[0] = last is None or (now[0] != last).any()
        last = now[-1]
        held.append(batch if fresh.all() else batch.filter(pa.array(fresh)))
        if sum(x.num_rows for x in held) >= rows:
            both = pa.Table.from_batches(held)
            keys = ids(both)[:, :-1]
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(edge):
                yield both.slice(0, edge[-1] + 1)
                held = both.slice(edge[-1] + 1).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def bounds_of(rows: pa.Table, by: list[str]) -> np.ndarray:
    keys = np.column_stack([rows.column(c).to_numpy() for c in by])
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])


def components_of(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """First member of each member's component; linked(x, rest) tells which of `rest` x is linked with. Each member
    is compared only with those that are in no component yet."""
    root, rest = np.arange(n), np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            hit = linked(todo.pop(), rest)
            if hit.any():
                root[rest[hit]] = first
                todo.extend(rest[hit].tolist())
                rest = rest[~hit]
    return root


def _parted(rows: DataFrame, sizes: DataFrame, by: str, parts: Column) -> DataFrame:
    """Adds i and j: a group of one part has both 0; otherwise a row of part k is in every pair (i, j) of parts with k."""
    rows = rows.join(sizes.select(by, parts.cast("int").alias("_parts")).hint("merge"), by)
    k = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda x: x != k), lambda x: F.struct(F.least(x, k).alias("i"), F.greatest(x, k).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    pairs = F.when(F.col("_parts") > 1, others).otherwise(one)
    return rows.withColumn("_ij", F.explode(pairs)).withColumn("i", F.col("_ij.i")).withColumn("j", F.col("_ij.j")).drop("_ij")


def alike(members: DataFrame) -> DataFrame:
    """a, b of the rows (key, i, j, node, sketch): every node that is joined with others of its group, and the group's
    first node that it is joined with."""
    by = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, by):
            node = rows["node"].to_numpy()
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
            bounds = bounds_of(rows, by)
            root = np.arange(len(node))
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            same = (sketch[two] == sketch[two + 1]).sum(axis=1) >= ALIKE
            root[two[same] + 1] = two[same]
            for g in np.flatnonzero(sizes > 2).tolist():
                part = sketch[bounds[g] : bounds[g + 1]]
                root[bounds[g] : bounds[g + 1]] = bounds[g] + components_of(len(part), lambda x, rest, part=part: (part[rest] == part[x]).sum(axis=1) >= ALIKE)
            moved = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])

    return members.select(*by, "node", "sketch").repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long")


class Sets:
    """Shingles of a list of texts as local numbers, for exact similarities of one text with many."""

    def __init__(self, texts: pa.Array, idf: Idf):
        of, h, tf, self.n = shingles(texts)
        known, self.ids = np.unique(h, return_inverse=True)
        self.tf, self.weight = tf.astype(np.float64), idf(h)
        self.at = np.searchsorted(of, np.arange(self.n + 1))
        self.total = np.bincount(of, self.tf * self.weight, minlength=self.n)
        self.here = np.zeros(len(known))

    def linked(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Which of the texts `rest` have a weighted Jaccard similarity of THRESHOLD or more with text x."""
        hit = np.zeros(len(rest), dtype=bool)
        low, high = np.minimum(self.total[rest], self.total[x]), np.maximum(self.total[rest], self.total[x])
        near = np.flatnonzero(low >= (THRESHOLD - 1e-9) * high)
        sizes = self.at[rest[near] + 1] - self.at[rest[near]]
        if not len(near) or self.total[x] == 0:
            return hit
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) + np.repeat(self.at[rest[near]] - (ends - sizes), sizes)
        mine = slice(self.at[x], self.at[x + 1])
        self.here[self.ids[mine]] = self.tf[mine]
        both = np.add.reduceat(np.minimum(self.here[self.ids[take]], self.tf[take]) * self.weight[take], ends - sizes)
        self.here[self.ids[mine]] = 0
        hit[near] = both >= (THRESHOLD - 1e-9) * (self.total[rest[near]] + self.total[x] - both)
        return hit


def verified_links(texts: DataFrame, idf: Idf) -> DataFrame:
    """a, b, whole of the rows (cloud, i, j, node, text): every node that is linked with others of its group, and the
    group's first node that it is joined with by exact links; `whole` if the group is a whole cloud."""
    by = ["cloud", "i", "j"]
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(slices(batches), by, rows=1):
            node, part, bounds = rows["node"].to_numpy(), rows["j"].to_numpy(), bounds_of(rows, by)
            text = rows["text"].combine_chunks()
            a, b, whole = [], [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s > 1:
                    root = s + components_of(e - s, Sets(text.slice(s, e - s), shared.value).linked)
                    moved = np.flatnonzero(root != np.arange(s, e)) + s
                    a.append(node[moved]), b.append(node[root[moved - s]]), whole.append(np.full(len(moved), part[s] == 0))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, whole)], names=["a", "b", "whole"])

    return texts.select(*by, "node", "text").repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long, whole boolean")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, node, text_id, class_id and class_node (one node per class) of every row; see near_duplicates."""
    n_docs = docs.select("doc_id").count()
    idf = document_frequencies(docs, n_docs)
    signed = materialise(signatures(docs, idf), "signatures")
    firsts = signed.groupBy("node").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    firsts = materialise(firsts, "texts-signed")
    rows = materialise(signed.select("doc_id", "node"), "rows")
    drop_table(signed)

    keys = firsts.select("node", F.explode("bands").alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = _parted(keys, shared, "key", F.when(F.col("n") > 2 * BUCKET_PART, F.ceil(F.col("n") / BUCKET_PART)).otherwise(1))
    joined = materialise(alike(members.join(firsts.select("node", "sketch").hint("merge"), "node")), "alike")
    drop_table(shared)
    clouds = connected_components(joined).select("node", F.col("component").alias("cloud"))
    drop_table(joined)

    dealt = clouds.join(firsts.select("node", "text_id", "size").hint("merge"), "node")
    sizes = dealt.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    most = F.greatest(F.col("n") / CLOUD_PART, F.col("bytes") / CLOUD_BYTES)
    dealt = materialise(_parted(dealt, sizes, "cloud", F.when(most > 2, F.ceil(most)).otherwise(1)).select("cloud", "i", "j", "node", "text_id"), "clouds-dealt")
    texts = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text").filter("text is not null")
    texts = texts.join(dealt.hint("merge"), (texts["node"] == dealt["node"]) & texts["doc_id"].eqNullSafe(dealt["text_id"])).select("cloud", "i", "j", dealt["node"], "text")
    links = materialise(verified_links(texts, idf), "links")
    drop_table(dealt)
    drop_table(clouds)

    classes = links.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("class_node"))
    if links.filter("not whole").limit(1).count():
        classes = classes.unionByName(connected_components(links.filter("not whole")).select("node", F.col("component").alias("class_node")))
    nodes = firsts.select("node", "text_id").join(classes, "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    nodes = materialise(nodes, "nodes")
    drop_table(firsts)
    ids = nodes.groupBy("class_node").agg(F.min("text_id").alias("class_id"))
    return rows.join(nodes.join(ids.hint("merge"), "class_node").hint("merge"), "node").select("doc_id", "node", "text_id", "class_id", "class_node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), text_id (smallest doc_id with the same text) of every row.

    Two texts are linked if their weighted Jaccard similarity is at least THRESHOLD; classes are the
    connected components. Texts of fewer than five words have one shingle, all their words. Texts
    without words, empty and null ones are in a class with equal texts alone. Rows that share a doc_id are rows of
    their own, each with the class of its text; a null doc_id gets the class of its text's other rows, else null. An
    empty table gives no rows. A very long text is sampled whole, in a batch of its own. Columns besides doc_id and text are not read.
    """
    return classify(docs).select("doc_id", "class_id", "text_id")


def op2_icws_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Class and text class of every row of `documents`, as near_duplicates gives them."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays, all columns unchanged: that with the smallest doc_id (null last,
    then by the text's digest). Repeated rows with the same doc_id and text count as one. Null, empty and wordless texts are
    copies of equal texts only; an empty table stays empty; further columns are kept and not read."""
    found = materialise(classify(docs).groupBy("class_node", "doc_id", "node").agg(F.count(F.lit(1)).alias("n")), "classes")
    best = found.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node"))
    drop = found.join(best, "class_node").filter(~same).select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"))
    on = lambda d: F.col("doc_id").eqNullSafe(F.col("_doc")) & (node_of(F.col("text")) == F.col("_node"))
    kept = docs.join(drop, on(drop), "left_anti")
    again = found.filter("n > 1").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"))
    if again.limit(1).count():
        kept = kept.join(again, on(again), "left_anti").unionByName(kept.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(docs.columns)
