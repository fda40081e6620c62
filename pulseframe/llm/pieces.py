"""SentencePiece segmentations drawn without replacement: Gumbel top-k by perturbed A-star search.

All ways to write a text in pieces of the vocabulary form a lattice. Piece weights follow Zipf's law
over the vocabulary's merge ranks, so every path has a probability. Each set of paths with a common
prefix has a perturbed maximum, a Gumbel at the set's log mass truncated at its parent's maximum;
the search always opens the set with the greatest one. What it finds first, second, ... are k
distinct segmentations drawn without replacement, and the greatest maximum left over gives their
inclusion scores. Texts fall into units wherever no piece of the vocabulary can reach across; lattices are
built once per distinct unit of a batch and whole texts are sampled in vectorised steps. All draws are
hashes of (seed, row key, draw, place): a row's result depends on nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .store import table
from .textops import MIX2, give_back_memory, mix, slices

U = np.uint64
BLANK, ZIPF_SHIFT = 0x2581, 8.0
DRAWS, SEED, SLICE = 2, 17, 1 << 19
EPOCHS = 4  # of training on the pipeline's result, each with a segmentation of its own
_MOST_CHARS = 1 << 21  # code points fit 21 bits


class Vocabulary:
    """The pieces as a trie in one hash table, their log weights, and their bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        rank = np.argsort(np.argsort([-model.get_score(i) for i in normal], kind="stable"), kind="stable")
        weight = -np.log(rank + ZIPF_SHIFT)
        self.log_w = np.full(n, -np.log(len(normal) + ZIPF_SHIFT) - 1.0)  # of bytes
        self.log_w[normal] = weight
        self.log_w -= np.logaddexp.reduce(self.log_w[normal])
        # A text is cut between two characters that no piece has side by side: every path goes through there.
        inner = sorted({c for i in normal if len(pieces[i]) > 1 for c in pieces[i]})
        self.char_number = np.zeros(0x110000, dtype=np.int16)
        self.char_number[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.together = np.zeros((len(inner) + 1, len(inner) + 1), dtype=bool)
        for i in normal:
            codes = self.char_number[[ord(c) for c in pieces[i]]]
            self.together[codes[:-1], codes[1:]] = True
        edges: dict[tuple[int, int], int] = {}
        ends: list[int] = [-1]
        for i in normal:
            at = 0
            for c in pieces[i]:
                to = edges.get((at, ord(c)))
                if to is None:
                    to = edges[at, ord(c)] = len(ends)
                    ends.append(-1)
                at = to
            ends[at] = i
        self.end = np.array(ends, dtype=np.int32)
        self.longest = max(len(pieces[i]) for i in normal)
        self.bits = max(10, int(np.ceil(np.log2(len(edges) * 4))))
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys = np.array([a * _MOST_CHARS + c for a, c in edges], dtype=np.int64)
        slots = self._slot(keys)
        for k, s, to in zip(keys.tolist(), slots.tolist(), edges.values()):
            while self.key[s] != -1:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.key[s], self.to[s] = k, to
        raw = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie node after each state by its character, -1 if there is none."""
        keys = state * _MOST_CHARS + char
        slot, out = self._slot(keys), np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.key[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.to[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the pieces; the blank that encoding puts first is taken off."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        total = np.cumsum(size)
        at = np.repeat(self.raw_at[ids] - total + size, size) + np.arange(total[-1] if len(total) else 0)
        return self.raw[at].tobytes()[1:]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Lattice:
    """Arcs of the lattices of distinct units laid end to end. Node i is the place before character i; a
    unit of n characters from `start` ends at start + n, which is the next unit's first node."""

    def __init__(self, vocab: Vocabulary, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        n = len(chars)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)  # characters to the unit's end
        at, state = np.arange(n), np.zeros(n, dtype=np.int64)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []  # nodes, arc length, piece ids; nodes are distinct in each
        single = np.zeros(n, dtype=bool)
        for length in range(1, vocab.longest + 1):
            state = vocab.step(state, chars[at + (length - 1)])
            alive = np.flatnonzero(state >= 0)
            at, state = at[alive], state[alive]
            made = vocab.end[state]
            whole = np.flatnonzero(made >= 0)
            found.append((at[whole], length, made[whole]))
            if length == 1:
                single[at[whole]] = True
            go = np.flatnonzero(left[at] > length)
            at, state = at[go], state[go]
            if not len(at):
                break
        raw = np.flatnonzero(~single)  # written as bytes; arcs of more than one byte have id -1
        found.append((raw, 1, np.where(chars[raw] < 0x80, vocab.byte_id[np.minimum(chars[raw], 0x7F)], -1).astype(np.int32)))
        count = np.zeros(n + 1, dtype=np.int64)
        for nodes, _, _ in found:
            count[nodes + 1] += 1
        self.first = np.cumsum(count)
        place, arcs = self.first[:-1].copy(), int(self.first[-1])
        self.length, self.id, node = np.empty(arcs, np.int32), np.empty(arcs, np.int32), np.empty(arcs, np.int64)
        is_raw = np.zeros(arcs, dtype=bool)
        for nodes, length, ids in found:
            to = place[nodes]
            self.length[to], self.id[to], node[to] = length, ids, nodes
            place[nodes] += 1
        is_raw[to] = True  # the last ones
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        log_w = np.where(is_raw, vocab.log_w[vocab.byte_id[0]] * width[node], vocab.log_w[self.id])
        # log mass of all paths from each node to its unit's end, from the ends backwards
        mass = np.zeros(n + 1)
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, (left.max() if n else 0) + 2))
        to_end = left[node] == self.length
        for k in range(len(bounds) - 1):
            here = by_left[bounds[k] : bounds[k + 1]]
            if not len(here):
                continue
            size = self.first[here + 1] - self.first[here]
            total = np.cumsum(size)
            arcs = np.repeat(self.first[here] - total + size, size) + np.arange(total[-1])
            x = log_w[arcs] + np.where(to_end[arcs], 0.0, mass[np.minimum(node[arcs] + self.length[arcs], n - 1)])
            begin = total - size
            top = np.maximum.reduceat(x, begin)
            mass[here] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size)), begin))
        x = log_w + np.where(to_end, 0.0, mass[np.minimum(node + self.length, n - 1)]) - mass[node] if n else log_w
        degree = self.first[node + 1] - self.first[node] if n else node
        self.log_p = np.where(degree == 1, 0.0, np.minimum(x, 0.0))
        p = np.exp(self.log_p)
        running = np.cumsum(p)
        self.upto = running - (running - p)[self.first[node]] if n else p
        self.p = p
        self.others = np.where(degree == 1, 0.0, -np.expm1(self.log_p))  # mass of the node's other arcs


def uniform(key: np.ndarray, draw: int, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of the row key, the draw and the place."""
    h = mix(key ^ mix(place.astype(np.uint64) * MIX2 + U((draw << 8 | salt) << 40)))
    return ((h >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _walk(lattice: Lattice, node: np.ndarray, end: np.ndarray, key: np.ndarray, place: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """One random path from each node to its end: arcs in order, and how many each has."""
    todo = np.flatnonzero(node < end)
    node, arcs, owners, steps, step = node.copy(), [], [], [], 0
    place = place.copy()
    count = np.zeros(len(node), dtype=np.int64)
    while len(todo):
        here = node[todo]
        arc, last = lattice.first[here], lattice.first[here + 1] - 1
        u = uniform(key[todo], draw, place[todo], 1)
        more = np.flatnonzero((lattice.upto[arc] < u) & (arc < last))
        while len(more):
            arc[more] += 1
            more = more[(lattice.upto[arc[more]] < u[more]) & (arc[more] < last[more])]
        arcs.append(arc)
        owners.append(todo)
        steps.append(np.full(len(todo), step))
        count[todo] += 1
        length = lattice.length[arc]
        node[todo] += length
        place[todo] += length
        step += 1
        todo = todo[node[todo] < end[todo]]
    if not arcs:
        return np.zeros(0, np.int64), count
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=np.int64)
    for arc, owner, s in zip(arcs, owners, steps):
        out[begin[owner] + s] = arc
    return out, count


class Batch:
    """Texts of one slice with the lattice of their distinct units."""

    def __init__(self, vocab: Vocabulary, texts: list[str]):
        self.vocab = vocab
        whole = "".join("▁" + t if t else "" for t in texts)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        chars[chars == 32] = BLANK
        self.size = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(self.size)])
        n = len(chars)
        begin = np.zeros(n + 1, dtype=bool)
        if n:
            number = vocab.char_number[chars]
            begin[1:n] = ~vocab.together[number[:-1], number[1:]]
            begin[bounds] = True
        cut = np.flatnonzero(begin)
        start, size = cut[:-1], np.diff(cut)
        self.text_of = np.searchsorted(bounds, start, side="right") - 1
        self.place = start - bounds[self.text_of]
        # distinct units by hash of their characters
        up = np.full(n + 1, U(0x9E3779B97F4A7C15))
        up[0] = 1
        up = np.multiply.accumulate(up)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(chars.astype(np.uint64) + U(7)) * up[:n])])
        down = np.full(n + 1, U(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
        down[0] = 1
        down = np.multiply.accumulate(down)
        h = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
        _, some, which = np.unique(h, return_index=True, return_inverse=True)
        sizes = size[some]
        total = np.cumsum(sizes)
        at = np.repeat(start[some] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)
        self.chars = chars[at]
        starts = total - sizes
        self.lattice = Lattice(vocab, self.chars, starts, sizes)
        self.node, self.end = starts[which], starts[which] + sizes[which]
        self.units = np.searchsorted(self.text_of, np.arange(len(texts) + 1))
        self.node_of_arc = np.repeat(np.arange(len(self.chars)), np.diff(self.lattice.first))

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        """Piece ids of the arcs; a character without a piece becomes its bytes."""
        ids = self.lattice.id[arcs]
        raw = np.flatnonzero(ids < 0)
        if not len(raw):
            return ids
        parts, last = [], 0
        for i in raw.tolist():
            parts.append(ids[last:i])
            parts.append(self.vocab.byte_id[list(chr(self.chars[self.node_of_arc[arcs[i]]]).encode("utf-8", "surrogatepass"))])
            last = i + 1
        return np.concatenate([*parts, ids[last:]])

    def draw(self, keys: np.ndarray, draws: int, lo: int = 0, hi: int | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each of the texts lo to hi up to `draws` segmentations: (arcs, log probability, perturbed value,
        log inclusion)."""
        la, hi = self.lattice, len(self.size) if hi is None else hi
        n, keys, some = hi - lo, keys[lo:hi], slice(self.units[lo], self.units[hi])
        root = -np.log(-np.log(uniform(keys, 0, np.zeros(n, np.int64), 2)))
        arcs, count = _walk(la, self.node[some], self.end[some], keys[self.text_of[some] - lo], self.place[some], 0)
        ends = np.concatenate([[0], np.cumsum(count)])[self.units[lo : hi + 1] - self.units[lo]]
        owner = np.repeat(np.arange(n), np.diff(ends))
        length = la.length[arcs].astype(np.int64)
        run = np.cumsum(length) - length
        place = run - np.concatenate([[0], np.cumsum(self.size[lo:hi])])[owner]
        front = self._front(arcs, place, keys[owner], root[owner], np.zeros(len(arcs)), ends, 0)
        paths: list[list[dict]] = [[] for _ in range(n)]
        for i in range(n):
            one = slice(ends[i], ends[i + 1])
            paths[i].append({"arcs": arcs[one], "place": place[one], "front": front[one], "from": 0, "closed": None, "value": float(root[i])})
        for t in range(1, draws):
            self._next(paths, keys, t, lo)
        return [self._scored(p) for p in paths]

    def _scored(self, paths: list[dict]) -> list[tuple[np.ndarray, float, float, float]]:
        rest = max((float(p["front"].max()) for p in paths if len(p["front"])), default=-np.inf)
        out = []
        for p in paths:
            log_p = float(self.lattice.log_p[p["arcs"]].sum())
            x = log_p - rest
            inclusion = 0.0 if rest == -np.inf or x > 30 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))
            out.append((p["arcs"], log_p, p["value"], inclusion))
        return out

    def _front(self, arcs, place, keys, limit, before, ends, draw):
        """Perturbed maxima of the sets that leave a path at each of its arcs. `before` is the log mass of the
        prefix in front of each text's first arc; `limit` the maximum of the set the path was drawn from."""
        la = self.lattice
        log_p = la.log_p[arcs]
        total = np.cumsum(log_p)
        first = np.concatenate([[0.0], total])[ends[:-1]]
        prefix = total - log_p - np.repeat(first, np.diff(ends)) + before
        # -log(exp(-limit) + exp(-g)) with g a Gumbel at log(others) + prefix; no mass left gives -inf
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            spread = np.exp(-prefix) / la.others[arcs]
            spread *= -np.log(uniform(keys, draw, place, 3))
            spread += np.exp(-limit)
            return -np.log(spread)

    def _next(self, paths: list[list[dict]], keys: np.ndarray, t: int, first: int) -> None:
        """Opens the set with the greatest perturbed maximum of every text and draws a path from it."""
        la = self.lattice
        jobs = []
        for i, own in enumerate(paths):
            best = max(((float(p["front"].max()), k) for k, p in enumerate(own) if len(p["front"])), default=(-np.inf, 0))
            if best[0] == -np.inf or len(own) < t:
                continue
            p = own[best[1]]
            j = int(p["front"].argmax())
            p["front"] = p["front"].copy()
            p["front"][j] = -np.inf
            at = j + p["from"]  # number of the arc in the path
            shut = p["closed"] if j == 0 and p["closed"] is not None else [int(p["arcs"][at])]
            node = int(self.node_of_arc[p["arcs"][at]])
            options = np.array([a for a in range(la.first[node], la.first[node + 1]) if a not in shut])
            share = np.cumsum(la.p[options])
            u = float(uniform(keys[i : i + 1], t, p["place"][at : at + 1], 4)[0]) * share[-1]
            arc = int(options[min(int(np.searchsorted(share, u)), len(options) - 1)])
            jobs.append((i, p, at, arc, [*shut, arc], best[0]))
        if not jobs:
            return
        # the rest of each opened unit, then all units behind it
        nodes, stops, places, owners = [], [], [], []
        for k, (i, p, at, arc, _, _) in enumerate(jobs):
            place = int(p["place"][at])
            lo, hi = self.units[first + i], self.units[first + i + 1]
            unit = int(np.searchsorted(self.place[lo:hi], place, side="right")) + lo - 1
            length = int(la.length[arc])
            nodes.append(np.concatenate([[self.node[unit] + place - self.place[unit] + length], self.node[unit + 1 : hi]]))
            stops.append(self.end[unit:hi])
            places.append(np.concatenate([[place + length], self.place[unit + 1 : hi]]))
            owners.append(np.full(hi - unit, k))
        owner = np.concatenate(owners)
        job_keys = keys[[j[0] for j in jobs]]
        arcs, count = _walk(la, np.concatenate(nodes), np.concatenate(stops), job_keys[owner], np.concatenate(places), t)
        sizes = np.bincount(owner, weights=count, minlength=len(jobs)).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        # the opened arc leads each tail
        heads = np.array([j[3] for j in jobs])
        tail = np.insert(arcs, cut[:-1], heads)
        ends = cut + np.arange(len(jobs) + 1)
        length = la.length[tail].astype(np.int64)
        run = np.cumsum(length) - length
        base = np.array([int(j[1]["place"][j[2]]) for j in jobs])
        spans = np.diff(ends)
        place = run - np.repeat(run[ends[:-1]], spans) + np.repeat(base, spans)
        before = np.array([float(la.log_p[j[1]["arcs"][: j[2]]].sum()) for j in jobs])
        value = np.array([j[5] for j in jobs])
        which = np.repeat(np.arange(len(jobs)), spans)
        front = self._front(tail, place, job_keys[which], value[which], before[which], ends, t)
        for k, (i, p, at, _, shut, top) in enumerate(jobs):
            one = slice(ends[k], ends[k + 1])
            mine = front[one].copy()
            node = int(self.node_of_arc[shut[0]])
            left = 1.0 - float(la.p[shut].sum())
            if len(shut) >= la.first[node + 1] - la.first[node] or left <= 1e-15:
                mine[0] = -np.inf
            else:
                u = float(uniform(keys[i : i + 1], t, p["place"][at : at + 1], 5)[0])
                mine[0] = -np.logaddexp(-top, -(before[k] + np.log(left) - np.log(-np.log(u))))
            paths[i].append({"arcs": np.concatenate([p["arcs"][:at], tail[one]]), "place": np.concatenate([p["place"][:at], place[one]]), "front": mine, "from": at, "closed": shut, "value": top})


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    values = pc.fill_null(ids.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(np.uint64)
    return mix(values * MIX2 + mix(np.full(len(values), seed, dtype=np.uint64)))


def sample_segmentations(docs: DataFrame, path: str, draws: int = DRAWS, seed: int = SEED, digest: bool = False, keep_ids: bool = False, most: int = SLICE) -> DataFrame:
    """Up to `draws` distinct segmentations of every whole text, rank 1 first: doc_id, rank, ids (little-endian
    unsigned 32-bit), log_prob, perturbed, log_inclusion. With `digest` the ids are replaced by n_pieces and
    ids_crc32, and decoded_crc32 tells the bytes that decoding them gives; with `keep_ids` they stay beside these.
    Texts of `most` bytes share lattices, and half as many are drawn at once: less takes less memory and more time.

    A text has fewer rows if it has fewer segmentations; a null or empty text has one, without pieces.
    A blank sign U+2581 in a text decodes to a blank, as in SentencePiece. Rows of the same doc_id and
    text have equal results. A very long text is one row of a batch of its own, whose lattice is in the task's memory. An empty table gives
    no rows. Columns besides doc_id and text are not read.
    """
    whole = keep_ids or not digest
    schema = f"doc_id long, rank int, {'ids binary, ' * whole}{'n_pieces long, ids_crc32 long, decoded_crc32 long, ' * digest}log_prob double, perturbed double, log_inclusion double"
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in slices(batches, most=most):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            made, keys, ids_of = Batch(vocab, texts), row_keys(batch.column("doc_id"), seed), batch.column("doc_id").to_pylist()
            part = np.cumsum([len(x) for x in texts]) // (most // 2)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                rows = []
                for doc, found in zip(ids_of[lo:hi], made.draw(keys, draws, lo, hi)):
                    for rank, (arcs, *scores) in enumerate(found, 1):
                        ids = made.ids(arcs)
                        raw = ids.astype("<u4").tobytes()
                        scores = [round(x, 6) for x in scores]  # beyond that they depend on the order of sums
                        sums = (len(ids), zlib.crc32(raw), zlib.crc32(vocab.decode(ids))) if digest else ()
                        rows.append((doc, rank, *([raw] if whole else ()), *sums, *scores))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=list(names))
            del made, rows, found, arcs  # before the next slice's lattices
            give_back_memory()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """Adds text to rows with ids: what the pieces spell."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, schema)


def op5_gumbel_segmentations(spark, sf_dir: str) -> DataFrame:
    """Digests of two segmentations of every row of `documents`."""
    import public_tokenizers

    return sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def encode_stage(spark, docs: DataFrame, sf_dir: str, draws: int = EPOCHS) -> DataFrame:
    """Last pipeline stage: every document that is left as piece ids, `draws` distinct segmentations of each (fewer if it has fewer)
    with their digests and scores, in one pass without a shuffle. From the third on the search chooses among the sets of all paths
    found before. Null and empty texts have one segmentation without pieces; repeated rows each keep theirs; a very long text is
    worked on in parts of its lattice, all of which are in memory; an empty table gives no rows; further columns are not read."""
    import public_tokenizers

    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), draws, digest=True, keep_ids=True, most=SLICE // 2)
