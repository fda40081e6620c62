"""Conversation structure repair by bidirectional Dijkstra over an edit lattice.

A node of the lattice is a row boundary and a state: nothing yet, after a system, user or assistant turn. Edges keep, rerole or
delete the next row or insert an empty turn. A forward heap from the start and a reverse heap from the ends grow until their
least costs add up to more than the best crossing, so all crossings of that cost are known; the walk over them takes the
least edit initial at each node, which is the ASCII-least audit since an audit determines its path.

Conversations of bounded size meet in one task, sorted, one after another. A longer one is cut into segments by
a range sort, so no task holds it: each segment's table of costs from state to state is made by itself, a fold over
these small tables (last to first, then first to last) says in which state each segment begins and what it costs to end in each
state, and the segments are searched with that. Only its SHA-256, which is defined in order, reads the packed segments in one task, as a stream.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, table
from .textops import give_back_memory

#: States: nothing yet, after system, after user, after assistant. An empty or finished conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {START: 0, ASSISTANT: 0}
#: The state after the one user or assistant turn that may come next, and after keeping a row by its role's initial.
STEP = (USER, USER, ASSISTANT, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED, NEVER = 1, 2, 5, 5, 1 << 40
LEGAL = {"su", "ua", "au"}
#: A conversation beyond one of these bounds is cut into segments of so many rows and bytes.
LONG_ROWS, LONG_BYTES, SEGMENT_ROWS, SEGMENT_BYTES = 4096, 32 << 20, 2048, 4 << 20
BLANKS = " \t\n\x0b\x0c\r"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@functools.cache
def edges(code: str) -> tuple[list, list]:
    """Edges over a row: for each state (letter, next state, cost), and for each state those that lead to it.

    `code` is `d` for a row that must go, else its role's initial (`x` if none of s, u, a), a capital if it is truncated.
    """
    out: list[list[tuple[str, int, int]]] = [[("D", q, DELETE)] for q in range(4)]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        for q in range(4):
            if (q, code.lower()) in KEPT:
                out[q].append(("K", KEPT[q, code.lower()], more))
            out[q].append(("R", STEP[q], REROLE + more))
    back: list[list[tuple[str, int, int]]] = [[] for _ in range(4)]
    for q in range(4):
        for letter, to, cost in out[q]:
            back[to].append((letter, q, cost))
    return out, back


def _after(codes: str, node: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """Edges from a node (4 * boundary + state): letter, node, cost. Turns are inserted before a row; after all rows only at the `last` segment's end."""
    i, q = divmod(node, 4)
    if i < len(codes):
        for letter, to, cost in edges(codes[i])[0][q]:
            yield letter, 4 * i + 4 + to, cost
    if i < len(codes) or last:
        yield "I", 4 * i + STEP[q], INSERT


def _before(codes: str, node: int, last: bool) -> Iterator[tuple[str, int, int]]:
    i, q = divmod(node, 4)
    if i:
        for letter, of, cost in edges(codes[i - 1])[1][q]:
            yield letter, 4 * i - 4 + of, cost
    if i < len(codes) or last:
        for of in range(4):
            if STEP[of] == q:
                yield "I", 4 * i + of, INSERT


class _Side:
    """One direction of the search: costs found, costs that are final, and the heap between them."""

    def __init__(self, seeds: dict[int, int]):
        self.cost, self.final = dict(seeds), {}
        self.heap = [(c, node) for node, c in seeds.items()]
        heapq.heapify(self.heap)

    def least(self) -> int:
        while self.heap and self.heap[0][1] in self.final:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else NEVER

    def grow(self, codes: str, neighbours, last: bool, other: _Side, best: int) -> int:
        """Make the nearest node final and look over its edges; the best crossing after that."""
        cost, node = heapq.heappop(self.heap)
        self.final[node] = cost
        best = min(best, cost + other.cost.get(node, NEVER))
        for _, to, w in neighbours(codes, node, last):
            if cost + w < self.cost.get(to, NEVER):
                self.cost[to] = cost + w
                heapq.heappush(self.heap, (cost + w, to))
                best = min(best, cost + w + other.cost.get(to, NEVER))
        return best


def search(codes: str, entry: int = START, exits: dict[int, int] = ENDS, last: bool = True) -> tuple[int, str, int]:
    """Cost, ASCII-least audit and final state of the cheapest way through the rows, begun in state `entry` and
    ended in a state of `exits`, which holds what each end costs more. No way: (NEVER, "", entry)."""
    n = len(codes)
    ahead, behind = _Side({entry: 0}), _Side({4 * n + q: c for q, c in exits.items() if c < NEVER})
    best = NEVER
    while (a := ahead.least()) + (b := behind.least()) <= best and min(a, b) < NEVER:  # equal crossings are finished too
        best = ahead.grow(codes, _after, last, behind, best) if a <= b else behind.grow(codes, _before, last, ahead, best)
    if best >= NEVER:
        return NEVER, "", entry
    left = dict(behind.final)  # cost still to come: known behind the crossings, and before them on cheapest ways
    end = {4 * n + q: c for q, c in exits.items()}
    met = [u for u, c in ahead.final.items() if c + min(end.get(u, NEVER), behind.final.get(u, NEVER)) == best or any(c + w + behind.final.get(v, NEVER) == best for _, v, w in _after(codes, u, last))]
    while met:
        u = met.pop()
        left[u] = best - ahead.final[u]
        for _, p, w in _before(codes, u, last):
            if p not in left and ahead.final.get(p, NEVER) + w == ahead.final[u]:
                left[p] = best - ahead.final[p]
                met.append(p)
    audit, node = [], entry
    while end.get(node, NEVER) != left[node]:
        letter, node = min((letter, v) for letter, v, w in _after(codes, node, last) if left.get(v, NEVER) + w == left[node])
        audit.append(letter)
    return best, "".join(audit), node - 4 * n


@functools.lru_cache(1 << 15)
def _kept_search(codes: str) -> tuple[int, str, int]:
    return search(codes)


def exit_costs(codes: str) -> list[int]:
    """4 x 4 least costs of a segment that is not the last, from each state to each."""
    out = []
    for entry in range(4):
        side = _Side({entry: 0})
        while side.least() < NEVER:
            side.grow(codes, _after, False, _Side({}), NEVER)
        out += [side.final.get(4 * len(codes) + q, NEVER) for q in range(4)]
    return out


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> tuple[list[str], int]:
    """The `role:text` lines that an audit leaves of (role, text) rows, and the state after them."""
    rows, lines = iter(rows), []
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state, role[:1]]
        else:
            state = STEP[state]
            role = ROLES[state]
        lines.append(f"{role}:{text}")
    return lines, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault (`gone`: the row is dropped but its conversation known; `blank`, `truncated` or none) of the damaged rows."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = F.crc32(name) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), what.alias("what"))
    rows = rows.withColumn("text", F.when(F.col("what") <= 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("what") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1))))
    told = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(F.col("what") == 0, "gone").when(told == "", "blank").when(~F.right(told, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))
    give_back_memory()


_KIND = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batches(rows: Iterable[tuple], ddl: str, size: int = 2048) -> Iterator[pa.RecordBatch]:
    rows, fields = iter(rows), [f.split() for f in ddl.split(", ")]
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, _KIND[kind]) for c, (_, kind) in zip(zip(*some), fields)], names=[n for n, _ in fields])


class _Tally:
    """Counts and codes of consecutive rows of a conversation."""

    def __init__(self):
        self.codes, self.faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.first_turn, self.last_turn = 0, 0, None, None
        self.first = self.last = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault:
            self.faults[fault] += 1
        known = initial if initial in ("s", "u", "a") else "x"
        self.codes.append("d" if fault in ("blank", "duplicate") else known.upper() if fault else known)


def _ordinary(rows: DataFrame) -> DataFrame:
    def result(conv: int | None, group: Iterator[tuple]) -> tuple:
        tally, seen, kept = _Tally(), set(), []
        for _, turn, role, text, fault in group:
            if fault == "gone":
                continue
            if fault != "blank":
                if (role, text) in seen:
                    fault = "duplicate"
                seen.add((role, text))
            tally.add(turn, role, fault)
            kept.append((role, text))
        codes = "".join(tally.codes)
        cost, audit, _ = (_kept_search if len(codes) < 32 else search)(codes)
        lines = "\n".join(repaired(kept, audit)[0])
        gaps = tally.last_turn - tally.first_turn + 1 - tally.turns if tally.turns else 0
        return conv, gaps, *tally.faults.values(), tally.illegal, cost, audit, hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((result(conv, group) for conv, group in groupby(_rows(batches), itemgetter(0))), RESULT)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, RESULT)


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string"
_SEGMENT = f"conv_id long, part int, seq long, codes string, roles array<string>, texts array<string>, {_COUNTS}"


def _segments(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Packed rows of long conversations in order (part, seq), with repeats known. A row that is gone keeps its conversation by an empty segment."""
    keyed = rows.withColumn("at", F.struct(F.col("turn").isNotNull().alias("has"), "turn")).withColumn("digest", F.when(F.col("fault").isin("gone", "blank"), None).otherwise(F.sha2(F.concat_ws("\x00", "role", "text"), 256)))
    first = keyed.filter("digest is not null").groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), "first")
    keyed = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    keyed = keyed.select("conv_id", "turn", "role", "text", "fault", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("later"))
    spread = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]

    def cut(group: Iterator[tuple], part: int, seq: Iterator[int]) -> Iterator[tuple]:
        tally, roles, texts, size, before = _Tally(), [], [], 0, None

        def packed(conv: int | None) -> tuple:
            t = tally
            return conv, part, next(seq), "".join(t.codes), roles, texts, *t.faults.values(), t.illegal, t.turns, t.first_turn, t.last_turn, t.first, t.last

        for conv, turn, role, text, fault, later in group:
            if fault == "gone":
                continue
            if len(roles) == most_rows or size > most_bytes:
                yield packed(conv)
                tally, roles, texts, size = _Tally(), [], [], 0
            if fault != "blank" and (later or before == (turn, role, text)):  # equal rows of one turn are neighbours
                fault = "duplicate"
            before = turn, role, text
            tally.add(turn, role, fault)
            roles.append(role)
            texts.append(text)
            size += len(text)
        yield packed(conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), iter(range(1 << 62))
        yield from _batches((s for _, group in groupby(_rows(batches), itemgetter(0)) for s in cut(group, part, seq)), _SEGMENT, 2)

    placed = keyed.repartitionByRange(*spread, F.substring("text", 1, 64).asc()).sortWithinPartitions(*spread, "text")
    return placed.mapInArrow(run, _SEGMENT)


def _solved(segments: DataFrame) -> DataFrame:
    """part, seq, entry state and audit of every segment."""

    def costs(batches):
        yield from _batches(((*row, exit_costs(row[3])) for row in _rows(batches)), f"{key}, codes string, costs array<long>", 64)

    def fold_back(batches):
        def rows():
            for _, group in groupby(_rows(batches), itemgetter(0)):
                exits, last = [0, 2 * INSERT, INSERT, 0], True  # of the end: what is inserted to finish
                for conv, part, seq, codes, table_ in group:
                    yield conv, part, seq, codes, [ENDS.get(q, NEVER) for q in range(4)] if last else exits, last
                    exits, last = [min(NEVER, *(table_[4 * q + to] + exits[to] for to in range(4))) for q in range(4)], False

        yield from _batches(rows(), f"{key}, codes string, exits array<long>, last boolean", 64)

    def walk(batches):
        def rows():
            for conv, part, seq, codes, exits, last in _rows(batches):
                found = [search(codes, q, dict(enumerate(exits)), last) for q in range(4)]
                yield conv, part, seq, [audit for _, audit, _ in found], [end for _, _, end in found]

        yield from _batches(rows(), f"{key}, audits array<string>, outs array<long>", 16)

    def fold_forward(batches):
        def rows():
            for _, group in groupby(_rows(batches), itemgetter(0)):
                state = START
                for _, part, seq, audits, outs in group:
                    yield part, seq, state, audits[state]
                    state = outs[state]

        yield from _batches(rows(), "part int, seq long, entry int, audit string", 64)

    key = "conv_id long, part int, seq long"
    found = segments.select("conv_id", "part", "seq", "codes").mapInArrow(costs, f"{key}, codes string, costs array<long>")
    found = found.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(fold_back, f"{key}, codes string, exits array<long>, last boolean")
    found = found.repartition("part", "seq").mapInArrow(walk, f"{key}, audits array<string>, outs array<long>")  # a conversation's segments part again
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(fold_forward, "part int, seq long, entry int, audit string")


def _long(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    segments = materialise(_segments(rows, most_rows, most_bytes), "repair-segments")
    solved = materialise(_solved(segments), "repair-audits")

    def result(conv: int | None, group: Iterator[tuple]) -> tuple:
        digest, audits, counts, cost = hashlib.sha256(), [], [0, 0, 0, 0, 0], 0
        begun, last, first_turn, last_turn = False, None, None, None
        for s in group:
            lines, _ = repaired(zip(s["roles"], s["texts"]), s["audit"], s["entry"])
            for line in lines:
                digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                begun = True
            audits.append(s["audit"])
            cost += _cost(s["codes"], s["audit"])
            for i, c in enumerate(("blank", "duplicate", "truncated", "illegal", "turns")):
                counts[i] += s[c]
            if s["first"] is not None:
                counts[3] += last is not None and last + s["first"] not in LEGAL
                last = s["last"]
            if s["first_turn"] is not None:
                counts[4] -= s["first_turn"] == last_turn
                first_turn, last_turn = s["first_turn"] if first_turn is None else first_turn, s["last_turn"]
        gaps = last_turn - first_turn + 1 - counts[4] if first_turn is not None else 0
        return conv, gaps, *counts[:4], cost, "".join(audits), digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        yield from _batches((result(conv, group) for conv, group in groupby(found, itemgetter("conv_id"))), RESULT, 16)

    return segments.join(solved, ["part", "seq"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, RESULT)


def _cost(codes: str, audit: str) -> int:
    """What an audit costs over the rows of `codes`."""
    left, total = iter(codes), 0
    for letter in audit:
        code = next(left) if letter != "I" else ""
        total += {"I": INSERT, "D": DELETE, "R": REROLE, "K": 0}[letter] + (TRUNCATED if letter in "KR" and code.isupper() else 0)
    return total


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired conversation for every conv_id of `rows` (conv_id, turn, role, text, fault as `damaged` gives them).

    Rows go by turn, nulls first; rows of one turn by role and text in byte order, so repeats are neighbours. A row of
    role and text seen before is a duplicate, blank ones aside. A conversation all of whose rows are gone has zeros, an empty audit and the
    digest of nothing. A null conv_id is a conversation like others. Roles other than system, user and assistant
    (an empty one too) can be reroled or deleted only. Very long texts and conversations go through segments of bounded rows and bytes, to the same result;
    extra columns are ignored, an empty table gives no rows.
    """
    size = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes))
    long = materialise(size.select(F.col("conv_id").alias("long_id")), "repair-long")
    if long.isEmpty():
        return _ordinary(rows)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _ordinary(rows.join(long, is_long, "left_anti")).unionByName(_long(rows.join(long, is_long, "left_semi"), segment_rows, segment_bytes))


def op11_bidirectional_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations by hash of conv_id and turn and repairs every one of them."""
    return repair(damaged(table(spark, sf_dir, "conversations")))
