import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pulseframe.llm import prefix_trie as pt

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """All nodes, straight from the definition."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()[: pt.WIDTH]
            convs[conv].append((turn is not None, turn or 0, role, key, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [total[k] for k in kids[path]]
        total[path] = (sum(x for x, _ in below) or 1, (len(members[path]) - 1) * words + sum(x for _, x in below))
    out = []
    for path, m in members.items():
        ends = hashlib.sha256(",".join(str(c) for c, e in m if e).encode()).hexdigest()
        out.append((m[0][0], len(path), members[path[:-1]][0][0] if path else None, len(m), len(kids[path]), *total[path], ends))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def hard_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(-45, 130)]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "", None]), rng.choice(["a b", "a  b c", "", None, " \t", "x" * 4000])) for _ in range(n)]


def shared_beginnings():
    """A first turn and a beginning of thirty turns that most conversations share, copies, and one long conversation."""
    rows = [(c, t, "user", "hello there") for c in range(0, 400, 20) for t in range(30)]
    rows += [(c, 30 + t, "assistant", f"w {c % 7} {t} z") for c in range(0, 400, 20) for t in range(c % 5)]
    rows += [(c, t, "user", "hello there" if t < 3 else f"own {c % 3} {t}") for c in range(1, 200) for t in range(3 + c % 4)]
    return rows + [(2001, t, "user", f"turn {t % 9}") for t in range(500)]


@pytest.mark.parametrize("which,suffixes,turns", [("hard", 256, 1 << 16), ("hard", 2, 1 << 16), ("shared", 256, 1 << 16), ("shared", 3, 40), ("shared", 10**6, 5), ("table", 1, 1 << 16)])
def test_nodes_equal_the_definition(spark, which, suffixes, turns):
    if which == "table":
        rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    else:
        rows = hard_rows(600, 3) if which == "hard" else shared_beginnings()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, depth int, ids string").repartition(4)
    assert got(pt.conversation_trie(docs, suffixes, turns)) == plain(rows)


def test_one_sequence_many_conversations(spark, monkeypatch):
    """Members of one node are named in blocks."""
    monkeypatch.setattr(pt, "BLOCK_IDS", 7)
    rows = [(c, 0, "user", "same words here") for c in range(-60, 300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(pt.conversation_trie(docs)) == plain(rows)


def test_conversations_without_turns(spark):
    """Conversations shorter than their borrowed beginning, whose base is absent, end at the root."""
    rows = [(c, 0, None, None) for c in (1, 2, 3, 5, 21, 22, 27)]
    assert got(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_no_conversations(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
