import functools
import hashlib
import random
import re
import zlib

import pytest

from pulseframe.llm import repair as rp

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
INITIALS = re.compile(r"(s?(ua)+)?")


def plain_edits(roles, faults):
    """Least (cost, audit) over all edits, from the end, by nothing but the grammar of role initials; at most three insertions at one place."""

    def step(state, initial):
        grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        return grammar[state].get(initial)

    @functools.cache
    def best(i, state, inserts):
        found = []
        if i == len(roles):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            after = [("D", 2, state)]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if roles[i][:1] and step(state, roles[i][:1]):
                    after.append(("K", more, step(state, roles[i][:1])))
                after += [("R", 1 + more, step(state, r)) for r in "ua" if step(state, r)]
            for letter, cost, to in after:
                c, a = best(i + 1, to, 3)
                found.append((cost + c, letter + a))
        if inserts:
            for r in "ua":
                if step(state, r):
                    c, a = best(i, step(state, r), inserts - 1)
                    found.append((5 + c, "I" + a))
        return min(found, default=(10**9, ""))

    return best(0, "", 3)


def plain(rows):
    """Every conversation of (conv_id, turn, role, text) rows, straight from the definition."""
    convs = {}
    for conv, turn, role, text in rows:
        here = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        here += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = []
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in here:
            told = text.strip(WHITE)
            faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
            seen.add((role, text))
        roles = [r[1] for r in here]
        cost, audit = plain_edits(tuple(roles), tuple(faults))
        lines, initials, left = [], "", iter(here)
        for letter in audit:
            role, text = next(left)[1:] if letter != "I" else ("", "")
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if initials[-1:] == "u" else "user"
            lines.append(f"{role}:{text}")
            initials += role[0]
        assert INITIALS.fullmatch(initials)
        turns = [t for t, _, _ in here if t is not None]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def hard_rows(n=700, seed=11):
    rng = random.Random(seed)
    texts = [None, "", " \n", "Yes.", "Yes.", "no end", "Why?", "x" * 3000 + "!", " nbsp\xa0", "…", "a. \t", "ü.", "b!\x85"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "Üser", "a", "sys"]
    return [(rng.choice([None, -7, *range(60)]), rng.choice([None, *range(9), -3, 40]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("entry", range(4))
def test_search_equals_all_edits(entry):
    rng = random.Random(entry)
    for _ in range(400):
        codes = "".join(rng.choice("ssuuuaaaxxddSUAX") for _ in range(rng.randrange(9)))
        roles = tuple(c.lower() if c != "d" else "u" for c in codes)
        faults = tuple("blank" if c == "d" else "truncated" if c.isupper() else "" for c in codes)
        want = plain_edits(roles, faults)
        assert rp.search(codes)[:2] == want
        assert rp._cost(codes, want[1]) == want[0]


def test_segments_fold_to_the_whole():
    """Exit costs of parts, folded, give the cost and the audit of the whole."""
    rng = random.Random(5)
    for _ in range(150):
        codes = "".join(rng.choice("suuuaaaxxdSUAX") for _ in range(rng.randrange(1, 30)))
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(3))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        exits, plans = dict(rp.ENDS), []
        for k, part in reversed(list(enumerate(parts))):
            last = k == len(parts) - 1
            plans.append((part, dict(exits), last))
            exits = {q: rp.search(part, q, exits, last)[0] for q in range(4)}
            if not last:
                table = rp.exit_costs(part)
                assert [min(table[4 * q + t] + plans[-1][1][t] for t in range(4)) for q in range(4)] == [min(c, rp.NEVER) for c in exits.values()] or max(exits.values()) >= rp.NEVER
        state, audit = rp.START, ""
        for part, ends, last in reversed(plans):
            _, piece, state = rp.search(part, state, ends, last)
            audit += piece
        cost, want, _ = rp.search(codes)
        assert (exits[rp.START], audit) == (cost, want)


def test_long_lattice():
    codes = "".join(random.Random(2).choice("suuaaaxdUA") for _ in range(5000))
    cost, audit, _ = rp.search(codes)
    assert rp._cost(codes, audit) == cost and sum(c != "I" for c in audit) == len(codes)


@pytest.mark.parametrize("bound", [4096, 3, 0])
def test_conversations_equal_the_definition(spark, bound):
    """Also when every conversation, or every one of more than three rows, is cut into segments of two rows."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] if bound else []
    rows += hard_rows()
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, cost int").repartition(5)
    assert got(rp.repair(rp.damaged(docs), long_rows=bound, segment_rows=2)) == plain(rows)


def test_bytes_make_a_conversation_long(spark):
    rows = [(i % 3, i, "user" if i % 2 else "assistant", f"word {i}.") for i in range(60)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(rp.repair(rp.damaged(docs), long_bytes=10, segment_bytes=20)) == plain(rows)


def test_empty_table(spark):
    assert rp.repair(rp.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
