import random

import pytest

import numpy as np
import pyarrow as pa

from pulseframe.llm import chunks
from pulseframe.llm.textops import buffers


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_cuts_tile_the_texts_and_follow_content():
    rng = random.Random(1)
    texts = [prose(rng, 300), "", "é" * 5000, "x" * 9000, prose(rng, 50)]
    data, offsets = buffers(pa.array(texts))
    ends = chunks.cuts(data, offsets)
    assert ends[-1] == len(data) and (np.diff(ends) > 0).all() and np.diff(np.append(0, ends)).max() <= chunks.LONGEST
    assert set(offsets[1:]) <= {*ends.tolist(), 0}
    for a, b in zip(np.append(0, ends[:-1]), ends):
        bytes(data[a:b]).decode()
    moved, _ = buffers(pa.array(["some words in front " + texts[0]]))
    ends2 = chunks.cuts(moved, np.array([0, len(moved)]))
    one, shift = ends[ends <= offsets[1]], len(moved) - offsets[1]
    assert set((one[one > 40] + shift).tolist()) <= set(ends2.tolist())


def test_cuts_do_not_depend_on_the_texts_before():
    rng = random.Random(2)
    text = prose(rng, 200)
    alone, offsets = buffers(pa.array([text]))
    want = chunks.cuts(alone, offsets).tolist()
    for before in ("", "a", prose(rng, 3), prose(rng, 77)):
        data, offsets = buffers(pa.array([before, text]))
        ends = chunks.cuts(data, offsets)
        assert (ends[ends > offsets[1]] - offsets[1]).tolist() == want


def test_repeated_passages_across_documents(spark):
    rng = random.Random(5)
    passages = [prose(rng, 60 + 5 * i) for i in range(20)]
    rows, want = [], set()
    for i, p in enumerate(passages):
        for k in range(3):
            rows.append((i * 10 + k, prose(rng, 80) + " " + p + " " + prose(rng, 70)))
            if k:
                want.add((i * 10 + k, i * 10))
    short = prose(rng, 20)
    rows += [(900 + i, prose(rng, 100) + " " + short + " " + prose(rng, 90)) for i in range(20)]
    rows += [(950, passages[3] * 2), (960, None), (961, ""), (None, passages[0]), (970, rows[0][1]), (970, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunks.repeated_passages(docs).collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in got}
    assert want <= pairs
    assert pairs - want == {(950, 30), (970, 0)}
    text = {d: t.encode() for d, t in rows if t and d is not None}
    for r in got:
        part = text[r.doc_id][r.start : r.start + r.n_bytes]
        assert part in text[r.first_doc_id] and len(part.decode().split()) == r.n_words >= 50


def test_stage_cuts_copies_and_keeps_the_rest(spark):
    rng = random.Random(9)
    p = prose(rng, 80)
    a, b, c = prose(rng, 40) + " ", prose(rng, 40) + " ", prose(rng, 60)
    rows = [(1, a + p, "en", "s", 0), (2, b + p, "en", "s", 0), (3, c, "en", "s", len(c)), (4, c, "en", "s", len(c)), (5, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in chunks.drop_repeats(spark, docs, "").collect()}
    assert set(got) == {1, 2, 3, 5} and got[1].text == a + p and got[3].text == c and got[5].text is None
    assert got[2].text.startswith(b) and len(got[2].text) < len(b) + 130 and got[2].n_chars == len(got[2].text)
    assert list(got[1].asDict()) == docs.columns


def longest_shared(a, b):
    """Words of the longest run of whole words that two word lists share, by suffix comparison."""
    at, best = {}, 0
    for i, w in enumerate(b):
        at.setdefault(w, []).append(i)
    length: dict = {}
    for w in a:
        length = {j: length.get(j - 1, 0) + 1 for j in at.get(w, ())}
        best = max([best, *length.values()])
    return best


def test_against_all_pairs_of_the_given_documents(spark):
    """Every passage is in its source; documents that share 50 words with an earlier one are found, 0.95 of them at least."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = chunks.repeated_passages(docs).collect()
    for r in got:
        part = text[r.doc_id].encode()[r.start : r.start + r.n_bytes]
        assert r.first_doc_id < r.doc_id and part in text[r.first_doc_id].encode()
    words = {d: t.split() for d, t in text.items()}
    grams: dict = {}
    want = set()
    for d in sorted(words):
        mine = {tuple(words[d][i : i + 52]) for i in range(len(words[d]) - 51)}
        if any(g in grams for g in mine):
            want.add(d)
        grams |= dict.fromkeys(mine, d)
    found = {r.doc_id for r in got}
    assert len(want) > 10 and len(want & found) >= 0.95 * len(want)
    for d in found - want:
        assert max(longest_shared(words[d], words[r.first_doc_id]) for r in got if r.doc_id == d) >= 45


def test_periodic_text_and_a_passage_of_pieces(spark):
    rng = random.Random(7)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(1, "tick " * 400), (2, "other start " + "tick " * 300), (3, prose(rng, 30) + " " + a), (4, b + " " + prose(rng, 30)), (5, prose(rng, 9) + " " + a + " " + b + " " + prose(rng, 9)), (6, prose(rng, 20) + " " + a + " " + b)]
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(2, 1), (6, 5)}
    words = {r.doc_id: r.n_words for r in got}
    assert words[6] == 80 and 280 <= words[2] <= 300  # at the one shift that is compared, the repeated word loses its first few


def test_a_passage_twice_in_one_document(spark):
    """Both copies are found and cut, apart from each other or from another source's text."""
    rng = random.Random(21)
    p, q = prose(rng, 80), prose(rng, 60)
    fill = [prose(rng, 40) + " " for _ in range(3)]
    text = fill[0] + p + " " + fill[1] + p + " " + fill[2] + q
    docs = spark.createDataFrame([(1, prose(rng, 20) + " " + p), (2, prose(rng, 20) + " " + q), (3, text)], "doc_id long, text string")
    got = sorted((r.start, r.n_words, r.first_doc_id) for r in chunks.repeated_passages(docs).collect())
    starts = [len(t.encode()) for t in (fill[0], fill[0] + p + " " + fill[1], text[: -len(q)])]
    assert [(s, w, f) for s, (_, w, f) in zip(starts, got)] == [(starts[0], 80, 1), (starts[1], 80, 1), (starts[2], 60, 2)] and [s for s, _, _ in got] == starts
    kept = {r.doc_id: r.text for r in chunks.drop_repeats(spark, docs, "").collect()}
    assert p not in kept[3] and q not in kept[3] and p in kept[1] and q in kept[2]


@pytest.mark.parametrize("reach", [64, 2048])
def test_a_long_stretch_with_two_sources_is_whole(spark, monkeypatch, reach):
    """A document shares 16 KB with one source, the later part of which is known from an earlier one."""
    monkeypatch.setattr(chunks, "REACH", reach)
    rng = random.Random(22)
    long, own = prose(rng, 2400), prose(rng, 70)
    rows = [(0, prose(rng, 30) + " " + long), (1, own + " " + long + " " + prose(rng, 10)), (2, prose(rng, 15) + " " + own + " " + long)]
    got = {(r.doc_id, r.first_doc_id): r for r in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 0].n_words == 2400
    assert got[2, 1].n_words == 2470 and got[2, 1].n_bytes == len((own + " " + long).encode())


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    rng = random.Random(11)
    p, q, r = prose(rng, 90), prose(rng, 90), prose(rng, 70)
    rows = [(1, p), (2, prose(rng, 30) + " " + p), (2, q), (3, q), (3, r), (3, r)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7L as __spans", "8L as other", "9L as key")
    kept = sorted((x.doc_id, x.text) for x in chunks.drop_repeats(spark, docs, "").collect())
    assert kept == sorted([(1, p), (2, rows[1][1][: -len(p)]), (2, q), (3, r), (3, r)])


def test_cuts_of_the_stage_keep_characters_whole(spark):
    """Long words of two-byte letters around and inside the compared spans."""
    rng = random.Random(3)
    p = " ".join("".join(rng.choice("äöüßéè") for _ in range(rng.randint(2, 30))) for _ in range(70))
    rows = [(i, "".join(rng.choice("äöüéè") for _ in range(300 + i)) + p + "".join(rng.choice("äöüéè") for _ in range(200 + i))) for i in range(12)]
    kept = chunks.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(kept) == 12
    for r in kept:
        assert "\ufffd" not in r.text and (len(r.text) < 800 or r.doc_id == 0)


def test_empty_table(no_docs, spark):
    assert chunks.repeated_passages(no_docs).count() == 0
    assert chunks.drop_repeats(spark, no_docs, "").count() == 0


def test_hard_rows(spark, hard_docs):
    got = chunks.repeated_passages(hard_docs.unionByName(hard_docs)).collect()
    assert all(r.doc_id != r.first_doc_id for r in got)
    kept = chunks.drop_repeats(spark, hard_docs, "")
    assert kept.columns == hard_docs.columns and kept.count() == hard_docs.count()
