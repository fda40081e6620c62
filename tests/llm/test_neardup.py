import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from pulseframe.llm import neardup as nd
from pulseframe.llm.components import connected_components


def brute(rows):
    """Classes from all pairs with plain dictionaries."""
    import re

    docs = {}
    for d, t in rows:
        if d is not None:
            docs.setdefault(d, t or "")
    grams = {}
    for d, t in docs.items():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        grams[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    n = len(rows)
    df = Counter(g for _, t in rows for g in set(grams[_] if _ is not None else ()))
    idf = {g: 1 + math.log((1 + n) / (1 + max(c, nd.RARE * n))) for g, c in df.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = grams[a], grams[b]
        if x and y and x.keys().isdisjoint(y.keys()):
            continue
        if x and y:
            low = sum(min(x[g], y[g]) * idf[g] for g in x.keys() & y.keys())
            high = sum(v * idf[g] for g, v in x.items()) + sum(v * idf[g] for g, v in y.items()) - low
            link = low / high >= nd.THRESHOLD
        else:
            link = docs[a] == docs[b]
        if link:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {d: root(d) for d in docs}


def sample(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0 or not rows:
            rows.append((i * 7 + 1, " ".join(word() for _ in range(rng.randint(3, 200)))))
        elif kind == 1:
            rows.append((i * 7 + 1, rng.choice(rows)[1]))
        elif kind == 2:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((i * 7 + 1, " ".join(w)))
        else:
            rows.append((i * 7 + 1, " ".join([word() for _ in range(40)] + shared + [word() for _ in range(30)])))
    return rows + [(9000, None), (9001, ""), (9002, "?!"), (9003, "?!"), (9004, "Two words"), (9005, "two WORDS."), (9006, "x " * 3000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = sample(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(300)] = f"new{rng.randrange(1 << 40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(30))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(docs).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0} and all(r.class_id == r.doc_id for r in got if r.doc_id >= 1000)


def test_hard_rows_and_stage(spark, hard_docs, no_docs):
    twice = hard_docs.unionByName(hard_docs).unionByName(hard_docs.selectExpr("cast(null as bigint) doc_id", *hard_docs.columns[1:]).limit(2))
    rows = nd.near_duplicates(twice).collect()
    assert len(rows) == twice.count()
    kept = nd.keep_one_of_each(spark, hard_docs, "")
    assert kept.columns == hard_docs.columns and kept.filter("text like 'One two%'").count() == 1
    assert nd.near_duplicates(no_docs).count() == 0


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    h = nd.mix(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    x, y = np.where(np.arange(400) < 300, 1.0, 0), np.where(np.arange(400) >= 60, 1.0, 0)
    x[:50] *= 3
    y[100:150] *= 2
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    old = nd.BANDS
    nd.BANDS = 400
    try:
        s = nd.Sampler(1.0)
        a, b = (s(h[w > 0], w[w > 0], np.array([0]))[:, 0] for w in (x, y))
    finally:
        nd.BANDS = old
    assert abs((a == b).mean() - want) < 0.04


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    assert got == {x: root(x) for x in parent}


def test_chains_of_links_join_texts_that_are_far_apart(spark):
    """Neighbours share 92 of 102 shingles, the ends share none; a gap of 25 words breaks the chain."""
    rows = [(i, " ".join(f"w{k}" for k in range(5 * i, 5 * i + 101))) for i in range(30)]
    rows += [(100 + i, " ".join(f"w{k}" for k in range(170 + 5 * i, 170 + 5 * i + 101))) for i in range(5)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) == 2


@pytest.mark.parametrize("seed", [3, 4])
def test_parts_of_buckets_and_clouds_give_the_same_classes(spark, monkeypatch, seed):
    monkeypatch.setattr(nd, "BUCKET_PART", 3)
    monkeypatch.setattr(nd, "CLOUD_PART", 4)
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    rows = sample(seed)
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(120)] = f"n{rng.randrange(1 << 40)}"
        rows.append((20_000 + i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and max(map(list(got.values()).count, set(got.values()))) > 8


def test_rows_that_share_a_doc_id_keep_their_own_text(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(1, "first text of one id here"), (1, long), (2, long), (3, "third"), (3, "third"), (None, "third"), (None, "lone"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in nd.keep_one_of_each(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, "first text of one id here"), (1, long), (3, "third"), (None, "lone")], key=str)


def test_recall_on_the_given_documents(spark):
    """Against all pairs of the given table by an inverted index over the same weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    want = brute(rows)
    wrong = [d for d in want if want[d] != got[d]]
    assert len(wrong) <= 0.01 * sum(want[d] != d for d in want)
