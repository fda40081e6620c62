import zlib
from collections import Counter

import pytest

from pulseframe.llm import sharding


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    got = sorted((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert got == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)


@pytest.mark.parametrize("which", ["hard_docs", "documents"])
def test_quotas_slots_and_sizes(which, request):
    docs = request.getfixturevalue(which)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(sharding.shard_documents(docs).collect(), texts, 8)


def test_groups_stay_together_and_a_hot_group_is_split(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i // 4}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs).collect()
    check(got, rows, 8)
    text = dict(rows)
    homes: dict = {}
    for r in got:
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert len(homes["hot"]) <= 4
    assert sum(len(h) > 1 for t, h in homes.items() if t != "hot") <= 12


def test_links_pull_nodes_together(spark):
    nodes = spark.createDataFrame([(i, i % 50) for i in range(1000)], "node long, link long")
    got = sharding.propagate(nodes, 4).collect()
    homes: dict = {}
    for r in got:
        homes.setdefault(r.link, set()).add(r.shard)
    assert sorted(Counter(r.shard for r in got).values()) == [250] * 4
    assert sum(len(h) - 1 for h in homes.values()) <= 6


def test_empty_table(no_docs):
    assert sharding.shard_documents(no_docs).count() == 0


@pytest.mark.parametrize("task_rows", [sharding.TASK_ROWS, 5])
def test_groups_cut_at_a_bound_are_reunited(spark, monkeypatch, task_rows):
    """5 task rows: several buckets for each order, as from 25.6 million rows on."""
    monkeypatch.setattr(sharding, "TASK_ROWS", task_rows)
    nodes = spark.createDataFrame([(i, i % 12 if i < 600 else None) for i in range(1600)], "node long, link long")
    got = sharding.propagate(nodes, 8).collect()
    assert len({r.node for r in got}) == 1600 and sorted(Counter(r.shard for r in got).values()) == [200] * 8
    homes: dict = {}
    for r in got:
        if r.link is not None:
            homes.setdefault(r.link, set()).add(r.shard)
    assert [len(h) for h in homes.values()] == [1] * 12


def cut_between(rows, texts):
    """Members of each set of texts that share a sentence outside the shard with most of them, from all sentences, in plain Python."""
    import re

    shard = {r.doc_id: r.shard for r in rows}
    holders: dict = {}
    for d, t in texts:
        for piece in {x for x in re.split(r"[.!?\n]+\s*", (t or "").lower()) if len(x) >= sharding.LONG}:
            holders.setdefault(piece, set()).add(d)
    cut = 0
    for docs in holders.values():
        if 1 < len(docs) <= len(texts) / 64:
            cut += len(docs) - max(Counter(shard[d] for d in docs).values())
    return cut


def test_rounds_cut_fewer_links_than_the_start(spark):
    """Communities of texts that share sentences begin scattered by their hashes and are gathered, sizes even throughout."""
    import random

    rng = random.Random(6)
    line = lambda: "".join(rng.choice("abcdefgh") for _ in range(40))
    rows = []
    for c in range(60):
        common = [line() for _ in range(3)]
        rows += [(c * 100 + k, ". ".join([*rng.sample(common, 2), *(line() for _ in range(2))])) for k in range(12)]
    rows += [(10_000 + i, line()) for i in range(1500)] + [(20_000 + i, f"same {i // 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, after = (sharding.shard_documents(docs, rounds=n).collect() for n in (0, 12))
    check(after, rows, 8)
    assert cut_between(after, rows) < 0.5 * cut_between(before, rows)
    homes: dict = {}
    text = dict(rows)
    for r in after:
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert max(map(len, homes.values())) == 1


def test_rounds_cut_fewer_links_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    before, after = (sharding.shard_documents(docs, rounds=n).collect() for n in (0, 12))
    check(after, texts, 8)
    assert cut_between(after, texts) < cut_between(before, texts)


def test_the_result_does_not_depend_on_how_rows_are_stored(spark, hard_docs):
    for docs in (hard_docs, hard_docs.unionByName(hard_docs)):
        one, other = ({tuple(r) for r in sharding.shard_documents(d).select("doc_id", "text_crc32", "shard", "slot").collect()} for d in (docs.coalesce(1), docs.repartition(7, "n_chars")))
        assert one == other
