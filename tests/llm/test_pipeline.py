"""The stages one after another, each against a plain version of its decision."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, corpus_pipeline.materialise(stage(spark, out[-1][1], SF), name)))
    return out


def test_columns_and_shrinking(steps):
    first = steps[0][1]
    for (_, a), (_, b) in zip(steps[:-2], steps[1:-1]):
        assert b.columns == first.columns and b.dtypes == first.dtypes
        assert {r[0] for r in b.select("doc_id").collect()} <= {r[0] for r in a.select("doc_id").collect()}


def test_each_decision_takes_effect(spark, steps):
    from pulseframe.llm import decontam, neardup, toxicity

    at = dict(steps)
    ids = {k: {r[0] for r in v.select("doc_id").collect()} for k, v in at.items()}
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(at["documents"], labels).collect()}
    assert ids["toxicity"] == {d for d in ids["documents"] if scores[d] < toxicity.THRESHOLD}
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(at["toxicity"]).collect()}
    assert ids["near_duplicates"] == {d for d in ids["toxicity"] if classes[d] == d}
    assert decontam.contaminated(at["decontamination"], bench).count() == 0
    assert ids["segmentation"] == ids["decontamination"]


def test_clean_documents_stay_whole(spark, steps):
    at = dict(steps)
    before = {r.doc_id: r.text for r in at["near_duplicates"].collect()}
    after = {r.doc_id: r.text for r in at["substring_dedup"].collect()}
    assert sum(after.get(d) == t for d, t in before.items()) > 0.5 * len(before)
    assert all(len(after[d]) <= len(before[d]) for d in after)


def test_stages_against_brute_force(spark, steps):
    """Near duplicates by all pairs; repeated passages and benchmark passages by sets of word windows."""
    from test_neardup import brute

    at = {k: {r.doc_id: r.text for r in v.select("doc_id", "text").collect()} for k, v in steps[:-1]}
    classes = brute(list(at["toxicity"].items()))
    wrong = {d for d in at["toxicity"] if (classes[d] == d) != (d in at["near_duplicates"])}
    assert len(wrong) <= 0.01 * len(at["toxicity"])
    before, after = at["near_duplicates"], at["substring_dedup"]
    width, seen, missed, changed = 55, {}, 0, 0
    for d in sorted(before):
        windows = lambda t: {" ".join(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1)}
        mine = windows(before[d])
        repeats = any(seen.get(w, d) != d for w in mine)
        missed += repeats and any(seen.get(w, d) != d for w in windows(after.get(d, "")))
        changed += after.get(d) != before[d]
        for w in mine:
            seen.setdefault(w, d)
        words = before[d].split()
        kept = iter(words)
        assert all(any(w.endswith(x) or w.startswith(x) for w in kept) for x in after.get(d, "").split()[:3])
    assert changed > 0 and missed <= 0.05 * changed
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {" ".join(t[i : i + 20]) for t in items for i in range(len(t) - 19)}
    for d, t in at["substring_dedup"].items():
        words = t.lower().split()
        if any(" ".join(words[i : i + 20]) in grams for i in range(len(words) - 19)):
            assert d not in at["decontamination"]


def test_the_result_holds_every_text_as_pieces(spark, steps):
    from pulseframe.llm import pieces
    import public_tokenizers

    at = dict(steps)
    texts = {r.doc_id: (r.text or "") for r in at["decontamination"].select("doc_id", "text").collect()}
    count = {}
    for r in pieces.decode_ids(at["segmentation"], public_tokenizers.path("piece_bpe_32k.model")).collect():
        assert r.text == texts[r.doc_id].replace("▁", " ")
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(count[d] == pieces.EPOCHS for d, t in texts.items() if len(t) > 20)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
