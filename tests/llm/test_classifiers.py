import numpy as np
import pyarrow as pa
import pytest

from pulseframe.llm import ngrams, quality, toxicity

BIG = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score))
    pos = y > 0
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / max(1, pos.sum() * (~pos).sum())


@pytest.mark.parametrize("score, label, least", [(quality.quality_scores, "quality", 0.97), (toxicity.toxicity_scores, "toxic", 0.95)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    assert (rows["predicted"] == rows[label]).mean() > 0.93


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_hard_rows(spark, score, hard_docs, no_docs):
    labels = spark.createDataFrame([(i * 3, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = score(hard_docs.unionByName(hard_docs), labels).collect()
    assert len(rows) == 2 * hard_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id: dict = {}
    for r in rows:
        assert by_id.setdefault(r.doc_id, r.score) == r.score
    assert score(no_docs, labels).count() == 0
    assert {r.score for r in score(hard_docs, labels.limit(0)).collect()} == {0.5}


def test_features_are_distinct_and_per_text():
    for grams in (ngrams.skip_grams, ngrams.shape_grams):
        of, values, n = grams(pa.array(["a b a b", None, "a b a b", "Ärger!! 12 x"]))
        assert n == 4 and set(of) == {0, 2, 3}
        assert (values[of == 0] == values[of == 2]).all() and len(set(values[of == 0])) == (of == 0).sum()


def _rows(seed, n=120, features=40):
    rng = np.random.default_rng(seed)
    x = [np.sort(rng.choice(features, rng.integers(1, 8), replace=False)).astype(np.uint32) for _ in range(n)]
    return x, np.array([int(rng.random() < (0.85 if 3 in v or 5 in v else 0.2)) for v in x], dtype=np.int8)


def test_ftrl_equals_plain_loops():
    """Coordinate by coordinate with dictionaries, in the same order of rows."""
    import math

    x, y = _rows(1)
    alpha, beta, l1, passes, seed = 0.5, 1.0, 0.8, 3, 11
    z, n = {}, {}
    rate = y.mean()
    prior = math.log(rate / (1 - rate))
    bz = bn = 0.0
    rng = np.random.default_rng(seed)

    def weight(j):
        v = z.get(j, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(j, 0.0))) / alpha)

    for _ in range(passes):
        for i in rng.permutation(len(y)):
            w = {int(j): weight(int(j)) for j in x[i]}
            bias = prior - bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y[i]
            for j, v in w.items():
                step = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / alpha
                z[j] = z.get(j, 0.0) + g - step * v
                n[j] = n.get(j, 0.0) + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * (bias - prior)
            bn += g * g
    got, bias = toxicity.fit_ftrl(x, y, alpha=alpha, beta=beta, l1=l1, passes=passes, seed=seed)
    assert np.allclose([got[j] for j in range(40)], [weight(j) for j in range(40)]) and np.count_nonzero(got) == sum(weight(j) != 0 for j in range(40)) < 40
    assert np.isclose(bias, prior - bz / ((beta + math.sqrt(bn)) / alpha))


def test_count_ratios_and_hinge_fit_reach_the_optimum():
    """Ratios against plain counts; the dual's optimum against the primal objective of the returned weights and of changed ones."""
    x, y = _rows(2)
    ratio = quality.count_ratios(x, y)
    for j in range(40):
        p, q = (1 + sum(j in v for v, t in zip(x, y) if t == c) for c in (1, 0))
        assert np.isclose(ratio[j], np.log(p / (1 + (y == 1).sum())) - np.log(q / (1 + (y == 0).sum())))
    scaled = [ratio[v] for v in x]
    w, bias = quality.fit_hinge(x, scaled, y, cost=0.5, passes=3000)
    sign = np.where(y > 0, 1.0, -1.0)
    cost = 0.5 * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y == 0).sum()))

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - s * (w[v] @ u + b)) for c, s, v, u in zip(cost, sign, x, scaled))

    best = primal(w, bias)
    rng = np.random.default_rng(0)
    for size in (0.3, 0.03):
        for _ in range(60):
            other = w.copy()
            other[:40] += rng.normal(0, size, 40)
            assert primal(other, bias + rng.normal(0, size)) >= best - 1e-2


def test_stages_of_hard_rows(spark, hard_docs, no_docs):
    from pulseframe.llm import pieces

    place = "/root/testdata/sf0.001"
    more = hard_docs.unionByName(hard_docs).unionByName(hard_docs.selectExpr("cast(null as bigint) doc_id", *hard_docs.columns[1:]).limit(2))
    kept = toxicity.reject_toxic(spark, more, place)
    assert kept.columns == more.columns and kept.count() <= more.count() and toxicity.reject_toxic(spark, no_docs, place).count() == 0
    fates = {}
    for r in kept.select("doc_id", "text").collect():
        fates[r.doc_id] = fates.get(r.doc_id, 0) + 1
    assert all(n == 2 for n in fates.values())
    made = pieces.encode_stage(spark, more, place)
    assert made.select("doc_id").distinct().count() == hard_docs.count() + 1 and pieces.encode_stage(spark, no_docs, place).count() == 0
