import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from pulseframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(PATH)


def all_paths(vocab, text):
    """Every segmentation of a short text with its weight, by recursion over a plain dictionary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    whole = "▁" + text.replace(" ", "▁")

    def rest(at):
        if at == len(whole):
            yield (), 0.0
            return
        options = [(to, (known[whole[at:to]],)) for to in range(at + 1, min(len(whole), at + 16) + 1) if whole[at:to] in known]
        if not any(to == at + 1 for to, _ in options):
            options.append((at + 1, tuple(int(vocab.byte_id[b]) for b in whole[at].encode())))
        for to, ids in options:
            for tail, w in rest(to):
                yield ids + tail, w + sum(vocab.log_w[i] for i in ids)

    found = dict(rest(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: w - total for k, w in found.items()}


def draw(vocab, text, keys, draws):
    made = pieces.Batch(vocab, [text] * len(keys))
    return [[(tuple(int(i) for i in made.ids(a)), *x) for a, *x in found] for found in made.draw(keys, draws)]


@pytest.mark.parametrize("text", ["cat", "a b", "the\nend", "é漢 z", "hello"])
def test_all_segmentations_in_order_with_their_probabilities(vocab, text):
    truth = all_paths(vocab, text)
    got = draw(vocab, text, pieces.mix(np.arange(3, dtype=np.uint64)), len(truth) + 3)
    for found in got:
        assert {ids for ids, *_ in found} == set(truth) and len(found) == len(truth)
        values = [v for _, _, v, _ in found]
        assert values == sorted(values, reverse=True)
        for ids, log_p, _, inclusion in found:
            assert math.isclose(log_p, truth[ids], abs_tol=1e-9) and inclusion == 0.0


def test_draws_follow_the_law_without_replacement(vocab):
    text, n = "the", 20000
    truth = {k: math.exp(v) for k, v in all_paths(vocab, text).items()}
    got = draw(vocab, text, pieces.mix(np.arange(n, dtype=np.uint64)), 2)
    for ids, p in truth.items():
        share = sum(f[0][0] == ids for f in got) / n
        assert abs(share - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for a, b in itertools.permutations(truth, 2):
        p = truth[a] * truth[b] / (1 - truth[a])
        share = sum(f[0][0] == a and f[1][0] == b for f in got) / n
        assert abs(share - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    # inverse-inclusion weights estimate the total mass without bias
    weights = [sum(math.exp(lp - inc) for _, lp, _, inc in f) for f in got]
    assert abs(np.mean(weights) - 1) < 5 * np.std(weights) / math.sqrt(n) + 1e-3


def test_rows_decode_to_their_texts_and_do_not_depend_on_neighbours(vocab, hard_docs, documents):
    for docs in (hard_docs, documents):
        texts = {r.doc_id: (r.text or "") for r in docs.select("doc_id", "text").collect()}
        got = pieces.sample_segmentations(docs, PATH, 2, digest=True).collect()
        assert {r.doc_id for r in got} == set(texts)
        for r in got:
            assert r.decoded_crc32 == zlib.crc32(texts[r.doc_id].replace("▁", " ").encode())
        alone = pieces.sample_segmentations(docs.repartition(7), PATH, 2, digest=True).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, alone))
        two = {}
        for r in got:
            two.setdefault(r.doc_id, []).append((r.ids_crc32, r.rank))
        assert all(len({c for c, _ in v}) == len(v) for v in two.values())
        assert all(len(two[d]) == 2 for d in texts if len(texts[d]) > 3 and texts[d].isascii() and texts[d].strip())


def test_decoding_rows(spark, vocab):
    docs = spark.createDataFrame([(1, "two words"), (2, "tab\there ☃"), (3, "")], "doc_id long, text string")
    rows = pieces.decode_ids(pieces.sample_segmentations(docs, PATH, 3), PATH).collect()
    assert {(r.doc_id, r.text) for r in rows} == {(1, "two words"), (2, "tab\there ☃"), (3, "")}


def test_the_stage_keeps_the_pieces(spark, vocab, hard_docs):
    """All ids are in the result, decode to the whole texts and agree with their digests."""
    texts = {r.doc_id: (r.text or "") for r in hard_docs.select("doc_id", "text").collect()}
    rows = pieces.encode_stage(spark, hard_docs, "")
    found = {}
    for r in pieces.decode_ids(rows, PATH).collect():
        assert r.text == texts[r.doc_id].replace("▁", " ")
        assert r.n_pieces == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) and r.decoded_crc32 == zlib.crc32(r.text.encode())
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(texts)
    for d, own in found.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and len({bytes(r.ids) for r in own}) == len(own)
        assert [r.perturbed for r in own] == sorted((r.perturbed for r in own), reverse=True)
        known = len(all_paths(vocab, texts[d])) if 0 < len(texts[d]) < 6 else 4 if texts[d] else 1
        assert len(own) == min(known, 4)
    assert pieces.encode_stage(spark, hard_docs.limit(0), "").columns == rows.columns


def test_the_third_draw_searches_all_paths(vocab):
    """With two draws only the first path's sets can be opened; further ones open those of later paths and shut sets again."""
    keys = pieces.mix(np.arange(200, dtype=np.uint64))
    made = pieces.Batch(vocab, ["the cat"] * len(keys))
    root = [f[0][0].tolist() for f in made.draw(keys, 2)]
    branches = 0
    for first, found in zip(root, made.draw(keys, pieces.EPOCHS)):
        shared = [[next(i for i, (x, y) in enumerate(zip(a, b)) if x != y) for a in (f[0].tolist() for f in found[:k])] for k, b in enumerate((f[0].tolist() for f in found)) if k]
        assert found[0][0].tolist() == first
        branches += any(max(at) > at[0] for at in shared[1:])
    assert branches > 0


def test_empty_table(no_docs):
    assert pieces.sample_segmentations(no_docs, PATH, 2).count() == 0
