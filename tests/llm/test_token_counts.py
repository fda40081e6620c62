import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulseframe.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["hard_docs", "documents"])
def test_counts_equal_the_library(which, request, library):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(rows, library([r.text or "" for r in rows])))
    assert sorted(map(tuple, tc.token_counts(docs, PATH).collect())) == want


def test_fuzz_with_special_strings_and_odd_characters(library):
    rng = random.Random(13)
    bits = ["'", "re", "'re", "'ve", "'d", "s", "\"'", " '", "\n'", "1'", "<|endoftext|>", "<|endoftext|", "<|", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "aaa", "aaaaaaaaa", "the", " the", "é", "漢字", "\U0001f600", "٣", "12", "3.5", "!!", "...", "՘", "\U000187f8", "x" * 40, "İ", "ǅ", "‍"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert tc.TokenCounter(PATH)(texts).tolist() == library(texts)


def test_long_texts_and_long_words(library, monkeypatch):
    monkeypatch.setattr(tc, "BLOCK", 77)
    monkeypatch.setattr(tc, "CACHE_WORDS", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(20000)), "ab " * 9000, "a" * 30001, "a1" * 5000 + " ", "", "\n" * 5000]
    count = tc.TokenCounter(PATH)
    assert count(texts).tolist() == library(texts) and count(texts).tolist() == library(texts)


def test_every_character_splits_as_in_the_library(library):
    rng = random.Random(3)
    points = [cp for cp in range(0x30000) if not 0xD800 <= cp < 0xE000]
    texts = [f"a{chr(cp)}a1{chr(cp)}1 {chr(cp)} {chr(cp)}.{chr(cp)}'s" for cp in rng.sample(points, 8000) + list(range(0x300)) + list(range(0x2000, 0x2100)) + list(range(0x3000, 0x3100))]
    assert tc.TokenCounter(PATH)(texts).tolist() == library(texts)


def test_runs_merge_every_second_place():
    letters = tc.byte_letters()
    vocab = {c: i for i, c in enumerate(letters.values())} | {"aa": 256, "aaa": 257, "ab": 258}
    m = tc.Merges(vocab, [["a", "a"], ["aa", "a"], ["a", "b"]])
    assert m.lengths([b"", b"a", b"aa", b"aaa", b"aaaa", b"aaaaa", b"aaab", b"ab", b"ba"]).tolist() == [0, 1, 1, 1, 2, 2, 2, 1, 2]
    assert tc.Merges(vocab, []).lengths([b"aaa", b"x"]).tolist() == [3, 1]


def test_rows_stay_rows(spark, no_docs):
    assert tc.token_counts(no_docs, PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, 6), (1, "a b", 7, 8), (None, "c", 1, 1), (2, None, 2, 2)], "doc_id long, text string, n_tokens int, n_bytes int")
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(docs, PATH).collect()) == [(-1, 1, 1, False), (1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tc.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
