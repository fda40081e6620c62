import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulseframe.llm import rans

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    model = Tokenizer.from_file(PATH)
    at, out = 0, []
    for doc, text in sorted(rows):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("which", ["hard_docs", "documents"])
def test_round_trip_equals_plain_encoding(which, request):
    docs = request.getfixturevalue(which)
    got = sorted(tuple(r) for r in rans.round_trip(docs, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_special_strings_are_the_librarys(monkeypatch):
    import random

    import pyarrow as pa

    from pulseframe.llm.token_ids import PieceEncoder

    rng = random.Random(4)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "\t", "abc", "Word", "word.", "é", "12", "'s", "it's", "<", "|", ">", "endoftext", "\xa0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(4000)] + ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|startoftext|>y"]
    ids, at = PieceEncoder(PATH)(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want and any(49406 in w for w in want) and any(49407 in w for w in want)


def test_empty_table(no_docs):
    assert rans.round_trip(no_docs, PATH).count() == 0


def test_repeated_doc_ids_keep_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert rans.round_trip(docs, PATH).count() == 4


@pytest.mark.parametrize("n", [1, 2, 255, 5000, 70001])
def test_blocks_and_segments(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 1000).astype(np.uint32)
    table = rans.Frequencies(*np.unique(ids, return_counts=True))
    assert table.freq.sum() == 1 << rans.SCALE
    block = rans.encode_block(ids, table.encoder(), table.key, lanes=32, every=16)
    slots = table.decoder()
    assert (rans.decode_block(block, slots, table.encoder(), table.key) == ids).all()
    marks = rans.HEAD.unpack_from(block)[5]
    parts = [rans.decode_segment(block, k, slots, table.encoder()) for k in reversed(range(marks))]
    assert (np.concatenate(parts[::-1]) == ids).all()
    broken = bytearray(block)
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), slots, table.encoder(), table.key)
    alone = [rans.decode_block(rans.segment_block(block, k), slots, table.encoder(), table.key) for k in reversed(range(marks))]
    assert (np.concatenate(alone[::-1]) == ids).all()


READ = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[2])
from pulseframe.llm import rans
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = rans.digest(rans.read_blocks(spark, sys.argv[1])).collect()
print("READ", sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))
"""


def test_files_stand_alone(spark, documents, monkeypatch, tmp_path):
    """Another process reads the folder with nothing but its path; segments decode as rows of their own."""
    import os
    import subprocess
    import sys

    from pulseframe.llm.token_ids import token_table, unit

    monkeypatch.setattr(rans, "BLOCK_IDS", 1 << 16)
    tokens = token_table(documents, PATH, 2)
    path = rans.write_blocks(tokens, rans.count_ids(tokens, unit(PATH)), unit(PATH))
    want = [(d, n, c) for d, _, n, c in expected([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])]
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", READ, path, root], capture_output=True, text=True, env=env, timeout=300)
    assert f"READ {want}" in out.stdout, out.stderr[-2000:]
    parts = rans.read_segments(spark, path, 3).collect()
    whole: dict = {}
    for r in sorted(parts, key=lambda r: (r.shard, r.block_no, r.segment)):
        whole[r.shard, r.block_no] = whole.get((r.shard, r.block_no), b"") + r.ids
    blocks: dict = {}
    for r in sorted(rans.read_blocks(spark, path).collect(), key=lambda r: (r.shard, r.block_no, r["at"])):
        blocks[r.shard, r.block_no] = blocks.get((r.shard, r.block_no), b"") + r.ids
    assert whole == blocks and len(parts) > len(blocks)


def test_damaged_frequencies_are_refused():
    table = rans.Frequencies(np.array([1, 5]), np.array([3, 4]))
    again = rans.Frequencies.of_rows(table.rows())
    assert again.key == table.key and (again.start == table.start).all() and len(rans.Frequencies.of_rows([]).freq) == 0
    for rows in (table.rows()[:1], [(9, *r[1:]) for r in table.rows()], [(*r[:3], r[3] + 1) for r in table.rows()]):
        with pytest.raises(ValueError):
            rans.Frequencies.of_rows(rows)
