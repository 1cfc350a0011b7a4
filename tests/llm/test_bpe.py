import base64
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    flat, n, *_ = bpe.encoder().encode_batch(texts)
    out, at = [], 0
    for k in n:
        out.append(flat[at : at + k].tolist())
        at += k
    return out


ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", "m", "S", " ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "B", "é", "日", "ß", "1", "٣", "½", "!", "?", "—", "’", "😀", "́", "<|endoftext|>", "\x00", "_"]


def test_random_texts(truth):
    r = random.Random(4)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(6000)]
    assert ids(texts) == [truth.encode_ordinary(t) for t in texts]


def test_scan_across_blocks(truth):
    for n in (bpe.BLOCK - 1, bpe.BLOCK, bpe.BLOCK + 1, bpe.BLOCK**2 + 3):
        t = ("don't  we'll\n\n x" * (n // 8 + 1))[:n]
        assert ids(["", t, " ", t]) == [[], truth.encode_ordinary(t), truth.encode_ordinary(" "), truth.encode_ordinary(t)]


def test_very_long_pieces(truth):
    for t in ("a" * 100_000, " " * 50_000 + "x", "ab" * 40_000, "!" * 30_000, "日本" * 20_000):
        assert ids([t]) == [truth.encode_ordinary(t)]


def test_offsets_and_decoding(spark):
    data = [(1, "we'll  see\n"), (2, None), (3, ""), (3, ""), (4, " \t "), (5, "日本 x" * 1000)]
    df = spark.createDataFrame(data, "id int, text string").withColumn("e", bpe.encode_with_offsets(F.col("text")))
    rows = df.select("id", "text", "e", bpe.decode(F.col("e.ids")).alias("back"), bpe.count_tokens(F.col("text")).alias("n")).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.back == (r.text or "") and r.n == len(r.e.ids) == sum(r.e.piece_ids)
        assert list(r.e.piece_at) == sorted(set(r.e.piece_at)) and (not r.text or r.e.piece_at[0] == 0)
    assert [list(r.e.piece_at) for r in rows if r.id == 1] == [[0, 2, 5, 6, 10]]


def test_null_empty_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z")], "id int, text string, ids string")
    assert [list(r[0]) for r in df.select(bpe.encode(F.col("text"))).collect()] == [[], []]
    assert df.limit(0).select(bpe.encode(F.col("text"))).collect() == []
