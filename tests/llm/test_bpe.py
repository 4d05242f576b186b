import random

import pytest
from pyspark.sql import functions as F

from earshot.llm import bpe

ODD = ["", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|> c", "aaaaaaaaaaaaa" * 50, "don't we'll 've 'S", "!" * 300, "ΑΣ ΑΣΑ", "İıſK ﬁ", "x\x1cy\x85z\xa0 　", "é", "<|ENDOFTEXT|>", "日本語 हिन्दी \U0001f600", "a" * 20_000]


def texts():
    rng = random.Random(0)
    letters = "aAbBàéΣςÖß'sllve 0123\n\t!?日\U0001f600"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_the_library(spark, tokenizer):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (got[i]["token_ids"], got[i]["n_tokens"], got[i]["decoded"]) == (ids, len(ids), tokenizer.decode(ids, skip_special_tokens=False)), repr(t[:50])


def test_small_cache_and_chunks(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    for t in texts()[:100]:
        ids, size, _ = codec.encode([codec.split(t)])
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids and size.tolist() == [len(ids)]


def test_nulls_other_columns_and_decoding(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "hello", "y")], "doc_id long, text string, n_tokens string").withColumn("__y", F.lit(1))
    out = bpe.encoded(df)
    assert out.columns == ["doc_id", "__y", "n_tokens", "token_ids", "decoded"]
    assert sorted(r["n_tokens"] for r in out.collect()) == [0, 0, 1]
    back = bpe.decoded(out.drop("decoded").union(spark.createDataFrame([(9, 1, 0, None)], "a long, b int, c long, d array<int>")))
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {1: "", None: "hello</w>", 9: None}
    assert bpe.encoded(df.limit(0)).count() == 0
