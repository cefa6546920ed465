import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.BytePairEncoder(bpe.vocabulary())


def test_same_ids_as_the_library(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in bpe.encode_corpus(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["ids"] == (library.encode(r["text"], add_special_tokens=False).ids if r["text"] else [])


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(own, library, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a" * 5000, " " * 3000, "\r\n\t x", "ሰላም" * 900, "日本語の文" * 500, "👩‍👩‍👧" * 50])
def test_long_and_odd(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids and own.decode(ids) == text


def test_nulls_empties_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x", [1]), (2, "", "x", [1]), (2, "hi", "x", [1])], "doc_id bigint, text string, key string, ids array<int>")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df).collect())
    assert got == [(1, []), (2, []), (2, [5303])]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert df.select(bpe.token_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == 1


def test_another_vocabulary(own):
    other = bpe.BytePairEncoder(bpe.vocabulary("byte_bpe_multi_50k"))
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=other.ranks, special_tokens={})
    for text in ("Hakuna mtu ambaye", "каждый фермер", "ไม่มีใคร", "أيضا تدولهي"):
        assert other.encode(text) == library.encode_ordinary(text)
