import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm.tokens import VOCABULARY, Vocabulary, _merge_long, encode, encode_pieces

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def voc():
    return Vocabulary()


@settings(max_examples=300, deadline=None)
@given(s=st.text("abcdefghijklmnopqrstuvwxyz", max_size=40))
def test_pieces_equal_the_library(library, voc, s):
    assert [int(i) for i in encode_pieces(voc, [s.encode()])[0]] == library(s)


def test_long_pieces_merge_alike(voc):
    rng = random.Random(1)
    for alphabet in ("a", "ab", "etaoin", "=-"):
        for n in (1, 2, 3, 7, 50, 501):
            s = "".join(rng.choices(alphabet, k=n)).encode()
            import numpy as np

            assert list(_merge_long(voc, voc.first[np.frombuffer(s, np.uint8)])) == list(encode_pieces(voc, [s])[0])


def test_a_vocabulary_out_of_order_merges_one_by_one(tmp_path, voc):
    """A merge that makes a part of an earlier one: its places may not be merged at once."""
    import json

    import numpy as np

    assert voc.ordered
    with open(VOCABULARY, encoding="utf-8") as f:
        model = json.load(f)["model"]
    single = {c: i for c, i in model["vocab"].items() if len(c) == 1}
    n = max(single.values()) + 1
    odd = {"model": {"vocab": single | {"ab": n, "abc": n + 1, "bc": n + 2}, "merges": ["ab c", "b c", "a b"]}}
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(odd))
    v = Vocabulary(str(path))
    assert not v.ordered
    s = b"abcabab" * 600
    ids = encode_pieces(v, [s, b"ab"])
    one = encode_pieces(v, [s[:7]])[0]
    assert ids[1].tolist() == [n] and ids[0].tolist() == np.tile(one, 600).tolist()


def test_texts(spark, library):
    texts = [
        None, "", " ", "\n\n  \n", "Hello, world! It's 2024.", "<|endoftext|> and <|startoftext|>", "日本語のテキストです。", "emoji 😀👍🏽 ‍", "tabs\tand\r\nlines  ",
        "a" * 5000, "ab" * 40_000, "I'll you've we'd 'S", "��", "x y z", "ṩ́ÄÖ", "1234567890" * 30, "\x1c\x1d a\x85b", "word " * 20_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(4, texts[4])], SCHEMA).withColumn("ids", F.lit("x")).withColumn("key", F.lit("x"))
    got = encode(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert list(r["ids"]) == (library(texts[r["doc_id"]]) if texts[r["doc_id"]] else []), texts[r["doc_id"]]
    assert encode(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, data, library):
    df = spark.read.parquet(f"{data}/documents.parquet")
    want = {r["doc_id"]: library(r["text"]) if r["text"] else [] for r in df.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in encode(df).collect()} == want
