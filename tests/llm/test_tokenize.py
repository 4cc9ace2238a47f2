import functools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import tokenize as tk

PATH = tk.tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@functools.lru_cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def peer():
    return library()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\u00a0\u2003\x1c\x85'sStrevmd\\{}$%09½Ⅷ²é\u0301"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_same_ids_as_the_library(text):
    bpe = tk.load(PATH)
    assert bpe.encode(text) == library()(text)
    assert bpe.decode(bpe.encode(text)) == text


def test_odd_texts(peer):
    bpe = tk.load(PATH)
    for text in ["<|endoftext|>", "a" * 3000, " " * 500 + "x", "\r\n\r\n  x", "don't I'LL", "='" * 400, "x\n\n  y", "a  b", "a \n b", "\ufeff", "🙂" * 50]:
        assert bpe.encode(text) == peer(text)


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(tk, "MEMO_ENTRIES", 50)
    bpe = tk.ByteBpe(PATH)
    random.seed(1)
    for _ in range(20):
        text = " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(40))
        assert bpe.encode(text) == tk.load(PATH).encode(text)
    assert len(bpe.spaced) <= 50 and len(bpe.words) <= 51


def test_column(spark, peer):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x", 9), (5, "long " * 20_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = tk.encode_column(df, "doc_id", "text", PATH)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    result = sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr)
    assert result == sorted(((i, peer(t) if t else []) for i, t, _ in rows), key=repr)
    back = {r.doc_id: r.text for r in tk.decode_column(got, "doc_id", "ids", PATH).collect()}
    assert back[5] == "long " * 20_000 and back[2] == ""
    assert tk.encode_column(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_corpus_round_trip(spark, small, duck):
    """Every document comes back as stored, none is missing."""
    from gridloom.llm.queries import oracle_sql, p6_round_trip

    got = sorted(map(tuple, p6_round_trip(spark, small).collect()))
    assert got == sorted(duck.execute(oracle_sql()["p6_round_trip"]).fetchall()) and len(got) > 50


def test_too_large_a_file(spark, monkeypatch):
    monkeypatch.setattr(tk, "FILE_BYTES", 1000)
    with pytest.raises(ValueError, match="1000 bytes"):
        tk.encode_column(spark.createDataFrame([(1, "a")], "k long, t string"), "k", "t", PATH)
