import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabulary files here")


def test_against_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ["Hello  world", "naïve 🛰️ ok\r\n\r\n  x", "<|endoftext|>", "don't 12345", "网关在切换", "a" * 300, " \t\n "]:
        assert tokens.encode(text) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 .\n\t'é\u00a0s", max_size=120), st.integers(1, 20))
def test_safe_parts_change_nothing(text, size):
    parts = list(tokens.safe_parts(text, size))
    e = tokens.encoding()
    assert "".join(parts) == text
    assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)
    assert tokens.decode(e.encode_ordinary(text)) == text


def test_rows(spark):
    long = "word, " * 30_000
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "abc def", 5), (3, "abc def", 5), (4, long, 5), (None, "x", 5)], "doc_id long, text string, ids int")
    out = tokens.encode_corpus(df)
    rows = out.collect()
    got = {r.doc_id: list(r.ids) for r in rows}
    assert len(rows) == 6 and got[1] == [] and got[2] == []
    assert got[4] == tokens.encoding().encode_ordinary(long)
    back = {r.doc_id: r.text for r in tokens.decode_corpus(out).collect()}
    assert back[3] == "abc def" and back[4] == long and back[1] == ""
    assert tokens.encode_corpus(df.limit(0)).count() == 0
