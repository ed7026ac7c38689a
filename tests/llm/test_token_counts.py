import public_tokenizers
import pytest
from helpers import awkward, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadtox.llm import token_counts as tc
from threadtox.sources.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


COUNTER = tc.Counter(tc.Vocabulary.load(PATH), 1000)


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_as_the_library_counts(library):
    texts = ["", "aaaa aaaaaaaaaaaaaaa", "It's I'VE we'll <|endoftext|>x<|startoftext|> <|EndOfText|>", "ΣΊΣΥΦΟΣ İstanbul ﬁ ǅ ŉ ß ẞ",
             "a\x1cb c\x1f\x1fd \x85 \xa0 \u2028x", "日本語テキスト 한국어 ½ ² ٣ 12345", "e\u0301 n\u0303o \u0301x", "\U0001f389\U0001f389\U0001f44d\U0001f3fd", "a\u200bb\ufeffc", "\x00\x01"]
    assert COUNTER.texts(texts) == want(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    assert COUNTER.texts([text]) == want(library, [text])


def test_whole_table(spark, sf, library):
    docs_table = table(spark, sf, "documents")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.count_tokens(docs_table, PATH, cache=500).collect()}
    rows = docs_table.select("doc_id", "text").collect()
    n = want(library, [r.text for r in rows])
    assert got == {r.doc_id: (len(r.text.encode()), k, k > 2048) for r, k in zip(rows, n, strict=True)}


def test_awkward_rows(spark, library):
    rows = awkward()
    got = tc.count_tokens(docs(spark, rows, extra=True), PATH).collect()
    n = want(library, [r[1] or "" for r in rows])
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(r[0], len((r[1] or "").encode()), k) for r, k in zip(rows, n, strict=True)]
    assert tc.count_tokens(docs(spark, []), PATH).count() == 0
