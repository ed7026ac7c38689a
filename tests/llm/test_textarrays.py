import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadtox.llm import textarrays as ta


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAzZ09 .\t\n\x0b\x1cé中\U0001f600", max_size=40), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    raw = [t.encode() for t in texts]
    for table, pattern in ((ta.WORDS_LOWER, rb"[^\x20\x09-\x0D]+"), (ta.ALNUM_LOWER, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = ta.words_of(raw, table)
        want = [re.findall(pattern, t.lower()) for t in raw]
        assert [[w.word(k) for k in range(w.first[i], w.first[i + 1])] for i in range(len(raw))] == want
        flat = [x for own in want for x in own]
        assert len(set(flat)) == len(set(w.hashes.tolist())) == len(set(zip(flat, w.hashes.tolist(), strict=True)))


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = [b" ".join(b"word%d" % i for i in range(5000)), b"x" * 3000 + b" tail"]
    whole = ta.words_of(text).hashes
    monkeypatch.setattr(ta, "PIECE_BYTES", 50)
    assert np.array_equal(whole, ta.words_of(text).hashes)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles(size):
    texts = [b"", b"a b", b"a b c d e f a b c d e", b"a", b"x y z q w"]
    h, first = ta.shingles(ta.words_of(texts), size)
    for i, t in enumerate(texts):
        w = t.split()
        want = [tuple(w[k:k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else ([tuple(w)] if w else [])
        own = h[first[i]:first[i + 1]].tolist()
        assert len(own) == len(want) and len(set(own)) == len(set(want)) == len(set(zip(own, want, strict=True)))


def test_slices_cover_a_batch_and_null_is_empty():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "c"])], names=["text"])
    parts = list(ta.sliced(batch, "text", limit=10))
    assert [t for _, own in parts for t in own] == [b"aa", b"", b"b" * 50, b"", b"c"]
    assert [r.start for r, _ in parts] == [0, *[r.stop for r, _ in parts][:-1]]
    assert list(ta.sliced(batch.slice(0, 0), "text")) == []
