import pytest

from threadtox.operators import wordpiece as W


def longest_match(word, vocab, limit=W.MAX_WORD_CHARS):
    """Brute force: of all ways to cut a word into pieces, the one whose first piece is longest, and so on."""
    best, todo = None, [((), 0)]
    while todo and len(word) <= limit:
        pieces, at = todo.pop()
        if at == len(word):
            best = list(pieces)
            break
        ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab]
        todo = [((*pieces, ("##" if at else "") + word[at:ends[0]]), ends[0])] if ends else []
    return best or [W.UNK]


def test_basic_tokens(spark):
    text = "Héllo, WORLD!! it's 東京\x00 ok\u200d\ufffd a\xa0b\u3000c\r\nd\t€5+x «q» \U00020001z"
    assert W.basic_tokens("Héllo, WORLD!! it's 東京\x00 ok", lower=True) == ["hello", ",", "world", "!", "!", "it", "'", "s", "東", "京", "ok"]
    assert W.basic_tokens(None) == [] and W.basic_tokens("") == []
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r.x for r in df.select(W.basic_tokenize(df.t).alias("x")).collect()] == [W.basic_tokens(text), [], []]
    assert W.basic_tokens("Héllo") == ["Héllo"]


@pytest.mark.parametrize("limit", [100, 0])
def test_pieces_are_the_longest_matches(spark, limit):
    rows = [(1, "Unaffable people, unaffable!"), (2, "abc ab a"), (3, ""), (4, None), (5, "x" * 220), (6, "x" * 150), (1, "ab"), (None, "abc"), (None, "people")]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = ["[UNK]", "un", "##aff", "##able", "a", "##b", "##c", "people", ",", "!", "x", "##x", "##xxx"]
    got = W.wordpiece_tokens(df, spark.createDataFrame([(t,) for t in vocab], "token string"), max_broadcast_mb=limit).collect()
    want = [(i, t, [p for w in W.basic_tokens(t) for p in longest_match(w, set(vocab))]) for i, t in rows]
    assert sorted(((r.id, r.text, r.pieces) for r in got), key=str) == sorted(want, key=str)
    assert [p for i, _, p in want if i == 5] == [[W.UNK]] and ["un", "##aff", "##able"] == want[0][2][-4:-1]


def test_derived_vocabulary_layout(spark):
    from threadtox.functions.text import SPECIAL_TOKENS
    df = spark.createDataFrame([(1, "ab ab cd b"), (2, "cd ab ef")], "id long, text string")
    v = [r.token for r in W.wordpiece_vocab(df, top_words=2).orderBy("token_id").collect()]
    assert v[:4] == list(SPECIAL_TOKENS)
    chars = set("abcdef")
    assert set(v[4:4 + 2 * len(chars)]) == chars | {"##" + c for c in chars}
    # top words by count (ab 3, cd 2, ef 1), ties by token; single characters are not words
    assert v[4 + 2 * len(chars):] == ["ab", "cd"]


@pytest.mark.parametrize("limit", [100, 0])
def test_an_empty_vocabulary_knows_nothing(spark, limit):
    df = spark.createDataFrame([(1, "ab c")], "id long, text string")
    got = W.wordpiece_tokens(df, spark.createDataFrame([], "token string"), max_broadcast_mb=limit).first()
    assert got.pieces == [W.UNK, W.UNK]


def test_a_large_vocabulary_is_asked_only_for_possible_pieces(spark):
    rows = [(i, " ".join(("ab" * (i % 5 + 1), "people", f"x{i}", "q", "##b", "a" * 190 + "zz"))) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = ["people", "ab", "a", "##b", "##a", "##aba", "x", "##1", "##2", "q", "#", "##bab"]
    table = spark.createDataFrame([(t,) for t in vocab], "token string")
    got = {r.id: r.pieces for r in W.wordpiece_tokens(df, table, max_broadcast_mb=0).collect()}
    assert got == {i: [p for w in W.basic_tokens(t) for p in longest_match(w, set(vocab))] for i, t in rows}
    words = spark.createDataFrame([("people",), ("ab" * 40,)], "__w string")
    # whole words are taken out by a join before any substring is made
    assert "LeftAnti" in W._split_with_joins(words, table, 200)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [100, 0])
def test_several_texts_are_split_in_one_pass(spark, limit):
    rows = [(1, "ab a", "people ab"), (2, None, "ab"), (3, "people", None), (4, "", ""), (4, "x\x00y", "zz ab"), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, parent string")
    vocab = ["a", "##b", "people", "x", "##y"]
    got = W.wordpiece_sides(df, spark.createDataFrame([(t,) for t in vocab], "token string"), ["text", "parent"], ["a", "b"], max_broadcast_mb=limit)
    pieces = lambda t: [p for w in W.basic_tokens(t) for p in longest_match(w, set(vocab))]
    assert got.columns == ["id", "a", "b"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(i, pieces(t), pieces(p)) for i, t, p in rows], key=str)
