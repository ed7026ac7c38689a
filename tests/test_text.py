import itertools

import pytest
from pyspark.sql import functions as F

from threadtox.functions.text import WORD_FILTERS, pad_pre, pair_budget, word_tokens
from threadtox.operators import text as T


def keras_like_tokens(text):
    t = text.lower()
    for c in WORD_FILTERS:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def pop_loop(a, b, budget):
    while a + b > budget:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_word_tokens_rule(spark):
    texts = ["Hello, World!", "it's  a\ttest\r\nnew-line", "", "Ünïcode ÉTÉ", "a/b\\c", "  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.tokens for r in df.select("id", word_tokens(F.col("text")).alias("tokens")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == keras_like_tokens(t), t


@pytest.mark.parametrize("size", [0, 3, 4, 5, 9])
def test_pad_pre(spark, size):
    n = 4
    df = spark.createDataFrame([(list(range(1, size + 1)),)], "ids array<long>")
    got = df.select(pad_pre(F.col("ids"), n).alias("p")).first().p
    ids = list(range(1, size + 1))
    assert got == ([0] * (n - len(ids)) + ids)[-n:]


def test_pair_budget_closed_form_against_loop(spark):
    cases = [(a, b, m) for a, b, m in itertools.product(range(0, 14), range(0, 14), range(0, 12))]
    df = spark.createDataFrame(cases, "a int, b int, m int")
    rows = df.collect()
    out = {}
    for m in range(0, 12):
        ka, kb = pair_budget(F.col("a"), F.col("b"), m)
        for r in df.where(F.col("m") == m).select("a", "b", ka.alias("ka"), kb.alias("kb")).collect():
            out[(r.a, r.b, m)] = (r.ka, r.kb)
    assert len(out) == len(rows)
    for (a, b, m), got in out.items():
        assert got == pop_loop(a, b, m), (a, b, m)


def test_word_index_ties_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b a c"), (2, "a c d"), (3, "d e")], "id long, text string")
    got = [(r.word, r.word_id, r.freq) for r in T.word_index(df).orderBy("word_id").collect()]
    assert got == [("a", 1, 2), ("c", 2, 2), ("d", 3, 2), ("b", 4, 1), ("e", 5, 1)]


def test_texts_to_sequences_drops_unknown_and_keeps_empty(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, word_id long")
    df = spark.createDataFrame([(1, "b x a b"), (2, "zz"), (3, None)], "id long, text string")
    got = {r.id: r.seq for r in T.texts_to_sequences(df, vocab).collect()}
    assert got == {1: [2, 1, 2], 2: [], 3: []}


def test_tokens_to_ids_join_paths_agree(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("[UNK]", 9)], "word string, word_id long")
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, ["zz"]), (3, [])], "id long, t array<string>")
    for bound in (2_000_000, 0):  # broadcast vocabulary / shuffle join beyond the bound
        got = {r.id: r.ids for r in T.tokens_to_ids(df, vocab, "t", "ids", max_broadcast_mb=bound).collect()}
        assert got == {1: [2, 1, 2], 2: [], 3: []}
        got = {r.id: r.ids for r in T.tokens_to_ids(df, vocab, "t", "ids", unknown_id=9,
                                                    max_broadcast_mb=bound).collect()}
        assert got == {1: [2, 9, 1, 2], 2: [9], 3: []}


def test_word_vector_parse_last_wins(spark):
    lines = spark.createDataFrame([(0, "cat 0.5 1.0"), (1, "dog 1 2"), (2, "cat 3 4")], "o long, value string")
    got = {r.word: r.vector for r in T.parse_word_vectors(lines, order=F.col("o")).collect()}
    assert got == {"cat": [3.0, 4.0], "dog": [1.0, 2.0]}


def test_masked_mean_pool_counts_unknown_tokens(spark):
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vector array<float>")
    df = spark.createDataFrame([(1, ["a", "b", "zz", "a"]), (2, ["q"]), (3, [])], "id long, tokens array<string>")
    # broadcast path, and the (document, word)-count path taken beyond the broadcast bound
    for bound in (2_000_000, 0):
        got = {r.id: r.pooled for r in T.masked_mean_pool(df, vec, 2, max_broadcast_mb=bound).collect()}
        assert got[1] == pytest.approx([5.0 / 4, 8.0 / 4])
        assert got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]
    for bound in (2_000_000, 0):
        first = {r.id: r.pooled for r in T.first_pool(df, vec, 2, max_broadcast_mb=bound).collect()}
        assert first == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_word_index_independent_of_bucket_width(spark):
    rows = [(i * 37 % 1009, " ".join(f"w{(i * j) % 23}" for j in range(1, 6))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    ranks = [{r.word: (r.word_id, r.freq) for r in T.word_index(df, id_bucket_bits=b).collect()} for b in (0, 3, 20)]
    ranks.append({r.word: (r.word_id, r.freq) for r in T.word_index(df).collect()})
    assert all(r == ranks[0] for r in ranks)
    assert sorted(v[0] for v in ranks[0].values()) == list(range(1, len(ranks[0]) + 1))


def test_repeated_and_null_ids_keep_their_own_tokens(spark):
    rows = [(7, ["a"]), (7, ["a", "b"]), (7, ["a", "b"]), (None, ["b", "x"]), (None, []), (8, ["x"]), (8, ["b", "b", "b"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, word_id long")
    vec = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<float>")
    ids = {"a": 1, "b": 2}
    for mb in (100, 0):
        got = sorted(((r.id, r.tokens, r.seq) for r in T.tokens_to_ids(df, vocab, "tokens", "seq", max_broadcast_mb=mb).collect()), key=str)
        assert got == sorted([(i, t, [ids[x] for x in t if x in ids]) for i, t in rows], key=str)
        pooled = sorted(((r.id, [round(x, 6) for x in r.pooled]) for r in T.masked_mean_pool(df, vec, 2, max_broadcast_mb=mb).collect()), key=str)
        want = [(i, [round(2.0 * t.count("a") / max(len(t), 1), 6), round(3.0 * t.count("b") / max(len(t), 1), 6)]) for i, t in rows]
        assert pooled == sorted(want, key=str)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_fit_are_looked_up_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, ["a", "b", None, "x"]), (1, ["b"]), (None, None)], "id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, word_id long")
    vec = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<float>")
    seq, pooled = T.tokens_to_ids(df, vocab, "tokens", "seq"), T.masked_mean_pool(df, vec, 2)
    assert "Exchange" not in _plan(seq) and "Exchange" not in _plan(pooled)
    assert sorted(((r.id, r.seq) for r in seq.collect()), key=str) == sorted([(1, [1, 2]), (1, [2]), (None, [])], key=str)


def test_a_large_vocabulary_is_joined_with_the_distinct_words_of_chunks(spark):
    from threadtox.operators import lookup as L
    rows = [(i, [f"w{(i * j) % 29}" for j in range(i % 7)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(2)
    vocab = spark.createDataFrame([(f"w{k}", k) for k in range(20)], "word string, word_id long")
    for chunk in (1, 50, 10_000):  # rows longer than a chunk are chunks of their own
        d = L.coded(df, "tokens", chunk)
        words = L.chunk_words(d)
        assert words.count() == words.select("__chunk", "__w").distinct().count()
        assert chunk < 10_000 or words.count() <= 2 * 29
        found = words.join(vocab.withColumnRenamed("word", "__w"), "__w").select("__chunk", "__code", words["__code"] * 0 + vocab["word_id"])
        got = {r.id: r.seq for r in L.decoded(d, found.toDF("__chunk", "__code", "__value"), "seq").collect()}
        assert got == {i: [int(w[1:]) if int(w[1:]) < 20 else None for w in t] for i, t in rows}
    assert "posexplode(tokens" not in _plan(T.tokens_to_ids(df, vocab, "tokens", "seq", max_broadcast_mb=0))


def test_texts_of_a_row_are_looked_up_in_one_pass_and_do_not_move(spark, monkeypatch):
    from threadtox.operators import lookup as L
    rows = [(1, "b x a b", "a a"), (1, "zz", None), (None, None, "b"), (3, "", "x a"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, parent string")
    vocab = spark.createDataFrame([("a", 1), ("b", -1)], "word string, word_id long")
    ids, moved, plain = {"a": 1, "b": -1}, [], L.coded
    monkeypatch.setattr(L, "coded", lambda d, *a: moved.append(d.columns) or plain(d, *a))
    want = sorted(((i, *([ids[w] for w in (t or "").split() if w in ids] for t in own)) for i, *own in rows), key=str)
    for mb in (100, 0):
        got = T.sequences(df, vocab, {"text": "a", "parent": "b"}, max_broadcast_mb=mb)
        assert got.columns == ["id", "a", "b"] and sorted(map(tuple, got.collect()), key=str) == want
    assert moved == [["id", "__n0", "__n1", "__tok"]]
    got = T.tokens_to_ids(df.select("id", F.split("text", " ").alias("t")), vocab, "t", "seq", max_broadcast_mb=0, keep_tokens=False)
    assert got.columns == ["id", "seq"] and moved[1:] == [["id", "t"]]


def test_vectors_too_large_for_the_workers_memory_are_mapped_without_a_shuffle(spark):
    """Joined, a vector would move for each distinct word of a text."""
    words = [f"w{i}é" for i in range(40)]
    listed = [*words, words[3], words[3], words[7], None]
    for kind in ("float", "double"):
        vec = spark.createDataFrame([(w, [float(i), i / 4, -1.0]) for i, w in enumerate(listed)], f"word string, vector array<{kind}>").repartition(3)
        sums = {w: [sum(x) for x in zip(*([float(i), i / 4, -1.0] for i, v in enumerate(listed) if v == w))] for w in words}
        rows = [(i % 50 or None, [words[(i * j) % 40] if j % 5 else [None, "?"][i % 2] for j in range(i % 9)]) for i in range(120)] + [(1, None)]
        df = spark.createDataFrame(rows, "id long, tokens array<string>")
        want = sorted(((i, [round(sum(sums.get(t, [0.0] * 3)[k] for t in ts or []) / max(len(ts or []), 1), 6) + 0.0 for k in range(3)]) for i, ts in rows[:-1]), key=str)
        for mb, file_mb in ((64, 0), (0, 64), (0, 0)):
            pooled = T.masked_mean_pool(df.where("tokens IS NOT NULL"), vec, 3, max_broadcast_mb=mb, max_mapped_mb=file_mb)
            assert ("Exchange" in _plan(pooled)) == (mb == file_mb == 0)
            assert sorted(((r.id, [round(x, 6) + 0.0 for x in r.pooled]) for r in pooled.collect()), key=str) == want
    none = T.masked_mean_pool(df, vec.limit(0), 3, max_broadcast_mb=-1)
    assert {tuple(r.pooled) for r in none.where("size(tokens) > 0").collect()} == {(0.0, 0.0, 0.0)}
    with pytest.raises(Exception, match="components"):
        T.masked_mean_pool(df, vec, 4, max_broadcast_mb=0).collect()
