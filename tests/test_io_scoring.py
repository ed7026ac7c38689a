import pytest
from pyspark.sql import functions as F

from threadtox.operators import scoring as SC
from threadtox.session import scratch_path
from threadtox.sources import files, sinks


def test_csv_round_trip_keeps_quotes_newlines_blanks(spark):
    rows = [(1, 'say "hi"\nline two', None, 1, 0.5), (2, "  padded  ", "p\r\nq", 0, 0.25),
            (3, "back\\slash, comma", "", 0, 0.125)]
    df = spark.createDataFrame(rows, files.COMMENT_SCHEMA)
    path = scratch_path(spark, "t-csv")
    files.write_csv(df, path)
    got = {r.id: tuple(r) for r in files.read_comments_csv(spark, path).collect()}
    assert got[1] == rows[0]
    assert got[2] == rows[1]
    assert got[3][:2] == rows[2][:2] and got[3][2] is None   # empty field reads back as null
    with pytest.raises(Exception):
        files.write_csv(df, path)                               # refuses an existing target


def test_tsv_keeps_every_field_of_ragged_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('a\tb\nc\td\te\tf\n\ng\n\t\nx"y\t"q"\n', encoding="utf-8")
    got = [r.fields for r in files.read_tsv(spark, str(tmp_path)).collect()]
    assert got == [["a", "b"], ["c", "d", "e", "f"], [""], ["g"], ["", ""], ['x"y', '"q"']]
    (tmp_path / "a.tsv").write_text('"a\tb"\tc\n"say ""hi"""\t""\tx"y\n\n', encoding="utf-8")
    got = [r.fields for r in files.read_tsv(spark, str(tmp_path), quote='"').collect()]
    assert got == [["a\tb", "c"], ['say "hi"', "", 'x"y'], [""]]


def test_capped_scan_exact(spark):
    df = spark.createDataFrame([(i * 7 % 101, str(i)) for i in range(101)], "id long, t string")
    got = sorted(r.id for r in files.capped_scan(df, 10, bucket_bits=2).collect())
    assert got == list(range(10))


def test_capped_scan_sparse_ids_against_brute_force(spark):
    # sparse ids over many buckets (and bucket groups of the offset pass), caps inside and beyond the table,
    # broadcast and non-broadcast keep lists
    ids = sorted({(i * 7919) % 100_003 for i in range(3000)})
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for n, mb in ((1, 10), (37, 10), (1000, 10), (1000, 1_000_000), (5000, 1_000_000)):
        got = sorted(r.id for r in files.capped_scan(df, n, bucket_bits=3, max_broadcast=mb).collect())
        assert got == ids[:n]


def test_split_sink_partitions(spark):
    df = spark.createDataFrame([(0, "gc", "val", 1), (1, "gn", "train", 2)], "split int, setting string, part string, id long")
    path = scratch_path(spark, "t-splits")
    sinks.write_splits(df, path)
    back = spark.read.parquet(path).where((F.col("split") == 0) & (F.col("part") == "val"))
    assert [r.id for r in back.collect()] == [1]


def test_join_scores_strict(spark):
    c = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    s = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, TOXICITY double")
    got = {r.id: r.ca_score for r in SC.join_scores(c, s, "TOXICITY").collect()}
    assert got == {1: 0.1, 2: 0.2}
    missing = spark.createDataFrame([(1, 0.1)], "id long, TOXICITY double")
    with pytest.raises(Exception):
        SC.join_scores(c, missing, "TOXICITY").collect()
    dup = spark.createDataFrame([(1, 0.1), (1, 0.3), (2, 0.2)], "id long, TOXICITY double")
    with pytest.raises(Exception):
        SC.join_scores(c, dup, "TOXICITY").collect()


def test_external_score_statuses(spark):
    from threadtox.functions.hashing import uniform_py
    texts = [f"comment number {i}" for i in range(300)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: (r.score, r.status) for r in SC.external_score(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] == (-1.0, "failed")
            continue
        f = uniform_py("f" + t)
        want = "failed" if f < 0.02 else "retried" if f < 0.1 else "ok"
        assert got[i][1] == want
        assert got[i][0] == (-1.0 if want == "failed" else uniform_py(t))


def test_char_cap_counts_characters(spark):
    df = spark.createDataFrame([("é" * 2500,)], "t string")
    assert df.select(F.length(SC.char_cap(F.col("t")))).first()[0] == 2000


def test_each_failed_row_is_retried_once_whatever_is_read_later(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        import os
        import uuid

        def score(text, language):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(f"{text} {language}")
            if language is None and text.startswith("bad"):
                raise RuntimeError
            return 0.5
        return score

    df = spark.createDataFrame([(f"k{i % 20}", f"{'bad' if i % 2 else 'good'} {i}") for i in range(40)], "id string, text string")
    out = SC.external_score(df, factory=factory)
    assert out.count() == 40 and out.where("status = 'retried'").count() == 20 and dict(out.dtypes)["id"] == "string"
    calls = [p.read_text() for p in tmp_path.iterdir()]
    assert len(calls) == len(set(calls)) == 60


def test_votes_of_nobody_have_no_rate(spark):
    from threadtox.operators import annotations as A
    df = spark.createDataFrame([(1, [], ["TOXIC"]), (2, None, ["NOT", "VERY TOXIC"])], "id long, tox_codes_oc array<string>, tox_codes_ic array<string>")
    assert {(r.id, r.condition): r.rate for r in A.annotator_rate(df).collect()} == {(1, "oc"): None, (1, "ic"): 1.0, (2, "oc"): None, (2, "ic"): 0.5}
    assert [r.sensitive for r in A.context_sensitivity(df).collect()] == [None, None]


def _logging_scorer(log, fail=lambda t, lang: False, stop_after=None):
    """A scorer that writes every successful call to a file; it stops for good after ``stop_after`` of them in all."""
    stopped = SC.ScoringStopped

    def factory():
        import hashlib
        import os

        def score(text, language):
            done = os.path.getsize(log) if os.path.exists(log) else 0
            if stop_after is not None and done >= stop_after * 9:
                raise stopped("quota")
            if fail(text, language):
                raise RuntimeError("refused")
            with open(log, "a") as f:
                f.write(hashlib.md5(text.encode()).hexdigest()[:8] + "\n")
            return len(text) / 100
        return score
    return factory


def test_a_stopped_pass_goes_on_without_repeating_calls(spark, tmp_path):
    rows = [(i, f"text {i % 70}") for i in range(100)] + [(None, "text 5"), (200, None), (201, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")

    def refuse(text, language):
        return text == "text 9" and language is None or text == "text 11"
    options = {"block_texts": 20, "partitions": 1}
    with pytest.raises(SC.ScoringStopped):
        SC.ledger_score(df, ledger, factory=_logging_scorer(log, refuse, stop_after=33), **options)
    kept = SC.read_ledger(spark, ledger)
    assert kept.count() == 33
    got = SC.ledger_score(df, ledger, factory=_logging_scorer(log, refuse), **options)
    calls = open(log).read().split()
    assert len(calls) == len(set(calls)) == 70  # 70 texts and the empty one, but for text 11: one successful call each
    status = {(r.id, r.status) for r in got.collect()}
    assert got.count() == len(rows) and {s for i, s in status if i in (11, 81, 200)} == {"failed"}
    assert {s for i, s in status if i in (9, 79)} == {"retried"} and (None, "ok") in status and (201, "ok") in status
    again = SC.ledger_score(df, ledger, factory=_logging_scorer(log, refuse), **options)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect())) and len(open(log).read().split()) == 70


def test_calls_at_a_time_are_bounded(spark, tmp_path):
    marks = str(tmp_path / "marks")

    def factory():
        import threading
        import time
        lock, now, most = threading.Lock(), [0], [0]

        def score(text, language):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                open(marks, "a").write(f"{most[0]} ")
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            return 0.5
        return score
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id long, text string")
    got = SC.ledger_score(df, str(tmp_path / "ledger"), factory=factory, concurrency=3, partitions=1)
    assert got.filter("status = 'ok'").count() == 40
    assert 2 <= max(map(int, open(marks).read().split())) <= 3


def test_ledger_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    assert SC.ledger_score(df, str(tmp_path / "ledger")).count() == 0


def test_tasks_get_only_what_is_sent(spark):
    """The scorer's tasks hold the capped text, in code points, whatever the text's length."""
    def factory():
        return lambda text, language: float(len(text))
    df = spark.createDataFrame([(1, "\U0001f600" * 5000), (2, "ab"), (3, None)], "id long, text string")
    scored = SC.external_score(df, factory=factory, materialize=False)
    assert {r.id: r.score for r in scored.collect()} == {1: float(SC.MAX_CHARS), 2: 2.0, 3: -1.0}
    assert "substring" in scored._jdf.queryExecution().optimizedPlan().toString()


def test_archives_follow_the_size_of_the_corpus(spark):
    from threadtox.plans.io import archived
    df = spark.createDataFrame([(i, "x" * 1000, 0.0) for i in range(100)], "id long, comment_text string, target double")
    assert archived(df, mb=0.01).rdd.getNumPartitions() == 10
    assert archived(df).rdd.getNumPartitions() == 2 and archived(df.limit(0)).rdd.getNumPartitions() == 2
    assert sorted(r.id for r in archived(df, mb=0.01).collect()) == list(range(100))
