"""Score lookup and external batch scoring.

``join_scores`` is the keyed lookup of a score table (strict: a missing or duplicated id fails the job).
``external_score`` calls a user-supplied scorer from inside tasks (``mapInPandas``): one client per
partition, text capped before the call, failed rows retried once with a language hint, and the first pass
materialised before the retry pass so a retry never repeats a successful call. ``ledger_score`` keeps the
answers in a ledger, so that a restarted job does not ask for them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from threadtox.functions.hashing import uniform_py
from threadtox.session import materialize as write_once

# --- fixed values -------------------------------------------------------------------------------
MAX_CHARS = 2000          # characters sent to the external scorer
RETRY_LANGUAGE = "en"     # language hint of the retry pass
FAILED = -1.0             # score value of a failed call
# -------------------------------------------------------------------------------------------------


def join_scores(df: DataFrame, scores: DataFrame, score_col: str, out: str = "ca_score", key: str = "id",
                strict: bool = True) -> DataFrame:
    """Left join ``scores[key, score_col]`` as ``out``. Strict mode raises at execution time when an id
    has no score or the score table holds an id twice (both are errors of a per-id lookup)."""
    s = scores.groupBy(key).agg(F.count(F.lit(1)).alias("__dups"), F.first(F.col(score_col)).alias(out))
    if strict:
        s = s.withColumn(out, F.when(F.col("__dups") > 1,
                                     F.raise_error(F.concat(F.lit("duplicate score id "), F.col(key).cast("string"))))
                         .otherwise(F.col(out)))
    j = df.join(s.drop("__dups").withColumn("__hit", F.lit(True)), key, "left")
    if strict:
        j = j.withColumn(out, F.when(F.col("__hit").isNull(),
                                     F.raise_error(F.concat(F.lit("no score for id "), F.col(key).cast("string"))))
                         .otherwise(F.col(out)))
    return j.drop("__hit")


def char_cap(text, n: int = MAX_CHARS):
    """First ``n`` characters (not bytes)."""
    return F.substring(text, 1, n)


# ---- external scorer --------------------------------------------------------------------------------

Scorer = Callable[[str, str | None], float]


def stub_scorer_factory() -> Scorer:
    """Deterministic stand-in for the remote service: u(text); fails (raises) for ~10% of texts without a
    language hint and ~2% even with one. Built once per partition, like a real client."""
    def score(text: str, language: str | None) -> float:
        f = uniform_py("f" + text)
        if f < 0.02 or (language is None and f < 0.1):
            raise RuntimeError("scoring service refused the request")
        return uniform_py(text)
    return score


def _call(scorer: Scorer, text: str | None, language: str | None, max_chars: int) -> float:
    try:
        if text is None:
            raise ValueError("no text")
        return float(scorer(text[:max_chars], language))
    except Exception:  # any failure of the service counts as a failed call
        return FAILED


def _pass(factory: Callable[[], Scorer], language: str | None, max_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for b in batches:
            yield b.assign(score=[_call(scorer, t, language, max_chars) for t in b["__text"]])
    return run


def external_score(df: DataFrame, text: Column | str = "text", factory: Callable[[], Scorer] = stub_scorer_factory,
                   key: str = "id", max_chars: int = MAX_CHARS, retry_language: str = RETRY_LANGUAGE,
                   materialize: bool = True) -> DataFrame:
    """id, score, status ('ok', 'retried', 'failed'). Failed rows keep score -1.

    Concurrency against the service is the number of partitions; repartition ``df`` beforehand to
    throttle. The id keeps its type. With ``materialize`` both passes are written to the shared checkpoint folder as
    they run, so neither the second pass nor any later reading of the result calls the service again. The failed
    rows travel with their text, so repeated or null ids are each scored once per row.
    """
    t = F.col(text) if isinstance(text, str) else text
    src = df.select(F.col(key).alias("id"), char_cap(t, max_chars).alias("__text"))  # no task holds more than is sent
    schema = StructType([*src.schema.fields, StructField("score", DoubleType())])

    def call(rows: DataFrame, language: str | None, tag: str) -> DataFrame:
        scored = rows.mapInPandas(_pass(factory, language, max_chars), schema)
        return write_once(scored, tag) if materialize else scored

    first = call(src, None, "score-pass1")
    ok = first.where(F.col("score") >= 0).select("id", "score", F.lit("ok").alias("status"))
    again = call(first.where(F.col("score") < 0).select("id", "__text"), retry_language, "score-pass2")
    return ok.unionByName(again.select(
        "id", "score", F.when(F.col("score") < 0, F.lit("failed")).otherwise(F.lit("retried")).alias("status")))



# ---- scoring with a ledger ----------------------------------------------------------------------------

LEDGER = "content string, score double, pass int"


class ScoringStopped(RuntimeError):
    """The service is gone for good (quota, credentials): what is answered is kept, the run ends."""


def content_key(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """What the ledger knows a text by: the hash of what is sent to the service."""
    return F.sha2(char_cap(text, max_chars), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """The answers so far (content, score, pass); none if there is no ledger yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _ask(factory: Callable[[], Scorer], language: str | None, number: int, concurrency: int):
    """Scores of a partition's texts, ``concurrency`` calls at a time. A failed call leaves its text without an answer;
    after ScoringStopped no further call is made, and a row without content says so."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, stopped = factory(), False

        def one(text: str) -> float | None:
            nonlocal stopped
            if stopped:
                return None
            try:
                return float(scorer(text, language))
            except ScoringStopped:
                stopped = True
            except Exception:  # any other failure of the service counts as a failed call
                pass
            return None

        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for b in batches:
                scores = list(pool.map(one, b["sent"]))
                answered = [(c, s, number) for c, s in zip(b["content"], scores, strict=True) if s is not None]
                yield pd.DataFrame(answered + [(None, None, number)] * stopped, columns=["content", "score", "pass"])
    return run


def ledger_score(df: DataFrame, ledger: str, text: Column | str = "text", factory: Callable[[], Scorer] = stub_scorer_factory,
                 key: str = "id", max_chars: int = MAX_CHARS, retry_language: str = RETRY_LANGUAGE, concurrency: int = 1,
                 block_texts: int = 100_000, partitions: int | None = None) -> DataFrame:
    """id, score, status as :func:`external_score`, with every answer kept in the parquet table ``ledger``.

    Distinct texts that the ledger has no answer for are sent in blocks of about ``block_texts``, and a block's answers are
    appended when it ends, so a run that is started again asks only for the rest. If the service stops for good
    (ScoringStopped), the answers up to then are kept and the run ends with that error; if executors are lost, at most
    the calls of one block are repeated. ``partitions`` x ``concurrency`` is the most calls at a time. Texts are asked once,
    however many rows share one; failed texts are not in the ledger and are asked again by the next run.
    """
    spark = df.sparkSession
    t = F.col(text) if isinstance(text, str) else text
    rows = df.select(F.col(key).alias("id"), char_cap(t, max_chars).alias("sent"), content_key(t, max_chars).alias("content"))
    texts = rows.filter("content IS NOT NULL").groupBy("content").agg(F.first("sent").alias("sent"))
    for number, language in ((1, None), (2, retry_language)):
        todo = write_once(texts.join(read_ledger(spark, ledger), "content", "left_anti"), f"ledger-pass{number}")
        blocks = -(-todo.count() // block_texts)
        for b in range(blocks):
            block = todo.filter(F.pmod(F.xxhash64("content"), F.lit(blocks)) == b)
            if partitions:
                block = block.repartition(partitions)
            got = write_once(block.mapInPandas(_ask(factory, language, number, concurrency), LEDGER), "ledger-block")
            got.filter("content IS NOT NULL").write.mode("append").parquet(ledger)
            if got.filter("content IS NULL").limit(1).count():
                raise ScoringStopped("the scoring service stopped; its answers so far are in the ledger")
    known = read_ledger(spark, ledger).groupBy("content").agg(F.min(F.struct("pass", "score")).alias("a"))
    joined = rows.select("id", "content").join(known, "content", "left")
    return joined.select("id", F.coalesce("a.score", F.lit(FAILED)).alias("score"),
                         F.when(F.col("a").isNull(), "failed").when(F.col("a.pass") == 1, "ok").otherwise("retried").alias("status"))
