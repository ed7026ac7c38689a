"""Every registered query against its SQL in DuckDB, and the pipeline stage by stage."""

import os
import shutil

import corpus_pipeline
import duckdb
import pytest
from helpers import docs, prose
from pyspark.sql import functions as F

from threadtox.llm import decontam, dedup, line_quality
from threadtox.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


def rows_of(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(map(str, frame.itertuples(index=False, name=None)))


def in_duckdb(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            p = f"{sf_dir}/{t}.parquet"
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.sql(sql).df()


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf).toPandas()) == rows_of(in_duckdb(sf, ORACLE_SQL[name]))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A small table with a hot source, copies, near copies, shared lines and licence lines."""
    d = str(tmp_path_factory.mktemp("skewed"))
    rows = []
    for i in range(240):
        lines = [prose(i * 5 + k, 25).capitalize() + "." for k in range(4)]
        if i % 4 == 0:
            lines.append(f"Posted in the forum by user{i} on day {i} of this year in our section")
        if i % 9 == 0:
            lines.append("Released under the MIT License.")
        rows.append((i, "\n".join(lines), "hot" if i % 3 == 0 else f"s{i % 5}"))
    rows += [(1000 + i, rows[i % 3][1], "hot") for i in range(30)]
    rows += [(2000 + i, rows[5][1].replace(".", f" edit{i}.", 1), "s1") for i in range(10)]
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, rows[i][1].split("\n")[0]) for i in range(0, 40, 7)] + [(99, "six words of an unseen item")], "item_id long, text string") \
        .write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    yield d
    shutil.rmtree(d, ignore_errors=True)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLE_SQL) if not n.startswith(("op10", "op12"))])
def test_query_equals_its_sql_on_skewed_rows(spark, skewed, name):
    assert rows_of(QUERIES[name](spark, skewed).toPandas()) == rows_of(in_duckdb(skewed, ORACLE_SQL[name]))


def test_pipeline_stages(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "source mixing"]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = corpus_pipeline.materialize(stage["quality rules"](spark, source, sf), "t1")
    assert good.columns == source.columns
    assert ids(good) == ids(line_quality.quality(source, labels).filter("kept"))
    lines = corpus_pipeline.materialize(stage["line dedup"](spark, good, sf), "t2")
    assert lines.columns == source.columns and set(ids(lines)) <= set(ids(good))
    assert lines.filter(F.length("text") != F.col("n_chars")).count() == 0
    near = corpus_pipeline.materialize(stage["near dedup"](spark, lines, sf), "t3")
    assert near.columns == source.columns
    assert ids(near) == ids(dedup.near_duplicates(lines, percent=80, match=24).filter("kept"))
    clean = corpus_pipeline.materialize(stage["decontamination"](spark, near, sf), "t4")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert clean.columns == source.columns
    assert ids(clean) == ids(decontam.contamination(near, bench).filter("NOT contaminated"))
    mixed = stage["source mixing"](spark, clean, sf)
    assert set(ids(mixed)) <= set(ids(clean))
    again = corpus_pipeline.run(spark, sf)
    assert rows_of(again.toPandas()) == rows_of(mixed.toPandas())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
