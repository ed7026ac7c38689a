import os
import zipfile

import pytest

from threadtox.sources import zipped as Z

SCHEMA = "id long, text string, target double"
ROWS = [(1, 'say "hi",\nline two\r\nthree', 0.5), (2, "  padded  ", None), (3, None, 1.0), (4, "comma, \u4e2d\u6587 \U0001f600", 0.1), (None, "x" * 300_000, -2.0)]


def test_round_trip_with_quoted_line_breaks(spark, tmp_path):
    df = spark.createDataFrame(ROWS * 3, SCHEMA).repartition(3)
    folder = str(tmp_path / "zips")
    assert Z.write_zip_csv(df, folder) == 15
    assert sorted(os.listdir(folder)) == ["part-00000.zip", "part-00001.zip", "part-00002.zip"]
    got = Z.read_zip_csv(spark, "file://" + folder, SCHEMA)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(FileExistsError):
        Z.write_zip_csv(df, folder)


def test_entries_columns_and_order(spark, tmp_path):
    path = str(tmp_path / "corpus.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("train.csv", "\ufeffextra,target,id,text\nq,0.25,7,\"a\n\"\"b\"\"\"\n")
        z.writestr("sub/more.csv", "id,text,target\n8,,\n")
        z.writestr("empty.csv", "")
        z.writestr("readme.txt", "no table")
    got = Z.read_zip_csv(spark, path, SCHEMA)
    assert sorted(map(tuple, got.collect())) == [(7, 'a\n"b"', 0.25), (8, None, None)] and got.rdd.getNumPartitions() == 3
    assert [r.id for r in Z.read_zip_csv(spark, path, SCHEMA, entries="train*").collect()] == [7]
    assert Z.read_zip_csv(spark, path, SCHEMA, entries="none*").count() == 0


def test_more_rows_than_a_batch_and_bad_input(spark, tmp_path):
    path = str(tmp_path / "big.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", "id,text,target\n" + "".join(f"{i},t{i},{i}\n" for i in range(3 * Z.BATCH_ROWS + 5)))
    got = Z.read_zip_csv(spark, path, SCHEMA)
    assert got.count() == 3 * Z.BATCH_ROWS + 5 and got.selectExpr("sum(id)").first()[0] == sum(range(3 * Z.BATCH_ROWS + 5))
    for text in ("id,text,target\nx,y,1\n", "id,text,target\n1,y\n", "id,text\n1,y\n"):
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("a.csv", text)
        with pytest.raises(Exception):
            Z.read_zip_csv(spark, path, SCHEMA).collect()
    with pytest.raises(Exception):
        Z.read_zip_csv(spark, str(tmp_path / "missing.zip"), SCHEMA).collect()
    with pytest.raises(ValueError):
        Z.local_path("hdfs://store/a.zip")
