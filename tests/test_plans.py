"""Scale guards on the physical plans of the registered queries."""
import pytest

from threadtox.plans import catalog

# Windows whose partition keys are not data-sized buckets (global windows) are only allowed over small,
# bounded tables; these queries must never rank raw rows in one partition.
RANKED = ["mccv_split", "holdout_split", "balanced_downsample", "auroc_by_split", "auroc", "word_index",
          "scan_capped", "thread_parent", "paired_randomization"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RANKED)
def test_no_python_in_native_plans(spark, sf, name):
    df = catalog.QUERIES[name].build(spark, sf)
    text = plan_text(df)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_splits_shuffle_no_rows(spark, sf):
    # the operators on wide rows: the text never lies below an exchange, only cut keys are joined (broadcast)
    from threadtox.operators import splits as S
    from threadtox.sources import fixtures as fx
    wide = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as id", "text", "lang as setting", "cast(doc_id % 3 = 0 as int) as label")
    for df in (S.mccv_split(wide, splits=10), S.holdout_split(wide), S.balanced_downsample(wide, by=["setting"])):
        df.select("id", "text").collect()
        text = plan_text(df.select("id", "text"))
        assert "Exchange hashpartitioning" not in text and "Window" not in text and "BroadcastExchange" in text
    assert fx.comments(spark, sf).count() > 0


def test_scan_split_reads_only_its_folders(spark, sf):
    text = plan_text(catalog.QUERIES["scan_split"].build(spark, sf))
    filters = [x for x in text.split("PartitionFilters: ")[1:]]
    assert filters and all("split" in x.split("]")[0] for x in filters) and "Exchange" not in text


def test_filters_and_pruning_reach_the_scan(spark, sf):
    from pyspark.sql import functions as F
    from threadtox.sources.tables import table
    df = table(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id")
    text = plan_text(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text
