"""Scoring comments as they arrive.

The study itself is batch-only. Its row-level operators (tokens, pair features, a fitted regime's
``predict``) are stateless, so they apply unchanged to a streaming DataFrame; this module only wires a
fitted pipeline to ``readStream`` / ``writeStream`` with the checkpoint in the shared folder, so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from threadtox.operators import models as ML
from threadtox.operators.stages import PooledVectors
from threadtox.sources.files import COMMENT_SCHEMA


def read_comment_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of comments (id, text, parent, label, api) dropped into ``path``."""
    return (spark.readStream.schema(COMMENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def _stages(model: PipelineModel) -> list:
    return [x for s in model.stages for x in (_stages(s) if isinstance(s, PipelineModel) else [s])]


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """id, label, score for every arriving comment (regimes without a table join: ooc, inc_concat, inc_pair)."""
    if any(isinstance(s, PooledVectors) for s in _stages(model)):
        raise ValueError("the model joins a word-vector table; score it in batch")
    return ML.predict(model, stream)


def write_scores(scored: DataFrame, out_path: str, checkpoint: str | None = None,
                 trigger_once: bool = False) -> StreamingQuery:
    """Append scores as parquet. The checkpoint defaults to a folder beside the output (``<out_path>-checkpoint``), so the
    same call after a restart goes on where the query stopped and scores no file twice."""
    ckpt = checkpoint or out_path.rstrip("/") + "-checkpoint"
    w = scored.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt) \
        .outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
