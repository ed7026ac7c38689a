from threadtox.operators import models as ML
from threadtox.session import scratch_path
from threadtox.sources import fixtures as fx
from threadtox.streaming import scoring as ST

CFG = ML.TrainConfig(reg_param=0.05, max_iter=10, vocab_size=1 << 12)


def test_stream_scores_equal_batch_scores(spark, sf):
    c = fx.comments(spark, sf).select("id", "text", "parent", "label", "api")
    model = ML.fit("ooc", c, CFG)
    src = scratch_path(spark, "t-stream-in")
    c.write.parquet(src)
    out = scratch_path(spark, "t-stream-out")
    q = ST.write_scores(ST.score_stream(ST.read_comment_stream(spark, src, 10), model), out,
                        trigger_once=True)
    q.awaitTermination(300)
    streamed = {r.id: r.score for r in spark.read.parquet(out).collect()}
    batch = {r.id: r.score for r in ML.predict(model, c).collect()}
    assert streamed == batch
    # a restart of the same call finds its checkpoint: nothing is scored again
    again = ST.write_scores(ST.score_stream(ST.read_comment_stream(spark, src, 10), model), out, trigger_once=True)
    again.awaitTermination(300)
    assert spark.read.parquet(out).count() == len(batch)


def test_models_with_a_table_are_not_streamed(spark, sf):
    import pytest
    c = fx.comments(spark, sf).select("id", "text", "parent", "label")
    model = ML.fit("inc_hybrid", c, CFG, fx.word_vectors(spark, sf))
    with pytest.raises(ValueError):
        ST.score_stream(c, model)
