"""ML stages of the context regimes that Spark ML lacks; all of them can be saved and loaded with the pipeline.

ClassWeight     label -> weight of the row, where the label is known
FittedTerms     a vocabulary counted on the training rows; encodes one or more token columns with it
PooledVectors   masked mean of a word-vector table over a token column; carries the table
LearntVectors   fits the word vectors on the training rows, then pools like PooledVectors
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorSizeHint, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtox.operators.features import class_weight
from threadtox.operators.ranking import exact_row_number
from threadtox.operators.text import masked_mean_pool, mean_pool
from threadtox.session import discard, materialize

#: First word of every vocabulary: no token is empty, so it encodes nothing, and no vocabulary is empty.
NO_WORD = ""
TIE_PREFIX = 3   # first characters of a word that name its bucket where words of one frequency are ranked


class ClassWeight(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``weight``: 1 for label 0, ``positiveWeight`` for label 1. Rows to score need no label and get none."""

    positiveWeight = Param(Params._dummy(), "positiveWeight", "weight of label 1", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, positiveWeight: float = 1.0):
        super().__init__()
        self._setDefault(positiveWeight=1.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        if "label" not in df.columns:
            return df
        return df.withColumn("weight", class_weight(F.col("label"), self.getOrDefault(self.positiveWeight)))


def ranked_words(df: DataFrame, columns: list[str], size: int) -> list[str]:
    """The ``size`` most frequent words of the token columns, by frequency, then word; only these reach the driver.

    The counts are written. How many words have each frequency says which frequencies are kept whole; of the one at which
    the vocabulary ends, the first words are found by ranks in buckets. A sort with a limit would send as many words from
    every partition to the driver."""
    tokens = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in columns))
    counts = materialize(df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    last, before = None, 0  # the frequency at which the vocabulary ends, and the words above it
    for n, words in sorted(counts.groupBy("n").agg(F.count("*")).collect(), reverse=True):  # few: their sum is the tokens
        if before + words > size:
            last = n
            break
        before += words
    kept = counts.filter(F.col("n") > last) if last is not None else counts
    if last is not None and before < size:
        tied = exact_row_number(counts.filter(F.col("n") == last), [], [F.col("word")], [F.substring("word", 1, TIE_PREFIX)])
        kept = kept.unionByName(tied.filter(F.col("rn") <= size - before).select("word", "n"))
    found = kept.toArrow()
    discard(counts)
    words = pa.table({"n": found["n"], "word": found["word"].cast(pa.binary())})  # bytes: the order of Spark's strings
    return found["word"].take(pc.sort_indices(words, sort_keys=[("n", "descending"), ("word", "ascending")])).to_pylist()


def _string_array(spark, words: list[str]):
    """The words as a Java array in one call; ``from_vocabulary`` makes a call a word, which takes longer than the fit.
    None if a word holds the separator."""
    if any("\n" in w for w in words):
        return None
    return spark._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(words), -1)


def _terms(words: list[str], array, inp: str, out: str) -> CountVectorizerModel:
    if array is None:
        return CountVectorizerModel.from_vocabulary(words, inputCol=inp, outputCol=out, binary=True)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", array)
    model.setInputCol(inp).setOutputCol(out).setBinary(True)
    return model._set(vocabSize=len(words))


class FittedTerms(Estimator):
    """Counts a vocabulary on the token columns ``counted`` of the training rows and encodes each of the token columns
    ``inputs`` with it: which of its words occur, as a vector of length 1. Words it lacks encode nothing, so a
    column that is not counted has weight only for words that the counted ones have too.
    """

    def __init__(self, inputs: list[str], outputs: list[str], counted: list[str], size: int):
        super().__init__()
        self.inputs, self.outputs, self.counted, self.size = list(inputs), list(outputs), list(counted), size

    def _fit(self, df: DataFrame) -> PipelineModel:
        words = [NO_WORD, *ranked_words(df, self.counted, self.size)]
        array = _string_array(df.sparkSession, words)
        stages = []
        for inp, out in zip(self.inputs, self.outputs, strict=True):
            stages += [_terms(words, array, inp, out + "_tf"),
                       Normalizer(inputCol=out + "_tf", outputCol=out, p=2.0), VectorSizeHint(inputCol=out, size=len(words))]
        return PipelineModel(stages)


class _TableWriter(MLWriter):
    def __init__(self, stage: PooledVectors):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = self.stage.vectors.sparkSession
        DefaultParamsWriter.saveMetadata(self.stage, path, spark)
        self.stage.vectors.select("word", "vector").write.parquet(f"{path}/vectors")


class _TableReader(MLReader):
    def load(self, path: str) -> PooledVectors:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        stage = PooledVectors(spark.read.parquet(f"{path}/vectors"))
        stage._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(stage, meta)
        return stage


class PooledVectors(Transformer, MLWritable, MLReadable):
    """``outputCol``: sum of the vectors of a row's tokens / number of tokens, as a vector (zeros without tokens).

    The table (word, vector) is saved with the stage. One that fits into every worker is looked up where the rows are, a
    larger one is joined. Results belong to rows: rows that share an id, or have none, keep their own.
    """

    inputCol = Param(Params._dummy(), "inputCol", "token column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "pooled vector", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "row id", TypeConverters.toString)
    dim = Param(Params._dummy(), "dim", "length of the vectors", TypeConverters.toInt)

    def __init__(self, vectors: DataFrame, inputCol: str | None = None, outputCol: str | None = None, keyCol: str = "id", dim: int | None = None):
        super().__init__()
        self.vectors = vectors
        given = {"inputCol": inputCol, "outputCol": outputCol, "keyCol": keyCol, "dim": dim}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        tokens, key, out = (self.getOrDefault(p) for p in (self.inputCol, self.keyCol, self.outputCol))
        if pool := mean_pool(self.vectors, self.getOrDefault(self.dim)):
            return df.withColumn(out, array_to_vector(pool(F.col(tokens))))
        row = F.struct(F.col(key).alias("k"), F.xxhash64(tokens).alias("h"), F.hash(tokens).alias("g"))
        d = df.withColumn("__row", row)
        own = d.select("__row", tokens).dropDuplicates(["__row"])
        pooled = masked_mean_pool(own, self.vectors, self.getOrDefault(self.dim), tokens=tokens, key="__row", out="__pool") \
            .select(F.col("__row").alias("__of"), array_to_vector("__pool").alias(out))
        return d.join(pooled, d["__row"].eqNullSafe(pooled["__of"]), "left").drop("__row", "__of")

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()


def vector_length(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vector"))).first()[0] or 0


class LearntVectors(Estimator):
    """Fits skip-gram word vectors on a token column of the training rows and pools them. Words that only other rows have
    get no vector, so nothing leaks from the dev and val parts.
    """

    def __init__(self, inputCol: str, outputCol: str, keyCol: str = "id", size: int = 32, min_count: int = 2, iterations: int = 3, seed: int = 42):
        super().__init__()
        self.inputCol, self.outputCol, self.keyCol = inputCol, outputCol, keyCol
        self.size, self.min_count, self.iterations, self.seed = size, min_count, iterations, seed

    def _fit(self, df: DataFrame) -> PooledVectors:
        seen = df.select(F.explode(self.inputCol).alias("w")).groupBy("w").count().filter(F.col("count") >= self.min_count)
        if seen.limit(1).count():
            model = Word2Vec(vectorSize=self.size, minCount=self.min_count, maxIter=self.iterations, seed=self.seed,
                             numPartitions=df.rdd.getNumPartitions(), inputCol=self.inputCol, outputCol="__w2v").fit(df.select(self.inputCol))
            # written: the plan of a fitted model's table holds every vector on the driver, again with each use
            vectors = materialize(model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector")), "learnt-vectors")
        else:  # nothing to learn from
            vectors = df.sparkSession.createDataFrame([], "word string, vector array<float>")
        return PooledVectors(vectors, self.inputCol, self.outputCol, self.keyCol, self.size)
