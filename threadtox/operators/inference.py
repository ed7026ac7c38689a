"""Batch inference with a user's own network.

The network runs in the tasks on Arrow batches (``predict_batch_udf``): its factory is called once per Python worker, not
once per batch, and gets the inputs as numpy arrays of the given shapes. Rows need no collecting and no shuffle; a lost
task loads the network again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from threadtox.session import ship_package

Network = Callable[..., np.ndarray]


def network_scores(df: DataFrame, make_network: Callable[[], Network], inputs: Mapping[str, Sequence[int]], key: str = "id",
                   keep: Sequence[str] = (), batch_size: int = 256, outputs: int = 1, out: str = "score") -> DataFrame:
    """key, kept columns, ``out``: what the network says about each row.

    ``inputs`` names the input columns and the shape of one row's value (``[128]`` for a padded id list, ``[]`` for a
    number); the network takes one array of shape (batch, *shape) for each and returns (batch,), or (batch, outputs) for
    ``outputs`` > 1, then ``out`` is a list. Rows with a null input get null. ``batch_size`` bounds a worker's memory.
    """
    ship_package(df.sparkSession)
    columns = list(inputs)
    kind = DoubleType() if outputs == 1 else ArrayType(DoubleType())
    shapes = [list(inputs[c]) for c in columns]
    udf = predict_batch_udf(make_network, return_type=kind, batch_size=batch_size,
                            input_tensor_shapes=shapes if any(shapes) else None)
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    scored = df.filter(whole).select(key, *keep, udf(*columns).alias(out))
    rest = df.filter(~whole).select(key, *keep, F.lit(None).cast(kind).alias(out))
    return scored.unionByName(rest)


def bag_network_factory(hidden: int = 3) -> Callable[[], Network]:
    """A small fixed network over encoder inputs, for queries and tests: the mean of the real tokens' embeddings, one tanh
    layer, a logistic output. Weights follow from the ids, so a SQL form can compute the same numbers."""
    def make() -> Network:
        unit = np.arange(hidden, dtype=np.int64)

        def embedding(ids: np.ndarray) -> np.ndarray:
            return ((ids[..., None] * 7919 + unit * 104729 + 13) % 1000) / 1000.0 - 0.5

        def network(input_ids: np.ndarray, input_mask: np.ndarray) -> np.ndarray:
            mask = input_mask[..., None].astype(np.float64)
            mean = (embedding(input_ids.astype(np.int64)) * mask).sum(1) / np.maximum(mask.sum(1), 1)
            return 1 / (1 + np.exp(-(np.tanh(8 * mean) * (unit + 1)).sum(1)))
        return network
    return make


def bag_network_sql(ids: str, mask: str, hidden: int = 3) -> str:
    """The network of :func:`bag_network_factory` as a DuckDB expression over two lists."""
    def unit(h: int) -> str:
        terms = f"list_transform({ids}, lambda x, i: {mask}[i] * (((x * 7919 + {h * 104729 + 13}) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE))"
        return f"{h + 1} * tanh(8 * list_sum({terms}) / greatest(list_sum({mask}), 1))"
    return f"1 / (1 + exp(-({' + '.join(unit(h) for h in range(hidden))})))"
