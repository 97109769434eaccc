"""User-function surface (X1, X2): the slow path, always Arrow-batched.

* ``batch_score_udf``: a user model applied to fixed-size batches of rows
  through ``predict_batch_udf`` (the model is built once per Python worker).
* ``pair_udf``: a user function of two matrices -> scalar, evaluated row by
  row inside Arrow batches (no shuffle: both matrices live in the row).
* ``grouped_pair_apply``: the same function when the matrices arrive in long
  form ``(keys..., side, pos, vector)``; one group = one (id, pair).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType


def batch_score_udf(make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int,
                    batch_size: int = 128):
    """``make_predict_fn()`` returns ``predict(batch: ndarray[n, width]) -> ndarray[n]``."""
    return predict_batch_udf(make_predict_fn, return_type=DoubleType(), batch_size=batch_size,
                             input_tensor_shapes=[[width]])


def linear_model(weights: Sequence[float], bias: float) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A user model for X1: a linear scorer, built once per worker."""
    w = np.asarray(weights, dtype=float)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return x.reshape(len(x), -1) @ w + bias
        return predict
    return make


def pair_udf(fn: Callable[[np.ndarray, np.ndarray], float]):
    """Wrap ``fn(matrix1, matrix2) -> float`` as an Arrow-batched column function."""
    @F.pandas_udf(DoubleType())
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None or len(x) == 0 or len(y) == 0:
                out.append(float("nan"))
                continue
            out.append(float(fn(np.vstack(x).astype(float), np.vstack(y).astype(float))))
        return pd.Series(out)
    return apply


def grouped_pair_apply(long: DataFrame, keys: list[str], fn: Callable[[np.ndarray, np.ndarray], float],
                       name: str = "value") -> DataFrame:
    """X2 over long-form input ``(keys..., side in {'a','b'}, pos, vector)``.

    Each group is one (id, pair): two bounded matrices, so no group grows
    with the table.  The groups are many and small: they are brought together
    by one exchange and sort, and a task goes through its sorted rows batch by
    batch, cutting them into groups where the keys change."""
    spread = long.repartition(*keys).select(F.struct(*keys).alias("k"), F.col("side"), F.col("pos"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    rows = spread.sortWithinPartitions("k", "side", "pos")
    schema = long.select(*keys, F.lit(0.0).alias(name)).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        def values(table: pa.Table, first: np.ndarray, end: np.ndarray):
            vectors = table["vector"].combine_chunks()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            offs = np.append(0, np.cumsum(np.diff(vectors.offsets.to_numpy())))
            is_b = pc.equal(table["side"], "b").to_numpy(zero_copy_only=False).astype(bool)
            out = []
            for i, j in zip(first.tolist(), end.tolist()):
                m = i + int(np.count_nonzero(~is_b[i:j]))
                out.append(float(fn(flat[offs[i]:offs[m]].reshape(m - i, -1), flat[offs[m]:offs[j]].reshape(j - m, -1))))
            keyed = table["k"].combine_chunks().take(pa.array(first))
            return pa.RecordBatch.from_arrays([*keyed.flatten(), pa.array(out, pa.float64())], schema=arrow)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            k = table["k"].combine_chunks()
            changed = np.zeros(len(k), bool)
            for column in k.flatten():
                code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                changed[1:] |= code[1:] != code[:-1]
            first = np.append(0, np.flatnonzero(changed))
            if len(first) > 1:
                yield values(table, first[:-1], first[1:])
            held = table.slice(int(first[-1]))
        if held is not None and held.num_rows:
            yield values(held, np.array([0]), np.array([held.num_rows]))

    return rows.mapInArrow(run, schema)


def mean_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """A sample user function: mean cosine over all token pairs (zero vector -> 0)."""
    na = np.linalg.norm(a, axis=1)
    nb = np.linalg.norm(b, axis=1)
    den = np.outer(na, nb)
    sims = np.divide(a @ b.T, den, out=np.zeros_like(den), where=den > 0)
    return float(sims.mean())
