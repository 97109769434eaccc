"""Exact k highest inner products by multi-resolution segment statistics.

A vector is summarised, at each resolution, by the mean and the deviation of
its segments.  For a segment of L components, q.x <= L (mq mx + sq sx), which
is the lower bound L ((mq-mx)^2 + (sq-sx)^2) on the squared distance written
for inner products.  A block of queries meets a block of candidates: the
coarsest bounds order the candidates, exact scores of the best bounds give
each query a threshold, finer bounds and then exact scores are computed for
the candidates that still reach it, ties included.

Queries are a stated set and meet all rows block by block; only ``k`` rows per
query and block leave a task.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows of a null id, take no part; only vectors of one length
meet; repeated rows are candidates each; a query never meets rows of its own
id; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import pack, stored, unpack

QUERY_BLOCK, ROW_BLOCK = 1024, 4096
SEGMENTS = (4, 16)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``i, v`` (array of doubles) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("i"), v.alias("v")).where(F.col("i").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def _packed(table: pa.Table) -> pa.Table:
    ids = table["i"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "b": pa.array([table["b"][0].as_py()], pa.int32()), "ids": pa.array([pack(ids)], pa.binary()), "m": pa.array([pack(flat)], pa.binary())})


def blocks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """``dim, b, ids, m``: one row per block of about ``size`` vectors."""
    return rows.withColumn("dim", F.size("v")).withColumn("b", F.pmod(F.xxhash64("i"), F.lit(max(1, -(-n // size)))).cast("int")).groupBy("dim", "b").applyInArrow(
        _packed, "dim int, b int, ids binary, m binary")


def summaries(m: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of each row's segments, side by side."""
    cuts = np.array_split(np.arange(m.shape[1]), min(segments, m.shape[1]))
    return np.concatenate([np.stack([m[:, c].mean(1) * len(c) ** 0.5, m[:, c].std(1) * len(c) ** 0.5], 1) for c in cuts], 1)


def best(query_ids, queries, row_ids, rows, k: int, segments=SEGMENTS):
    """(query id, row id, score) of each query's k best rows of one block."""
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * rows.shape[1]
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    x, q = rows.astype(kind), queries.astype(kind)
    levels = [(summaries(queries.astype(np.float64), s), summaries(rows.astype(np.float64), s)) for s in segments]
    slack = 1e-9 * largest + 1e-6
    coarse = levels[0][0] @ levels[0][1].T + slack
    out = []
    for i in range(len(q)):
        bound = coarse[i].copy()
        bound[row_ids == query_ids[i]] = -np.inf
        n = int((bound > -np.inf).sum())
        if not n:
            continue
        first = np.argpartition(-bound, min(4 * k, len(bound)) - 1)[:4 * k]
        first = first[bound[first] > -np.inf]
        scores = x[first] @ q[i]
        least = np.sort(scores)[-k] if len(scores) >= k else -np.inf
        some = np.flatnonzero(bound >= least) if least > -np.inf else np.flatnonzero(bound > -np.inf)
        for qs, xs in levels[1:]:
            some = some[xs[some] @ qs[i] + slack >= least]
        scores = (x[some] @ q[i]).astype(np.int64)
        top = np.lexsort((row_ids[some], -scores))[:k]
        out += [(int(query_ids[i]), int(row_ids[some[t]]), int(scores[t])) for t in top]
    return out


def _meet(k: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                dim = get("dim")
                found = best(unpack(get("qids")), unpack(get("qm")).reshape(-1, dim), unpack(get("ids")), unpack(get("m")).reshape(-1, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k rows of highest inner
    product of floor(scale * component)."""
    whole = lambda df: valid(df, id_col, vec_col).select("i", F.transform("v", lambda x: F.floor(x * F.lit(scale))).alias("v"))
    rows, asks = whole(vectors), whole(queries).distinct()
    n, m = rows.count(), asks.count()
    cand = blocks(rows, n, ROW_BLOCK)
    ask = blocks(asks, m, QUERY_BLOCK).select("dim", F.col("ids").alias("qids"), F.col("m").alias("qm"), F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // ROW_BLOCK)) - 1))).alias("b"))
    # Stated as a merge: the query blocks are repeated for every row block, far beyond what is estimated for them.
    found = cand.join(ask.hint("merge"), ["dim", "b"]).repartition(F.xxhash64("qids", "b")).mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return stored(found, "topk").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
