"""Similarity between regions of an embedded sequence.

A sequence's hidden states are one row holding ``ARRAY<ARRAY<DOUBLE>>``
(token x dimension).  Every region statistic is a row-local expression over
two bounded matrices, so none of them shuffles; the mean over all n x m
token pairs is never materialised as rows:

* cosine (A27): mean_ij cos(a_i, b_j) = mean_i(a_i/|a_i|) . mean_j(b_j/|b_j|)
* Pearson (A29): centre and unit-scale each vector, the same dot of means,
  times (d-1)/d for the biased covariance over the unbiased deviations
* Euclidean (A28) has no linear form; it is a nested fold inside the row.
* DTW (A30) is a dynamic program, mutual information (A31) a histogram:
  Arrow-batched pandas UDFs per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from helixframe.functions.numeric import let

# --- fixed values: the five regions and their ten unordered pairs ---
REGIONS = ("blank", "up", "core", "down", "gene")
REGION_PAIRS = tuple((a, b) for i, a in enumerate(REGIONS) for b in REGIONS[i + 1:])
MI_BINS = 30
# --- end of fixed values ---


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vsum(m: Column) -> Column:
    """Element-wise sum of the vectors of a matrix (``m`` evaluated once)."""
    return let(m, lambda mm: F.aggregate(F.slice(mm, 2, F.greatest(F.size(mm) - 1, F.lit(0))),
                                         F.try_element_at(mm, F.lit(1)),
                                         lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y)))


def vmean(m: Column) -> Column:
    return let(m, lambda mm: F.transform(vsum(mm), lambda x: x / F.size(mm)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def region_span(m: Column | str) -> Column:
    """P10: rows from the first to the last whose maximum is non-zero (an
    all-negative row counts, a row with maximum exactly 0 does not; interior
    zero rows stay).  Empty when no row qualifies."""
    return let(_c(m), lambda mat: let(F.transform(mat, lambda v: F.array_max(v) != 0), lambda nz: F.when(
        F.array_position(nz, True) > 0,
        F.slice(mat, F.array_position(nz, True).cast("int"),
                (F.size(nz) - F.array_position(F.reverse(nz), True) + 1 - F.array_position(nz, True) + 1)
                .cast("int")))
        .otherwise(F.slice(mat, 1, 0))))


def unit_rows(m: Column) -> Column:
    """Each vector scaled to length 1; a zero vector stays zero (cosine 0)."""
    return F.transform(m, lambda v: let(norm(v), lambda n: F.transform(
        v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def centred_unit_rows(m: Column) -> Column:
    """Each vector minus its mean, scaled to length 1; zero spread gives NaN
    (so the mean over pairs is NaN, as in the reference)."""
    def one(v: Column) -> Column:
        return let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), lambda mu:
                   let(F.transform(v, lambda x: x - mu), lambda c:
                       let(norm(c), lambda n: F.transform(
                           c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(float("nan")))))))
    return F.transform(m, one)


def cosine_profile(m: Column | str) -> Column:
    """Mean of the unit vectors: the per-region half of the cosine form."""
    return vmean(unit_rows(_c(m)))


def pearson_profile(m: Column | str) -> Column:
    """Mean of the centred unit vectors: the per-region half of the Pearson form."""
    return vmean(centred_unit_rows(_c(m)))


def pearson_from_profiles(pa: Column | str, pb: Column | str, corrected: bool = False) -> Column:
    """A29 from two profiles: dot * (d-1)/d, d the vector width; with
    ``corrected`` the plain correlation, both moments with the same divisor (Q9)."""
    if corrected:
        return dot(_c(pa), _c(pb))
    return let(_c(pa), lambda x: dot(x, _c(pb)) * (F.size(x) - 1) / F.size(x))


def region_cosine(a: Column | str, b: Column | str) -> Column:
    """Mean cosine over all token pairs (linear form)."""
    return dot(vmean(unit_rows(_c(a))), vmean(unit_rows(_c(b))))


def region_pearson(a: Column | str, b: Column | str) -> Column:
    """Mean over token pairs of cov/(std1 std2), biased covariance and
    unbiased deviations: r * (d-1)/d (linear form)."""
    return let(_c(a), lambda ma: let(F.size(F.try_element_at(ma, F.lit(1))), lambda d: dot(
        vmean(centred_unit_rows(ma)), vmean(centred_unit_rows(_c(b)))) * (d - 1) / d))


def region_euclidean(a: Column | str, b: Column | str) -> Column:
    """Minus the mean Euclidean distance over all token pairs (in-row)."""
    def body(ma: Column, mb: Column) -> Column:
        total = F.aggregate(ma, F.lit(0.0), lambda acc, u: acc + F.aggregate(
            mb, F.lit(0.0), lambda acc2, v: acc2 + F.sqrt(F.aggregate(
                F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t))))
        return -(total / (F.size(ma) * F.size(mb)))
    return let(_c(a), lambda ma: let(_c(b), lambda mb: body(ma, mb)))


def mean_pairwise_dot(a: Column | str, b: Column | str) -> Column:
    """J7 summary: the mean over all n x m token pairs of their dot product,
    as the dot of the two mean vectors (no pairs are formed)."""
    return dot(vmean(_c(a)), vmean(_c(b)))


def mean_pool(m: Column | str) -> Column:
    """Element-wise mean over all positions (zero rows count)."""
    return vmean(_c(m))


def cls_pool(m: Column | str) -> Column:
    """The vector at position 0."""
    return F.try_element_at(_c(m), F.lit(1))


def _dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Cheapest warping path, one anti-diagonal at a time (``acc[i]`` is cell
    (i, k - i)), so the interpreter takes n + m steps instead of n * m."""
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return float("nan")
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    before[0] = 0.0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        acc = np.full(n + 1, np.inf)
        acc[i] = cost[i - 1, k - i - 1] + np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
        before, last = last, acc
    return float(last[n])


def dtw_distance(a, b) -> float:
    """A30 on two matrices (lists of vectors), L2 local cost."""
    return _dtw(np.asarray([np.asarray(v, dtype=float) for v in a]).reshape(len(a), -1),
                np.asarray([np.asarray(v, dtype=float) for v in b]).reshape(len(b), -1))


@F.pandas_udf(DoubleType())
def region_dtw_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The dynamic program per row, Arrow-batched."""
    return pd.Series([dtw_distance(x, y) for x, y in zip(a, b)])


def region_pairs(df: DataFrame, regions: dict[str, Column], keep: list[str]) -> DataFrame:
    """The ten unordered region pairs of every row, long form
    ``(keep..., pair, a, b)``; a fixed ten rows per input row."""
    # Project each region once; building the pairs then only references columns.
    spans = df.select(*keep, *[regions[r].alias(f"__r_{r}") for r in REGIONS])
    pairs = F.array(*[F.struct(F.lit(f"{x}_{y}").alias("pair"), F.col(f"__r_{x}").alias("a"),
                               F.col(f"__r_{y}").alias("b")) for x, y in REGION_PAIRS])
    return spans.select(*keep, F.inline(pairs))


def _mutual_info(x: np.ndarray, y: np.ndarray, bins: int) -> float:
    def binned(v: np.ndarray) -> np.ndarray:
        lo, w = v.min(), v.max() - v.min()
        return np.minimum(np.floor((v - lo) * (bins / w)), bins - 1).astype(np.int64) if w > 0 else np.zeros(len(v), np.int64)

    n, bx, by = len(x), binned(x), binned(y)
    joint, c = np.unique(bx * bins + by, return_counts=True)
    cx, cy = np.bincount(bx, minlength=bins), np.bincount(by, minlength=bins)
    return float(np.sum(c / n * np.log(c / n / (cx[joint // bins] / n * (cy[joint % bins] / n)))))


def mutual_information(pairs: DataFrame, key: list[str], a: str = "a", b: str = "b",
                       bins: int = MI_BINS, name: str = "mutual_info") -> DataFrame:
    """A31 (textbook joint form): the flattened values of the two matrices
    paired by position (up to the shorter, pairs with a null left out), each
    binned on its own [min, max] into ``bins`` equal bins (last closed);
    MI = sum pxy ln(pxy/(px py)).  Both matrices lie in the row, so it is an
    Arrow-batched function of the row and nothing is shuffled; rows without
    a pair are not returned, a NaN or infinite value gives NaN."""
    @F.pandas_udf(DoubleType())
    def info(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_mutual_info(np.asarray(u), np.asarray(v), bins)
                          if np.isfinite(u).all() and np.isfinite(v).all() else float("nan") for u, v in zip(x, y)], dtype=float)

    zipped = F.arrays_zip(F.flatten(a).alias("x"), F.flatten(b).alias("y"))
    z = pairs.select(*key, F.filter(zipped, lambda t: t["x"].isNotNull() & t["y"].isNotNull()).alias("__z"))
    return z.where(F.size("__z") > 0).select(*key, info("__z.x", "__z.y").alias(name))
