"""Numeric column functions: class bins, link functions, array maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the published ones) ---
# Inverse of the log1p standardisation used for intensities.
INTENSITY_LOG1P_MEAN = 4.813026468891894
INTENSITY_LOG1P_STD = 1.6166693708525242
# Class-bin edges for intensities.
BIN_EDGES_4 = (10.0, 100.0, 500.0)
BIN_EDGES_3 = (10.0, 100.0)
ACTIVE_THRESHOLD = 10.0
# Epsilons of the two categorical distribution measures.
CATEGORICAL_EPS = 1e-20
# --- end of fixed values ---


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _valid(x: Column) -> Column:
    # NaN compares as the largest value in Spark, so it is tested explicitly.
    return x.isNotNull() & ~F.isnan(x)


def bin_intensity_4(x: Column | str) -> Column:
    """0 (<10), 1 [10,100), 2 [100,500), 3 (>=500), else -1."""
    v = _c(x)
    a, b, c = BIN_EDGES_4
    return (F.when(~_valid(v), F.lit(-1)).when(v < a, 0).when(v < b, 1)
            .when(v < c, 2).otherwise(3))


def bin_intensity_3(x: Column | str) -> Column:
    """0 (<10), 1 [10,100), 2 (>=100), else -1."""
    v = _c(x)
    a, b = BIN_EDGES_3
    return F.when(~_valid(v), F.lit(-1)).when(v < a, 0).when(v < b, 1).otherwise(2)


def bin_activity_2(x: Column | str) -> Column:
    """0 (<10), 1 (>=10), else -1."""
    v = _c(x)
    return F.when(~_valid(v), F.lit(-1)).when(v < ACTIVE_THRESHOLD, 0).otherwise(1)


def bin_strong_weak(x: Column | str) -> Column:
    """-1 (<10, dropped later by P6), 0 [10,100), 1 (>=100)."""
    v = _c(x)
    a, b = BIN_EDGES_3
    return F.when(~_valid(v), F.lit(-1)).when(v < a, -1).when(v < b, 0).otherwise(1)


def log1p_standardise(x: Column | str, mean: float = INTENSITY_LOG1P_MEAN,
                      std: float = INTENSITY_LOG1P_STD) -> Column:
    """F9 forward."""
    return (F.log1p(_c(x)) - F.lit(mean)) / F.lit(std)


def expm1_destandardise(y: Column | str, mean: float = INTENSITY_LOG1P_MEAN,
                        std: float = INTENSITY_LOG1P_STD) -> Column:
    """F9 inverse: expm1(y * std + mean)."""
    return F.expm1(_c(y) * F.lit(std) + F.lit(mean))


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def sigmoid_class(z: Column | str) -> Column:
    """sigmoid then round half to even (``rint``; ``round`` is half-up)."""
    return F.rint(sigmoid(z)).cast("int")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (a Column -> Column function).

    Catalyst does not share common subexpressions inside higher-order
    function lambdas, so an array referenced inside a lambda would be
    recomputed per element; binding it through a one-element ``transform``
    evaluates it exactly once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column | str) -> Column:
    """max-shifted softmax of an array (each intermediate computed once)."""
    z = _c(logits)
    return let(F.array_max(z), lambda m:
               let(F.transform(z, lambda v: F.exp(v - m)), lambda e:
                   let(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda s:
                       F.transform(e, lambda v: v / s))))


def logsumexp(logits: Column | str) -> Column:
    z = _c(logits)
    return let(F.array_max(z), lambda m:
               m + F.log(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))))


def argmax(logits: Column | str) -> Column:
    """O2: 0-based index of the largest value, first on ties."""
    z = _c(logits)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def categorical_kl(p: Column | str, q: Column | str, eps: float = CATEGORICAL_EPS) -> Column:
    """relu(sum p * (ln(p + e) - ln(q + e)))."""
    terms = F.zip_with(_c(p), _c(q), lambda a, b: a * (F.log(a + F.lit(eps)) - F.log(b + F.lit(eps))))
    return F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0))


def categorical_xent(p: Column | str, target: Column | str, eps: float = CATEGORICAL_EPS) -> Column:
    """-ln(max(p[target], 0) + e), target 0-based."""
    pt = F.element_at(_c(p), _c(target) + 1)
    return -F.log(F.greatest(pt, F.lit(0.0)) + F.lit(eps))


def linear_head(vec: Column | str, weights: list[float], bias: float) -> Column:
    """w . v + b with literal weights."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(_c(vec), w, lambda a, b: a * b), F.lit(float(bias)),
                       lambda acc, v: acc + v)


def one_hot(x: Column | str, k: int) -> Column:
    """index to an int indicator array of width k."""
    v = _c(x)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == v).cast("int"))
