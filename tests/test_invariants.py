"""Invariants: fast forms equal brute force, folds are exact, results do not
depend on the number of partitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import folds as FO
from helixframe.operators import regions as R
from helixframe.operators import text as TX
from helixframe.operators.ranking import global_row_number
from tests.conftest import MEDIUM


def _mat(rnd, n, d=6, zero_row=False):
    m = [[rnd.uniform(-1, 1) for _ in range(d)] for _ in range(n)]
    if zero_row:
        m[0] = [0.0] * d
    return m


def test_region_linear_forms_equal_all_pairs(spark):
    rnd = random.Random(3)
    data = [(i, _mat(rnd, rnd.randint(1, 4)), _mat(rnd, rnd.randint(1, 4), zero_row=(i % 3 == 0)))
            for i in range(25)]
    df = spark.createDataFrame(data, "id int, a array<array<double>>, b array<array<double>>")
    got = {r["id"]: r for r in df.select("id", R.region_cosine("a", "b").alias("cos"),
                                         R.region_pearson("a", "b").alias("pea"),
                                         R.region_euclidean("a", "b").alias("euc"),
                                         R.mean_pairwise_dot("a", "b").alias("dot")).collect()}
    for i, a, b in data:
        A, B = np.array(a), np.array(b)
        cos, pea, euc, dot = [], [], [], []
        for u in A:
            for v in B:
                nu, nv = np.linalg.norm(u), np.linalg.norm(v)
                cos.append(0.0 if nu * nv == 0 else u @ v / (nu * nv))
                cov = ((u - u.mean()) * (v - v.mean())).mean()
                pea.append(cov / (u.std(ddof=1) * v.std(ddof=1)) if u.std() > 0 and v.std() > 0 else float("nan"))
                euc.append(np.sqrt(((u - v) ** 2).sum()))
                dot.append(u @ v)
        assert got[i]["cos"] == pytest.approx(np.mean(cos), abs=1e-12)
        assert got[i]["euc"] == pytest.approx(-np.mean(euc), abs=1e-12)
        assert got[i]["dot"] == pytest.approx(np.mean(dot), abs=1e-12)
        if any(math.isnan(x) for x in pea):
            assert math.isnan(got[i]["pea"])                  # zero spread propagates as NaN
        else:
            assert got[i]["pea"] == pytest.approx(np.mean(pea), abs=1e-12)


def test_region_span_negative_row_counts(spark):
    m = [[0.0, 0.0], [-1.0, -2.0], [0.0, 0.0], [1.0, 0.0], [0.0, -0.5]]
    df = spark.createDataFrame([(m,)], "m array<array<double>>")
    span = df.select(R.region_span("m").alias("s")).first()["s"]
    # an all-negative row counts (its max is non-zero), the interior zero row stays,
    # a row whose max is exactly 0 does not count (Q2)
    assert span == [[-1.0, -2.0], [0.0, 0.0], [1.0, 0.0]]


def _dtw_rec(a, b):
    n, m = len(a), len(b)
    memo = {}

    def f(i, j):
        if i == 0 and j == 0:
            return 0.0
        if i == 0 or j == 0:
            return math.inf
        if (i, j) not in memo:
            c = math.dist(a[i - 1], b[j - 1])
            memo[(i, j)] = c + min(f(i - 1, j), f(i, j - 1), f(i - 1, j - 1))
        return memo[(i, j)]
    return f(n, m)


def test_dtw_udf_equals_recursion(spark):
    rnd = random.Random(5)
    data = [(i, _mat(rnd, rnd.randint(1, 5), 3), _mat(rnd, rnd.randint(1, 5), 3)) for i in range(10)]
    df = spark.createDataFrame(data, "id int, a array<array<double>>, b array<array<double>>")
    got = dict((r["id"], r["d"]) for r in df.select("id", R.region_dtw_udf("a", "b").alias("d")).collect())
    for i, a, b in data:
        assert got[i] == pytest.approx(_dtw_rec(a, b), abs=1e-12)


def _bleu_brute(hyp, refs):
    """NLTK corpus BLEU (method 4) for one hypothesis, written out directly."""
    from collections import Counter
    c = len(hyp)
    num, den = [], []
    for n in range(1, 5):
        hc = Counter(tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1))
        mx = Counter()
        for r in refs:
            for g, k in Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1)).items():
                mx[g] = max(mx[g], k)
        num.append(sum(min(k, mx[g]) for g, k in hc.items()))
        den.append(max(1, sum(hc.values())))
    if num[0] == 0:
        return 0.0
    r = min((len(x) for x in refs), key=lambda L: (abs(L - c), L))
    p, inc = [], 1
    for nu, de in zip(num, den):
        if nu == 0 and c > 1:
            inc *= 2
            p.append(1 / (inc * 5 / math.log(c)) / de)
        else:
            p.append(nu / de)
    if min(p) <= 0:
        return 0.0
    bp = 1.0 if c > r else math.exp(1 - r / c)
    return bp * math.exp(sum(0.25 * math.log(x) for x in p))


def test_bleu_smoothing_by_hand(spark):
    # 6 words, one match: p1 = 1/6, then 1/(2^j * 5/ln 6) over 5, 4 and 3 n-grams
    k = math.log(6) / 5
    want = (1 / 6 * k / 2 / 5 * k / 4 / 4 * k / 8 / 3) ** 0.25
    assert want == pytest.approx(0.0376, abs=5e-5)
    hyp = spark.createDataFrame([(1, "a b c d e f")], "i long, text string")
    ref = spark.createDataFrame([(1, "a x y z w q")], "i long, text string")
    assert TX.corpus_bleu(hyp, ref, ["i"]).first()[0] == pytest.approx(want, rel=1e-12)
    pair = hyp.selectExpr("1 as g", "i", "text").union(ref.selectExpr("1 as g", "2 as i", "text"))
    assert {round(r.bleu, 12) for r in TX.self_bleu_scores(pair, ["g"], ["i"], "text").collect()} == {round(want, 12)}


def test_self_bleu_fast_form_equals_all_pairs(spark):
    rnd = random.Random(11)
    words = ["a", "b", "c", "d", "e", "f"]
    rows = []
    for g in range(12):
        n = rnd.randint(2, 6)
        sents = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(n)]
        if g % 4 == 0:
            sents[1] = sents[0]                      # identical sentences
        rows += [(g, t, s) for t, s in enumerate(sents)]
    df = spark.createDataFrame(rows, "g int, t int, text string")
    got = {(r["g"], r["t"]): r["bleu"] for r in TX.self_bleu_scores(df, ["g"], ["t"], "text").collect()}
    for g, grp in itertools.groupby(rows, key=lambda x: x[0]):
        grp = list(grp)
        for _, t, s in grp:
            refs = [o.split() for _, t2, o in grp if t2 != t]
            assert got[(g, t)] == pytest.approx(_bleu_brute(s.split(), refs), abs=1e-12), (g, t)


def test_kfold_sizes_and_cover(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "row_id")
    f = FO.kfold_assign(df, "row_id", k=10)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sum(sizes) == 1003 and sizes[-1] - sizes[0] <= 1 and len(sizes) == 10
    assert f.select("row_id").distinct().count() == 1003


def test_stratified_folds_balance_classes(spark):
    df = spark.range(0, 500).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    f = FO.stratified_kfold_assign(df, "row_id", "y", k=10)
    per = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in per if r["y"] == y]
        assert max(c) - min(c) <= 1


def test_paired_sample_keeps_pairs(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "row_id")
    s = FO.paired_sample(df, "row_id", 40).collect()
    assert len(s) == 40
    real = {r["pair"] for r in s if r["label"] == 1}
    fake = {r["pair"] for r in s if r["label"] == 0}
    assert real == fake
    for r in s:
        assert r["row_id"] == r["pair"] + (50 if r["label"] == 0 else 0)


def test_global_row_number_partition_independent(spark):
    o = spark.read.parquet(f"{MEDIUM}/orders.parquet").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]   # unique total order
    a = global_row_number(o, order, "rn", num_partitions=1)
    b = global_row_number(o.repartition(13), order, "rn", num_partitions=7)
    ka = dict(a.select("o_orderkey", "rn").collect())
    kb = dict(b.select("o_orderkey", "rn").collect())
    assert len(ka) == o.count()
    assert ka == kb and sorted(ka.values()) == list(range(1, len(ka) + 1))


@pytest.mark.parametrize("key", ["candidate_selection", "token_counts", "running_mean_loss", "kfold_assign",
                                 "self_bleu", "roc_curve"])
def test_queries_do_not_depend_on_partitioning(spark, key):
    import __spark_entry__ as E
    from tests.conftest import SMALL
    q = E.queries()[key]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(repr(tuple(r)) for r in q(spark, SMALL).collect())   # repr: NaN equals NaN
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = sorted(repr(tuple(r)) for r in q(spark, SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight
