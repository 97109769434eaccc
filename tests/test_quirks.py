"""Hand-computed cases for the quirks kept from the reference (FIXTURES.md §2)."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.functions import sequence as S
from helixframe.functions import tokens as TF
from helixframe.operators import metrics as M
from helixframe.operators import ranking as RK
from helixframe.operators import select as SEL
from helixframe.operators import tokens as T


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_seq_edge_dinucleotides(spark):
    df = spark.createDataFrame([("",), ("A",), ("AC",), ("acgt",), ("ANNC",), (None,)], "s string")
    out = df.select("s", S.dinucleotide_pairs("s").alias("p"), S.dinucleotide_energy("s").alias("e"),
                    S.dinucleotide_energy("s", keep_position=True).alias("k")).collect()
    got = {r["s"]: (r["p"], r["e"], r["k"]) for r in out}
    assert got[""][0] == [] and got["A"][0] == []          # short rows give no pairs (Q12)
    assert got["AC"][1] == [1.323]
    assert got["acgt"][1] == [1.323, 1.124, 1.323]          # upper-cased first
    assert got["ANNC"][1] == []                             # unknown pairs drop out (Q4)
    assert got["ANNC"][2] == [0.0, 0.0, 0.0]                # or keep their place
    assert got[None][0] is None


def test_zero_pad_and_prefix(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([float(i) for i in range(450)],)], "v array<double>")
    out = df.select(S.zero_pad("v", 4).alias("p"), S.energy_features(F.lit("ACGT"), "CA_D", 5).alias("f"),
                    S.feature_prefix(S.zero_pad("v", 400), 400).alias("q")).collect()
    assert out[0]["p"] == [1.0, 2.0, 0.0, 0.0]
    assert len(out[1]["p"]) == 450                          # longer rows untouched
    assert out[0]["f"] == [1.323, 1.124, 1.323, 0.0, 0.0]
    assert all(len(r["q"]) == 400 for r in out)


@pytest.mark.parametrize("seq,expected,found", [
    ("AAAATTAGTCC", "AAAA", True),        # marker in the middle
    ("TTAGTCC", "", True),                # at position 0: empty prefix
    ("ACGTACGT", "ACGTACG", False),       # absent: the last letter is lost (Q14)
    ("CTTAGTATTAGT", "C", True),          # first occurrence
])
def test_marker_edge(spark, seq, expected, found):
    df = spark.createDataFrame([(seq,)], "s string")
    r = df.select(S.cut_at_marker("s", "TTAGT").alias("c"), S.marker_found("s", "TTAGT").alias("m")).first()
    assert r["c"] == expected and r["m"] == found
    keep = df.select(S.cut_at_marker("s", "TTAGT", on_missing="keep").alias("c")).first()["c"]
    assert keep == (expected if found else seq)


def test_intensity_edge(spark):
    vals = [-1.0, 0.0, 9.999, 10.0, 99.9, 100.0, 499.9, 500.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = df.select(N.bin_intensity_4("x").alias("b4"), N.bin_intensity_3("x").alias("b3"),
                    N.bin_activity_2("x").alias("b2"), N.bin_strong_weak("x").alias("sw")).collect()
    assert [r["b4"] for r in out] == [0, 0, 0, 1, 1, 2, 2, 3, -1, -1]   # NaN is not >= 500 (Q3)
    assert [r["b3"] for r in out] == [0, 0, 0, 1, 1, 2, 2, 2, -1, -1]
    assert [r["b2"] for r in out] == [0, 0, 0, 1, 1, 1, 1, 1, -1, -1]
    assert [r["sw"] for r in out] == [-1, -1, -1, 0, 0, 1, 1, 1, -1, -1]


def test_rank_edge_nan_last_ties_by_id(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 2), (2, float("nan"), 1.0, 3), (3, 0.5, 1.0, 2),
                                (4, None, 9.0, 3), (5, 0.9, None, 0)],
                               "row_id long, a double, b double, c int")
    r = SEL.rank_candidates(df, ["a", "b", "c"]).orderBy("sort_pos")
    # NaN and null sort after every number (Q13); then b decides; equal keys by row_id
    assert [x["row_id"] for x in r.collect()] == [5, 1, 3, 4, 2]


def test_hits_edge_first_hit_and_left_join(spark):
    hits = spark.createDataFrame([
        (1, "s1", 90.0, 10, 1, 0, 1, 10, 5, 14, 1e-3, 20.0),
        (1, "s2", 99.0, 12, 0, 0, 1, 12, 1, 12, 1e-5, 24.0),
        (1, "s3", 80.0, 11, 2, 0, 1, 11, 3, 13, 1e-2, 18.0),
        (2, "s1", 95.0, 11, 0, 0, 2, 12, 7, 17, 1e-4, 22.0)],
        "query_id long, subject_id string, pct_identity double, align_len int, mismatches int, gap_opens int, "
        "q_start int, q_end int, s_start int, s_end int, e_value double, bit_score double")
    best = SEL.first_hit_per_query(hits)
    got = {r["query_id"]: r["subject_id"] for r in best.collect()}
    assert got == {1: "s2", 2: "s1"}
    ranked = spark.createDataFrame([(1, "A"), (2, "C"), (3, "G")], "row_id long, sequence string")
    j = SEL.left_join_best_hit(ranked, best)
    assert j.count() == 3 and j.where("row_id = 3").first()["subject_id"] is None


def test_binary_edge(spark):
    # logit 0 -> p = 0.5 -> class 0 (half to even); all-positive truth, no predicted positive
    df = spark.createDataFrame([(1, 0.0), (1, -1.0), (1, -2.0)], "y int, z double")
    pred = df.withColumn("pred", N.sigmoid_class("z"))
    assert [r["pred"] for r in pred.collect()] == [0, 0, 0]
    m = M.binary_metrics(pred, "y", "pred").first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["mcc"] == 0.0
    assert m["accuracy"] == 0.0


def test_roc_ties_auc(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.5), (1, 0.5), (0, 0.5)], "y int, s double")
    assert M.auc(df, "y", "s").first()["auc"] == pytest.approx(0.75)
    roc = sorted(rows(M.roc_curve(df, "y", "s"), "fpr", "tpr"))
    assert roc == [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]


def test_auc_equals_rank_statistic(spark):
    import random
    rnd = random.Random(7)
    data = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "y int, s double")
    auc = M.auc(df, "y", "s").first()["auc"]
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(u, abs=1e-12)


def test_multi_edge_macro(spark):
    # class 2 only in truth, class 3 only in predictions: both enter the mean
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (1, 3)], "y int, p int")
    r = M.multiclass_macro(df, "y", "p").first()
    # per class precision: 0:1, 1:1/2, 2:0, 3:0 ; recall: 0:1, 1:1/2, 2:0, 3:0
    assert r["macro_precision"] == pytest.approx(1.5 / 4)
    assert r["macro_recall"] == pytest.approx(1.5 / 4)
    assert r["accuracy"] == pytest.approx(0.5)


def test_hist_edge(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(31)], "a double, b double")
    h = M.shared_histogram(df, "a", "b")
    assert h.count() == 30
    assert M.kl_divergence(h, "density_a", "density_b").first()["kl"] == pytest.approx(0.0, abs=1e-12)
    top = h.where("bin = 29").first()
    assert top["density_a"] > 0                            # the maximum falls in the last bin


def test_rank_ties_average(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    r = sorted(rows(RK.average_rank(df, "v"), "v", "rank"))
    assert r == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0)]


def test_tokens_tiny_counts_and_word_freq(spark):
    toks = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 2, 6), (1, 0, 6), (1, 1, 7)],
                                 "row_id long, pos int, token_id int")
    vocab = spark.createDataFrame([(i,) for i in range(9)], "token_id int")
    counts = dict(rows(T.token_counts(toks, vocab), "token_id", "n"))
    assert counts == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2, 6: 2, 7: 1, 8: 0}
    wf = dict(rows(T.word_freq(T.token_counts(toks, vocab)), "token_id", "wf"))
    assert wf[5] == pytest.approx(1.0) and wf[7] == pytest.approx(math.log(2) / math.log(3))
    # a special token with the largest count still sets the maximum before it is zeroed (Q5)
    toks2 = toks.unionByName(spark.createDataFrame([(2, i, 0) for i in range(8)], "row_id long, pos int, token_id int"))
    wf2 = dict(rows(T.word_freq(T.token_counts(toks2, vocab)), "token_id", "wf"))
    assert wf2[0] == 0.0 and wf2[5] == pytest.approx(math.log(3) / math.log(9))


def test_word_mask_follows_head(spark):
    df = spark.createDataFrame([(0, 0, False, True), (0, 1, True, False), (0, 2, True, True), (0, 3, False, False),
                                (1, 0, False, False), (1, 1, True, True)],
                               "row_id long, pos int, is_continuation boolean, masked boolean")
    out = sorted(rows(T.whole_word_mask(df), "row_id", "pos", "ww_masked"))
    assert out == [(0, 0, True), (0, 1, True), (0, 2, True), (0, 3, False), (1, 0, False), (1, 1, False)]


def test_schedule_mutual_closed_form(spark):
    s = T.survival_schedule(spark, 10, "mutual").orderBy("t").collect()
    for r in s:
        assert r["survival"] == pytest.approx(1 - r["t"] / 10, abs=1e-12)


def test_running_mean(spark):
    from helixframe.operators.metrics import running_weighted_mean
    df = spark.createDataFrame([("r", 1, 2.0, 1), ("r", 2, 4.0, 3)], "run string, step int, val double, n int")
    out = rows(running_weighted_mean(df, ["run"], [F.col("step")], "val", "n").orderBy("step"), "running_mean")
    assert out == [(2.0,), (3.5,)]


def test_topk_and_nucleus(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0, 0.0],)], "z array<double>")
    r = df.select(T.topk_filter(F.col("z"), 2).alias("k"), T.nucleus_filter(F.col("z"), 0.5).alias("p")).first()
    ninf = float("-inf")
    assert r["k"] == [ninf, 3.0, 3.0, ninf, ninf]           # ties at the k-th are kept
    assert r["p"] == [ninf, 3.0, 3.0, ninf, ninf]
    one = df.select(T.nucleus_filter(F.col("z"), 0.0).alias("p")).first()["p"]
    assert sum(x != ninf for x in one) >= 1                  # always at least one candidate


def test_split_words_and_ngrams(spark):
    df = spark.createDataFrame([("  a b  c ",)], "t string")
    r = df.select(TF.split_words("t").alias("w"), TF.ngrams(TF.split_words("t"), 2).alias("g")).first()
    assert r["w"] == ["a", "b", "c"] and r["g"] == ["a b", "b c"]


def test_uniform_draw_matches_duckdb(spark):
    import duckdb
    u = spark.range(1).select(TF.uniform_draw(F.lit(42), F.lit(7), F.lit(3), F.lit(11)).alias("u")).first()["u"]
    d = duckdb.sql("SELECT CAST(('0x' || substr(md5(concat_ws(':', 42, 7, 3, 11)), 1, 8)) AS BIGINT) "
                   "/ 4294967296.0").fetchall()[0][0]
    assert u == pytest.approx(float(d), abs=0)


def test_let_binds_once(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "z array<double>")
    r = df.select(N.softmax("z").alias("p"), N.logsumexp("z").alias("l")).first()
    e = [math.exp(x - 3) for x in (1, 2, 3)]
    assert r["p"] == pytest.approx([x / sum(e) for x in e])
    assert r["l"] == pytest.approx(3 + math.log(sum(e)))
