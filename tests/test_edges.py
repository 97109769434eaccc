"""Defined results at the edges: nulls, constants, t = 0, collisions, headers."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from helixframe.operators import folds as FO
from helixframe.operators import metrics as M
from helixframe.operators import ml
from helixframe.operators import tokens as T
from helixframe.operators.select import zip_columns
from helixframe.session import ensure_checkpoint_dir
from helixframe.sources.readers import scan_fasta


def test_cluster_without_checkpoint_folder_is_an_error():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=sc))


def test_incomplete_pairs_do_not_count(spark):
    full = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 4.0)], "y double, p double")
    more = full.union(spark.createDataFrame([(9.0, None), (None, 7.0)], "y double, p double"))
    for f in (M.regression_metrics, M.pearson, M.spearman, M.shared_histogram):
        assert sorted(map(tuple, f(full, "y", "p").collect())) == sorted(map(tuple, f(more, "y", "p").collect()))
    assert abs(M.pearson(more, "y", "p").first().r) <= 1


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0, 3.0)] * 4, "a double, b double")
    h = M.shared_histogram(df, "a", "b")
    assert h.agg(F.sum("density_a")).first()[0] / M.HIST_BINS == pytest.approx(1.0)
    assert M.kl_divergence(h, "density_a", "density_b").first()[0] == pytest.approx(0.0)


def test_nothing_is_masked_at_step_zero(spark):
    df = spark.createDataFrame([(0, 1.0), (5, 0.5)], "t int, s double")
    p = [r[0] for r in df.select(T.keep_probability(F.col("s"), F.lit(-3.0), F.col("t"), 10)).collect()]
    assert p[0] == 1.0 and p[1] < 1.0


def test_columns_do_not_collide(spark):
    a = spark.createDataFrame([(1, 5.0)], "row_id long, x double")
    with pytest.raises(ValueError):
        zip_columns([a, a])


def test_marks_inside_fasta_headers(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">r1 c.1A>G variant\nACGT\nAC\n>r2\nGG\n")
    assert sorted(map(tuple, scan_fasta(spark, str(tmp_path / "g.fa")).collect())) == [("r1", "c.1A>G variant", "ACGTAC"), ("r2", "", "GG")]


def test_small_tables_are_their_own_sample(spark):
    df = spark.range(7).withColumnRenamed("id", "row_id")
    got = {r.row_id: (r.label, r.pair) for r in FO.paired_sample(df, "row_id", 100).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 2), 3: (0, 0), 4: (0, 1), 5: (0, 2), 6: (0, None)}


def test_too_deep_trees_are_an_error():
    with pytest.raises(ValueError):
        ml.random_forest(depth=39)
    assert math.isclose(ml.LR_C, 7.782e-5)


def test_rank_keeps_wide_columns_and_null_ids(spark):
    from helixframe.operators.select import rank_candidates

    df = spark.createDataFrame([(1, 0.5, "AC"), (2, None, "GT"), (3, float("nan"), "TT"), (4, 0.5, None), (None, 0.9, "C")],
                               "row_id long, score double, sequence string")
    out = rank_candidates(df, ["score"])
    assert out.columns == ["row_id", "score", "sequence", "sort_pos"]
    got = {r.row_id: (r.sort_pos, r.sequence) for r in out.collect()}
    assert got == {None: (1, "C"), 1: (2, "AC"), 4: (3, None), 2: (4, "GT"), 3: (5, "TT")}


def test_best_hit_of_a_table_and_of_a_stream_agree(spark):
    from helixframe.operators.select import HIT_COLUMNS, first_hit_per_query, running_first_hit

    hits = spark.range(400).selectExpr(
        "id % 7 as query_id", "cast(id % 5 as string) as subject_id", "100D as pct_identity", "11 as align_len", "0 as mismatches", "0 as gap_opens",
        "cast(id % 3 as int) as q_start", "12 as q_end", "cast(id % 11 as int) as s_start", "20 as s_end",
        "if(id % 13 = 0, null, 0.5D) as e_value", "cast(id % 2 as double) as bit_score")
    assert hits.columns == HIT_COLUMNS
    best = first_hit_per_query(hits)
    rows = sorted(map(tuple, best.collect()), key=str)
    assert rows == sorted(map(tuple, running_first_hit(hits).collect()), key=str) and len(rows) == 7
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    assert first_hit_per_query(hits.limit(0)).count() == 0


def test_special_words_in_a_text_are_words_like_others(spark):
    from helixframe.functions.tokens import N_SPECIAL, SPECIAL_TOKENS
    from helixframe.operators import tokens as T

    docs = spark.createDataFrame([(1, f"a b {SPECIAL_TOKENS[0]} a")], "doc_id long, text string")
    words = T.words_long(docs)
    full = T.special_vocabulary(spark).unionByName(T.build_vocabulary(words))
    wf = T.word_freq(full, keep=("word",)).where(f"token_id >= {N_SPECIAL}")
    assert sorted(r.word for r in wf.collect()) == sorted(["a", "b", SPECIAL_TOKENS[0]])
