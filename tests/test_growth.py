"""Steps that must grow no faster than their input: what is exchanged, broadcast, or run per batch."""

import os



import pytest
from pyspark.sql import functions as F

from helixframe.operators import text as TX


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leave_one_out_never_collects_a_table_of_ngrams(spark):
    rows = [(1, 1, "a a b c"), (1, 2, "a b"), (1, 3, "a a d"), (2, 1, "a"), (None, 1, "a"), (None, 2, "a"), (3, 1, None), (1, None, "b b b")]
    df = spark.createDataFrame(rows, "g long, s long, text string")
    loo = TX.leave_one_out_max(TX.sentence_ngrams(df, ["g", "s"], "text", by=["g"]), ["g"], ["g", "s"])
    counts = {}
    for g, s, text in rows:
        w = (text or "").split()
        for n in range(1, 5):
            for i in range(len(w) - n + 1):
                key = (g, s, n, " ".join(w[i:i + n]))
                counts[key] = counts.get(key, 0) + 1
    want = {k: (c, max([d for j, d in counts.items() if (j[0], *j[2:]) == (k[0], *k[2:]) and j != k], default=0)) for k, c in counts.items() if k[0] is not None}
    assert {(r.g, r.s, r.n, r.gram): (r.c, r.ref_max) for r in loo.collect()} == want
    assert "Broadcast" not in _plan(loo)
    scores = _plan(TX.self_bleu_scores(df, ["g"], ["s"], "text"))
    assert "BroadcastHashJoin" not in scores


def test_drops_are_few_and_whole(spark, monkeypatch, tmp_path):
    from datetime import datetime, timedelta

    from helixframe.plans import stream_queries as Q

    monkeypatch.setattr(Q, "DROP_ROWS", 5)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=7 * i), i) for i in range(400)] + [(None, 400)]
    src = spark.createDataFrame(rows, "ts timestamp, i int").repartition(8)
    drops = str(tmp_path / "drops")
    Q._drop_in_time_order(src, "ts", drops)
    folders = sorted(os.listdir(drops))
    found = [[f for f in os.listdir(f"{drops}/{x}") if f.endswith(".parquet")] for x in folders]
    assert 3 <= len(folders) <= 20 and all(len(f) == 1 for f in found)  # a micro-batch each
    parts = [[r.i for r in spark.read.parquet(f"{drops}/{x}").collect()] for x in folders]
    assert sorted(i for p in parts for i in p) == list(range(400))
    assert all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
    assert Q._n_drops(10**9) == Q._n_drops(10**8) and Q._n_drops(0) == 3


def test_pairs_of_many_groups_need_no_call_per_group(spark):
    import numpy as np

    from helixframe.functions.udf import grouped_pair_apply

    rows = [(g if g % 50 else None, p, side, i, [float(g % 7 + i), float(p == 'x'), 1.0 if side == "a" else -2.0])
            for g in range(1, 400) for p in ("x", "y") for side, k in (("a", 1 + g % 3), ("b", 2)) for i in range(k)]
    df = spark.createDataFrame(rows, "id long, pair string, side string, pos int, vector array<double>")
    out = grouped_pair_apply(df, ["id", "pair"], lambda a, b: float((a @ b.T).sum()) + 100 * len(a))
    assert "FlatMapGroupsInPandas" not in _plan(out)
    sides = {}
    for g, p, side, i, v in rows:
        sides.setdefault((g, p), {"a": [], "b": []})[side].append((i, v))
    stack = lambda x: np.array([v for _, v in sorted(x)])
    want = {k: float((stack(s["a"]) @ stack(s["b"]).T).sum()) + 100 * len(s["a"]) for k, s in sides.items()}
    got = {(r.id, r.pair): r.value for r in out.collect()}
    assert got == pytest.approx(want) and len(got) == out.count()


def test_reference_matches_exchange_texts_not_ngrams(spark):
    hyp = spark.createDataFrame([(1, "a a b c"), (2, "a b"), (3, None), (None, "a"), (4, "x y"), (4, "x")], "k long, text string")
    ref = spark.createDataFrame([(1, "a b c c"), (2, "z"), (3, "a"), (None, "a"), (4, "x x"), (5, "q")], "k long, text string")
    out = TX.reference_join(hyp, ref, ["k"])
    assert _plan(out).count("Exchange hashpartitioning") == 1
    got = {(r.k, r.n): (r.num, r.den) for r in out.collect()}
    assert got == {(1, 1): (3, 4), (1, 2): (2, 3), (1, 3): (1, 2), (1, 4): (0, 1), (2, 1): (0, 2), (2, 2): (0, 1), (None, 1): (0, 1), (4, 1): (2, 3), (4, 2): (0, 1)}


def test_half_of_the_trusted_texts_is_learnt_from_however_long(spark, monkeypatch):
    from helixframe.llm import quality

    rows = [(i, " ".join(f"w{(i * 31 + j) % 997}" for j in range(2000)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").crossJoin(spark.range(60).withColumnRenamed("id", "k"))
    docs = docs.selectExpr("doc_id + 40 * k AS doc_id", "text", "lang")  # 28 MB
    seen = {}

    def fit(texts, *bits):
        seen["n"], seen["bits"] = texts.count(), bits
        return None

    monkeypatch.setattr(quality, "fit", fit)
    quality.quality_scores(docs, docs.select("doc_id"))
    assert 1050 < seen["n"] < 1350 and seen["bits"] == (6,)
    monkeypatch.setattr(quality, "SHARD_BYTES", 1 << 14)
    quality.quality_scores(docs, docs.select("doc_id"))
    assert seen["bits"][0] > 6


def test_more_shards_give_the_same_scores(spark):
    import numpy as np

    from helixframe.llm import quality

    texts = spark.createDataFrame([(" ".join(f"w{(i * 7 + j * j) % 53}" for j in range(30)),) for i in range(20)], "t string")
    rows = spark.createDataFrame([(1, "en", "w1 w2 w4 w9 zz"), (2, "en", "w7 w8")], "i long, l string, t string")
    got = [{r.i: r.s for r in quality.score(rows, quality.fit(texts, bits)).collect()} for bits in (6, 9)]
    assert len(got[0]) == 2 and all(np.isclose(got[0][i], got[1][i], rtol=1e-12) for i in got[0])


def test_tokens_meet_the_vocabulary_by_block(spark, monkeypatch, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from helixframe.operators import tokens as T
    from helixframe.plans import token_queries as TQ

    monkeypatch.setattr(T, "BLOCK_VALUES", 7)
    texts = [(1, "b a  b C ##d"), (2, None), (3, " \t"), (4, "a " * 20), (None, "C a"), (None, "b b"), (1, "a e b"), (5, "É a\nb")]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in texts], pa.int64()), "text": [t for _, t in texts]}), tmp_path / "documents.parquet")
    words = [(i, p, w) for i, t in texts for p, w in enumerate((t or "").split())]
    count = {}
    for _, _, w in words:
        count[w] = count.get(w, 0) + 1
    ids = {w: 5 + k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w)))}
    want = {}
    for i, p, w in words:
        want.setdefault(i, []).append((p, ids[w], w))
    blocks = TQ._blocks(spark, str(tmp_path))
    assert blocks.count() > 2 and sum(len(r["codes"]) // 4 for r in blocks.collect()) == len(words)
    arrays = TQ._token_arrays(spark, str(tmp_path))
    assert {r.row_id: r.tokens for r in arrays.collect()} == {i: [t for _, t, _ in sorted(x)] for i, x in want.items()}
    decoded = TQ.q_decode_tokens(spark, str(tmp_path))
    assert {r.row_id: r.sentence for r in decoded.collect()} == {i: " ".join(w for _, w in sorted((p, w) for p, _, w in x)) for i, x in want.items()}
    kept = TQ.q_freq_aware_keep_prob(spark, str(tmp_path))
    assert sorted((str(r.row_id), r.pos) for r in kept.collect()) == sorted((str(i), p) for i, p, _ in words)


def test_blocks_of_texts_are_not_exchanged(spark):
    """Scores of op 4 and op 8: answers go to the stored blocks, not blocks to the answers."""
    from helixframe.llm import katz, quality

    docs = spark.createDataFrame([(i, f"some words w{i % 9} and w{i % 7} " * 5, "en") for i in range(60)], "doc_id long, text string, lang string").repartition(3)
    model = quality.fit(docs.select(F.col("text").alias("t")))
    scores = quality.score(docs.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.col("text").alias("t")), model)
    for df, column in ((scores, "texts"), (katz.score_corpus(docs, order=3)[0], "codes")):
        plan = df._jdf.queryExecution().executedPlan()
        assert df.count() == 60
        text = plan.toString()
        left = text[text.index("FlatMapCoGroupsInArrow"):text.index("Bucketed: true")]
        assert column in left and "Exchange" not in left


def test_query_blocks_are_not_broadcast(spark, monkeypatch):
    """Op 2 repeats the query blocks for every row block: they are never sent through the driver."""
    from helixframe.llm import topk

    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "stored", lambda df, tag: df)
    df = spark.createDataFrame([(i, [float(i * 7 % 13), float(i * 5 % 11)]) for i in range(600)], "vec_id long, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), k=3, scale=1.0)
    rows = out.collect()
    vec = {i: (i * 7 % 13, i * 5 % 11) for i in range(600)}
    for q in range(0, 600, 50):
        want = sorted((-(vec[q][0] * v[0] + vec[q][1] * v[1]), i) for i, v in vec.items() if i != q)[:3]
        assert [(-r.score, r.vec_id) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert "SortMergeJoin" in _plan(out) and "Broadcast" not in _plan(out)


def test_wide_rows_are_stored_in_small_groups(spark):
    import glob

    import pyarrow.parquet as pq

    from helixframe.session import stored

    rows = [(i, os.urandom(5 << 20)) for i in range(12)]
    back = stored(spark.createDataFrame(rows, "i long, b binary").coalesce(1), "wide-test", wide=True)
    (name,) = [f for f in back.inputFiles()]
    (path,) = glob.glob(name.removeprefix("file://"))
    meta = pq.ParquetFile(path).metadata
    assert meta.num_rows == 12 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 6
    assert {r.i: r.b for r in back.collect()} == dict(rows)


def test_tokens_are_centred_and_followed_as_arrays(spark):
    """No window or sort meets a row per token, unless rows share an id."""
    from helixframe.operators import tokens as T

    rows = [(1, [0.1, 0.5, 0.9], [False, True, False], [True, True, False]), (2, [], [], []), (3, [0.25], [True], [True]), (4, [0.5, 0.0], [True, False], [False, True]),
            (5, [0.5, 0.25], [True, False], [False, True]), (5, [0.5, 0.25], [True, False], [False, True]), (None, [1.0, 0.0, 0.5], [False, True, True], [True, False, True])]
    df = spark.createDataFrame(rows, "row_id int, wf array<double>, masked array<boolean>, is_continuation array<boolean>").repartition(3)
    long = T.arrays_long(df, ["wf", "masked", "is_continuation"])
    key = lambda r: [str(x) for x in r]
    centred = T.arrays_long(T.centred_word_freq(df), ["wf_centred"])
    plan = _plan(centred)
    assert plan.index("Generate") < plan.index("Window")
    want = sorted(T.centred_word_freq(long).select("row_id", "pos", "wf_centred").collect(), key=key)
    got = sorted(centred.collect(), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    columns = ["row_id", "pos", "masked", "is_continuation", "ww_masked"]
    followed = T.whole_word_mask(df.drop("wf")).select(columns)
    assert sorted(followed.collect(), key=key) == sorted(T.whole_word_mask(long).select(columns).collect(), key=key)
    noised = [sorted(T.arrays_long(T.corrupt(df.withColumn("token_id", F.transform("wf", lambda x, i: i + 7)).withColumn("t", F.lit(3)), 42, "wf"), ["token_id", "noised"]).collect(), key=key),
              sorted(T.corrupt(long.withColumn("token_id", F.col("pos") + 7).withColumn("t", F.lit(3)), 42, "wf").select("row_id", "pos", "token_id", "noised").collect(), key=key)]
    assert noised[0] == noised[1]


def _letters_table(path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(4)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    parts = [word(40) for _ in range(6)]
    docs = [(i, r.choice(parts) + word(i % 9) + r.choice(parts)) for i in range(80)]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", list(enumerate(parts)))):
        pq.write_table(pa.table({key: pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}), f"{path}/{name}.parquet")
    return str(path)


def test_hits_are_stored_compressed(spark, monkeypatch, tmp_path):
    from helixframe.plans import io_queries as IO
    from helixframe.plans import select_queries as SQ
    from helixframe.plans import stream_queries as Q

    d = _letters_table(tmp_path)
    monkeypatch.setattr(IO, "_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(Q, "_dirs", lambda spark, name: tuple(f"{tmp_path}/{x}" for x in ("drops", "sink", "checkpoint")))
    monkeypatch.setattr(Q, "FILE_ROWS", 20)
    hits = sorted(map(str, SQ.q_kmer_seed_join(spark, d).collect()))
    assert sorted(map(str, IO.q_scan_hits(spark, d).collect())) == hits and len(hits) > 150
    best = SQ.q_first_hit_per_query(spark, d)
    assert sorted(map(str, Q.q_stream_first_hit(spark, d).select(best.columns).collect())) == sorted(map(str, best.collect()))
    batches = {r.batch_id for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    for folder in ("hits", "drops"):
        files = [f for f in os.listdir(f"{tmp_path}/{folder}") if f.startswith("part-")]
        assert files and all(f.endswith(".gz") for f in files)
    assert len(files) > len(batches)  # a drop is several files


def test_chains_are_gathered_without_sequences(spark, tmp_path):
    from helixframe.plans import select_queries as SQ

    plan = _plan(SQ.q_kmer_seed_join(spark, _letters_table(tmp_path)))
    below = plan[plan.rindex("ObjectHashAggregate"):]
    assert "q_seq" not in below[:below.index("Generate inline")]
