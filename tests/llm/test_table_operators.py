"""Vectors, archives, shards, mixing and the pipeline, against brute force."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import graph, mixing, near_vectors, sharding, topk, warc
from helixframe.llm.common import scratch

NAN = float("nan")


def vectors(n=400, dim=8, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(dim)
        if i % 4 == 3:
            v = np.array(rows[i - 3][1]) + rng.standard_normal(dim) * 0.05
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, None, 1), (n + 3, [], 1), (n + 4, [0.0] * dim, 1), (n + 5, [NAN] * dim, 1),
             (n + 6, [None] * dim, 1), (n + 7, [1.0, 2.0], 1), (n + 8, rows[1][1], None), (None, rows[0][1], rows[0][2]), (n + 10, [float("inf")] * dim, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def taking(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_is_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and taking(v)}
    for q in [i for i in whole if i % 50 == 0]:
        s = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:5]
        assert got.pop(q) == [(k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert not got


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-500, 500, (20, 64)), rng.integers(-500, 500, (30, 64))
    for s in (1, 4, 16):
        assert (topk.summaries(a.astype(float), s) @ topk.summaries(b.astype(float), s).T + 1e-6 >= a @ b.T).all()


def brute_links(rows, threshold=0.98):
    links = defaultdict(set)
    unit = [(i, np.array(v, float) / np.linalg.norm(v), y) for i, v, y in rows if i is not None and taking(v) and any(v) and y is not None]
    for n, (i, a, y) in enumerate(unit):
        for j, b, z in unit[:n]:
            if y == z and len(a) == len(b) and a @ b >= threshold:
                links[i].add(j), links[j].add(i)
    return links


def smallest(links, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()] - seen:
            seen.add(j), todo.append(j)
    return min(seen)


def test_near_vectors_are_brute_forces(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    links = brute_links(rows)
    assert sum(map(len, links.values())) > 50
    for slab in (7, 2048):
        got = {r.vec_id: r for r in near_vectors.near_vectors(df, slab=slab).collect()}
        assert got.keys() == {i for i, _, _ in rows}
        for i in got:
            if i is not None:
                assert (got[i].n_links, got[i].component_id) == (len(links[i]), smallest(links, i)), i
                assert got[i].kept == (smallest(links, i) == i)


def test_chain_is_one_component(spark):
    rng = random.Random(1)
    ids = list(range(500))
    rng.shuffle(ids)
    edges = [*zip(ids, ids[1:]), (1000, 1001), (1001, 1001)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i,) for i in [*ids, 1000, 1001, 1002]], "id long"), "a", "b").collect())
    assert set(got[i] for i in ids) == {0} and got[1001] == 1000 and got[1002] == 1002


# ----------------------------------------------------------- archives


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}\n", f"<p>{i % 7} é</p>" * (i % 5)) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "u", "<p>null</p>"), (None, "u", "<p>null</p>"), (102, "é u", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    index = warc.write_archives(pages, scratch(spark, "warc"), frame_bytes=500, archive_bytes=800).cache()
    got = warc.read_archives(index).collect()
    assert len(got) == len(rows) and index.select("archive").distinct().count() > 4
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for payload, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in known:
            r = by[i]
            assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            main = max(known)
            assert (r.record_type, r.refers_to) == (("response", None) if i == main else ("revisit", main))
            assert bytes(r.payload) == (payload if i == main else b"")
    for row in index.limit(20).collect():
        head, payload = warc.read_record(row)
        assert head["WARC-Record-ID"] == f"<urn:page:{'' if row.page_id is None else row.page_id}>"
        assert sum(x[2] for x in warc.seek_table(row.archive)) >= row.length
    assert warc.round_trip(pages, least=10**6).where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


# ------------------------------------------------------------- shards


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(4)
    rows = [(i, f"text {rng.randrange(10**9)}") for i in range(700)]
    for g in range(40):
        rows += [(1000 + 10 * g + j, f"copy {g}") for j in range(2 + g % 3)]
    rows += [(5000 + j, "hot") for j in range(400)] + [(None, None), (9999, None), (9998, ""), (9997, ""), (7, "again")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, node int").repartition(5)
    got = sharding.shard_documents(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    load = Counter(r.shard for r in got)
    assert set(load) == set(range(24)) and max(load.values()) - min(load.values()) <= 1
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(load[s]))
    place = {r.doc_id: r.shard for r in got}
    whole = sum(len({place[1000 + 10 * g + j] for j in range(2 + g % 3)}) == 1 for g in range(40))
    assert whole >= 36
    assert len({place[5000 + j] for j in range(400)}) <= 12  # 400 need 7 of the shards of 56
    assert {r.size for r in got if r.doc_id == 9999} == {8}


def test_small_and_empty_shards(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert len({r.shard for r in sharding.shard_documents(df, 24).collect()}) == 3
    assert sharding.shard_documents(df.limit(0)).count() == 0


# ------------------------------------------------------------- mixing


def test_mixing_meets_its_targets_and_plain_descent(spark):
    rng = random.Random(6)
    rows, lab = [], []
    for i in range(400):
        kind = ("news", "chat", "spam")[i % 3]
        rows.append((i, " ".join(rng.choice([f"{kind}{rng.randrange(5)}", f"c{rng.randrange(200)}"]) for _ in range(rng.randrange(20, 60)))))
        if i < 200:
            lab.append((i, kind))
    rows += [(None, None), (1000, ""), (1001, " \n ")]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, rate double, domain string").repartition(3)
    labels = spark.createDataFrame([*lab, (None, "news"), (5, None), (6, "other")], "doc_id long, domain string")
    weights = {"news": 0.6, "chat": 0.4, "spam": 0.0}
    got = mixing.mix_documents(docs, labels, weights).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    hit = [r.domain == ("news", "chat", "spam")[r.doc_id % 3] for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(hit) > 0.97 * len(hit)
    total = sum(r.tokens for r in got)
    have = [sum(r.rate * r.tokens * r.p[j] for r in got) / total for j in range(3)]
    assert have == pytest.approx([0.6, 0.4, 0.0], abs=0.01)
    # the same least squares by plain projected descent
    p, t = np.array([r.p for r in got]), np.array([r.tokens for r in got]) / total
    r = np.ones(len(got))
    for _ in range(5000):
        r = np.maximum(0, r - 0.9 * (p @ (p.T @ (r * t) - np.array([0.6, 0.4, 0.0])) + 1e-3 * (r - 1)))
    assert np.abs(r - np.array([x.rate for x in got]))[t > 0].max() < 0.1


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix_documents(none, labels, {"a": 1.0}).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = mixing.mix_documents(some, labels, {"a": 1.0, "b": 1.0}).collect()
    assert len(got) == 2 and all(list(r.p) == [0.5, 0.5] and r.rate == pytest.approx(1.0) for r in got)


def test_long_documents_keep_their_evidence(spark):
    rng = random.Random(7)
    rows, lab = [], []
    for i in range(360):
        toxic = i % 9 == 0
        n = (60, 600, 3000)[i // 9 % 3]
        # half of the domains' words say nothing; "low" rows give the words without evidence a lean
        kind = "toxic" if toxic else "low" if i % 9 == 1 else "good"
        words = [f"low{rng.randrange(20)}" if kind == "low" and rng.random() < 0.5 else f"c{rng.randrange(3000)}" for _ in range(n)]
        if toxic:
            for _ in range(6):
                words[rng.randrange(n)] = f"bad{rng.randrange(8)}"
        rows.append((i, " ".join(words)))
        lab.append((i, kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(lab, "doc_id long, domain string")
    got = {r.doc_id: r.domain for r in mixing.mix_documents(docs, labels, {"good": 1.0, "low": 1.0, "toxic": 1.0}, relative=True).collect()}
    for n in range(3):  # by length
        toxic = [i for i, d in lab if d == "toxic" and i // 9 % 3 == n]
        assert sum(got[i] == "toxic" for i in toxic) >= 0.9 * len(toxic), n
    assert sum(got[i] == "toxic" for i, d in lab if d != "toxic") <= 3


@pytest.mark.parametrize("scarce", [0.01, 0.001])
def test_scarce_domains_meet_their_targets(spark, scarce, recwarn):
    n = 4000
    rare = F.col("id") < int(n * scarce)
    pure = spark.range(n).select(F.lit(100).cast("long").alias("tokens"), rare.alias("rare"), F.when(rare, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("p"))
    have = [100.0 * n * (1 - scarce), 100.0 * n * scarce]
    for factors in ((1.05, 0.0), (0.9, 20.0)):
        got = mixing.fit_rates(pure, [h * f for h, f in zip(have, factors)])
        rates = {r.rare: r.rate for r in got.groupBy("rare").agg(F.avg("rate").alias("rate")).collect()}
        for is_rare, f in zip((False, True), factors):
            assert rates[is_rare] == pytest.approx(f, rel=0.01, abs=0.01)
        assert max(map(abs, got.first().gaps)) <= mixing.CLOSE
    assert not [w for w in recwarn if "mixing" in str(w.message)]


def test_targets_out_of_reach_are_reported(spark):
    same = spark.range(50).select(F.lit(10).cast("long").alias("tokens"), F.array(F.lit(0.5), F.lit(0.5)).alias("p"))
    with pytest.warns(UserWarning, match="targets not met"):
        got = mixing.fit_rates(same, [500.0, 0.0])
    gaps = got.first().gaps
    assert gaps[0] < -0.2 and gaps[1] > 0.2


def test_no_python_in_native_operators(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sharding.shard_documents(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ----------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns and after.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        assert after.count() == after.select("doc_id").distinct().count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "near duplicates":
            assert after.select("text").distinct().count() == after.count()
        if name == "mixing":
            lab = spark.read.parquet(f"{sf}/labels.parquet")
            had = before.join(lab.where("toxic = 1"), "doc_id").count()
            assert after.join(lab.where("toxic = 1"), "doc_id").count() <= 0.3 * had
            clean = lab.where("toxic = 0 and quality = 1")
            assert after.join(clean, "doc_id").count() >= 0.95 * before.join(clean, "doc_id").count()
        before = after
    packed = c.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
