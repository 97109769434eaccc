"""Event time: late rows are dropped, state does not grow for ever; masks put
back, repeated keys refused."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.operators import select as S
from helixframe.operators import tokens as T
from helixframe.session import scratch_path
from helixframe.sources.readers import HITS_SCHEMA
from helixframe.streaming import streams as ST

START = datetime(2024, 1, 1)


def _drops(spark, batches, schema):
    """One file per batch, in folders that are read in order."""
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i:03}")
    return f"{base}/in/*", f"{base}/out", f"{base}/checkpoint"


def test_windows_close_and_late_rows_are_dropped(spark):
    at = lambda h: START + timedelta(hours=h)
    batches = [[(at(0.5), "a", 1.0, 1), (at(1.5), "a", 3.0, 1)], [(at(0.7), "a", 5.0, 1), (at(6), "a", 7.0, 2)], [(at(6.5), "a", 7.0, 1)],
               [(at(0.8), "a", 100.0, 1), (at(9), "b", 9.0, 1)]]
    src, sink, ckpt = _drops(spark, batches, "ts timestamp, run string, val double, n long")
    q = ST.stream_windowed_mean(spark, src, "ts timestamp, run string, val double, n long", "ts", "run", "val", "n", "1 hour", "2 hours", sink, ckpt)
    ST.run_to_end(q)
    got = {(r.window_start, r.run): r.weighted_mean for r in spark.read.parquet(sink).collect()}
    # the row of the second batch came in time, that of the last after its window had closed; 9 h is still open
    assert got == {(at(0), "a"): 3.0, (at(1), "a"): 3.0, (at(6), "a"): 7.0}


def _hit(query, bit, minute):
    return (query, f"s{bit}", 100.0, 12, 0, 0, 1, 12, 5, 16, 1e-3 / (1 + bit), float(bit), START + timedelta(minutes=minute))


def test_state_of_best_hits_shrinks(spark):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HITS_SCHEMA) + ", ts timestamp"
    batches = [[_hit(q, 10 + (q * 7 + b) % 5, 100 * b + q) for q in range(20 * b, 20 * b + 30)] for b in range(8)]
    batches.append([_hit(3, 50, 880), _hit(300, 1, 900)])  # query 3 comes back long after its state was dropped
    batches += [[_hit(301, 1, 2000)], [_hit(302, 1, 2001)]]
    src, sink, ckpt = _drops(spark, batches, schema)
    q = ST.stream_first_hit_ttl(spark, src, schema, "query_id", "ts", "30 minutes", sink, ckpt)
    ST.run_to_end(q)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) <= 60 and rows[-1] <= 3 and len(batches) <= len(rows)
    every = spark.createDataFrame([h for b in batches for h in b], schema).drop("ts")
    want = {r.query_id: r.bit_score for r in S.first_hit_per_query(every).collect()}
    assert {r.query_id: r.bit_score for r in S.first_hit_per_query(spark.read.parquet(sink).drop("ts")).collect()} == want
    assert len(want) == 173 and want[3] == 50.0


def test_masked_restore_is_the_way_back(spark):
    rows = [(1, [5, 6, 7, 0], [1, 0, 1, 0]), (2, [9], [0]), (3, [], []), (4, [4, 4], [1, 1])]
    df = spark.createDataFrame(rows, "row_id long, ids array<int>, mask array<int>")
    picked = df.select("row_id", F.posexplode(F.arrays_zip("ids", "mask")).alias("pos", "z")).where("z.mask = 1").select("row_id", "pos", F.col("z.ids").alias("token_id"))
    back = T.masked_restore(picked, df.select("row_id", F.size("ids").alias("width")))
    assert {r.row_id: r.ids for r in back.collect()} == {i: [a * m for a, m in zip(ids, mask)] for i, ids, mask in rows}


def test_zip_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.7)], "row_id long, x double")
    b = spark.createDataFrame([(1, 3), (3, 4)], "row_id long, y int")
    t = spark.createDataFrame([(1, "ab"), (4, "cd")], "row_id long, text string")
    got = {r.row_id: (r.x, r.y, r.text) for r in S.zip_columns([t, a, b]).collect()}
    assert got == {1: (0.5, 3, "ab"), 2: (0.7, None, None), 3: (None, 4, None), 4: (None, None, "cd")}
    for tables in ([a.union(a), b], [t.union(t), a], [a, t.union(t)]):
        with pytest.raises(PySparkException, match="repeated key"):
            S.zip_columns(tables).collect()
