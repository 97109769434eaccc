"""Balanced label propagation: linked documents move towards their neighbours'
shards under capacity quotas.  DataFrame operations only.

Links are given as memberships (link, node): a link of two nodes is an edge, a
link of many a group whose members are all each other's neighbours; no pair is
made.  Linked nodes start dealt out evenly; in each round the members of each
link are counted by shard, a node sums the counts of its links and proposes
to move to the shard (with room) where it has most neighbours, itself counted,
ties by a hash that all members share.  A shard accepts proposals, link by
link, up to its quota.  Rounds end when no node moves.  Nodes without links
then fill the shards up, so that counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import stored

BUCKET = 20_000
SUB = 16


def numbered(df: DataFrame, part: list[str], spread: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within ``part``: the rows are dealt to buckets of
    about ``BUCKET`` by hash and counted, and numbered within their bucket; no
    part is ever sorted in one task."""
    n = max(1, -(-rows // BUCKET))
    b = df.withColumn("_b", F.pmod(F.xxhash64(*spread), F.lit(n)))
    keys = [*part, "_b"]
    count = b.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = count.select(*keys, (F.sum("_n").over(Window.partitionBy(*part).orderBy("_b")) - F.col("_n")).alias("_o"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return b.withColumn("_r", at).join(before, keys).withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_b", "_r", "_o")


def _load(placed: DataFrame, shards: int) -> list[int]:
    got = dict(placed.groupBy("shard").count().collect())  # a row per shard
    return [got.get(s, 0) for s in range(shards)]


def propagate(members: DataFrame, quota: list[int], rounds: int = 16) -> DataFrame:
    """``node, shard`` of every node in ``members`` (link long, node long)."""
    k = len(quota)
    members = stored(members.distinct(), "members")
    nodes = members.groupBy("node").agg(F.min("link").alias("first"))
    n = members.count()
    placed = stored(numbered(nodes, [], ["node"], ["node"], n, "r").select("node", "first", (F.col("r") % k).cast("int").alias("shard")), "placed")
    for _ in range(rounds):
        room = [max(0, q - x) for q, x in zip(quota, _load(placed, k))]
        at = members.join(placed, "node")
        by_shard = [F.sum((F.col("shard") == s).cast("long")) for s in range(k)]
        votes = at.groupBy("link").agg(F.array(*by_shard).alias("v"))
        mine = at.join(votes, "link").groupBy("node", "first", "shard").agg(F.array(*[F.sum(F.col("v")[s]) for s in range(k)]).alias("v"))
        there = F.array(*[F.lit(r) for r in room])
        choice = F.array_max(F.filter(F.transform("v", lambda c, s: F.struct(c.alias("c"), F.xxhash64("first", s).alias("h"), s.cast("int").alias("s"))),
                                      lambda x: (there[x["s"]] > 0) | (x["s"] == F.col("shard"))))
        wish = mine.withColumn("to", choice["s"]).where("to <> shard").select("node", "first", "shard", "to")
        wish = stored(wish.withColumn("b", F.pmod(F.xxhash64("first"), F.lit(max(64, n // BUCKET)))).withColumn("sub", F.pmod(F.xxhash64("node"), F.lit(SUB))), "wishes")
        count = wish.groupBy("to", "b", "sub").agg(F.count("*").alias("c"))
        before = count.select("to", "b", "sub", (F.sum("c").over(Window.partitionBy("to").orderBy("b", "sub")) - F.col("c")).alias("o"))
        rank = F.row_number().over(Window.partitionBy("to", "b", "sub").orderBy("first", "node"))
        moves = wish.withColumn("r", rank).join(before, ["to", "b", "sub"]).where(F.col("o") + F.col("r") <= there[F.col("to")])
        moves = stored(moves.select("node", F.col("to").cast("int").alias("to")), "moves")
        if moves.isEmpty():
            break
        placed = stored(placed.join(moves, "node", "left").select("node", "first", F.coalesce("to", "shard").alias("shard")), "placed")
    return placed.select("node", "shard")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: documents of equal texts are
    linked; the law is ``rows`` (counts of shards at most one apart).

    Defined results: a null text has no bytes and no links; empty texts are
    equal texts; rows of null or repeated ids are rows like any other; ties go
    by hash; other columns are ignored."""
    text = F.col(text_col).cast("string")
    key = F.when(text.isNotNull(), F.xxhash64(text, F.octet_length(text), F.crc32(text.cast("binary"))))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                       F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), key.alias("link"))
    nodes = stored(base.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    groups = nodes.where("link is not null").groupBy("link").agg(F.count("*").alias("c")).where("c > 1").select("link")
    placed = stored(propagate(nodes.join(groups, "link").select("link", "node"), quota, rounds), "linked")
    room = [q - x for q, x in zip(quota, _load(placed, shards))]
    free = numbered(nodes.join(placed, "node", "left_anti").select("node"), [], ["node"], ["node"], n, "r")
    ends = F.array(*[F.lit(sum(room[:s + 1])) for s in range(shards)])
    filled = free.select("node", F.size(F.filter(ends, lambda e: e <= F.col("r"))).alias("shard"))
    where = placed.unionByName(filled)
    out = nodes.join(where, "node").select("doc_id", "size", "text_crc32", "shard", "node")
    return numbered(out, ["shard"], ["node"], ["node"], -(-n // shards), "slot").drop("node")
