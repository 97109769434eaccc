"""Near-duplicate vectors by collision counting on sorted projections.

Unit vectors of one label are projected on ``m`` random Gaussian directions.
Two vectors of cosine c differ by N(0, 2 - 2c) in each, so that around a
query, a window of ``z`` standard deviations holds a partner at the threshold
with a known chance; a pair is verified when it collides in at least ``need``
of the windows, the largest count that such a partner misses with a chance
below ``miss``.  Vectors are sorted by the first projection and cut into
slabs; only slabs within the first window (``Z_FIRST`` deviations) of each
other meet, so that tasks have bounded size and a hot label is many slabs.

Equal vectors are collapsed first.  A task returns, for the vectors it
compared, how many links each has and the smallest id it is connected to
there, never the pairs themselves; components follow from those.

Defined results: rows whose label is null, or whose vector is null, empty,
zero or holds null or non-finite components, link with nothing; vectors of
different length never link; repeated rows are copies of each other; rows of a
null id have a null component and are kept; other columns are ignored.
"""

from __future__ import annotations

from math import comb, erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import long_ids, pack, stored, unpack
from helixframe.llm.graph import components

DIRECTIONS, Z, Z_FIRST, MISS = 16, 2.5, 5.0, 1e-6
SLAB = 2048


def needed(m: int = DIRECTIONS, z: float = Z, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold reaches but for a chance of ``miss``."""
    p = erf(z / 2**0.5)
    tail = 0.0
    for c in range(m + 1):
        tail += comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail > miss:
            return c
    return m


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, m))


def _unit(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = flat.reshape(-1, dim).astype(np.float64)
    big = np.abs(x).max(1, initial=0)
    size = big * np.sqrt(np.square(x / np.where(big > 0, big, 1)[:, None]).sum(1))
    return x, size


def _project(m: int):
    def run(batches):
        for batch in batches:
            p, blob = np.zeros(batch.num_rows), []
            for i, v in enumerate(batch.column("v").to_pylist()):
                x, size = _unit(np.array(v), len(v))
                p[i] = (x[0] / size[0]) @ directions(len(v), m)[:, 0]
                blob.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([len(b) // 8 for b in blob], pa.int32()), pa.array(p), batch.column("r"), batch.column("n"), pa.array(blob, pa.binary())],
                                             names=["label", "dim", "p", "r", "n", "v"])

    return run


def _slabs(size: int):
    names = ["slab", "label", "dim", "lo", "hi", "ids", "n", "m"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def emit():
            r = [(part << 32) + seq, held[0][0], held[0][1], held[0][2], held[-1][2], pack(np.array([h[3] for h in held], np.int64)), pack(np.array([h[4] for h in held], np.int64)), b"".join(h[5] for h in held)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, kinds)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "p", "r", "n", "v"))):
                if held and (len(held) >= size or row[:2] != held[0][:2]):
                    yield emit()
                    held, seq = [], seq + 1
                held.append(row)
        if held:
            yield emit()

    return run


def linked(a: np.ndarray, b: np.ndarray, threshold: float, m: int, z: float, need: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked rows of two slabs; i < j if they are one."""
    (x, sx), (y, sy) = (_unit(v, v.shape[1]) for v in (a, b))
    proj = directions(a.shape[1], m)
    px, py = (x / sx[:, None]) @ proj, (y / sy[:, None]) @ proj
    window = z * (2 - 2 * threshold) ** 0.5
    count = np.zeros((len(x), len(y)), np.uint8)
    for j in range(m):
        count += np.abs(px[:, j, None] - py[None, :, j]) <= window
    i, j = np.nonzero(np.triu(count >= need, 1) if same else count >= need)
    keep = [np.einsum("ij,ij->i", x[i[s:s + 65536]] / sx[i[s:s + 65536], None], y[j[s:s + 65536]] / sy[j[s:s + 65536], None]) >= threshold for s in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _lowest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest position connected to each, within one pair of slabs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(threshold: float, m: int, z: float, need: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                dim, same = get("dim"), get("a") == get("b")
                ia, ib, na, nb = unpack(get("ia")), unpack(get("ib")), unpack(get("na")), unpack(get("nb"))
                x, y = (np.frombuffer(get(c), np.float64).reshape(-1, dim) for c in ("ma", "mb"))
                i, j = linked(x, y, threshold, m, z, need, same)
                if not len(i):
                    continue
                off = 0 if same else len(ia)
                ids, n = (ia, na) if same else (np.concatenate([ia, ib]), np.concatenate([na, nb]))
                u, v = i, j + off
                links = np.bincount(u, n[v], len(ids)) + np.bincount(v, n[u], len(ids))
                order = np.argsort(ids, kind="stable")  # positions in order of id
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                low = _lowest(len(ids), rank[u], rank[v])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[order[low[rank[some]]]])], names=["r", "links", "low"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.98, m: int = DIRECTIONS, z: float = Z, miss: float = MISS, slab: int = SLAB) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per input row."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    part = F.coalesce(F.col("i").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine, F.lit(False))
    reps = stored(rows.where(part).groupBy("label", "v").agg(F.min("i").alias("r"), F.count("*").alias("n")), "vectors")
    flat = reps.mapInArrow(_project(m), "label string, dim int, p double, r long, n long, v binary")
    slabs = stored(flat.repartitionByRange("label", "dim", "p").sortWithinPartitions("label", "dim", "p", "r").mapInArrow(
        _slabs(slab), "slab long, label string, dim int, lo double, hi double, ids binary, n binary, m binary"), "slabs")
    reach = Z_FIRST * (2 - 2 * threshold) ** 0.5
    side = lambda s: slabs.select("label", "dim", F.col("slab").alias(s), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}"))
    meet = side("a").join(side("b"), ["label", "dim"]).where("a <= b").where((F.col("lob") <= F.col("hia") + reach) & (F.col("loa") <= F.col("hib") + reach)).select("dim", "a", "b")
    blob = lambda s: slabs.select(F.col("slab").alias(s), F.col("ids").alias(f"i{s}"), F.col("n").alias(f"n{s}"), F.col("m").alias(f"m{s}"))
    both = meet.join(blob("a"), "a").join(blob("b"), "b").repartition(F.xxhash64("a", "b"))
    found = stored(both.mapInArrow(_compare(threshold, m, z, needed(m, z, miss)), "r long, links long, low long"), "links")
    comp = components(found.where("r <> low"), reps.select("r"), "r", "low")
    total = reps.select("label", "v", "r", "n").join(found.groupBy("r").agg(F.sum("links").alias("links")), "r", "left").join(comp.withColumnRenamed("id", "r"), "r")
    total = total.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("c"))
    taking = rows.where(part).join(total, ["label", "v"]).select("i", "n_links", "c")
    out = taking.unionByName(rows.where(~part).select("i", F.lit(0).cast("long").alias("n_links"), F.col("i").alias("c")))
    return out.select(F.col("i").alias("vec_id"), "n_links", F.col("c").alias("component_id"), F.coalesce(F.col("i") == F.col("c"), F.lit(True)).alias("kept"))
