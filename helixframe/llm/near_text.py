"""Near-duplicate texts by Order MinHash.

A document's k-mers are its shingles of ``k`` lower-cased words, each labelled
with its occurrence number in the document (a text of fewer words is one
shingle).  A sketch takes the ``ell`` smallest labelled k-mers under one
random order and keeps them in the order they have in the text, so that two
documents share it when they share k-mers *in the same order*: it is
sensitive to edit similarity, not only to shared content.  Documents that
share one of ``m`` sketches are candidates; a banded alignment of their
labelled k-mer sequences verifies them: with ``a`` aligned k-mers,
similarity = a / (n1 + n2 - a), linked at ``threshold`` or more.

Equal word sequences are collapsed first.  Candidates come in two rounds so
that a group of thousands of copies does not become pairs: first every member
of a sketch bucket against the bucket's smallest document; then, in buckets
that the first round left in several components, all texts of different
components, block by block: a matrix product counts the k-mers that two texts
share, and only pairs which that count does not rule out are aligned.  Tasks
return links that join components, never pairs.

Defined results: null or blank texts (no word) link with nothing and are
classes of their own, as do rows of a null id, which are returned with a null
class; repeated ids take part once per distinct text; ties go to the smallest
id; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import mix, stored, text_chunks, utf8, word_hashes
from helixframe.llm.graph import components

K, ELL, SKETCHES, THRESHOLD = 5, 4, 16, 0.8


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mer hashes of one text, in text order."""
    n = len(words)
    if not n:
        return words[:0]
    h = np.zeros(max(1, n - k + 1), np.uint64)
    for j in range(min(k, n)):
        h = h * np.uint64(0xD1342543DE82EF95) + words[j:j + len(h)]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        nth = np.arange(len(s)) - np.repeat(head, np.diff(np.append(head, len(s))))
        h[order] = np.where(nth > 0, mix(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), s)
    return h


def order_sketches(kmers: np.ndarray, ell: int, seeds: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """One hash per seed of the ell minimum k-mers in their text order; a long
    text takes its seeds a few at a time (``most`` hashes at once)."""
    n, ell = len(kmers), min(ell, len(kmers))
    step = max(1, most // n)
    if step < len(seeds):
        return np.concatenate([order_sketches(kmers, ell, seeds[i:i + step], most) for i in range(0, len(seeds), step)])
    h = (kmers[None, :] ^ seeds[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    at = np.sort(np.argpartition(h, ell - 1, axis=1)[:, :ell], axis=1)
    x = seeds.copy()
    for j in range(ell):
        x = x * np.uint64(0xD1342543DE82EF95) + kmers[at[:, j]]
    return mix(x)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, k: int, ell: int, m: int) -> DataFrame:
    seeds = mix(np.arange(1, m + 1, dtype=np.uint64))

    def run(batches):
        for rows, data, offs in text_chunks(batches, "t"):
            words, per = word_hashes(data, offs)
            at = np.concatenate([[0], np.cumsum(per)])
            key, size, sk = [], [], []
            for i in range(rows.num_rows):
                w = words[at[i]:at[i + 1]]
                if not len(w):
                    key.append(None), size.append(0), sk.append([])
                    continue
                km = labelled_kmers(w, k)
                key.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                size.append(len(km))
                sk.append(order_sketches(km, ell, seeds).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column("i"), pa.array(key, pa.binary()), pa.array(size, pa.int32()), pa.array(sk, pa.list_(pa.int64()))],
                names=["i", "key", "n", "sk"])

    return (docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
            .mapInArrow(run, "i long, key binary, n int, sk array<long>"))


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two sequences of distinct
    k-mers within ``band`` diagonals: matched positions, then the longest
    increasing run of them."""
    from bisect import bisect_left

    ia, ib = np.argsort(a), np.argsort(b)
    sa, sb = a[ia], b[ib]
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    hit = sb[at] == sa
    x, y = ia[hit], ib[at[hit]]
    near = np.abs(x - y) <= band
    y = y[near][np.argsort(x[near])]
    if len(y) < 2 or (y[1:] > y[:-1]).all():
        return len(y)
    tails: list[int] = []
    for v in y.tolist():
        j = bisect_left(tails, v)
        tails[j:j + 1] = [v]
    return len(tails)


def similarity(wa: np.ndarray, wb: np.ndarray, k: int = K, threshold: float = THRESHOLD) -> float:
    """Aligned share of two word-hash sequences."""
    return share(labelled_kmers(wa, k), labelled_kmers(wb, k), threshold)


def share(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned share of two labelled k-mer sequences.  The band is the number of
    unmatched k-mers a pair at the threshold may have, so that no alignment
    which reaches the threshold leaves it."""
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    band = int((len(a) + len(b)) * (1 - 2 * threshold / (1 + threshold))) + 1
    got = aligned(a, b, band)
    return got / (len(a) + len(b) - got)


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of representatives whose aligned similarity reaches the
    threshold, with it.  Texts are attached by joins on the ids."""
    left = texts.select(F.col("r").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("r").alias("b"), F.col("t").alias("tb"))

    def run(batches):
        for rows, da, oa in text_chunks(batches, "ta"):
            db, ob = utf8(rows.column("tb"))
            (wa, na), (wb, nb) = word_hashes(da, oa), word_hashes(db, ob)
            at_a, at_b = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
            got = np.array([similarity(wa[at_a[i]:at_a[i + 1]], wb[at_b[i]:at_b[i + 1]], k, threshold) for i in range(rows.num_rows)])
            keep = pa.array(got >= threshold)
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(keep), rows.column("b").filter(keep), pa.array(got).filter(keep)], names=["a", "b", "similarity"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def _kmer_table(k: int):
    def run(batches):
        for rows, data, offs in text_chunks(batches, "t"):
            words, per = word_hashes(data, offs)
            at = np.concatenate([[0], np.cumsum(per)])
            yield pa.RecordBatch.from_arrays([rows.column("r"), pa.array([labelled_kmers(words[at[i]:at[i + 1]], k).tobytes() for i in range(rows.num_rows)], pa.binary())], names=["r", "km"])

    return run


def _blocked(table: pa.Table) -> pa.Table:
    """The members of one block of a bucket as one row."""
    kms = table["km"].to_pylist()
    one = [pa.array([table[c][0].as_py()], t) for c, t in (("f", pa.int32()), ("h", pa.int64()), ("b", pa.int64()))]
    packed = [table["r"].to_numpy().tobytes(), table["c"].to_numpy().tobytes(), np.array([len(x) // 8 for x in kms], np.int64).tobytes(), b"".join(kms)]
    return pa.Table.from_arrays([*one, *(pa.array([x], pa.binary()) for x in packed)], names=["f", "h", "b", "rs", "cs", "ns", "kms"])


def shared_counts(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, wide: int = 4096) -> np.ndarray:
    """How many labelled k-mers each text of one block shares with each of another."""
    u, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.isin(u, a) & np.isin(u, b)
    col = np.where(common, np.cumsum(common) - 1, -1)[at]
    row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
    first = np.arange(len(at)) < len(a)
    out = np.zeros((len(na), len(nb)), np.float32)
    for s in range(0, int(common.sum()), wide):
        x, y = np.zeros((len(na), wide), np.float32), np.zeros((len(nb), wide), np.float32)
        here = (col >= s) & (col < s + wide)
        x[row[here & first], col[here & first] - s] = 1
        y[row[here & ~first], col[here & ~first] - s] = 1
        out += x @ y.T
    return out


def _across(threshold: float):
    """Links between texts of different components in two blocks of a bucket.
    Counts of shared k-mers, an upper bound of the alignment, come from one
    matrix product; pairs that reach the threshold by it are aligned, unless a
    link found before already joins their components."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, t=np.int64: np.frombuffer(batch.column(c)[i].as_py(), t)  # noqa: B023, E731
                (ra, ca, na, a), (rb, cb, nb, b) = ((get("rs" + s), get("cs" + s), get("ns" + s), get("kms" + s, np.uint64)) for s in ("1", "2"))
                if len(set(ca.tolist()) | set(cb.tolist())) < 2:
                    continue
                size = na[:, None] + nb[None, :]
                could = (ca[:, None] != cb[None, :]) & (shared_counts(a, na, b, nb) >= size * (threshold / (1 + threshold)) - 1e-6)
                ea, eb = np.cumsum(na), np.cumsum(nb)
                parent: dict[int, int] = {}

                def find(x):
                    while (y := parent.get(x, x)) != x:  # noqa: B023
                        x = y
                    return x

                found = []
                for p, q in zip(*np.nonzero(could)):
                    x, y = find(int(ca[p])), find(int(cb[q]))
                    if x != y and (v := share(a[ea[p] - na[p]:ea[p]], b[eb[q] - nb[q]:eb[q]], threshold)) >= threshold:
                        parent[max(x, y)] = min(x, y)
                        found.append((int(ra[p]), int(rb[q]), v))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["a", "b", "similarity"])

    return run


BLOCK_KMERS = 65_536


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ell: int = ELL,
                    m: int = SKETCHES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes has ``doc_id, class_id, kept`` with one row
    per input row; class_id is the smallest id of the component.  links has
    the verified pairs of representatives of distinct texts that joined the
    components, with their similarity."""
    sk = stored(sketch_table(docs, id_col, text_col, k, ell, m), "sketches")
    rep = stored(sk.where("key is not null and i is not null").groupBy("key").agg(F.min("i").alias("r"), F.min_by("sk", "i").alias("sk"), F.min("n").alias("n")), "texts")
    bucket = rep.select("r", "n", F.posexplode("sk").alias("f", "h"))
    shared = bucket.groupBy("f", "h").agg(F.count("*").alias("c"), F.min("r").alias("hub")).where("c > 1").drop("c")
    member = stored(bucket.join(shared, ["f", "h"]), "members")
    near_size = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)  # noqa: E731  a necessary condition
    sizes = rep.select(F.col("r").alias("hub"), F.col("n").alias("hn"))
    first = member.where("r <> hub").select("r", "n", "hub").distinct().join(sizes, "hub").where(near_size(F.col("n"), F.col("hn")))
    first = stored(first.select(F.col("hub").alias("a"), F.col("r").alias("b")), "pairs1")
    text = docs.select(F.col(id_col).cast("long").alias("r"), F.col(text_col).cast("string").alias("t"))
    wanted = member.select("r").distinct().join(rep.select("r", "key"), "r")
    text = stored(text.join(sk.select(F.col("i").alias("r"), "key").join(wanted, ["r", "key"]).select("r").distinct(), "r")
                  .groupBy("r").agg(F.min("t").alias("t")), "candidates")
    link1 = stored(verify(first, text, k, threshold), "links1")
    comp = components(link1, rep.select("r"), "a", "b")
    placed = member.select("f", "h", "r", "n").join(comp.withColumnRenamed("id", "r"), "r")
    mixed = placed.groupBy("f", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.sum("n") / BLOCK_KMERS).cast("long").alias("blocks")).where("lo < hi").select("f", "h", "blocks")
    placed = placed.join(mixed, ["f", "h"]).withColumn("b", F.pmod(F.xxhash64("r"), F.col("blocks")))
    kmers = text.mapInArrow(_kmer_table(k), "r long, km binary")
    block = stored(placed.join(kmers, "r").select("f", "h", "b", "r", "c", "km").groupBy("f", "h", "b").applyInArrow(
        _blocked, "f int, h long, b long, rs binary, cs binary, ns binary, kms binary"), "blocks")
    side = lambda s: block.select("f", "h", *[F.col(c).alias(c + s) for c in ("b", "rs", "cs", "ns", "kms")])
    link2 = stored(side("1").join(side("2"), ["f", "h"]).where("b1 <= b2").mapInArrow(_across(threshold), "a long, b long, similarity double"), "links2")
    links = link1.unionByName(link2)
    final = components(links, rep.select("r"), "a", "b")
    named = rep.select("key", F.col("r").alias("id")).join(final, "id").select("key", F.col("c").alias("class_id"))
    out = sk.select(F.col("i").alias("doc_id"), "key").join(named, "key", "left")
    classes = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return classes.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))), links
