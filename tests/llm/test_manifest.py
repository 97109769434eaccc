"""The Merkle manifest against a tree built node by node."""

import hashlib
import zlib

from helixframe.llm import merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root, and each leaf's siblings and position level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H("".join(x[i:i + 16])) for i in range(0, len(x), 16)])
    paths = []
    for i in range(len(leaves)):
        path, at = [], i
        for x in levels[:-1]:
            run = at // 16 * 16
            path.append(("".join(x[run:at]), "".join(x[at + 1:run + 16])))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, top = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for k, s in enumerate(names):
        for r, path in zip(groups[s], trees[s][1]):
            path = path + top[k]
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf((*r[:4], None if r[4] is None else r[4].translate(low)))
            for a, b in path:
                h = H(a + h + b)
            out.append((r[0], leaf(r), trees[s][0], root, H("".join(a + b for a, b in path)), h, h == root))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, i int, d string").repartition(parts)
    got = merkle.document_manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_manifest_is_the_definition(spark):
    rows = [(i, "hot", "en", i % 7, f"Text {i} É") for i in range(5000)]  # three rounds of blocks
    rows += [(10_000 + i, f"s{i % 40}", None, None, None if i % 9 == 0 else "Aa" * (i % 5)) for i in range(700)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 1, "No id"), (7, "hot", "en", 0, "Text 7 É"), (7, "hot", "en", 0, "Text 7 É"), (20_000, "", "x", 1, ""), (20_001, "long", "x", 1, "B" * 300_000)]
    rows += [(30_000 + i, "b256", "x", 1, "T") for i in range(256)] + [(40_000 + i, "b257", "x", 1, "T") for i in range(257)] + [(50_000 + i, "b17", "x", 1, "T") for i in range(17)]
    check(spark, rows)


def test_one_row_and_none(spark):
    check(spark, [(3, "a", "en", 1, "Only")])
    check(spark, [])


def test_many_groups(spark):
    check(spark, [(i, f"g{i:04}", "en", 1, "T") for i in range(300)])
