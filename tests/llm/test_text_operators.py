"""Texts: Order MinHash, repeated passages, Katz, quality, packing, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import katz, near_text, packing, quality, repeats
from helixframe.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(300)]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def corpus(seed=1):
    """Documents with exact and near copies, shared passages, long and empty texts, non-ASCII bytes."""
    rng = random.Random(seed)
    rows, passage = [], " ".join(words(rng, 60))
    for i in range(60):
        w = words(rng, rng.randrange(1, 400))
        rows.append((i, " ".join(w)))
        if i % 5 == 0:
            rows.append((100 + i, " ".join(w)))
        if i % 4 == 0 and len(w) > 100:
            near = list(w)
            for _ in range(len(w) // 80):
                near[rng.randrange(len(w))] = "changed"
            rows.append((200 + i, " ".join(near)))
        if i % 6 == 0:
            rows.append((300 + i, " ".join(w[:20]) + " " + passage + " é" + " ".join(w[20:40])))
    rows += [(400, None), (401, ""), (402, "  \n"), (403, "ab " * 500), (404, "ab " * 500 + "x"), (405, " ".join(words(rng, 30000))), (406, "a" * 3000), (None, "no place")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", None) for i, t in corpus()], "doc_id long, text string, key string, n int").repartition(5).cache()


# ------------------------------------------------------------ op 1


def kmers(text):
    w = text.lower().split()
    if not w:
        return []
    grams = [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))]
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return 0.0
    if len(set(a) & set(b)) < 0.5 * len(a):
        return 0.0
    n = lcs(a, b)
    return n / (len(a) + len(b) - n)


def test_near_duplicates_are_brute_forces(spark, docs):
    classes, links = near_text.near_duplicates(docs)
    got = {r.doc_id: (r.class_id, r.kept) for r in classes.collect()}
    rows = [(i, kmers(t or "")) for i, t in corpus() if i is not None and i != 405]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and alike(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    for i, _ in rows:
        assert got[i] == (find(i), find(i) == i), i
    assert got[405] == (405, True) and got[None] == (None, True) and got[400] == (400, True)
    assert all(r.similarity >= 0.8 for r in links.collect())


def test_order_matters_to_sketches():
    km = near_text.labelled_kmers(np.arange(100, dtype=np.uint64) * np.uint64(7919))
    seeds = np.arange(1, 9, dtype=np.uint64)
    assert (near_text.order_sketches(km, 4, seeds) == near_text.order_sketches(km.copy(), 4, seeds)).all()
    assert (near_text.order_sketches(km, 4, seeds) != near_text.order_sketches(km[::-1], 4, seeds)).any()


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(5)
    base = words(rng, 200)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((1000, " ".join(base)))
    got = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert {r.class_id for r in got} == {0}


# ------------------------------------------------------------ op 9


def removed(rows, window=100):
    """Brute force: covered bytes per document."""
    place: dict[bytes, tuple] = {}
    out = {}
    data = sorted(((i, (t or "").encode()) for i, t in rows if i is not None))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            s = b[p:p + window]
            if place.setdefault(s, (i, p)) < (i, p):
                gone[p:p + window] = b"\1" * window
        out[i] = (b, gone)
    return out


def test_repeats_are_brute_forces(spark, docs):
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    want = removed(corpus())
    assert got.keys() == want.keys()
    for i, (b, gone) in want.items():
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        assert list(zip(got[i].starts, got[i].ends)) == spans, i
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone) if not g)
        assert got[i].n_bytes == len(b)


def test_loser_tree_merges_with_shared_prefixes():
    rng = random.Random(3)
    runs = []
    for _ in range(7):
        entries = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(32, 60))), b"l", rng.randrange(99), 1, 2) for _ in range(rng.randrange(0, 200)))
        runs.append(list(repeats.front_decode(repeats.front_code(entries))))
    merged = list(repeats.LoserTree(runs))
    assert [m[1] for m in merged] == sorted(e[1] for r in runs for e in r)
    for a, b in zip(merged, merged[1:]):
        assert b[0] == repeats.shared_prefix(a[1], b[1])


# ------------------------------------------------------------ op 8


def katz_brute(rows, k=5):
    """Katz bigrams in plain Python."""
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [tok(t) for i, t in rows if not held(i)]
    uni = Counter(w for d in train for w in d)
    bi = Counter((a, b) for d in train for a, b in zip(["<s>", *d[:-1]], d))
    ctx = Counter(a for d in train for a in ["<s>", *d[:-1]])
    n = sum(uni.values())
    d1 = katz.discounts([0, *(sum(c == r for c in uni.values()) for r in range(1, k + 2))])
    d2 = katz.discounts([0, *(sum(c == r for c in bi.values()) for r in range(1, k + 2))])
    disc = lambda d, c: d[c] if c <= k else 1.0
    free = sum((1 - disc(d1, c)) * c for c in uni.values())
    tot = n if free else n + 1
    p1 = {w: disc(d1, c) * c / tot for w, c in uni.items()}
    unknown = (free or 1) / tot
    follow = defaultdict(dict)
    for (a, b), c in bi.items():
        follow[a][b] = c
    model = {}
    for a, f in follow.items():
        lost = sum((1 - disc(d2, c)) * c for c in f.values())
        den = ctx[a] if lost else ctx[a] + 1
        seen = {b: disc(d2, c) * c / den for b, c in f.items()}
        alpha = ((lost or 1) / den) / (1 - sum(p1[b] for b in f))
        model[a] = (seen, alpha)

    def p(a, b):
        if a not in model:
            return p1.get(b, unknown)
        seen, alpha = model[a]
        return seen[b] if b in seen else alpha * p1.get(b, unknown)

    v = len(uni)
    out = {}
    for i, t in rows:
        d = tok(t)
        out[i] = (held(i), len(d), sum(uni[w] > 0 for w in d), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d),
                  sum(math.log10(p(a, b)) for a, b in zip(["<s>", *d[:-1]], d)))
    return out, p, uni, model


def test_katz_is_brute_force_and_normalised(spark, docs):
    rows = [(i, t) for i, t in corpus() if i is not None]
    want, p, uni, model = katz_brute(rows)
    for a in list(model)[:50]:
        assert abs(sum(p(a, b) for b in uni) + p(a, "never seen") - 1) < 1e-9
    got = {r.doc_id: r for r in katz.score_corpus(docs, block_tokens=5000)[0].collect()}
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def katz_trigrams(rows, p2, k=5):
    """Katz trigrams in plain Python, on top of the bigrams' p2."""
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    tri = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            d = ["<s>", *tok(t)]
            tri.update(zip(d, d[1:], d[2:]))
    disc = katz.discounts([0, *(sum(c == r for c in tri.values()) for r in range(1, k + 2))], k)
    less = lambda c: (disc[c] if c <= k else 1.0) * c
    follow = defaultdict(dict)
    for (a, b, w), c in tri.items():
        follow[a, b][w] = c
    model = {}
    for (a, b), f in follow.items():
        lost = sum(c - less(c) for c in f.values())
        den = sum(f.values()) + (0 if lost else 1)
        model[a, b] = ({w: less(c) / den for w, c in f.items()}, (lost or 1) / den / (1 - sum(p2(b, w) for w in f)))

    def p(a, b, w):
        if (a, b) not in model:
            return p2(b, w)
        seen, alpha = model[a, b]
        return seen[w] if w in seen else alpha * p2(b, w)

    return [(i, sum(math.log10(p2("<s>", w) if j == 0 else p(["<s>", *d][j - 1], d[j - 1], w)) for j, w in enumerate(d))) for i, d in ((i, tok(t)) for i, t in rows)], p, model, tri


def test_katz_of_order_3_is_brute_force_and_normalised(spark):
    rng = random.Random(8)
    few = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(few, [1 / (r + 1) for r in range(40)], k=rng.randrange(0, 60)))) for i in range(150)]
    rows += [(i + 200, f"only{i} here V1 v2 {'v3 ' * (i % 9)}") for i in range(20)] + [(300, None), (301, ""), (302, "all unknown words"), (9, "v1 v2 v3"), (9, "v1 v2 v3"), (303, "v1 v2 " * 12), (304, "v7 v1 v2 v1 v2")]
    _, p2, uni, _ = katz_brute(rows)
    want, p, model, tri = katz_trigrams(rows, p2)
    for a, b in list(model)[:60]:
        assert abs(sum(p(a, b, w) for w in uni) + p(a, b, "never seen") - 1) < 1e-9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, tables = katz.score_corpus(docs, block_tokens=600, order=3)
    got = sorted((r.doc_id, r.score) for r in got.collect())
    assert [i for i, _ in got] == sorted(i for i, _ in rows)
    for (_, score), (_, brute) in zip(got, sorted(want)):
        assert score == pytest.approx(brute, rel=1e-9, abs=1e-12)
    stored = [katz.unpack(r.d) for r in tables.where("order = 3").collect()]
    assert sorted(c for s in stored for c in s.tolist()) == sorted(tri.values())


def test_katz_of_order_3_beats_order_2_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    two, three = (katz.score_corpus(docs, order=o)[0].where("held_out").agg({"score": "sum"}).first()[0] for o in (2, 3))
    assert three > two


def test_katz_query_asks_triples_of_words(spark):
    from helixframe.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.score for r in katz.score_corpus(docs, order=3)[0].collect()}
    got = {r.doc_id: r.score for r in QUERIES["op8_katz_backoff"](spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx(want, rel=1e-9)
    with pytest.raises(ValueError, match="order"):
        katz.score_corpus(docs, order=4)


def test_katz_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = katz.score_corpus(docs)[0].where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


# ------------------------------------------------------------ op 4


def test_quality_keeps_clean_text_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    s = quality.quality_scores(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"))
    rate = dict(s.join(labels, "doc_id").groupBy("quality").agg({"accepted": "count"}).collect())
    kept = dict(s.where("accepted").join(labels, "doc_id").groupBy("quality").count().collect())
    assert kept[1] > 0.98 * rate[1] and kept.get(0, 0) < 0.35 * rate[0]


def kneser_ney_brute(texts):
    """Interpolated modified Kneser-Ney of order 3, spelt out."""
    tri = Counter()
    for t in texts:
        w = t.split()
        tri.update(zip(["<2>", "<1>", *w], ["<1>", *w], w))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1] for g in bi)

    def disc(c):
        n = [sum(x == r for x in c.values()) for r in range(5)]
        if not all(n[1:]):
            return [0, 0.5, 0.75, 0.75]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(r - (r + 1) * y * n[r + 1] / n[r], 0.05), r - 0.05) for r in (1, 2, 3))]

    d3, d2, d1 = disc(tri), disc(bi), disc(uni)

    def level(counts, d, h):
        f = {g[-1]: c for g, c in counts.items() if g[:-1] == h}
        n = sum(f.values())
        return f, n, sum(d[min(c, 3)] for c in f.values()) / n if n else 1.0

    n1 = sum(uni.values())
    floor = sum(d1[min(c, 3)] for c in uni.values()) / n1 / (len(uni) + 1)

    def p(u, v, w):
        x = (uni[w] - d1[min(uni[w], 3)]) / n1 + floor if uni[w] else floor
        for counts, d, h in ((bi, d2, (v,)), (tri, d3, (u, v))):
            f, n, g = level(counts, d, h)
            x = (f[w] - d[min(f[w], 3)]) / n + g * x if w in f else g * x
        return x

    return p, uni


def test_kneser_ney_is_the_definition(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(30)) for _ in range(40)]
    model = quality.fit(spark.createDataFrame([(t,) for t in texts], "t string"))
    p, uni = kneser_ney_brute(texts)
    assert abs(sum(p("a", "b", w) for w in uni) + p("a", "b", "new") - 1) < 1e-9
    probe = "a b new c dd a a"
    data = np.frombuffer(probe.encode(), np.uint8)
    *grams, _ = quality._grams(data, np.array([0, len(data)]))
    w = probe.split()
    want = [math.log10(p(u, v, x)) for u, v, x in zip(["<2>", "<1>", *w], ["<1>", *w], w)]
    assert model.logp(*grams).tolist() == pytest.approx(want, rel=1e-9)


def test_quality_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "some words", "en"), (3, "some words", "en")]
    got = {r.doc_id: r for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long")).collect()}
    assert not got[1].accepted and not got[2].accepted and got[3].accepted and got[None].accepted


# ------------------------------------------------------------ op 6


def test_packing_tokens_and_placement(spark, docs):
    from tokenizers import Tokenizer

    odd = [(900, "It's 12 o'clock: ÉCOLE, naïve—text... <|endoftext|> x\ty\r\nz  ff"), (901, "áb  c\x1cd e.f,g'h \"q\" İstanbul ΣΑΣ"), (902, "<|startoftext|>AB")]
    rows = [*corpus(), *odd, (903, "x"), (903, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer_path(), group_tokens=30000, with_tokens=True).cache()
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[i, p, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want
    bins = defaultdict(list)
    for r in got.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(len(s.tokens) for s in packing.sequences(got).collect()) == 4 * sum(k[3] * n for k, n in want.items())


def test_sum_of_squares_wastes_next_to_nothing():
    rng = np.random.default_rng(0)
    x = np.minimum(rng.lognormal(5.5, 1.0, 8000).astype(int) + 1, 2048)
    bins, offsets = packing.sum_of_squares(x, 2048)
    assert bins.max() + 1 <= math.ceil(x.sum() / 2048) * 1.01
    assert (np.bincount(bins, x) <= 2048).all()


# ------------------------------------------------------------ edges


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, b int, shard int, block int")
    assert near_text.near_duplicates(none)[0].count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert katz.score_corpus(none)[0].count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert quality.quality_scores(none, none.select("doc_id")).count() == 0


def test_hash_of_kept_bytes_is_stable(spark, docs):
    a = {r.doc_id: hashlib.md5(bytes(r.kept)).hexdigest() for r in repeats.remove_repeats(docs.repartition(2)).collect()}
    b = {r.doc_id: hashlib.md5(bytes(r.kept)).hexdigest() for r in repeats.remove_repeats(docs.repartition(7)).collect()}
    assert a == b
