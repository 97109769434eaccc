"""The tokenization automaton against merging by hand and the tokenizers library."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import automaton
from helixframe.llm.common import utf8
from helixframe.llm.queries import op11_tokenization_automaton, tokenizer_path
from tests.conftest import MEDIUM

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return automaton.Automaton.load(PATH)


def toy(pairs):
    """An automaton and its merges by hand over the letters a, b, c (other bytes are idle)."""
    labels = {b: bytes([b]) for b in range(256)}
    ids = {v: k for k, v in labels.items()}
    merges = []
    for u, v in pairs:
        t = ids.setdefault(u + v, len(ids))
        labels[t] = u + v
        merges.append((ids[u], ids[v], t))
    return automaton.Automaton(labels, merges, {}), {(u, v): (k, t) for k, (u, v, t) in enumerate(merges)}, labels


def by_hand(word, rank):
    ids = list(word)
    while True:
        best = min((rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank) if any(p in rank for p in zip(ids, ids[1:])) else None
        if best is None:
            return ids
        k, u, v = best[0], *next(p for p in rank if rank[p][0] == best[0])
        out, i = [], 0
        while i < len(ids):
            if ids[i:i + 2] == [u, v]:
                out.append(rank[u, v][1])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        assert k == rank[u, v][0]
        ids = out


@pytest.mark.parametrize("seed", range(6))
def test_toy_merges(seed):
    rng = random.Random(seed)
    tokens, pairs = [b"a", b"b", b"c"], []
    while len(pairs) < 14:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens and len(u + v) < 9:
            tokens.append(u + v)
            pairs.append((u, v))
    machine, rank, labels = toy(pairs)
    for n in range(1, 8):
        for w in itertools.product(b"abc", repeat=n):
            path = machine.path(bytes(w))
            assert path == by_hand(w, rank)
            assert all(machine.has_arc(s, t) for s, t in zip(path, path[1:]))
    # an arc is there exactly where merging leaves the two tokens as they are
    live = [t for t in labels if machine.order[t] >= 0 and (t > 255 or chr(t) in "abc")]
    for s, t in itertools.product(live, live):
        assert machine.has_arc(s, t) == (by_hand(labels[s] + labels[t], rank) == [s, t])


def encode(machine, texts):
    ids, per = automaton.Encoder(machine).encode(*utf8(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])]


def test_odd_texts_are_those_of_the_library(machine, library):
    rng = random.Random(1)
    parts = ["'", "s", "t", " ", "  ", "\n", "re", "ll", "l", "d", "é", "ß", "中", "1", "²", "٣", "-", "!", "<|endoftext|>", "<|end", "\t", " ", "　", "VE", "ve", "m", "😀", "á", "\x1c", "\x85", "\0", "''", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    texts += ["", "a" * 3000, "ab" * 2000, "中" * 500, " " * 400, "'" * 50, "<|endoftext|>" * 3, "x<|endoftext|>", "  <|endoftext|>  's"]
    assert encode(machine, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_classes_are_those_of_the_library(machine):
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    kind = np.repeat(*machine.classes)
    for c in [*range(0x3100), *range(0xA000, 0xD800), *range(0xE000, 0x110000, 37)]:
        assert {"a": 1, "1": 2, "-": 0}.get(next((p for p in "a1-" if len(split(p + chr(c))) == 1), ""), 3) == kind[c], hex(c)


def test_long_text_in_pieces(machine, library):
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", "  ", "\n ", "é ", "中", "'s", "1", "<|endoftext|>", "  "]) for _ in range(20_000))
    got = automaton.Encoder(machine).encode_long(np.frombuffer(text.encode(), np.uint8), piece=300)
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    solid = "中a" * 4000
    assert automaton.Encoder(machine).encode_long(np.frombuffer(solid.encode(), np.uint8), piece=100).tolist() == library.encode(solid, add_special_tokens=False).ids


def test_operators_and_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "No id, twice", None), (None, "No id, twice", None), (4, "Ünï 'll <|endoftext|>" * 30_000, "z"), (5, "퟿ end", "w")]
    df = spark.createDataFrame(rows, "ids long, text string, decoded string").repartition(3)
    got = automaton.encode(df, PATH)
    assert got.columns == ["decoded", "ids"]
    back = {(r.decoded_, r.n): (r.text, list(r.ids)) for r in automaton.decode(got.withColumnRenamed("decoded", "decoded_"), PATH, out="text").selectExpr("*", "size(ids) n").collect()}
    assert {k[0]: v for k, v in back.items()} == {d: (t or "", library.encode(t or "", add_special_tokens=False).ids) for _, t, d in rows}
    assert automaton.encode(df.where("false"), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([0xE4 + 0, 188, 0],), ([171],)], "ids array<int>")
    assert [r.decoded for r in automaton.decode(odd, PATH).collect()] == [None, "", library.decode([0xE4, 188, 0], skip_special_tokens=False), library.decode([171], skip_special_tokens=False)]


def test_query_is_the_library(spark, library):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in op11_tokenization_automaton(spark, MEDIUM).collect()} == want
