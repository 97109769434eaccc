"""Byte-level BPE by a tokenization automaton.

A merge list is compiled into the deterministic automaton over *tokens* whose
paths are exactly the tokenizations that the merges produce.  It starts as one
state with a loop for every byte.  The merge (u, v) is a gadget: where u leads
to a state s that has a v-arc, u is sent to a copy of s without the v-arc, and a
new arc uv leads from u's source to where v led.  All u-arcs share one target,
so a gadget adds one state: the copy, stored as "s without v, from this merge
on".

The transition table.  A state lacks v and every later token whose leftmost
derivation passes through v after that merge.  Tokens are numbered in preorder
of the tree of left parts, later children first, which makes each such set one
interval; a state is the sorted union of its intervals, and a transition is one
search in it.

Encoding.  Texts are split into words by the classes of their characters
(letters, numbers, white space, others; English contractions), in whole
arrays.  Every prefix of a word has exactly one path, so one pass over a
word's positions, extending each by the byte trie of token labels where the
table has the transition, finds the word's path; distinct words are encoded
once per Python worker and remembered.  Decoding emits the arcs' labels; bytes
that are no UTF-8 become the replacement character.

Tables are compiled on the driver from the vocabulary file, whose size bounds
them, and broadcast.

Defined results: null texts are empty; a text has no ids where it is empty; the
special tokens of the file are found in texts, as the file's tokenizer does;
null and repeated ids and other columns are kept as they are, and the new
columns replace columns of the same name.  Long texts are encoded in pieces cut
before white space, where a word ends in any case.  Null ids decode to null, an id
without a label is an error.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from helixframe.llm.common import Spans, text_chunks

PIECE = 1 << 20          # bytes of one text that are encoded at once
MEMO_WORDS, MEMO_IDS = 400_000, 4_000_000
OTHER, LETTER, NUMBER, BLANK = range(4)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


@lru_cache(1)
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal class over all code points: (class, length).  Characters
    that two versions of Unicode class differently are tried on the tokenizer's
    own splitter."""
    import unicodedata

    import regex
    from tokenizers import pre_tokenizers

    whole = "".join(map(chr, [*range(0xD800), *[0xFFFD] * 0x800, *range(0xE000, 0x110000)]))
    kind = np.zeros(0x110000, np.uint8)
    for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, whole):
            kind[m.start():m.end()] = k
    older = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in whole), np.uint8, len(whole))
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero((kind != older) & (kind != BLANK)).tolist():
        kind[c] = next((k for k, other in ((LETTER, "a"), (NUMBER, "1")) if len(split(other + chr(c))) == 1), OTHER)
    cut = np.flatnonzero(np.diff(kind, prepend=255))
    return kind[cut], np.diff(np.append(cut, len(kind)))


# ----------------------------------------------------------- compilation


class Automaton:
    """The compiled tables of one vocabulary."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[bytes, int]):
        """``labels``: bytes of each ordinary token; ``merges``: (u, v, uv) in order; ``special``: texts that are one token."""
        self.special = special
        target, left, born = {t: 0 for t, b in labels.items() if len(b) == 1}, {}, {}
        parent, gone, when = [-1], [-1], [-1]
        if len({labels[t] for t in target}) != 256:
            raise ValueError("every byte needs a token")
        for k, (u, v, uv) in enumerate(merges):
            if uv in target:
                raise ValueError("a token is the result of two merges")
            if u not in target or v not in target:
                continue  # no tokenization has this pair
            above, x, later = {}, v, len(merges)
            while True:
                above[x], later = later, born.get(x, -1)
                if x not in left:
                    break
                x = left[x]
            q = s = target[u]
            while q and above.get(gone[q], -1) < when[q]:
                q = parent[q]
            if q:
                continue  # u's target has no v-arc
            left[uv], born[uv], target[uv] = u, k, target[v]
            parent.append(s), gone.append(v), when.append(k)
            target[u] = len(parent) - 1
        self.states = len(parent)
        self._tabulate(labels, target, left, born, parent, gone, when)

    def _tabulate(self, labels, target, left, born, parent, gone, when) -> None:
        children: dict[int, list[int]] = {}
        for t in sorted(left, key=born.__getitem__):
            children.setdefault(left[t], []).append(t)
        size = dict.fromkeys(target, 1)
        for t in sorted(left, key=born.__getitem__, reverse=True):
            size[left[t]] += size[t]
        order: dict[int, int] = {}
        at = 0
        for root in (t for t in target if t not in left):
            order[root] = at
            at += size[root]
        for t in sorted(children, key=lambda t: born.get(t, -1)):
            place = order[t] + 1
            for c in reversed(children[t]):
                order[c] = place
                place += size[c]
        ages = {t: [born[c] for c in cs] for t, cs in children.items()}

        def interval(v: int, m: int) -> tuple[int, int]:
            k = bisect_right(ages.get(v, ()), m - 1)
            if k == len(children.get(v, ())):
                return order[v], order[v] + 1
            c = children[v][k]
            return order[v], order[c] + size[c]

        row, starts, ends = {}, [], []
        for s in sorted(set(target.values())):
            found, q = [], s
            while q:
                found.append(interval(gone[q], when[q]))
                q = parent[q]
            begin = len(starts)
            for a, b in sorted(found):
                if len(starts) > begin and a <= ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a), ends.append(b)
            row[s] = (begin, len(starts))
        n = 1 + max([*labels, *self.special.values()])
        self.order, self.low, self.high = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for t, s in target.items():
            self.order[t], (self.low[t], self.high[t]) = order[t], row[s]
        self.starts, self.ends = np.array(starts, np.int32), np.array(ends, np.int32)
        names = [labels.get(t, b"") for t in range(n)]
        for text, t in self.special.items():
            names[t] = text
        self.known = np.zeros(n, bool)
        self.known[[*labels, *self.special.values()]] = True
        self.label_at = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.label = np.frombuffer(b"".join(names), np.uint8)
        self.classes = character_classes()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @classmethod
    def load(cls, path: str) -> Automaton:
        """From a tokenizers file of a byte-level BPE without normaliser."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte, vocab = byte_letters(), {w: t for w, t in model["vocab"].items() if w not in added}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        return cls({t: bytes(byte[c] for c in w) for w, t in vocab.items()}, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], {w.encode(): t for w, t in added.items()})

    # ------------------------------------------------------ transitions

    def has_arc(self, after: int, token: int) -> bool:
        """Whether ``token`` may follow ``after`` in a tokenization."""
        lo, p = int(self.low[after]), int(self.order[token])
        k = bisect_right(self.starts, p, lo, int(self.high[after])) - 1
        return p >= 0 and (k < lo or p >= self.ends[k])

    def _machine(self):
        """The tables as Python sequences and the byte trie of the labels, built once per worker."""
        if not hasattr(self, "_ready"):
            words, roots = {}, {}
            raw, at = self.label.tobytes(), self.label_at.tolist()
            for t in np.flatnonzero(self.order >= 0).tolist():
                word, node = raw[at[t]:at[t + 1]], roots
                words[word] = t
                for b in word:
                    node = node.setdefault(b, {})
                node[-1] = (t, int(self.order[t]))  # no byte is -1
            size = np.diff(self.label_at).tolist()
            self._ready = (roots, words, size, self.low.tolist(), self.high.tolist(), self.starts.tolist(), self.ends.tolist())
        return self._ready

    def path(self, word: bytes) -> list[int]:
        """The only path that spells ``word``."""
        roots, words, size, low, high, starts, ends = self._machine()
        if word in words:  # the start state has an arc for every token
            return [words[word]]
        n = len(word)
        last = [-1] * n  # the token that ends each prefix's path
        node = roots
        for j in range(n):
            node = node.get(word[j])
            if node is None:
                break
            if -1 in node:
                last[j] = node[-1][0]
        for i in range(1, n):
            before, node = last[i - 1], roots
            lo, hi = low[before], high[before]
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                if -1 in node:
                    token, p = node[-1]
                    k = bisect_right(starts, p, lo, hi) - 1
                    if k < lo or p >= ends[k]:
                        last[j] = token
        out, i = [], n
        while i:
            out.append(last[i - 1])
            i -= size[last[i - 1]]
        return out[::-1]

    def labels_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label bytes of the ids one after the other, length of each)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id without a label")
        start, size = self.label_at[ids], self.label_at[ids + 1] - self.label_at[ids]
        return self.label[_spread(start, size)], size


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


# -------------------------------------------------------------- splitting


def word_starts(points: np.ndarray, edge: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words start in code points; ``edge`` marks where texts start.

    A word is a run of one class with a space in front, if there is one; white
    space before that, or at the end of a text; or one of the contractions
    's 't 'm 'd 're 've 'll where an apostrophe begins a word."""
    n, kind = len(points), classes[points]
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    joined = np.zeros(n, bool)  # belongs to the text before it
    joined[:-1] = ~edge[1:]
    tail = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & joined[:-1])
    start[tail] = True
    start[tail[points[tail] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start & joined)
    if len(quote):
        one, two = points[quote + 1], np.append(points, 0)[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = joined[np.minimum(quote + 1, n - 1)] & (quote + 2 < n) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        took = short | long
        end = quote[took] + np.where(short[took], 2, 3)
        start[quote[took] + 1] = False
        start[end[end < n]] = True
    return start


class Encoder:
    """Ids of whole texts, with the paths of the words met so far."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.classes = np.repeat(*automaton.classes)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        a = self.automaton
        paths = [[a.special[w]] if w in a.special else a.path(w) for w in words]
        n = np.array([len(p) for p in paths], np.int64)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, np.array([t for p in paths for t in p], np.int32)])
        order = np.argsort(k := np.concatenate([self.keys, keys]))
        self.keys, self.at, self.n = k[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        raw, whole = data.tobytes(), []
        for mark in self.automaton.special:
            i = raw.find(mark) if mark else -1
            while i >= 0:
                whole.append((i, i + len(mark)))
                i = raw.find(mark, i + len(mark))
        if whole:  # one that spans two texts is none
            first, last = np.array(whole).T
            fits = np.searchsorted(offs, first, "right") == np.searchsorted(offs, last, "left")
            whole = np.stack([first[fits], last[fits]])
        ascii_only = int(data.max()) < 128
        lead = None if ascii_only else np.flatnonzero((data & 0xC0) != 0x80)
        points = data if ascii_only else np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        place = (lambda b: b) if ascii_only else (lambda b: np.searchsorted(lead, b))
        edge = np.zeros(len(points) + 1, bool)
        edge[place(offs)] = True
        if len(whole):
            edge[place(whole.ravel())] = True
        start = word_starts(points, edge[:-1], self.classes)
        if len(whole):
            inner = place(whole)
            start[_spread(inner[0] + 1, inner[1] - inner[0] - 1)] = False
        first = np.flatnonzero(start)
        per = np.diff(np.searchsorted(first, place(offs)))
        first = first if ascii_only else lead[first]
        last = np.append(first[1:], len(data))
        h = Spans(data).hash(first, last)
        u, at, where = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_WORDS or len(self.pool) > MEMO_IDS:
            self._forget()
        j = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[j] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            self._learn(u[new], [raw[a:b] for a, b in zip(first[at[new]].tolist(), last[at[new]].tolist())])
            j = np.searchsorted(self.keys, u)
        size, origin = self.n[j][where], self.at[j][where]
        ids = self.pool[_spread(origin, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per)])])

    def encode_long(self, data: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Ids of one text, piece by piece."""
        out, i = [], 0
        while i < len(data):
            j = min(len(data), i + piece)
            if j < len(data):  # the next place where a space follows something else
                gap = np.flatnonzero((data[j:] == 32) & (data[j - 1:-1] > 32) & (data[j - 1:-1] < 127))
                j = j + int(gap[0]) if len(gap) else len(data)
            out.append(self.encode(data[i:j], np.array([0, j - i]))[0])
            i = j
        return np.concatenate(out) if out else np.zeros(0, np.int32)


# -------------------------------------------------------------- operators


def _with(columns: list[str], df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*(df.schema[c] for c in columns), StructField(name, kind)])


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text) of every row, and its text's ids as ``out`` array<int>."""
    tables = docs.sparkSession.sparkContext.broadcast(Automaton.load(path))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (out, text_col)]

    def run(batches):
        coder = Encoder(tables.value)
        for rows, data, offs in text_chunks(batches, "_text"):
            if len(data) > 2 * PIECE:
                ids = coder.encode_long(data)
                per = np.array([len(ids)])
            else:
                ids, per = coder.encode(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), lists], names=[*keep, out])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, _with(keep, docs, out, ArrayType(IntegerType())))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) of every row, and the text of its ids as ``out``."""
    tables = rows.sparkSession.sparkContext.broadcast(Automaton.load(path))
    keep = [c for c in (rows.columns if keep is None else keep) if c != out]

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = []
                for ids in part.column("_ids"):
                    ids = None if ids.values is None else ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    texts.append(None if ids is None else tables.value.labels_of(ids)[0].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    source = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).alias("_ids"))
    return source.mapInArrow(run, _with(keep, rows, out, StringType()))
