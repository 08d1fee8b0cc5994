"""Byte-level BPE ids of a whole corpus by speculation and verification.

For each word (piece of the pre-tokenizer's pattern) a greedy longest match proposes tokens. A
proposal is the true encoding exactly if every adjacent pair of its tokens is compatible, that is
if encoding the two tokens' bytes gives the two tokens again. All pairs of a batch are tested
together on arrays by undoing merges along the boundary. Words with an incompatible pair, and only
those, are merged exactly. Workers remember the ids of words, up to a bound.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int64(1 << 40)
#: Words a worker remembers before it starts over, and bytes of a word worth remembering.
REMEMBERED, LONG = 300_000, 64


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and their order of one vocabulary file in ``tokenizers`` JSON form."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        table = byte_of_char()
        ids = {t: i for t, i in model["vocab"].items()}
        size = max(ids.values()) + 1
        self.ids: dict[bytes, int] = {}
        for t, i in ids.items():
            if all(c in table for c in t):
                self.ids[bytes(table[c] for c in t)] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        # rank: a merged token's place in the order of merges, -1 for single bytes
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(merges)), left, right
        key = (left << 32) | right
        order = np.argsort(key)
        self.keys, self.key_rank = key[order], order.astype(np.int64)
        self.merge = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays apart when its bytes are merged together.

        Merges run in order of rank, leftmost first, so undoing the later-made of the two tokens
        at the boundary goes back in time. At every stage the pair at the boundary must not have
        been due before the merge that used one of its tokens up.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        due = np.full(len(a), NONE)  # the boundary pair fails if its rank is under this
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            fail = self.pair_rank(x, y) < due[live]
            good[live[fail]] = False
            live, x, y = live[~fail], x[~fail], y[~fail]
            rx, ry = self.rank[x], self.rank[y]
            go = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry  # of equal ranks the right one was made later
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            # a tie goes to the leftmost: to a merge left of the boundary, but not to one right of it
            due[live] = np.where(undo_left, rx, ry + 1)
        return good

    def greedy(self, word: bytes) -> list[int]:
        """The proposal: longest token first, from the left."""
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            end = min(n, at + self.longest)
            while (t := ids.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding of one word, with a heap of due merges over a linked list."""
        tok = [self.single[b] for b in word]
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, tok[k], tok[k + 1]) for k in range(n - 1) if (m := self.merge.get((tok[k], tok[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            j = nxt[k] if tok[k] is not None else n
            if tok[k] != x or j >= n or tok[j] != y:
                continue  # one of the two is gone or has grown
            tok[k], tok[j] = self.merge[x, y][1], None
            nxt[k] = nxt[j]
            if nxt[k] < n:
                prv[nxt[k]] = k
                if m := self.merge.get((tok[k], tok[nxt[k]])):
                    heapq.heappush(heap, (m[0], k, tok[k], tok[nxt[k]]))
            if prv[k] >= 0 and (m := self.merge.get((tok[prv[k]], tok[k]))):
                heapq.heappush(heap, (m[0], prv[k], tok[prv[k]], tok[k]))
        return [t for t in tok if t is not None]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v = vocabulary
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of new words: propose, test all adjacent pairs at once, merge the failing words."""
        raw = [w.encode() for w in words]
        ids = [[t] if (t := self.v.ids.get(r)) is not None else self.v.greedy(r) for r in raw]
        size = np.array([len(x) for x in ids])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(ids)), size)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, at = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        good = self.v.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        for k in np.unique(owner[inner[~good[at]]]).tolist():
            ids[k] = self.v.merged(raw[k])
        return {w: tuple(x) for w, x in zip(words, ids)}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for a null or empty one."""
        pieces = [self.split(t) if t else () for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for x in pieces for p in x if p not in known})
        once = {}
        if new:
            got = self.learn(new)
            known.update((w, i) for w, i in got.items() if len(w) <= LONG)
            once = {w: i for w, i in got.items() if len(w) > LONG}
        return [list(chain.from_iterable(known[p] if p in known else once[p] for p in x)) for x in pieces]


@lru_cache(4)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(raw), pattern)


def tokenizer_file(name: str, folder: str = "/opt/tokenizers") -> tuple[bytes, str]:
    """A vocabulary file and the pattern its folder's module gives for it."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("tokenizer_folder", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return Path(folder, f"{name}.json").read_bytes(), module.PATTERN


def encode_corpus(docs: DataFrame, key: str, text: str, raw: bytes, pattern: str, most: int = 64 << 20) -> DataFrame:
    """``key, ids``: the token ids of each text, no special tokens; their strings are ordinary text.

    A null and an empty text both give an empty list; a null key keeps its row. Each input row
    gives one row, whatever else its table holds. The vocabulary is broadcast: one file of a
    public tokenizer, checked to be under ``most`` bytes.
    """
    if len(raw) > most:
        raise ValueError("the vocabulary file is larger than a broadcast may be")
    shared = docs.sparkSession.sparkContext.broadcast((raw, pattern))

    def run(batches):
        encoder = _encoder(*shared.value)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                ids = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
