"""Near-duplicate records by banded min-hash candidates and sequential Bayesian verification.

1. Each text's word set gets ``bands * rows`` min-hashes in which every word weighs the same, so
   the bands' recall is that of plain Jaccard similarity for every text. Each band's key is shuffled
   together with the set's class (a hash of the set: equal sets are one class, so copies collapse
   before the shuffle), its size and a 128-bit signature. The same pass over the texts gives the
   records of the classes.
2. In a bucket, pairs are compared batch by batch of 32 signature bits, whole arrays at a time.
   After each batch a pair is pruned if the posterior probability that its similarity reaches the
   threshold, given the bits that differ so far and the two sizes, is under the chosen miss
   probability.
3. Survivors are verified exactly on their words.

Signatures are of two kinds. A set of at most 128 words has a bit per cell of a hash, the parity of
its words there: two sets differ in at most as many bits as words, so small sets are told apart
sharply. A larger set has the low bits of 128 min-hashes. Sets whose possible partners are of both
sizes have both, in buckets of their own.

A bucket of more than ``hot`` classes is streamed through and cut into blocks, and its pairs of
blocks become tasks of their own. The only driver-side data is a bitmap of bounded size, which says
which records' words step 3 needs, so that only these are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.blocks import BLOCK, block_of, pairs_within
from larkspur.session import written

#: Default bands and rows: at Jaccard similarity s a pair shares a band with probability
#: 1 - (1 - s**ROWS)**BANDS, 0.990 at 0.7 and 0.9999 at 0.8.
BANDS, ROWS = 25, 5
SIGNATURE, BATCH = 128, 32
#: Most classes of a bucket that are compared in one task.
HOT = 16_384
#: Rows a task gathers before it compares their buckets.
HELD = 65_536
#: Bits of the bitmap of records whose texts are needed (2 MiB at any size of input).
BITMAP = 24
#: Most words or classes a worker remembers before it starts over.
REMEMBERED = 40_000
#: Most words hashed at once.
CHUNK = 30_000

WORD = re.compile(r"[^\W_]+")
M64 = (1 << 64) - 1


def terms_of(text: str, shingle: int = 1) -> set[str]:
    """Distinct words (runs of letters and digits, lower case) or shingles of ``shingle`` words.

    A text shorter than a shingle is one shingle of all its words.
    """
    words = WORD.findall(text.lower())
    if shingle == 1 or not words:
        return set(words)
    return {" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(base: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """words x seeds."""
    return np.concatenate([(_mix(base[a : a + 4096, None] ^ seeds) >> np.uint64(32)).astype(np.uint32) for a in range(0, len(base), 4096)])


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each prefix of batches of min-hash bits, the fewest agreeing bits that keep a pair.

    Two sets of similarity s agree in a bit with probability p = (1 + s) / 2. Under a uniform prior
    of p on [1/2, 1], the posterior of p >= (1 + threshold) / 2 after m of n agree is a ratio of
    incomplete beta integrals, that is of binomial tails.
    """

    def above(x: float, m: int, n: int) -> float:  # integral of the Beta(m + 1, n - m + 1) density above x
        return sum(comb(n + 1, k) * x**k * (1 - x) ** (n + 1 - k) for k in range(m + 1))

    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        out.append(next(m for m in range(n + 1) if above((1 + threshold) / 2, m, n) >= miss * above(0.5, m, n)))
    return out


def most_differences(threshold: float, miss: float) -> np.ndarray:
    """batches x (2 * SIGNATURE + 2): the most differing bits that keep a pair after each batch, by the
    sum of the two sizes for parity bits; the last column is for min-hash bits.

    Sets of sizes a and b reach the threshold if they differ in at most (a + b)(1 - t) / (1 + t)
    words. A cell is odd after D differing words with probability (1 - (1 - 2 / cells)**D) / 2; the
    prior of D is uniform. More differing bits than words there cannot be.
    """
    t = Fraction(str(threshold))
    out = np.zeros((SIGNATURE // BATCH, 2 * SIGNATURE + 2), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        seen = (k + 1) * BATCH
        out[k, -1] = seen - least
        ways = np.array([float(comb(seen, h)) for h in range(seen + 1)])
        h = np.arange(seen + 1)
        q = (1 - (1 - 2 / SIGNATURE) ** np.arange(2 * SIGNATURE + 1)) / 2
        given = ways * q[:, None] ** h * (1 - q[:, None]) ** (seen - h)  # differing words x differing bits
        for total in range(2 * SIGNATURE + 1):
            most = int(total * (1 - t) / (1 + t))
            near = given[: most + 1].sum(axis=0) >= miss * given[: total + 1].sum(axis=0)
            out[k, total] = min(most, int(np.flatnonzero(near)[-1]))
    return out


class Sketcher:
    """Word-set classes, min-hash bands and signatures of texts; remembers the words it has seen."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        self.seeds = _mix(np.arange(1, bands * rows + SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.known = np.zeros(0, np.uint64)
        self.ranks = np.zeros((0, self.bands * self.rows), np.uint32)

    def take(self, sets: list[set[str]]) -> None:
        """The (non-empty) sets that the other methods speak about, of some CHUNK words in all; one set
        may be larger, and is then hashed piece by piece."""
        self.size = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(np.r_[0, self.size])[:-1]
        if self.size.sum() > CHUNK:
            self.base = np.array([xxhash.xxh3_64_intdigest(w) for s in sets for w in s], np.uint64)
            self.least = np.stack([self._least(self.base[a : a + n], self.seeds[SIGNATURE:]) for a, n in zip(self.starts, self.size)])
            return
        if len(self.at) > REMEMBERED:
            self._forget()
        at = self.at
        new = {w for s in sets for w in s if w not in at}
        if new:
            base = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)
            for k, w in enumerate(new, len(at)):
                at[w] = k
            self.known = np.concatenate([self.known, base])
            self.ranks = np.concatenate([self.ranks, _hashes(base, self.seeds[SIGNATURE:])])
        places = np.fromiter((at[w] for s in sets for w in s), np.int64, self.size.sum())
        self.base = self.known[places]
        self.least = np.minimum.reduceat(self.ranks[places], self.starts, axis=0)

    @staticmethod
    def _least(base: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        out = np.full(len(seeds), np.iinfo(np.uint32).max, np.uint32)
        for a in range(0, len(base), 4096):
            out = np.minimum(out, _hashes(base[a : a + 4096], seeds).min(axis=0))
        return out

    def classes(self, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each set with its salt."""
        c = _mix(np.add.reduceat(_mix(self.base), self.starts) + salt)
        d = _mix(np.add.reduceat(_mix(self.base ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.starts) ^ salt)
        return c, d

    def parities(self, k: np.ndarray) -> np.ndarray:
        """Of the sets k, 2 words of 64 bits each: in each cell the parity of the set's words there."""
        which = np.repeat(np.arange(len(self.size)), self.size)
        cell = (self.base >> np.uint64(64 - SIGNATURE.bit_length() + 1)).astype(np.int64)
        odd = np.bincount(which * SIGNATURE + cell, minlength=len(self.size) * SIGNATURE).reshape(-1, SIGNATURE)[k] & 1
        return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)

    def signatures(self, k: np.ndarray) -> np.ndarray:
        """Of the sets k, 2 words of 64 bits each: the low bits of as many min-hashes."""
        low = np.stack([self._least(self.base[self.starts[x] : self.starts[x] + self.size[x]], self.seeds[:SIGNATURE]) for x in k])
        return np.packbits((low & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)

    def band_keys(self, salt: np.ndarray) -> np.ndarray:
        """sets x bands."""
        grid = self.least.reshape(len(self.size), self.bands, self.rows).astype(np.uint64)
        key = np.zeros((len(self.size), self.bands), np.uint64)
        for r in range(self.rows):
            key = _mix(key + grid[:, :, r] + np.uint64(0x9E3779B97F4A7C15))
        band = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        return _mix(key ^ band ^ salt[:, None])


def _salt(tbl: list[str]) -> np.ndarray:
    known = {t: xxhash.xxh3_64_intdigest(t, seed=7) for t in set(tbl)}
    return np.array([known[t] for t in tbl], np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[set[str]]]]:
    """Rows whose text has words, with their sets: at most 512 rows and, but for a single larger set, CHUNK words at a time."""
    for b in batches:
        rows, sets, n = [], [], 0
        for k in range(b.num_rows):
            s = terms_of(t, shingle) if (t := b.column("text")[k].as_py()) else set()
            if not s:
                continue
            if sets and (len(sets) >= 512 or n + len(s) > CHUNK):
                yield b.take(pa.array(rows)), sets
                rows, sets, n = [], [], 0
            rows.append(k)
            sets.append(s)
            n += len(s)
        if sets:
            yield b.take(pa.array(rows)), sets


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _First:
    """Which classes a task has not handed on yet; starts over when full, so its size is bounded."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, c: np.ndarray) -> np.ndarray:
        keep = []
        for k, x in enumerate(c.tolist()):
            if x not in self.seen:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen.add(x)
                keep.append(k)
        return np.array(keep, np.int64)


SKETCH = "key bigint, c bigint, s0 bigint, s1 bigint, n bigint, tbl string"


def sketch_rows(bands: int, rows: int, shingle: int, threshold: float):
    """(tbl, id, text) -> SKETCH, one row per record and one per band of each class new to the task.

    A record's row has its class's second hash as s0, its id as s1 and n = 0. A band's row has the
    signature and the size n of the set, negative where the signature is of min-hashes.
    """
    names = [x.split()[0] for x in SKETCH.split(", ")]
    other = np.uint64(0xC2B2AE3D27D4EB4F)
    both = ceil(Fraction(str(threshold)) * SIGNATURE)  # from this size on a partner may have more than SIGNATURE words

    def run(batches):
        sketch, first = Sketcher(bands, rows), _First()
        for part, sets in _chunks(batches, shingle):
            sketch.take(sets)
            salt = _salt(part.column("tbl").to_pylist())
            c, d = sketch.classes(salt)
            ids = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([*map(_signed, (_mix(c ^ _mix(ids.astype(np.uint64))), c, d)), pa.array(ids), pa.array(np.zeros(len(c), np.int64)), part.column("tbl")], names=names)
            k = first(c)
            keys = sketch.band_keys(salt)
            for small in (True, False):
                at = k[sketch.size[k] <= SIGNATURE] if small else k[sketch.size[k] >= both]
                if not len(at):
                    continue
                bits = sketch.parities(at) if small else sketch.signatures(at)
                key = keys[at] if small else _mix(keys[at] ^ other)
                cols = [key.ravel(), *(np.repeat(x, bands) for x in (c[at], bits[:, 0], bits[:, 1]))]
                n = np.repeat(sketch.size[at] if small else -sketch.size[at], bands)
                yield pa.RecordBatch.from_arrays([*map(_signed, cols), pa.array(n), pa.nulls(len(n), pa.string())], names=names)

    return run


def word_rows(bitmap: bytes, shingle: int):
    """(h, text) -> (h, words), of records whose hash h is in the bitmap."""

    def run(batches):
        bits = np.frombuffer(bitmap, np.int64)
        for b in batches:
            at = (b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP)).astype(np.int64)
            hit = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
            if len(hit):
                b = b.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([sorted(terms_of(t, shingle)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["h", "words"])

    return run


def prune(i: np.ndarray, j: np.ndarray, sig: np.ndarray, size: np.ndarray, most: np.ndarray, at_least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of ``sig`` (rows x batches, uint32) that every bound keeps: that of the
    sizes (negative: min-hash bits), then after each batch the posterior's (:func:`most_differences`)."""
    a, b = np.abs(size[i]), np.abs(size[j])
    keep = np.minimum(a, b) * at_least.denominator >= np.maximum(a, b) * at_least.numerator
    i, j, by = i[keep], j[keep], np.where(size[i] > 0, a + b, -1)[keep]
    differ = np.zeros(len(i), np.int64)
    for k in range(len(most)):
        differ = differ + np.bitwise_count(sig[i, k] ^ sig[j, k])
        keep = differ <= most[k, by]
        i, j, by, differ = i[keep], j[keep], by[keep], differ[keep]
    return i, j


def _halves(m: np.ndarray) -> np.ndarray:
    """Two columns of signature words as batches of 32 bits."""
    return np.ascontiguousarray(m).view(np.uint32)


def _pairs(m: np.ndarray, test) -> np.ndarray:
    """Surviving pairs (a < b) of classes among neighbours of equal key, each once; rows (key, c, s0, s1, n) sorted by key."""
    key, c, sig, size = m[:, 0], m[:, 1], _halves(m[:, 2:4]), m[:, 4]
    out = []
    at, d = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        for s in range(0, len(at), 1 << 20):
            i, j = test(at[s : s + (1 << 20)], at[s : s + (1 << 20)] + d, sig, size)
            out.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]))
        d += 1
    if not out:
        return np.zeros((2, 0), np.int64)
    both = np.concatenate(out, axis=1)
    return np.unique(both[:, both[0] != both[1]], axis=1)


MET = "a bigint, b bigint, key bigint, s0 bigint, s1 bigint, n bigint, tbl string"


def bucket_pairs(test, hot: int):
    """SKETCH sorted by key -> MET: a pair of classes (a < b, all else null); a row of a hot bucket
    (its class, its block, key, signature and size); a record (class, id, null key, s0, n = 0, tbl)."""
    names = [x.split()[0] for x in MET.split(", ")]

    def rows(cols, n: int, tbl=None):
        cols = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x)) for x in cols]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.string()) if tbl is None else tbl], names=names)

    def spill(m: np.ndarray, before: int = 0):
        return rows((m[:, 1], (before + np.arange(len(m))) // hot, m[:, 0], m[:, 2], m[:, 3], m[:, 4]), len(m))

    def compared(m: np.ndarray):
        for k in range(0, len(both := _pairs(m, test).T), 1 << 16):
            part = both[k : k + (1 << 16)]
            yield rows((part[:, 0], part[:, 1], None, None, None, None), len(part))

    def run(batches):
        held: list[np.ndarray] = []
        count, spilling, spilled = 0, None, 0
        last = np.zeros((1, 5), np.int64)
        for b in batches:
            m = np.stack([b.column(k).to_numpy() for k in ("key", "c", "s0", "s1", "n")], axis=1)
            own = np.flatnonzero(m[:, 4] == 0)
            if len(own):
                r = m[own]  # one record's deliveries are neighbours
                own, last = own[(r != np.concatenate([last, r[:-1]])).any(axis=1)], r[-1:]
            if len(own):
                yield rows((m[own, 1], m[own, 3], None, m[own, 2], None, m[own, 4]), len(own), b.column("tbl").take(pa.array(own)))
            m = m[m[:, 4] != 0]
            if not len(m):
                continue
            if spilling is not None:
                n = int(np.searchsorted(m[:, 0], spilling, "right"))
                if n:
                    yield spill(m[:n], spilled)
                    spilled += n
                m = m[n:]
                if not len(m):
                    continue
                spilling = None
            held.append(m)
            count += len(m)
            if count < HELD:
                continue
            m = np.concatenate(held)
            edge = int(np.searchsorted(m[:, 0], m[-1, 0], "left"))  # the last bucket may go on
            if edge:
                yield from large_aside(m[:edge], hot, compared, spill)
            held, count = [m[edge:]], len(m) - edge
            if count > hot:
                spilling, spilled = m[-1, 0], count
                yield spill(held[0])
                held, count = [], 0
        if count:
            yield from large_aside(np.concatenate(held), hot, compared, spill)

    return run


def large_aside(m: np.ndarray, hot: int, compared, spill):
    """Compares whole buckets; one of more than ``hot`` rows is handed on in blocks instead."""
    start = np.flatnonzero(np.r_[True, m[1:, 0] != m[:-1, 0]])
    size = np.diff(np.r_[start, len(m)])
    big = np.flatnonzero(size > hot)
    if len(big):
        keep = np.ones(len(m), bool)
        for k in big:
            keep[start[k] : start[k] + size[k]] = False
            yield spill(m[start[k] : start[k] + size[k]])
        m = m[keep]
    if len(m):
        yield from compared(m)


def block_pairs(test):
    """Rows (key, x, y, side, c, s0, s1, n) sorted by (key, x, y): the pairs of block x with block y."""

    def run(batches):
        held, last = [], None

        def done(parts):
            m = np.concatenate(parts)
            sig, size = _halves(m[:, 5:7]), m[:, 7]
            same = m[0, 1] == m[0, 2]
            left = np.flatnonzero(m[:, 3] == 0)
            right = left if same else np.flatnonzero(m[:, 3] == 1)
            for k in left:
                others = right[right > k] if same else right
                i, j = test(np.full(len(others), k), others, sig, size)
                a, b = m[i, 4], m[j, 4]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            m = np.stack([b.column(k).to_numpy() for k in ("key", "x", "y", "side", "c", "s0", "s1", "n")], axis=1)
            while len(m):
                here = tuple(m[0, :3])
                n = int(np.argmin((m[:, :3] == m[0, :3]).all(axis=1))) or len(m)
                if last is not None and here != last:
                    yield from done(held)
                    held = []
                held.append(m[:n])
                last, m = here, m[n:]
        if held:
            yield from done(held)

    return run


def candidate_pairs(docs: DataFrame, threshold: float, miss: float, bands: int, rows: int, shingle: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """``a, b``: pairs of classes whose signatures pass every bound, each once; and the records of all
    classes, ``tbl, id, c, d``, each once."""
    most, at_least = most_differences(threshold, miss), Fraction(str(threshold))

    def test(i, j, sig, size):
        return prune(i, j, sig, size, most, at_least)

    sorted_ = docs.mapInArrow(sketch_rows(bands, rows, shingle, threshold), SKETCH).repartition("key").sortWithinPartitions("key", "c")
    out = written(sorted_.mapInArrow(bucket_pairs(test, hot), MET))
    pairs = out.where("n is null").select("a", "b")
    spilled = out.where("n <> 0").select("key", F.col("b").alias("block"), F.col("a").alias("c"), "s0", "s1", "n")
    if not spilled.isEmpty():
        last = spilled.groupBy("key").agg(F.max("block").alias("last"))
        each = spilled.join(last, "key").withColumn("o", F.explode(F.expr("sequence(0, last)")))
        x, y = F.least("block", "o"), F.greatest("block", "o")
        tasks = each.select("key", x.alias("x"), y.alias("y"), (F.col("block") > F.col("o")).cast("bigint").alias("side"), "c", "s0", "s1", "n")
        apart = tasks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(block_pairs(test), "a bigint, b bigint")
        pairs = pairs.unionByName(apart.where("a <> b"))
    members = out.where("n = 0").select("tbl", F.col("b").alias("id"), F.col("a").alias("c"), F.col("s0").alias("d"))
    return written(pairs.distinct()), members


def bitmap_of(hashes: DataFrame) -> bytes:
    """The column h of ``hashes`` in a bitmap of 2**BITMAP bits; other hashes may seem to be in it."""
    top = f"shiftrightunsigned(h, {64 - BITMAP})"
    words = hashes.groupBy(F.expr(f"shiftright({top}, 6)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({top} & 63 as int))")).alias("bits"))
    got = words.toPandas()  # at most 2**(BITMAP - 6) rows
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.tobytes()


def verified_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs of classes whose word sets really reach the threshold, read from the texts of their
    smallest records (``classes``: tbl, c, rep)."""
    at_least = Fraction(str(threshold))
    needed = classes.where("paired").select("c", F.xxhash64("tbl", "rep").alias("h"))
    hashed = docs.select(F.xxhash64("tbl", "id").alias("h"), "text")
    said = hashed.mapInArrow(word_rows(bitmap_of(needed), shingle), "h bigint, words array<string>")
    of = needed.join(said, "h").groupBy("c").agg(F.max("words").alias("words"))
    # the words of one text of each pair travel to the other's
    both = pairs.join(of.select(F.col("c").alias("a"), F.col("words").alias("x")), "a").join(of.select(F.col("c").alias("b"), F.col("words").alias("y")), "b")
    n = F.size(F.array_intersect("x", "y"))
    return both.where(n * at_least.denominator >= (F.size("x") + F.size("y") - n) * at_least.numerator).select("a", "b")


def class_table(mem: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes that matter, ``tbl, c, d, size, rep, paired`` (of several records or in a pair), and
    their records, ``tbl, id, c, d, size, rep``.

    Sizes are added up before records are shuffled; a class of one record is its own member.
    """
    sizes = mem.groupBy("c", "d").agg(F.count("*").alias("size"), F.min("id").alias("rep"), F.min("tbl").alias("tbl"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().withColumn("paired", F.lit(True))
    classes = written(sizes.join(ends, "c", "left").withColumn("paired", F.coalesce("paired", F.lit(False))).where("paired or size > 1").select("tbl", "c", "d", "size", "rep", "paired"))
    single = classes.where("size = 1").select("tbl", F.col("rep").alias("id"), "c", "d", "size", "rep")
    several = mem.select("id", "c", "d").join(classes.where("size > 1").drop("paired"), ["c", "d"]).select("tbl", "id", "c", "d", "size", "rep")
    return classes, written(single.unionByName(several))


def expand(mem: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``tbl, a_id, b_id`` of the records in one class and of those in classes of a pair.

    Every pair is listed; classes of any size are cut into blocks of ``block`` records that meet in
    tasks of their own.
    """
    inside = pairs_within(mem.where("size > 1"), ["tbl", "c", "d"], "id", "size", block).select("tbl", F.col("x").alias("a_id"), F.col("y").alias("b_id"))
    k = block_of(F.col("id"), F.col("size"), block)
    x = mem.select("tbl", F.col("c").alias("a"), k.alias("ka"), F.col("id").alias("x"))
    y = mem.select(F.col("c").alias("b"), k.alias("kb"), F.col("id").alias("y"))
    sizes = mem.where("id = rep").select("c", (F.ceil(F.col("size") / block) - 1).alias("last"))
    zero = F.lit(0).cast("bigint")
    met = pairs.join(sizes.select(F.col("c").alias("a"), F.col("last").alias("la")), "a").join(sizes.select(F.col("c").alias("b"), F.col("last").alias("lb")), "b")
    met = met.withColumn("ka", F.explode(F.sequence(zero, F.col("la")))).withColumn("kb", F.explode(F.sequence(zero, F.col("lb"))))
    across = met.select("a", "ka", "b", "kb").join(x, ["a", "ka"]).join(y, ["b", "kb"]).select("tbl", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    return inside.unionByName(across).where("a_id <> b_id").distinct()


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, shingle: int = 5, miss: float = 0.0005, bands: int = BANDS, rows: int = ROWS, hot: int = HOT
) -> DataFrame:
    """``tbl, a_id, b_id`` (a_id < b_id): records of one table whose term sets have a Jaccard similarity of at least ``threshold``.

    ``docs`` has tbl, id and text. Null texts and texts without a letter or digit belong to no pair;
    rows with a null id are left out; repeated rows count once. A pair at the threshold is missed
    with a probability of about (1 - s**rows)**bands (s: its Jaccard similarity) plus ``miss`` per batch; no pair under
    the threshold is returned. All pairs are listed.
    """
    mem, pairs = near_duplicate_classes(docs, threshold, shingle, miss, bands, rows, hot)
    return expand(mem, pairs)


def near_duplicate_classes(
    docs: DataFrame, threshold: float = 0.8, shingle: int = 5, miss: float = 0.0005, bands: int = BANDS, rows: int = ROWS, hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """The result of :func:`near_duplicates` before it is multiplied out: records with links,
    ``tbl, id, c, d, size, rep``, and the similar pairs of their classes, ``a, b``."""
    docs = docs.select("tbl", F.col("id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    pairs, members = candidate_pairs(docs, threshold, miss, bands, rows, shingle, hot)
    classes, mem = class_table(members, pairs)
    return mem, written(verified_pairs(docs, classes, pairs, threshold, shingle))


def link_counts(mem: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tbl, id, rep, n_links`` of each record with links, and the links of classes by their smallest
    ids, ``tbl, src, dst``: the same as from the pairs of :func:`expand`, without listing those.

    A record has as many links as its class has other records and all linked classes have records.
    """
    sizes = mem.where("id = rep").select("tbl", "c", "d", "size", "rep")
    there = sizes.select(F.col("c").alias("b"), F.col("size").alias("other"), F.col("rep").alias("dst"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = written(both.join(sizes.withColumnRenamed("c", "a"), "a").join(there, "b").select("tbl", F.col("a").alias("c"), "d", F.col("rep").alias("src"), "dst", "other"))
    linked = near.groupBy("c", "d").agg(F.sum("other").alias("others"))
    counts = mem.join(linked, ["c", "d"], "left").select("tbl", "id", "rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    links = near.where("src < dst").select("tbl", "src", "dst").unionByName(sizes.where("size > 1").select("tbl", F.col("rep").alias("src"), F.col("rep").alias("dst")))
    return counts.where("n_links > 0"), links
