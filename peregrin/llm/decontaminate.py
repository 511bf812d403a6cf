"""Operator 2, benchmark decontamination by the CGK embedding.

Words (lower-cased, punctuation off both ends) are the letters of the strings compared. A document holds an item if
some run of its words is within EDITS of the item's length in word edits of the item.

Items are the query set: a block of at most BLOCK_WORDS words of them (or one longer item) is indexed and shipped to a scan of the
documents. Blocks follow each other: the findings of one are written before the next is read, so driver and tasks hold one block.
Documents are neither shuffled nor grouped.

1. Places. A run within k edits of an item holds one of k + 1 disjoint pieces of it unchanged (pigeonhole), so windows are
   embedded only where some piece of some item is near; this loses nothing, and names no item.
2. CGK: a random walk over a window, which at every step writes the letter under it and moves on or stays by a coin
   that the letter throws, maps edit distance to Hamming distance. It is run in repetitions with coins of their own; one walk
   serves windows of all items' lengths from a place.
3. Bit-sampling LSH: in each repetition, SAMPLES places of a window's image are its key, and the items of its length in the
   bucket of that key are its candidates.
4. Candidates are verified by exact edit distance (best run within the window's reach).

The number of repetitions is set for each item: by simulated edits of that item, as many as are allowed, once replacements only,
once deletions, once insertions, and mixed, until each kind meets the target recall. Of items for which MOST_REPEATS do not, all
windows around their own pieces are verified.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema, slices, staged, texts, word_hashes

EDITS, SAMPLES, RECALL, MOST_REPEATS, BLOCK_WORDS = 0.2, 2, 0.99, 128, 200_000
#: Calibration: trials an item and mix; shares of words replaced, taken out and put in.
TRIALS, MIXES = 400, ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1 / 3, 1 / 3, 1 / 3))
PUNCTUATION = ".,;:!?\"'()[]{}|#*$%&<>-_/\\"
_FOUND = "doc_id long, item_id long, start long, n_words long, edits int"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def coin(letters: np.ndarray, step: int, repeat: int) -> np.ndarray:
    """0 or 1 for each letter: whether a walk moves on."""
    return (((letters ^ np.uint64((repeat + 1) * 1_000_003 + step)) * _ODD) >> np.uint64(63)).view(np.int64)


def cgk(strings: np.ndarray, places: np.ndarray, repeat: int) -> np.ndarray:
    """The letters at `places` (ascending) of the image of each row of letters (0 ends it)."""
    n, width = strings.shape
    padded = np.concatenate([strings, np.zeros((n, 1), np.uint64)], axis=1).ravel()
    at, row = np.zeros(n, np.int64), np.arange(n) * (width + 1)
    out = np.empty((n, len(places)), np.uint64)
    for j in range(places[-1] + 1):
        c = padded[row + at]
        out[:, places == j] = c[:, None]
        at += coin(c, j, repeat)
        np.minimum(at, width, out=at)
    return out


def best_runs(items: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: least edits from its item to any run of its text, and start and end of the first best run.

    Rows are letters; a 0 in an item matches nothing, one in a text stands beyond its end and is never part of a run.
    """
    n, m = text.shape
    place = np.arange(m + 1)
    cost, start = np.zeros((n, m + 1), np.int64), np.tile(place, (n, 1))
    for i in range(items.shape[1]):
        swap = cost[:, :-1] + (text != items[:, i, None])
        drop = cost[:, 1:] + 1
        best = np.minimum(swap, drop)
        origin = np.where(swap <= drop, start[:, :-1], start[:, 1:])
        ahead = np.concatenate([np.full((n, 1), i + 1), best], axis=1) - place  # a run of letters of text put in costs one each
        least = np.minimum.accumulate(ahead, axis=1)
        own = np.maximum.accumulate(np.where(ahead == least, place, 0), axis=1)
        cost, start = least + place, np.take_along_axis(np.concatenate([np.zeros((n, 1), np.int64), origin], axis=1), own, axis=1)
    cost[:, 1:][text == 0] = items.shape[1] + m
    end = np.argmin(cost, axis=1)
    row = np.arange(n)
    return cost[row, end], start[row, end], end


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q letters."""
    out = np.zeros(max(0, len(h) - q + 1), np.uint64)
    for j in range(q):
        out = (out ^ h[j : len(h) - q + 1 + j]) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Lookup:
    """Which of a sorted array of hashes a value is; a bit for each value of the upper bits keeps most others out."""

    def __init__(self, known: np.ndarray):
        bits = min(20, max(12, len(known).bit_length() + 6))
        self.known, self.shift, self.maybe = known, np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.maybe[(known >> self.shift).astype(np.int64)] = True

    def __reduce__(self) -> tuple:  # only the hashes are shipped
        return Lookup, (self.known,)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x of values that are known, and the first place of each in the array."""
        at = np.flatnonzero(self.maybe[(x >> self.shift).view(np.int64)])
        which = np.searchsorted(self.known, x[at])
        real = self.known[np.minimum(which, len(self.known) - 1)] == x[at] if len(at) else np.zeros(0, bool)
        return at[real], which[real]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], first[i] + 1, ... (count[i] of them), and the i of each."""
    i = np.repeat(np.arange(len(count)), count)
    return np.arange(len(i)) - (np.cumsum(count) - count)[i] + first[i], i


class Index:
    """Of items (id, letters): pieces, repetitions that reach the target recall, and the buckets of every repetition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], recall: float = RECALL, most: int = MOST_REPEATS):
        self.items, self.most = items, most
        self.size = np.array([len(w) for _, w in items], np.int64)
        self.k = (EDITS * self.size).astype(np.int64)
        self.lengths = np.unique(self.size)
        rng = np.random.default_rng(7)
        fractions = [np.sort(rng.choice(1000, SAMPLES, replace=False)) for _ in range(most)]
        #: Of each repetition and length the sampled places; they lie where the walk is still inside the string.
        self.places = [{int(n): f * max(1, int(1.6 * n)) // 1000 for n in self.lengths} for f in fractions]
        self.repeats = np.zeros(len(items), np.int64)
        for n in self.lengths:
            self._calibrate(int(n), rng, recall)
        self.exhaustive = self.repeats == 0
        self.buckets = [self._buckets(r) for r in range(int(self.repeats.max(initial=0)))]
        self._pieces()

    def _pieces(self) -> None:
        """By length of pieces: their hashes, how far from one windows may start, and the exhaustive items of each with their offsets."""
        every, own = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
        for i, (_, w) in enumerate(self.items):
            k = int(self.k[i])
            q = len(w) // (k + 1)
            for p in range(0, (k + 1) * q, q):
                h = int(grams(w[p : p + q], q)[0])
                every[q][h] += [-p - k, -p + k]
                if self.exhaustive[i]:
                    own[q][h].append((i, p))
        self.reach, self.own = {}, {}
        for q, of in every.items():
            known = sorted(of)
            self.reach[q] = Lookup(np.array(known, np.uint64)), np.array([min(of[h]) for h in known]), np.array([max(of[h]) for h in known])
            if q in own:
                known = sorted(own[q])
                self.own[q] = Lookup(np.array(known, np.uint64)), [own[q][h] for h in known]

    def _key(self, images: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(images), n, np.uint64)
        for j in range(images.shape[1]):
            out = (out ^ images[:, j]) * _ODD
            out ^= out >> np.uint64(31)
        return out * _ODD

    def _buckets(self, repeat: int) -> tuple[Lookup, np.ndarray, np.ndarray, list[int]]:
        """Keys of the items that this repetition is for: distinct ones, where each one's items end, the items, and their lengths."""
        members = np.flatnonzero(self.repeats > repeat)
        keys = np.array([self._key(cgk(self.items[i][1][None], self.places[repeat][int(self.size[i])], repeat), int(self.size[i]))[0] for i in members], np.uint64)
        order = np.argsort(keys, kind="stable")
        known, first = np.unique(keys[order], return_index=True)
        return Lookup(known), np.append(first, len(members)), members[order], np.unique(self.size[members]).tolist()

    def _calibrate(self, n: int, rng: np.random.Generator, recall: float) -> None:
        """Set the repetitions of the items of n words: the first after which, of every mix of edits, at most a share of 1 - recall of the
        trials, less a standard error, is left."""
        members = np.flatnonzero(self.size == n)
        few = (1 - recall) * TRIALS
        few -= min(few, few**0.5)
        step = max(1, 40_000_000 // (TRIALS * len(MIXES) * n))
        for some in (members[i : i + step] for i in range(0, len(members), step)):
            own = np.repeat(np.array([self.items[i][1] for i in some], np.uint64), TRIALS, axis=0)
            a, b = np.concatenate([own] * len(MIXES)), np.concatenate([self._edited(own, int(EDITS * n), mix, rng) for mix in MIXES])
            group = np.concatenate([np.repeat(np.arange(len(some)), TRIALS) * len(MIXES) + j for j in range(len(MIXES))])
            for r in range(self.most):
                missed = (cgk(a, self.places[r][n], r) != cgk(b, self.places[r][n], r)).any(axis=1)
                a, b, group = a[missed], b[missed], group[missed]
                left = np.bincount(group, minlength=len(some) * len(MIXES)).reshape(-1, len(MIXES)).max(axis=1)
                self.repeats[some[(left <= few) & (self.repeats[some] == 0)]] = r + 1
                if (left <= few).all():
                    break

    @staticmethod
    def _edited(a: np.ndarray, k: int, mix: tuple[float, float, float], rng: np.random.Generator) -> np.ndarray:
        """The windows that stand where rows of letters stood, after k edits each at places of their own; fresh letters follow."""
        n = a.shape[1]
        fresh = lambda *shape: rng.integers(1, 2**63, shape, dtype=np.uint64)
        kind = np.zeros(a.shape, np.int8)  # 0 as it is, 1 replaced, 2 taken out, 3 one put before
        if k:
            np.put_along_axis(kind, np.argpartition(rng.random(a.shape), k - 1, axis=1)[:, :k], rng.choice(3, (len(a), k), p=mix).astype(np.int8) + 1, axis=1)
        x = np.where(kind == 1, fresh(*a.shape), a)
        copies = np.where(kind == 2, 0, np.where(kind == 3, 2, 1))
        flat, size = np.repeat(x.ravel(), copies.ravel()), copies.sum(axis=1)
        ends = np.cumsum(copies.ravel())
        put = (ends - 2)[(kind == 3).ravel()]
        flat[put] = fresh(len(put))
        at = (np.cumsum(size) - size)[:, None] + np.arange(n)
        return np.where(np.arange(n) < size[:, None], flat[np.minimum(at, len(flat) - 1)], fresh(*a.shape))

    def starts(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows are embedded, and rows (start, item) to be verified whatever their keys."""
        mark, pairs = np.zeros(len(h) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        for q, (lookup, low, high) in self.reach.items():
            g = grams(h, q)
            p, j = lookup(g)
            d = np.searchsorted(at, p, "right") - 1
            lo, hi = np.maximum(p + low[j], at[d]), np.minimum(p + high[j] + 1, at[d + 1])
            mark += np.bincount(lo[lo < hi], minlength=len(h) + 1) - np.bincount(hi[lo < hi], minlength=len(h) + 1)
            if q in self.own:
                lookup, members = self.own[q]
                for p, j in zip(*(x.tolist() for x in lookup(g)), strict=True):
                    d = int(np.searchsorted(at, p, "right")) - 1
                    for i, offset in members[j]:
                        s = np.arange(max(p - offset - self.k[i], at[d]), min(p - offset + self.k[i] + 1, at[d + 1]))
                        pairs.append(np.stack([s, np.full(len(s), i)], axis=1))
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0), np.concatenate(pairs)

    def candidates(self, h: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (start, item): windows at the starts that share a bucket with an item of their length in one of its repetitions."""
        pairs = [np.zeros((0, 2), np.int64)]
        apart = np.insert(h, at[1:], np.uint64(0))  # a 0 ends each text
        for i in range(0, len(starts), 1 << 15):
            some = starts[i : i + (1 << 15)]
            d = np.searchsorted(at, some, "right") - 1
            base, room = some + d, at[d + 1] - some
            for r, (lookup, ends, members, lengths) in enumerate(self.buckets):
                wanted = defaultdict(list)
                for n in lengths:
                    for w, p in enumerate(self.places[r][n].tolist()):
                        wanted[p].append((n, w))
                images = {n: np.empty((len(some), SAMPLES), np.uint64) for n in lengths}
                off = np.zeros(len(some), np.int64)
                for j in range(max(wanted) + 1):
                    c = apart[base + off]
                    for n, w in wanted.get(j, ()):
                        images[n][:, w] = np.where(off < n, c, np.uint64(0))
                    off += coin(c, j, r)
                    np.minimum(off, room, out=off)
                for n in lengths:
                    where, which = lookup(self._key(images[n], n))
                    item, of = _spread(ends[which], ends[which + 1] - ends[which])
                    pairs.append(np.stack([some[where[of]], members[item]], axis=1))
        return np.unique(np.concatenate(pairs), axis=0)

    def search(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Of texts' words end to end: (text, item, start, words, edits) of the best run of every item that each text holds."""
        starts, pairs = self.starts(h, at)
        pairs = np.unique(np.concatenate([self.candidates(h, at, starts), pairs]), axis=0)
        text = np.searchsorted(at, pairs[:, 0], "right") - 1
        order = np.lexsort((pairs[:, 0], text, pairs[:, 1]))
        jobs, last = defaultdict(list), (-1, -1, 0)
        for d, (s, i) in zip(text[order].tolist(), pairs[order].tolist(), strict=True):
            if last[:2] != (i, d) or s >= last[2]:  # else within what is verified already
                jobs[int(self.size[i])].append((d, i, s))
                last = (i, d, s + int(self.k[i]) + 1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, of in jobs.items():
            k = int(EDITS * n)
            width = n + 4 * k + 1
            for j in range(0, len(of), max(1, (1 << 20) // (width + 1))):
                d, i, s = (np.array(x) for x in zip(*of[j : j + max(1, (1 << 20) // (width + 1))], strict=True))
                lo = np.maximum(s - k, at[d])
                where = lo[:, None] + np.arange(width)
                rows = np.where(where < at[d + 1][:, None], h[np.minimum(where, len(h) - 1)], np.uint64(0))
                edits, a, b = best_runs(np.array([self.items[x][1] for x in i], np.uint64), rows)
                for x in np.flatnonzero(edits <= k).tolist():
                    found = int(edits[x]), int(lo[x] + a[x] - at[d[x]]), int(b[x] - a[x])
                    key = int(d[x]), int(i[x])
                    best[key] = min(best.get(key, found), found)
        return sorted((d, i, start, n, edits) for (d, i), (edits, start, n) in best.items())


def find_leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Return doc_id, item_id, start (word), n_words, edits: the best run of each item that each document row holds.

    Null texts and texts without words hold nothing, and items of that kind are in nothing. Items of fewer words than an edit is
    allowed for (under 5) are found word for word. Items of equal words are all reported, repeated rows of documents and items
    too. Of runs with equally few edits the first counts. Empty tables give no rows.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator()
    block: list[tuple[int, np.ndarray]] = []
    size, done = 0, []
    for r in rows:
        h, _ = word_hashes(pa.array([r.text]), PUNCTUATION, pc.utf8_lower)
        if block and size + len(h) > block_words:
            done.append(_scan(docs, block, write=True))
            block, size = [], 0
        if len(h):
            block.append((r.item_id, h))
            size += len(h)
    out = _scan(docs, block, write=bool(done))
    for b in done:
        out = out.unionByName(b)
    return out


def _scan(docs: DataFrame, block: list[tuple[int, np.ndarray]], write: bool) -> DataFrame:
    """The findings of a block; if they are written, nothing of the block stays."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for part in slices(b, "text"):
                rows = []
                for d, i, start, n, edits in index.search(*word_hashes(part.column("text"), PUNCTUATION, pc.utf8_lower)):
                    rows.append({"doc_id": part.column("doc_id")[d].as_py(), "item_id": index.items[i][0], "start": start, "n_words": n, "edits": edits})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))

    found = texts(docs).mapInArrow(run, schema(_FOUND))
    if write:
        found = staged(found, "leaks")
        shared.unpersist()
    return found


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
