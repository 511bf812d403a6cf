"""Operator 5, suffix-array dedup by a common-prefix-aware distributed merge sort.

A byte goes if it lies in a LENGTH-byte string that also starts earlier. Sorting the suffixes of every byte would multiply the
corpus, so a sparse suffix array is sorted: suffixes at anchors, the places of the least GRAM-byte hash of some
LENGTH-byte string. Anchors depend on the string's bytes alone, so equal strings have an anchor at the same offset.

0. Strings that stand a period of at most LEFT bytes earlier in the same text are found there and need no anchor, so that long
   runs of a letter or pattern have a few anchors instead of one a byte.
1. Anchors around which no LENGTH bytes can repeat fall away: such a string holds the SIDE bytes from the anchor on, or those that end
   with its gram, so one of the two stands elsewhere too (a common gram in other company doesn't count). Their hashes meet by bucket; a
   task sends a distinct hash of its documents once, so that a passage in a third of all documents is a record a task. What repeats is packed by the bucket of its document, a row for
   each pair of buckets, and unpacked to a row a document.
2. Each partition sorts the suffixes at what is left, by the bytes from the anchor on and then those before it, as far as any LENGTH-byte string
   with the anchor reaches. Equal ones become the earliest (others are covered whole). The sorted run is front-coded and
   cut at the splitters of sampled suffixes.
3. Runs of a range are merged by a loser tree that keeps each suffix's common prefix with the last one put out: it
   compares lengths first and, where they tie, only the bytes beyond them.
4. In the merged array neighbours that share GRAM bytes hold the candidates. For each offset of the anchor in a LENGTH-byte string, all
   but the earliest of equal strings are covered; equality is that of bytes (classes of common prefixes to both sides), never of hashes.

Covered spans go back to their documents by id. Work is cut by bytes and by numbers of anchors, so memory depends on neither the number
nor the kind of documents in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, flat, parts, schema, slices, staged, texts

LENGTH, GRAM, SIDE = 100, 32, 64
LEFT = LENGTH - GRAM
WIDTH = LENGTH + LEFT
_NULL = -(2**63)
_A = 0x9E3779B97F4A7C15 | 1
#: Anchors that are sorted, or suffixes that are compared, at a time; bytes that are hashed at a time.
_BATCH, _CHUNK = 1 << 18, 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def periodic(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of texts end to end: pairs of ends of stretches whose LENGTH-byte strings all stand 1 to LEFT bytes earlier in the same text.

    A period that is a multiple of one met before in the text isn't looked for. What a text gives depends on it alone.
    """
    half, found = LENGTH // 2, {}
    probe = np.arange(0, len(data), half)  # a stretch holds a whole block from one of these on
    text = np.searchsorted(at, probe, "right") - 1
    inside = probe + half <= at[text + 1]
    probe, text = probe[inside], text[inside]
    for p in range(1, LEFT + 1):
        ok = probe - p >= at[text]
        m, t = probe[ok], text[ok]
        for j in (0, half - 1, 17, 33, 9, 41, 25):
            same = data[m + j] == data[m + j - p]
            m, t = m[same], t[same]
        for k in np.unique(t).tolist():
            if any(p % q == 0 for q in found.get(k, ())):
                continue
            s, e = int(at[k]), int(at[k + 1])
            differ = np.concatenate([[-1], np.flatnonzero(data[s + p : e] != data[s : e - p]), [e - s - p]])
            long = np.flatnonzero(np.diff(differ) > LENGTH)
            if len(long):
                found.setdefault(k, {})[p] = np.stack([differ[long] + 1, differ[long + 1]], axis=1) + s + p
    every = [x for of in found.values() for x in of.values()]
    return np.concatenate(every) if every else np.zeros((0, 2), np.int64)


def anchors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of texts end to end (text i is data[at[i] : at[i + 1]]): where anchors are."""
    again = np.zeros(len(data) + 1, np.int32)
    spans = periodic(data, at)
    np.add.at(again, spans[:, 0], 1)
    np.add.at(again, spans[:, 1] - LENGTH + 1, -1)
    again = np.cumsum(again)[:-1] > 0
    starts = at[1:] - LENGTH + 1
    for s, e in zip(np.maximum(at[:-1], starts), at[1:], strict=True):  # such strings would cross the text's end
        again[s:e] = True
    places = [np.zeros(0, np.int64)]
    for c in range(0, len(data) - LENGTH + 1, _CHUNK):  # strings that start from here on
        part = data[c : c + _CHUNK + LENGTH - 1]
        h, step, power = part.astype(np.uint64) + np.uint64(1), 1, _A
        while step < GRAM:
            h = h[:-step] * np.uint64(power) + h[step:]
            power, step = power * power & (2**64 - 1), step * 2
        h = _mix(h) | np.uint64(1)
        w = LENGTH - GRAM + 1
        low = _sliding(np.minimum, h, w)
        low[again[c : c + len(low)]] = 0
        edge = np.zeros(w - 1, np.uint64)
        best = _sliding(np.maximum, np.concatenate([edge, low, edge]), w)
        got = np.flatnonzero(best == h) + c
        if places[-1].size:
            got = got[got > places[-1][-1]]  # both chunks may have those at the seam
        if got.size:
            places.append(got)
    return np.concatenate(places)


def _sides(data: np.ndarray, at: np.ndarray, where: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the SIDE bytes from anchors on and of those that end with their grams, one after the other, and the number of the anchor of each."""
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(SIDE, np.uint8)]), SIDE)
    hashes, of = [], []
    for salt, start in enumerate((where, where - (SIDE - GRAM))):
        fits = np.flatnonzero((start >= at[d]) & (start + SIDE <= at[d + 1]))
        words = np.ascontiguousarray(window[start[fits]]).view("<u8")
        h = np.full(len(fits), salt, np.uint64)
        for j in range(SIDE // 8):
            h = _mix((h ^ words[:, j]) * np.uint64(_A))
        hashes.append(h)
        of.append(fits)
    return np.concatenate(hashes), np.concatenate(of)


def _sliding(of: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """of over each window of w values."""
    step = 1
    while step * 2 <= w:
        x = of(x[:-step], x[step:])
        step *= 2
    return of(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


_REC = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<u4")])
_OCC = np.dtype([("doc", "<i8"), ("pos", "<u4")])


def _pack(a: np.ndarray) -> bytes:
    import zstandard

    cols = b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names)
    return zstandard.ZstdCompressor(1).compress(cols)


def _unpack(b: bytes, kind: np.dtype) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    out, at = np.empty(len(raw) // kind.itemsize, kind), 0
    for f in kind.names:
        size = len(out) * kind[f].itemsize
        out[f] = np.frombuffer(raw, kind[f], len(out), at)
        at += size
    return out


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A row of bytes for each run of values that starts at one of the cuts."""
    ends = np.concatenate([cuts, [len(values)]]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _pieces(key: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys start and end."""
    at = _starts(key).tolist()
    return list(zip(at, [*at[1:], len(key)], strict=False))


def _arrow(rows: list[tuple], names: tuple[str, ...], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=list(names))


def _dealt(a: np.ndarray, to: np.ndarray) -> dict[int, bytes]:
    """a packed by where its records go."""
    order = np.argsort(to, kind="stable")
    a, to = a[order], to[order]
    return {int(to[s]): _pack(a[s:e]) for s, e in _pieces(to)}


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return (_mix(doc.astype(np.uint64) * np.uint64(_A)) % np.uint64(buckets)).astype(np.int64)


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, pos): the anchors of which the hash of one side more than one place has, a row a document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            rec = np.concatenate([np.zeros(0, _REC), *held])
            held.clear()
            rec = rec[np.argsort(rec["h"], kind="stable")]
            again = np.ones(len(rec), bool)
            again[_starts(rec["h"])] = False
            one = rec[~again]
            again[:-1] |= again[1:]  # several places here: known to repeat
            known = rec[again][["doc", "pos"]].astype(_OCC)
            recs, occ = _dealt(one, one["h"] % np.uint64(buckets)), _dealt(known, _home(known["doc"], buckets))
            return _arrow([(k, recs.get(k), occ.get(k)) for k in sorted({*recs, *occ})], ("bucket", "recs", "occ"), [pa.int64(), pa.binary(), pa.binary()])

        for b in batches:
            for part in slices(b, "text"):
                data, at = flat(part.column("text"))
                where = anchors(data, at)
                d = np.searchsorted(at, where, "right") - 1
                h, i = _sides(data, at, where, d)
                rec = np.empty(len(h), _REC)
                rec["h"], rec["doc"], rec["pos"] = h, part.column("doc_id").to_numpy()[d[i]], (where - at[d])[i]
                held.append(rec)
                if sum(map(len, held)) >= 4 * _BATCH:
                    yield send()
        yield send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs, occ = [np.zeros(0, _REC)], [np.zeros(0, _OCC)]
        for b in batches:
            recs += [_unpack(x.as_py(), _REC) for x in b.column("recs") if x.is_valid]
            occ += [_unpack(x.as_py(), _OCC) for x in b.column("occ") if x.is_valid]
        rec = np.concatenate(recs)
        recs.clear()
        rec = rec[np.argsort(rec["h"], kind="stable")]
        same = rec["h"][1:] == rec["h"][:-1]
        again = np.zeros(len(rec), bool)
        again[1:] |= same
        again[:-1] |= same
        all_ = np.concatenate([*occ, rec[again][["doc", "pos"]].astype(_OCC)])
        yield _arrow(sorted(_dealt(all_, _home(all_["doc"], buckets)).items()), ("bucket", "occ"), [pa.int64(), pa.binary()])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ = np.concatenate([np.zeros(0, _OCC), *[_unpack(x.as_py(), _OCC) for b in batches for x in b.column("occ")]])
        occ = occ[np.lexsort((occ["pos"], occ["doc"]))]
        occ = occ[_starts(occ["doc"], occ["pos"])]
        at = np.concatenate([_starts(occ["doc"]), [len(occ)]])
        for i in range(0, len(at) - 1, 4096):
            some = at[i : i + 4097]
            part = occ[some[0] : some[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(occ["doc"][some[:-1]]), _binary(np.ascontiguousarray(part["pos"]), some[:-1] - some[0])], names=["doc_id", "pos"])

    sent = docs.mapInArrow(scan, schema("bucket long, recs binary, occ binary")).repartitionById(buckets, F.col("bucket").cast("int"))
    return sent.mapInArrow(meet, schema("bucket long, occ binary")).repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(unpack, schema("doc_id long, pos binary"))


class LoserTree:
    """Merge sorted runs of fixed-width keys. Every suffix carries its common prefix with the last one put out; of two
    with unequal prefixes the longer is smaller, and with equal ones only the bytes beyond are looked at."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, tuple]]]):
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = [iter(r) for r in runs] + [iter(())] * (self.k - len(runs))
        self.head: list[tuple[bytes, tuple] | None] = []
        self.lcp = [0] * self.k
        for i, r in enumerate(self.runs):
            x = next(r, None)
            self.head.append(x and x[1:])
        self.tree = [0] * self.k
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The smaller of two stays on; the other stays at the node, with its common prefix with the smaller."""
        x, y = self.head[a], self.head[b]
        if y is None:
            self.tree[node] = b
            return a
        if x is None:
            self.tree[node] = a
            return b
        p, q = self.lcp[a], self.lcp[b]
        if p < q:
            self.tree[node] = a
            return b
        if p > q:
            self.tree[node] = b
            return a
        u, v = int.from_bytes(x[0][p:], "big"), int.from_bytes(y[0][p:], "big")
        size = len(x[0])
        same = size - ((u ^ v).bit_length() + 7) // 8
        if u < v or (u == v and a <= b):
            self.lcp[b], self.tree[node] = same, b
            return a
        self.lcp[a], self.tree[node] = same, a
        return b

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        while (x := self.head[self.winner]) is not None:
            w = self.winner
            yield self.lcp[w], *x
            nxt = next(self.runs[w], None)
            self.head[w] = nxt and nxt[1:]
            self.lcp[w] = nxt[0] if nxt else 0  # within the run: with the one just put out
            node = (w + self.k) // 2
            while node:
                w = self._play(node, w, self.tree[node])
                node //= 2
            self.winner = w


def encode_run(keys: np.ndarray, extra: np.ndarray) -> bytes:
    """Front-code sorted keys (rows of bytes): the common prefix with the key before, and the rest."""
    import zstandard

    lcp = _prefix(keys).astype(np.uint8)
    rest = keys[np.arange(WIDTH) >= lcp[:, None]]
    return zstandard.ZstdCompressor(3).compress(np.uint32(len(keys)).tobytes() + lcp.tobytes() + extra.tobytes() + rest.tobytes())


_EXTRA = np.dtype([("doc", "<i8"), ("t", "<i8"), ("pos", "<u4"), ("left", "u1"), ("right", "u1")])


def decode_run(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    lcp = np.frombuffer(raw, np.uint8, n, 4)
    extra = np.frombuffer(raw, _EXTRA, n, 4 + n)
    at, key = 4 + n + n * _EXTRA.itemsize, b""
    for p, e in zip(lcp.tolist(), extra.tolist(), strict=True):
        key = key[:p] + raw[at : at + WIDTH - p]
        at += WIDTH - p
        yield p, key, e


def _contexts(data: np.ndarray, a: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Rows of bytes: from the anchor on, then backwards from it, zeros beyond the text's ends."""
    window = np.lib.stride_tricks.sliding_window_view
    after = window(np.concatenate([data, np.zeros(LENGTH, np.uint8)]), LENGTH)
    before = window(np.concatenate([np.zeros(LEFT, np.uint8), data]), LEFT)  # row i: the LEFT bytes before data[i]
    keys = np.concatenate([after[a], before[a][:, ::-1]], axis=1)
    for side, size, full in ((keys[:, :LENGTH], extra["right"], LENGTH), (keys[:, LENGTH:], extra["left"], LEFT)):
        short = np.flatnonzero(size < full)
        side[short] = np.where(np.arange(full) < size[short, None], side[short], 0)
    return keys


def _runs(joined: DataFrame, splitters: np.ndarray) -> DataFrame:
    """(doc_id, t, text, pos) to front-coded runs by range, with the spans that this partition covers whole."""
    names, types = ("range", "run", "doc_id", "t", "spans"), [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def sort(keys: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((extra["pos"], extra["doc"], np.ascontiguousarray(keys).view(f"S{WIDTH}").ravel()))
        keys, extra = keys[order], extra[order]
        same = np.concatenate([[False], (keys[1:] == keys[:-1]).all(axis=1) & (extra["right"][1:] == extra["right"][:-1]) & (extra["left"][1:] == extra["left"][:-1]) & ((extra["doc"][1:] != extra["doc"][:-1]) | (extra["pos"][1:] != extra["pos"][:-1]))])
        # the first of equals is the earliest; the others are covered as far as their context goes
        rows = [(k % (len(splitters) + 1), None, *r) for k, r in enumerate(_spans(extra[same]))]
        keys, extra = keys[~same], extra[~same]
        to = np.searchsorted(splitters, np.ascontiguousarray(keys[:, :GRAM]).view(f"S{GRAM}").ravel(), "right")
        for s, e in _pieces(to):
            rows.append((int(to[s]), encode_run(keys[s:e], extra[s:e]), None, None, None))
        return _arrow(rows, names, types)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for part in slices(b, "text"):
                data, at = flat(part.column("text"))
                where = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in part.column("pos")]
                d = np.repeat(np.arange(len(where)), [len(x) for x in where])
                pos = np.concatenate([np.zeros(0, np.int64), *where])
                ok = at[d] + pos + GRAM <= at[d + 1]
                d, pos = d[ok], pos[ok]
                extra = np.empty(len(pos), _EXTRA)
                extra["doc"], extra["t"], extra["pos"] = part.column("doc_id").to_numpy()[d], part.column("t").to_numpy()[d], pos
                extra["right"], extra["left"] = np.minimum(LENGTH, at[d + 1] - at[d] - pos), np.minimum(LEFT, pos)
                for i in range(0, len(pos), _BATCH // 4):
                    some = slice(i, i + _BATCH // 4)
                    held.append((_contexts(data, (at[d] + pos)[some], extra[some]), extra[some]))
                    n += len(held[-1][0])
                    if n >= _BATCH:
                        yield sort(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]))
                        held, n = [], 0
        if n:
            yield sort(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]))

    return joined.mapInArrow(build, schema("range long, run binary, doc_id long, t long, spans binary"))


def _spans(extra: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """Rows of a document: doc, t, pairs of ends; by default all that stands around an anchor within reach."""
    pos = extra["pos"].astype(np.int64)
    low = pos - extra["left"] if low is None else low
    high = pos + extra["right"] if high is None else high
    ok = high - low >= LENGTH
    extra, pairs = extra[ok], np.stack([low[ok], high[ok]], axis=1).astype("<u4")
    order = np.lexsort((pairs[:, 0], extra["t"], extra["doc"]))
    extra, pairs = extra[order], pairs[order]
    cut = np.flatnonzero((extra["doc"][1:] != extra["doc"][:-1]) | (extra["t"][1:] != extra["t"][:-1])) + 1
    return [(int(e["doc"][0]), int(e["t"][0]), p.tobytes()) for e, p in zip(np.split(extra, cut), np.split(pairs, cut), strict=True) if len(e)]


def _prefix(keys: np.ndarray) -> np.ndarray:
    """Of rows of bytes the common prefix with the row before; 0 for the first."""
    differ = keys[1:] != keys[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])])


def _covered(keys: np.ndarray, extra: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Spans of sorted suffixes that share GRAM bytes with others: for each offset, all but the earliest of equal strings.

    Strings are equal if their bytes to the right of the anchor are one class of common prefixes, and those to the left another.
    """
    n = len(keys)
    before = np.ascontiguousarray(keys[:, LENGTH:])
    by_left = np.argsort(before.view(f"S{LEFT}").ravel(), kind="stable")
    right, left = _prefix(keys[:, :LENGTH]), _prefix(before[by_left])
    order = np.lexsort((extra["pos"], extra["doc"]))
    extra, place = extra[order], np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    doc, pos = extra["doc"], extra["pos"].astype(np.int64)
    for r in range(LEFT + 1):
        fits = np.flatnonzero((extra["left"] >= r) & (extra["right"] >= LENGTH - r))
        if not len(fits):
            continue
        kind = np.cumsum(left < r)[place] * (n + 1) + np.cumsum(right < LENGTH - r)
        _, first, kind = np.unique(kind[order[fits]], return_index=True, return_inverse=True)
        lead = fits[first[kind]]
        later = fits[(doc[fits] != doc[lead]) | (pos[fits] != pos[lead])]
        high[later] = np.where(high[later] < 0, pos[later] - r + LENGTH, high[later])
        low[later] = pos[later] - r
    hit = high >= 0
    return _spans(extra[hit], low[hit], high[hit])


def _merge(runs: DataFrame, ranges: int) -> DataFrame:
    """Runs by range to covered spans: (doc_id, t, spans), several rows a document."""
    names, types = ("doc_id", "t", "spans"), [pa.int64(), pa.int64(), pa.binary()]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for b in batches:
            yield b.filter(b.column("spans").is_valid()).select(list(names))
            blobs += [x.as_py() for x in b.column("run") if x.is_valid]
        held: list[tuple[bytes, tuple]] = []  # distinct suffixes of whole groups so far
        group: list[tuple[bytes, tuple]] = []
        whole: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                held.extend(group)
            group.clear()

        def flush() -> pa.RecordBatch:
            rows: list[tuple[int, int, bytes]] = []
            if held:
                keys = np.frombuffer(b"".join(k for k, _ in held), np.uint8).reshape(-1, WIDTH)
                rows += _covered(keys, np.array([e for _, e in held], _EXTRA))
                held.clear()
            if whole:
                rows += _spans(np.array(whole, _EXTRA))
                whole.clear()
            return _arrow(rows, names, types)

        for lcp, key, e in LoserTree([decode_run(b) for b in blobs]):
            if lcp < GRAM:
                close()
                if len(held) + len(whole) >= _BATCH:
                    yield flush()
            elif lcp == WIDTH and group and group[-1][1][3:] == e[3:]:
                last = group[-1][1]
                if (e[0], e[2]) < (last[0], last[2]):
                    group[-1], e = (key, e), last
                if (e[0], e[2]) != (group[-1][1][0], group[-1][1][2]):
                    whole.append(e)
                continue
            group.append((key, e))
        close()
        yield flush()

    return runs.repartitionById(ranges, F.col("range").cast("int")).mapInArrow(merge, schema("doc_id long, t long, spans binary"))


def _splitters(joined: DataFrame, ranges: int) -> np.ndarray:
    """Ends of ranges, from the anchors of some documents with repeated ones; they set the balance alone."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column("text"))
            some = [data[s + p : min(e, s + p + GRAM)].tobytes() for s, e, x in zip(at[:-1].tolist(), at[1:].tolist(), b.column("pos"), strict=True) for p in np.frombuffer(x.as_py(), "<u4")[::8].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["head"])

    rows = joined.select("text", "pos").mapInArrow(heads, schema("head binary")).distinct().collect()
    found = np.array(sorted(bytes(r.head) for r in rows) or [b"m"], f"S{GRAM}")
    return np.unique(found[(np.arange(1, ranges) * len(found)) // ranges])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, t, spans: list of packed pairs of byte offsets) for each document that holds repeated strings; t: xxhash64 of the text.

    Repeats within a text at a period of LEFT bytes or less are for `periodic` to find.
    """
    n = parts(docs.sparkSession)
    found = staged(repeated_anchors(docs, n), "repeated-anchors")
    few = found.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, found.count() // 4000))) == 0)
    splitters = _splitters(docs.join(F.broadcast(few), "doc_id"), n)  # about 4000 rows
    spans = _merge(_runs(docs.join(found, "doc_id"), splitters), n).groupBy("doc_id", "t").agg(F.collect_list("spans").alias("spans"))
    spans = staged(spans, "repeated-spans")
    discard(found)
    return spans


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Return per row doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    Texts are their UTF-8 bytes, null texts empty. Each byte in a LENGTH-byte string that starts earlier too goes (smaller doc_id, or the same
    document and an earlier start), judged on the input. Shorter texts keep everything. Rows with equal ids are one document:
    strings at the same offset of both aren't earlier than each other. Null ids come first. An empty table gives no rows.
    """
    d = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL))).withColumn("t", F.xxhash64("text"))
    spans = repeated_spans(d)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                data, at = flat(part.column("text"))
                pairs = [periodic(data, at)]
                for s, packed in zip(at[:-1].tolist(), part.column("spans").to_pylist(), strict=True):
                    if packed:
                        pairs.append(np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2).astype(np.int64) + s)
                p = np.concatenate(pairs)
                change = np.bincount(p[:, 0], minlength=len(data) + 1) - np.bincount(p[:, 1], minlength=len(data) + 1)
                out = np.cumsum(change)[:-1] > 0
                first = out.copy()
                first[1:] &= ~out[:-1]
                inner = at[1:-1][at[1:-1] < len(data)]
                first[inner] = out[inner]  # a run ends with its text
                gone, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (out, first))
                kept = _binary(data[~out], at[:-1] - gone[at[:-1]])
                keys = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == _NULL), pa.array(np.diff(at)), *[pa.array(np.diff(x[at])) for x in (gone, runs)], kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return d.join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def op5_lcp_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 100 bytes, ranked by its 128-bit digest.
OP5_SQL = r"""
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents
), d AS (
  SELECT doc_id, hex(data) AS x, octet_length(data) AS n FROM raw
), strings AS (
  SELECT doc_id, pos, md5_number(substr(x, 2 * pos + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(n - 99)) AS pos FROM d WHERE n >= 100)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth FROM strings
), later AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ranked WHERE nth > 1
), numbered AS (
  SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM later
), spans AS (
  SELECT doc_id, span, min(pos) AS s, max(pos) + 100 AS e FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(spans.e), 0), any_value(d.n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), counted AS (
  SELECT doc_id, sum(e - s) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
