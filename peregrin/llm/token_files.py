"""Operator 1, token ids as binary files: static range asymmetric numeral system (rANS).

Documents are sorted by id over range partitions, tokenised (pieces between the pre-tokeniser's cuts are
encoded once and remembered) and staged as blocks of plain ids. Counts of ids over all blocks, scaled to 2**20, are the
frequency table that all blocks share; a map over the staged blocks then encodes each.

A block holds whole documents, about BLOCK ids, and stands alone: LANES interleaved coders work on ids i % LANES, so that
numpy codes a whole step at once; every EVERY steps a checkpoint keeps all coder states, the place in the stream
and a checksum of the ids up to the next one, so that segments can be decoded apart; the block ends with a checksum
of itself. Blocks are rows (part, block, ids before it in the part, documents, payload) of Parquet files without
compression: Spark's commit protocol then makes retried and speculative tasks harmless on any store.

What reaches the driver: the table (a row an id of the vocabulary) and one total a partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, flat, fresh_path, parts, schema, slices, staged, texts, write

BITS, LOW, LANES, EVERY, BLOCK = 20, 1 << 31, 512, 128, 1 << 17
_MAGIC, _HEAD = b"PRANS\x00\x01\x00", struct.Struct("<8sQIIII")
_BLOCKS = "part int, block int, first long, n_tokens long, doc_ids binary, doc_lens binary, payload binary"


#: Of each byte: 0 white space, 1 letter (ASCII, or part of one from U+00C0 to U+017F), 2 digit, 3 any other; 4 where this can't tell.
_KIND = np.full(256, 4, np.uint8)
_KIND[:0x80] = 3
_KIND[[*range(0x1C, 0x20)]] = 4
_KIND[[*b" \t\n\x0b\x0c\r"]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1
_KIND[[*range(0x30, 0x3A)]] = 2


def cut_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokeniser cuts texts end to end, all of whose bytes _KIND tells (and that hold neither U+00D7 nor U+00F7).

    Its pieces are runs of letters, digits or others, with a space before them if there is one; white space but
    for the last before something else; and the endings that follow an apostrophe.
    """
    kind = _KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at] = True
    after = np.flatnonzero(new[1:-1] & (kind[1:] != 0) & (kind[:-1] == 0)) + 1  # something that follows white space ...
    after = after[~np.isin(after, at)]  # ... of its own text
    new[after - 1] = True
    new[after] = data[after - 1] != 0x20
    end = np.zeros(len(data) + 4, np.uint8)
    end[: len(data)] = data
    quote = np.flatnonzero((data == 0x27) & new[:-1] & new[1:])
    quote = quote[~np.isin(quote + 1, at)]
    x, y = end[quote + 1], end[quote + 2]
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two = (((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)) & ~np.isin(quote + 2, at)
    new[quote[one | two] + 1] = False
    new[quote[one] + 2] = True
    new[quote[two] + 3] = True
    return np.flatnonzero(new[:-1])


class Encoder:
    """Encodes texts with a tokenizers file whose pre-tokeniser is the byte-level one without prefix space.

    Texts are cut where that one cuts, and each distinct piece of a slice is encoded by the library once, and remembered if short:
    at most `most` pieces, of which those not met again since the last clearance are forgotten when there are too many.
    Texts with bytes that _KIND can't tell, or with an added token, are encoded whole.
    """

    LONG = 32

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True  # pieces that are encoded together can't make up an added token
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True  # how the vocabulary writes a space
        line = self._ids("\n")
        self.line = int(line[0]) if len(line) == 1 else None
        self.most = most
        self.words, self.lists, self.met = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32())), np.zeros(0, bool)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and the number of ids of each; pieces that a space starts cut themselves, others are set apart by line ends."""
        spaced = pieces[0][0] == " "
        ids = self._ids("".join(pieces) if spaced else "\n".join(pieces))
        if spaced:
            at = np.flatnonzero(self.leads[ids])
            size = np.diff(at, append=len(ids))
        else:
            at = np.concatenate([[-1], np.flatnonzero(ids == self.line)])
            size = np.diff(at, append=len(ids)) - 1
            ids = ids[ids != self.line]
        if len(size) != len(pieces):
            raise ValueError("this vocabulary doesn't cut before spaces and around line ends")
        return ids, size

    def _new(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, in their order."""
        first, size = pc.utf8_slice_codeunits(pieces, 0, 1), pc.utf8_length(pieces).to_numpy()
        white = pc.match_substring_regex(pieces, r"^[ \t\n\v\f\r]+$").to_numpy(zero_copy_only=False)
        spaced = pc.equal(first, " ").to_numpy(zero_copy_only=False) & ~white & (size > 1)
        n, got, where = np.zeros(len(pieces), np.int64), [], []
        for kind in (spaced, ~spaced & ~white):
            if self.line is None:
                continue
            at = np.flatnonzero(kind)
            for i in range(0, len(at), 4096):
                ids, n[at[i : i + 4096]] = self._together(pieces.take(pa.array(at[i : i + 4096])).to_pylist())
                got.append(ids)
            where.append(at)
        alone = np.flatnonzero(white) if self.line is not None else np.arange(len(pieces))
        for e in self.bare.encode_batch_fast(pieces.take(pa.array(alone)).to_pylist(), add_special_tokens=False):
            got.append(np.asarray(e.ids, np.uint32))
        n[alone] = [len(g) for g in got[len(got) - len(alone) :]] if len(alone) else []
        where.append(alone)
        order = np.concatenate(where).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[order])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint32), *got])))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return lists.take(pa.array(back))

    def _known(self, kinds: pa.Array) -> pa.Array:
        """Ids of distinct pieces."""
        at = pc.index_in(kinds, value_set=self.words)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        self.met[at.drop_null().to_numpy()] = True
        pieces = kinds.filter(pa.array(new))
        ids = self._new(pieces)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[new] = len(self.words) + np.arange(len(pieces))
        out = pa.concat_arrays([self.lists, ids]).take(pa.array(place))
        short = pa.array(pc.binary_length(pieces).to_numpy() <= self.LONG)
        if len(self.words) + len(pieces) > self.most:
            stay = pa.array(self.met)
            self.words, self.lists = self.words.filter(stay), self.lists.filter(stay)
            self.met = np.zeros(len(self.words), bool)
            if len(self.words) > self.most // 2:
                self.words, self.lists, self.met = self.words[:0], self.lists[:0], self.met[:0]
        self.words, self.lists = pa.concat_arrays([self.words, pieces.filter(short)]), pa.concat_arrays([self.lists, ids.filter(short)])
        self.met = np.concatenate([self.met, np.zeros(len(self.words) - len(self.met), bool)])
        return out

    def _cut(self, col: pa.Array) -> list[np.ndarray]:
        data, at = flat(col)
        starts = cut_words(data, at)
        ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int32).tobytes())
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        lists = self._known(coded.dictionary).take(coded.indices)
        return np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[np.searchsorted(starts, at[1:-1])])

    def __call__(self, col: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column without nulls."""
        if not len(col):
            return []
        col = col.cast(pa.string())
        data, at = flat(col)
        odd = np.flatnonzero(_KIND[data] == 4)
        odd = np.concatenate([odd, np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))])
        whole = np.zeros(len(col), bool)
        whole[np.searchsorted(at, odd, "right") - 1] = True
        for t in self.added:
            whole |= pc.match_substring(col, t).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(col)
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.asarray(self.tok.encode(col[i].as_py(), add_special_tokens=False).ids, np.uint32)
        plain = np.flatnonzero(~whole)
        if len(plain):
            for i, ids in zip(plain.tolist(), self._cut(col.take(pa.array(plain)) if len(plain) < len(col) else col), strict=True):
                out[i] = ids
        return out


_LEARNED: dict[str, Encoder] = {}


def learned(path: str) -> Encoder:
    """The worker process's own encoder: it keeps what it has learned for the tasks to come."""
    if path not in _LEARNED:
        _LEARNED[path] = Encoder(path)
    return _LEARNED[path]


def scaled(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their frequencies: 1 at least each, 2**BITS in all."""
    ids = np.array(sorted(counts), np.uint32)
    n = np.array([counts[int(i)] for i in ids], np.float64)
    if len(ids) > 1 << BITS:
        raise ValueError("more ids than the table has room for")
    if not len(ids):
        return ids, np.zeros(0, np.uint64)
    f = np.maximum(1, np.floor(n / n.sum() * (1 << BITS))).astype(np.int64)
    while (over := int(f.sum()) - (1 << BITS)) > 0:
        big = np.argsort(-f, kind="stable")[: max(1, min(over, int((f > 1).sum())))]
        f[big] -= np.minimum(f[big] - 1, max(1, over // len(big)))
    f[np.argmax(f)] += (1 << BITS) - int(f.sum())
    return ids, f.astype(np.uint64)


class Table:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids, freq
        self.start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(freq)[:-1]]) if len(freq) else freq
        self.place = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
        self.place[ids] = np.arange(len(ids))
        self.slot = np.repeat(np.arange(len(ids), dtype=np.int32), freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    at = table.place[ids]
    freq, start = table.freq[at], table.start[at]
    steps = -(-len(ids) // LANES)
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    checks: list[tuple[int, int, bytes]] = []
    n_words = 0
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * LANES : (s + 1) * LANES], start[s * LANES : (s + 1) * LANES]
        y = x[: len(f)]
        full = y >= f << np.uint64(63 - BITS)
        if full.any():
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            n_words += len(words[-1])
            y[full] >>= np.uint64(32)
        q, r = np.divmod(y, f)
        x[: len(f)] = (q << np.uint64(BITS)) + r + c
        if s % EVERY == 0:
            checks.append((n_words, zlib.crc32(ids[s * LANES : (s + EVERY) * LANES].astype("<u4").tobytes()), x.astype("<u8").tobytes()))
    out = [_HEAD.pack(_MAGIC, len(ids), LANES, EVERY, len(checks), n_words)]
    out += [struct.pack("<II", n_words - n, crc) + states for n, crc, states in reversed(checks)]
    out += [w.tobytes() for w in reversed(words)]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(payload: bytes, table: Table, segments: range | None = None) -> np.ndarray:
    """The ids of a block, or of some of its segments only; ValueError if a checksum is wrong."""
    magic, n, lanes, every, n_checks, n_words = _HEAD.unpack_from(payload)
    if magic != _MAGIC or struct.unpack("<I", payload[-4:])[0] != zlib.crc32(payload[:-4]):
        raise ValueError("damaged block")
    size = 8 + 8 * lanes
    words = np.frombuffer(payload, "<u4", n_words, _HEAD.size + n_checks * size).astype(np.uint64)
    segments = range(n_checks) if segments is None else segments
    got = []
    for k in segments:
        at, crc = struct.unpack_from("<II", payload, _HEAD.size + k * size)
        x = np.frombuffer(payload, "<u8", lanes, _HEAD.size + k * size + 8).astype(np.uint64)
        out = np.empty(min(n - k * every * lanes, every * lanes), np.int32)
        for s in range(0, len(out), lanes):
            m = min(lanes, len(out) - s)
            y = x[:m]
            low = y & np.uint64((1 << BITS) - 1)
            sym = table.slot[low.astype(np.int64)]
            out[s : s + m] = sym
            y = table.freq[sym] * (y >> np.uint64(BITS)) + low - table.start[sym]
            need = y < np.uint64(LOW)
            took = int(need.sum())
            y[need] = (y[need] << np.uint64(32)) | words[at : at + took]
            at += took
            x[:m] = y
        ids = table.ids[out]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("damaged segment")
        got.append(ids)
    return np.concatenate(got) if got else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Write path/table and path/blocks: the ids of every whole text, end_id after each, in ascending doc_id order.

    A null text counts as empty and has the end id alone; null ids come first; rows with equal ids are ordered by
    text, equal rows stay twice. An empty table makes an empty table and no blocks.
    """
    spark = docs.sparkSession

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), learned(vocabulary)
        block = first = n = 0
        held: list[np.ndarray] = []
        keys: list[int] = []
        lens: list[int] = []
        for b in batches:
            for some in slices(b, "text"):
                for key, got in zip(some.column("doc_id").to_pylist(), enc(some.column("text")), strict=True):
                    held += [got, end]
                    keys.append(_NULL if key is None else key)
                    lens.append(len(got) + 1)
                    n += len(got) + 1
                    if n >= BLOCK:
                        yield _row(part, block, first, n, np.array(keys, "<i8").tobytes(), np.array(lens, "<i8").tobytes(), np.concatenate(held).astype(kind).tobytes())
                        block, first, n = block + 1, first + n, 0
                        held, keys, lens = [], [], []
        if keys:
            yield _row(part, block, first, n, np.array(keys, "<i8").tobytes(), np.array(lens, "<i8").tobytes(), np.concatenate(held).astype(kind).tobytes())

    end = np.array([end_id], np.uint32)
    kind = "<u2" if max(len(Encoder(vocabulary).leads), end_id + 1) <= 1 << 16 else "<u4"
    ordered = texts(docs).repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    raw = staged(ordered.mapInArrow(tokenise, schema(_BLOCKS)), "raw-tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("payload"):
                got = np.bincount(np.frombuffer(x.as_py(), kind), minlength=len(n))
                got[: len(n)] += n
                n = got
        seen = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["id", "n"])

    counts = raw.select("payload").mapInArrow(count, schema("id long, n long")).groupBy("id").agg(F.sum("n").alias("n"))
    ids, freq = scaled({r.id: r.n for r in counts.collect()})  # a row an id of the vocabulary
    spark.createDataFrame([(ids.tolist(), freq.astype(np.int64).tolist())], "ids array<long>, freq array<long>").coalesce(1).write.parquet(f"{path}/table")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(ids, freq)
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(c)[i].as_py() for c in _NAMES]
                yield _row(*row[:-1], encode_block(np.frombuffer(row[-1], kind).astype(np.uint32), table))

    write(raw.mapInArrow(encode, schema(_BLOCKS)), f"{path}/blocks", "none")
    discard(raw)


_NULL = -(2**63)
_NAMES = ("part", "block", "first", "n_tokens", "doc_ids", "doc_lens", "payload")


def _row(*values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_NAMES, values, strict=True))], schema=_arrow())


def _arrow() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_lens", pa.binary()), ("payload", pa.binary())])


_Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _decoding(spark: SparkSession, path: str) -> tuple[DataFrame, _Batches]:
    """The blocks, and what decodes them."""
    t = spark.read.parquet(f"{path}/table").first()
    ids, freq = np.array(t.ids, np.uint32), np.array(t.freq, np.uint64)
    blocks = spark.read.schema(schema(_BLOCKS)).parquet(f"{path}/blocks")
    offsets, so_far = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # a row a partition
        offsets[r.part], so_far = so_far, so_far + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(ids, freq)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                got = decode_block(row["payload"], table).astype(np.int32)
                keys, lens = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_lens"], "<i8")
                ends = np.cumsum(lens)
                key = pa.array(keys, mask=keys == _NULL)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(got))
                yield pa.RecordBatch.from_arrays([key, pa.array(offsets[row["part"]] + row["first"] + ends - lens), pa.array(lens), lists], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks, decode


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start (ids before it), n_tokens, ids (array<int>). Blocks are decoded apart.

    Null ids come back null, documents without text have the end id alone, and files of an empty table give no rows.
    """
    blocks, decode = _decoding(spark, path)
    return blocks.mapInArrow(decode, schema("doc_id long, start long, n_tokens long, ids array<int>"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_token_files, but ids_crc32 instead of the ids: that of them as little-endian unsigned 32-bit integers, in the worker that decodes them."""
    blocks, decode = _decoding(spark, path)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decode(batches):
            at, flat_ids = b.column("ids").offsets.to_numpy(), b.column("ids").values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(flat_ids[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(crc, schema("doc_id long, start long, n_tokens long, ids_crc32 long"))


def op1_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
