"""Operator 10, SentencePiece encoding and decoding: offset-preserving.

Texts are normalised as the model's own specification says, by longest prefixes of its compiled character map (a
double-array trie), and each normalised byte records the source byte it came from. The library then segments
the normalised text through a copy of the model whose normaliser does nothing, so pieces are its own; piece ends are
projected through the record to byte spans of the original text.

Where no piece of the vocabulary has white space after something else, merges can't cross from a word into the white space
that follows, and scores decide within each word alone: words are then segmented once and remembered (bounded).
Rows are independent: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema, texts

SPACE = "▁"
_ENCODED = "doc_id long, ids array<int>, ends array<int>"


class CharsMap:
    """The compiled character map: longest prefix of bytes to its replacement."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self.strings = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, source bytes it covers); covers 0 if no prefix is in the map."""
        if not self.units:
            return b"", 0
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, best = offset(self.units[0]), (b"", 0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or (u := self.units[node]) & 0x800000FF != data[i]:
                break
            node ^= offset(u)
            if u >> 8 & 1:
                s = self.units[node] & 0x7FFFFFFF
                best = (self.strings[s : self.strings.index(b"\0", s)], i + 1 - at)
        return best


class Encoder:
    def __init__(self, path: str, most: int = 300_000):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.spec, self.suffix = type(m.normalizer_spec)(), m.trainer_spec.treat_whitespace_as_suffix
        self.spec.CopyFrom(m.normalizer_spec)
        kind = {p.type for p in m.pieces}
        if 4 in kind or not m.trainer_spec.byte_fallback:
            raise ValueError("models with user-defined pieces or without byte fallback aren't supported")
        self.map = CharsMap(m.normalizer_spec.precompiled_charsmap)
        self.lens = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in m.pieces], np.int64)
        self.spaces = np.array([0 if p.type == 6 else p.piece.count(SPACE) for p in m.pieces], np.int64)
        self.by_word = not any(SPACE in p.piece.lstrip(SPACE) for p in m.pieces if p.type != 6)
        s = self.spec
        self.plain = not s.precompiled_charsmap and s.add_dummy_prefix and s.escape_whitespaces and not s.remove_extra_whitespaces and not self.suffix and self.by_word
        m.normalizer_spec.Clear()
        m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", False
        m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = False
        self.raw = SentencePieceProcessor(model_proto=m.SerializeToString())
        self.most, self.memo = most, {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and the end) the source byte it came from."""
        data, s = text.encode(), self.spec
        space = SPACE.encode() if s.escape_whitespaces else b" "
        out, src, at = bytearray(), [], 0

        def step(i: int) -> tuple[bytes, int]:
            to, n = self.map.longest(data, i)
            if n:
                return to, n
            b = data[i]
            n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return data[i : i + n], n

        if s.remove_extra_whitespaces:
            while at < len(data) and (p := step(at))[0] == b" ":
                at += p[1]
        if at >= len(data):
            return "", np.zeros(1, np.int64)
        if s.add_dummy_prefix and not self.suffix:
            out += space
            src += [at] * len(space)
        was_space = s.remove_extra_whitespaces
        while at < len(data):
            to, n = step(at)
            while was_space and to.startswith(b" "):
                to = to[1:]
            if to:
                for ch in to:
                    add = space if ch == 0x20 else bytes([ch])
                    out += add
                    src += [at] * len(add)
                was_space = s.remove_extra_whitespaces and to.endswith(b" ")
            at += n
        end = len(data)
        if s.remove_extra_whitespaces:
            while out.endswith(space):
                end = src[-len(space)]
                del out[-len(space) :], src[-len(space) :]
        if s.add_dummy_prefix and self.suffix:
            out += space
            src += [end] * len(space)
        return out.decode(), np.array([*src, end], np.int64)

    def _units(self, units: list[list[str]]) -> None:
        new = set().union(*units) - self.memo.keys()
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = set().union(*units)
        new = list(new)
        for u, ids in zip(new, self.raw.encode(new, num_threads=1), strict=True):
            self.memo[u] = np.asarray(ids, "<i4").tobytes()

    def __call__(self, batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and for each piece the source byte where it ends (pieces start where the last ended)."""
        for i in range(0, len(batch), 64):
            units, src = [], []
            for t in batch[i : i + 64]:
                if self.plain and t and SPACE not in t and "  " not in t and t[0] != " " and t[-1] != " ":
                    units.append([SPACE + w for w in t.split(" ")])
                    src.append(None)
                else:
                    norm, from_ = self.normalise(t)
                    units.append(re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", norm) if self.by_word else [norm] if norm else [])
                    src.append(from_)
            self._units(units)
            for u, from_ in zip(units, src, strict=True):
                ids = np.frombuffer(b"".join(map(self.memo.__getitem__, u)), "<i4")
                if from_ is None:  # each white space is one source byte, but for the one put in front
                    ends = np.cumsum(self.lens[ids] - 2 * self.spaces[ids]) - 1
                else:
                    ends = from_[np.cumsum(self.lens[ids])]
                yield ids, ends


_LEARNED: dict[str, Encoder] = {}


def learned(path: str) -> Encoder:
    """The worker process's own encoder: it keeps the words it has met for the tasks to come."""
    if path not in _LEARNED:
        _LEARNED[path] = Encoder(path)
    return _LEARNED[path]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


def _encoding(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = learned(model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = list(enc(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists([g[0] for g in got]), _lists([g[1] for g in got])], names=["doc_id", "ids", "ends"])

    return run


def _decoding(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                at, flat = part.column("ids").offsets.to_numpy(), part.column("ids").values.to_numpy()
                text = [sp.decode(flat[s:e].tolist()) if e > s else "" for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "ids", "ends")), pa.array(text, pa.string())], names=["doc_id", "ids", "ends", "decoded"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per row doc_id, ids and ends (the byte of the text's UTF-8 where each piece ends).

    Every whole text, as the library encodes it. A null or empty text has no pieces. Repeated rows stay; an empty
    table gives no rows.
    """
    return texts(docs).mapInArrow(_encoding(model), schema(_ENCODED))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded plus decoded: what the library's decode makes of the ids."""
    return encoded.mapInArrow(_decoding(model), schema(_ENCODED + ", decoded string"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """decode(encode(docs)) in one worker a task."""
    encoding, decoding = _encoding(model), _decoding(model)
    return texts(docs).mapInArrow(lambda batches: decoding(encoding(batches)), schema(_ENCODED + ", decoded string"))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256, decoded_sha256, covered (source bytes that pieces cover)."""
    d = round_trip(docs, model)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.element_at("ends", -1), F.lit(0)).cast("long").alias("covered"))


def op10_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
