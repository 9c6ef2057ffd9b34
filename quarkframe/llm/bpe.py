"""Byte-level BPE encoding and decoding through a sentencepiece model.

``serialise`` writes a sentencepiece BPE model directly from a rank file: one
piece per rank (its bytes mapped to printable code points), scored by the
negative rank, so sentencepiece merges the lowest rank first and leftmost
first among equals, as byte-level BPE does; normalisation is the identity, no
dummy prefix, no whitespace handling. A text is split into pre-tokens by the
vocabulary's pattern and each pre-token is encoded on its own; one that is a
vocabulary entry as a whole is that entry. Decoding maps ids back to their
bytes and concatenates.

Style: Arrow batches in ``mapInArrow``. The model (about 1 MB, bounded by the
vocabulary file) travels with the task closure; each Python worker builds its
processor once. Encoded pre-tokens are remembered per worker in a dictionary
of bounded size. There is no shuffle; a lost executor re-runs its splits.

Edge cases: a null text counts as empty (no ids, decoded to nothing); any
code point, very long texts and very long pre-tokens are encoded whole;
repeated rows give repeated rows; an empty table gives an empty result;
input columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

CACHE_SIZE = 300_000     # pre-tokens remembered per worker
CHUNK = 2_000_000        # characters encoded at a time
UNK = "￿<unk>"      # a piece no byte-mapped text can contain


def byte_to_char() -> list[str]:
    """Code point of each byte: printable Latin-1 bytes stand for themselves,
    the others are numbered from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; one more, last,
    is the unknown piece that a model must have."""
    char = byte_to_char()
    piece = lambda s, score, kind: _field(1, _field(1, s.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind))
    out = [piece("".join(char[b] for b in e), -float(rank), 1) for rank, e in enumerate(entries)]
    out.append(piece(UNK, 0.0, 2))
    bpe, no = 2, 0
    trainer = _field(3, bpe) + _field(4, len(entries) + 1) + _field(40, len(entries)) + _field(41, (1 << 64) - 1) \
        + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1) + _field(45, UNK.encode())
    normaliser = _field(1, b"identity") + _field(3, no) + _field(4, no) + _field(5, no)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one rank file's entries."""

    def __init__(self, entries: list[bytes], model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.entries = entries
        self.split = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = {b: c for b, c in enumerate(byte_to_char())}
        self.whole = {e: [rank] for rank, e in enumerate(entries)}
        self.known: dict[str, list[int]] = {}

    def _learn(self, tokens: list[str]) -> None:
        hard = []
        for t in tokens:
            ids = self.whole.get(t.encode())
            if ids is not None:
                self.known[t] = ids
            else:
                hard.append(t)
        mapped = [t.encode().decode("latin-1").translate(self.table) for t in hard]
        for t, ids in zip(hard, self.processor.encode(mapped, num_threads=1)):
            self.known[t] = ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text. Texts are taken ``CHUNK`` characters at a time, so
        that sentencepiece is called once for all their new pre-tokens."""
        held, size = [], 0
        for text in texts:
            held.append(self.split(text))
            size += len(text)
            if size >= CHUNK:
                yield from self._encode_split(held)
                held, size = [], 0
        yield from self._encode_split(held)

    def _encode_split(self, split: list[list[str]]) -> Iterator[list[int]]:
        known = self.known
        distinct = set().union(*split)
        new = [t for t in distinct if t not in known]
        if new:
            if len(known) + len(new) > CACHE_SIZE:
                known.clear()
                new = [*distinct]
            self._learn(new)
        for tokens in split:
            yield list(chain.from_iterable(map(known.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        entries = self.entries
        return b"".join([entries[i] for i in ids])


def codec_broadcast(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The vocabulary, its sentencepiece model and the pattern. The size is
    bounded by the vocabulary file, which is read once, on the driver."""
    entries = read_ranks(path)
    return spark.sparkContext.broadcast((entries, serialise(entries), pattern))


_CODECS: dict[tuple[str, str], Codec] = {}   # the worker's codec, by vocabulary and pattern


def _codec(shared: Broadcast) -> Codec:
    entries, model, pattern = shared.value
    key = (hashlib.sha256(model).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(entries, model, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) of every text."""
    schema = "doc_id bigint, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = [*codec.encode_all(t or "" for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([codec.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest_documents(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 of every text, without moving ids or bytes
    out of the Python worker."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            n, a, b = [], [], []
            for ids in codec.encode_all(t or "" for t in batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
