"""Byte-level BPE encoding and decoding with a sentencepiece model written from a rank file.

A rank file lists byte strings with their merge ranks. Every byte is mapped to one printable
character, so each byte string becomes a piece of text; the piece's score is its negative rank,
which makes sentencepiece's best-score-first merging the same as lowest-rank-first merging. The
normaliser is the identity. A text is cut into pre-tokens by a pattern, each pre-token is mapped
to characters and encoded on its own; decoding maps ids to pieces and characters back to bytes.

Cases: a null or empty text has no ids and decodes to no bytes; very long texts are encoded whole, a few at a
time, and very long pre-tokens aren't remembered; rows that repeat give equal ids; of merges of equal rank
there are none; a column named like the output is replaced, others are kept; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytekit import release
from lodestone.llm.store import small_batches

#: Pre-tokens of up to this many characters are remembered, and so many of them during a task.
REMEMBER_CHARS, REMEMBER = 48, 150_000

_CODECS: dict[str, "Codec"] = {}


def byte_characters() -> list[str]:
    """One character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """A sentencepiece model for the ranks, and the rank of each of its piece ids (-1: no rank)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    chars, model = byte_characters(), pb.ModelProto()
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    order = sorted(ranks.items(), key=lambda x: x[1])
    for token, rank in order:
        p = model.pieces.add()
        p.piece, p.score, p.type = "".join(chars[b] for b in token), -float(rank), pb.ModelProto.SentencePiece.NORMAL
    t = model.trainer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(order) + 1, 0, -1, -1, -1
    n = model.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString(), np.array([-1, *(r for _, r in order)], np.int64)


class Codec:
    """Encoder and decoder around one serialised model."""

    def __init__(self, model: bytes, rank_of_id: np.ndarray, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.ranks = rank_of_id.tolist()
        inverse = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of: dict[int, bytes] = {}
        self.whole: dict[str, bytes] = {}
        for k in range(1, self.sp.get_piece_size()):
            piece, rank = self.sp.id_to_piece(k), self.ranks[k]
            self.bytes_of[rank] = bytes(inverse[c] for c in piece)
            self.whole[piece] = np.array([rank], "<u4").tobytes()
        self.to_chars = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}

    def mapped(self, token: str) -> str:
        """The token's bytes as characters."""
        return token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)

    def learn(self, tokens: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, as little-endian unsigned 32-bit integers."""
        names = [self.mapped(t) for t in tokens]
        out = {t: self.whole[m] for t, m in zip(tokens, names) if m in self.whole}
        rest = [(t, m) for t, m in zip(tokens, names) if m not in self.whole]
        if rest:
            ranks = self.ranks
            for (t, _), ids in zip(rest, self.sp.encode([m for _, m in rest], out_type=int, num_threads=1)):
                out[t] = np.array([ranks[k] for k in ids], "<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; pre-tokens met before are looked up, the others encoded in one call."""
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        fresh = {t for t in set(chain.from_iterable(cut)) if t not in known}
        if fresh:
            if len(known) + len(fresh) > REMEMBER:
                known.clear()
                fresh = set(chain.from_iterable(cut))
            learnt = self.learn(sorted(fresh))
            known.update(learnt)
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for t in fresh:
            if len(t) > REMEMBER_CHARS:
                del known[t]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; an id without a piece is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def codec(model: bytes, rank_of_id: np.ndarray, pattern: str) -> Codec:
    """The worker's codec for this model; built once."""
    key = hashlib.sha1(model + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, rank_of_id, pattern)
    return _CODECS[key]


def _with_column(schema: T.StructType, *more: T.StructField) -> T.StructType:
    names = {f.name for f in more}
    return T.StructType([*(f for f in schema.fields if f.name not in names), *more])


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids", batch_chars: int = 2_000_000) -> DataFrame:
    """docs with a column `out`: the ids of the whole text as array<int>. A column of that name is replaced."""
    model, ranks = serialise_model(read_ranks(vocabulary))
    schema = _with_column(docs.schema, T.StructField(out, T.ArrayType(T.IntegerType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, ranks, pattern)
        for b in batches:
            for part in _parts(b, text, batch_chars):
                rows = c.encode_batch(part.column(text).to_pylist())
                flat = np.frombuffer(b"".join(rows), "<i4")
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield _replaced(part, out, ids)
        c.known.clear()  # the worker outlives the task
        release()

    return small_batches(docs).mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column `out`: the bytes that the ids stand for (null ids: null)."""
    model, ranks = serialise_model(read_ranks(vocabulary))
    schema = _with_column(docs.schema, T.StructField(out, T.BinaryType(), True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, ranks, pattern)
        for b in batches:
            rows = [None if x is None else c.decode(np.array(x, np.int64)) for x in b.column(ids).to_pylist()]
            yield _replaced(b, out, pa.array(rows, pa.binary()))

    return small_batches(docs).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """docs without `text`, with n_tokens, ids_sha256 and decoded_sha256 of a round trip of the whole text."""
    model, ranks = serialise_model(read_ranks(vocabulary))
    keep = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, ranks, pattern)
        for b in batches:
            for part in _parts(b, text, batch_chars):
                rows = c.encode_batch(part.column(text).to_pylist())
                back = (c.decode(np.frombuffer(r, "<u4")) for r in rows)
                columns = [part.column(f.name) for f in keep]
                columns += [pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        c.known.clear()  # the worker outlives the task
        release()

    return small_batches(docs).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text each."""
    from lodestone.llm.bytekit import pieces, raw

    _, offsets = raw(batch.column(text))
    for a, b in pieces(offsets, most):
        yield batch.slice(a, b - a)


def _replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])


def digest_query(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_digests(docs.select(F.col("doc_id"), F.col("text")), vocabulary, pattern)
