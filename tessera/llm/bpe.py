"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each vocabulary entry becomes a piece: its bytes mapped to one printable character each, scored by the negative
rank, so that sentencepiece's best-score-first merging is merging by rank. Normalisation is the identity. A text is
cut by the pre-token pattern, each distinct pre-token is encoded once a worker (the cache is emptied beyond
CACHE_CHARS, which changes nothing but time), and ids are rank for rank those of the file.

Defined cases: null and empty texts give no ids and decode to nothing; special tokens are ordinary text; texts are
encoded whole, whatever their length; repeated rows give equal rows; an unknown id raises when decoded; `encode`, `decode` and `round_trip` add
their columns to whatever columns there are, replacing those of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shipping import ship
from tessera.llm.common import tidy

CACHE_CHARS = 10_000_000
#: Rows that go back to Spark at once.
SLICE = 128


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not dense")
    return [t for _, t in pairs]


def byte_chars() -> list[str]:
    """One printable character for each byte; none is a space, a control or sentencepiece's own mark."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (piece 1, score 2, type 3), trainer (model type 3 = BPE), normaliser."""
    chars = byte_chars()
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, "⁇unknown⁇".encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.map = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self.cache: dict[str, bytes] = {}
        self.chars = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text, one after the other; what the texts have anew is encoded in one call."""
        parts = [self.cut(t) for t in texts]
        if self.chars > CACHE_CHARS:
            self.cache.clear()
            self.chars = 0
        new = list(set().union(*parts).difference(self.cache))
        if new:
            self.chars += sum(map(len, new)) + 32 * len(new)
            mapped = [p.encode().decode("latin-1").translate(self.map) for p in new]
            got = self.sp.encode(mapped, num_threads=1)
            self.cache.update(zip(new, (struct.pack(f"<{len(x)}i", *x) for x in got), strict=True))
        return [b"".join(map(self.cache.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def encoder(model: bytes, pattern: str) -> Encoder:
    return Encoder(model, pattern)


def _lists(blobs: list[bytes]) -> pa.ListArray:
    """int32 lists of their bytes."""
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(blobs))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>)."""
    ship(docs.sparkSession)
    model = model_bytes(read_ranks(path))
    kept = [c for c in docs.columns if c != into]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(into, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                blobs = enc.ids([t.as_py() or "" for t in part.column(text)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], _lists(blobs)], names=[*kept, into])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(tidy(run), schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for (binary)."""
    ship(docs.sparkSession)
    tokens = read_ranks(path)
    kept = [c for c in docs.columns if c != into]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                blobs = [b"".join(map(tokens.__getitem__, x.values.to_pylist())) if x.is_valid else b"" for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(blobs, pa.binary())], names=[*kept, into])

    return docs.mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the token ids of the text and the bytes that these ids stand for, in one pass; columns of these names are replaced."""
    ship(docs.sparkSession)
    tokens = read_ranks(path)
    model = model_bytes(tokens)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                blobs = enc.ids([t.as_py() or "" for t in part.column(text)])
                back = [b"".join(map(tokens.__getitem__, np.frombuffer(b, np.int32).tolist())) for b in blobs]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], _lists(blobs), pa.array(back, pa.binary())], names=[*kept, ids, decoded])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(tidy(run), schema)


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )


def checked(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids, n_tokens and decodes (whether the ids decode to the text's bytes), without the text."""
    both = round_trip(docs, path, pattern, text)
    same = F.col("decoded") == F.coalesce(F.col(text), F.lit("")).cast("binary")
    return both.select(*[c for c in docs.columns if c != text], "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))
