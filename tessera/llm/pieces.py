"""Offset-preserving SentencePiece encoding and decoding.

The model file is read directly: its normaliser (compiled character map and
flags) and its pieces.  Normalisation walks the text with the longest matching
prefix in the character map's double array and records, for every normalised
byte, the original byte span it came from; each piece is then projected to its
span of original bytes.  Where the map is empty and white space is kept, the
same result is computed without the walk.

Segmentation is the library's own.  Where no piece joins a character to a
following white-space mark, no merge crosses that place, so a long text is cut
before runs of marks and encoded cut by cut, with the same ids.  Models for
which this does not hold are given whole texts.

Defined cases: a null text is an empty one and gets no piece; any other text is
encoded whole, however long; repeated rows are encoded each; an empty table
gives an empty result; the input's further columns are kept by
``encode_documents`` unless an output has the same name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import empty_text

MARK = "▁"
MARK_UTF8 = MARK.encode()
#: Characters from which a cut is sought; the library's queue is quicker on short texts.
CUT_CHARS = 1500


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass
class NormalizerSpec:
    """Field numbers of the public model format: character map 2, dummy prefix 3, extra white space 4, escaping 5."""

    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True


def read_model(path: str) -> tuple[NormalizerSpec, list[tuple[str, int]]]:
    """The normaliser (message 3) and the pieces (message 1) of a model file."""
    spec, pieces = NormalizerSpec(), []
    with open(path, "rb") as file:
        data = file.read()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), piece.get(3, 1)))
        elif number == 3:
            for k, x in _fields(value):
                if k == 2:
                    spec.charsmap = x
                elif k in (3, 4, 5):
                    setattr(spec, {3: "dummy_prefix", 4: "strip_spaces", 5: "escape_spaces"}[k], bool(x))
    return spec, pieces


class CharsMap:
    """The compiled character map: a double array over UTF-8 and its replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that ``data`` has at ``at``."""
        units = self.units
        if not units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & (1 << 9)) >> 6)

        found, node = None, offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]


class Normalizer:
    """Normalised UTF-8 of a text, with the original byte span of each byte."""

    def __init__(self, spec: NormalizerSpec):
        self.spec, self.map = spec, CharsMap(spec.charsmap)
        self.space = MARK_UTF8 if spec.escape_spaces else b" "

    def run(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        if not data:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.map.units and not self.spec.strip_spaces:
            return self._plain(data)
        return self._walk(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        out = data.replace(b" ", self.space)
        raw = np.frombuffer(data, np.uint8)
        times = np.where(raw == 32, len(self.space), 1)
        start = np.repeat(np.arange(len(raw)), times)
        end = start + 1
        if self.spec.dummy_prefix:
            zero = np.zeros(len(self.space), np.int64)
            out, start, end = self.space + out, np.concatenate((zero, start)), np.concatenate((zero, end))
        return out, start, end

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(data):
            if hit := self.map.longest(data, at):
                n, text = hit
            else:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                text = data[at : at + n]
            yield at, at + n, text
            at += n

    def _walk(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        out, start, end = bytearray(), [], []

        def put(text: bytes, a: int, b: int) -> None:
            out.extend(text)
            start.extend([a] * len(text))
            end.extend([b] * len(text))

        steps = list(self._steps(data))
        strip = self.spec.strip_spaces
        while strip and steps and steps[0][2] == b" ":
            steps.pop(0)
        if not steps:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.spec.dummy_prefix:
            put(self.space, steps[0][0], steps[0][0])
        after_space = strip
        for a, b, text in steps:
            if strip and after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", self.space), a, b)
                after_space = strip and text.endswith(b" ")
        while strip and out.endswith(self.space):
            del out[-len(self.space) :]
        n = len(out)
        return bytes(out), np.array(start[:n], np.int64), np.array(end[:n], np.int64)


@dataclass
class Encoding:
    ids: list[int]
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        spec, pieces = read_model(path)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalizer = Normalizer(spec)
        # a byte piece stands for one byte; a control piece never comes out of a text
        self.lengths = np.array([1 if kind == 6 else len(text.encode()) for text, kind in pieces], np.int64)
        # original bytes of a piece where every mark stands for a space
        self.originals = self.lengths - np.array([(len(MARK_UTF8) - 1) * text.count(MARK) for text, _ in pieces], np.int64)
        self.unknown = {i for i, (_, kind) in enumerate(pieces) if kind == 2}
        self.mark = self.model.piece_to_id(MARK)
        plain = not spec.charsmap and not spec.strip_spaces and spec.dummy_prefix and spec.escape_spaces
        own = [text for text, kind in pieces if kind == 1]
        apart = not any(MARK in text.lstrip(MARK) for text in own) and not any(kind == 4 for _, kind in pieces)
        self.plain, self.apart = plain, plain and apart

    def _parts(self, text: str) -> Iterator[str]:
        """``text`` cut before runs of white-space marks, without the first mark of each
        cut: the dummy prefix that the library puts before a text gives it back."""
        norm, at = MARK + text.replace(" ", MARK), 0
        last = len(norm.rstrip(MARK))  # a cut of marks alone would come out empty
        while at < len(norm):
            end = norm.find(MARK, at + CUT_CHARS)
            while end > 0 and norm[end - 1] == MARK:
                end = norm.find(MARK, end + 1)
            end = len(norm) if end < 0 or end >= last else end
            yield norm[at + 1 : end]
            at = end

    def ids(self, text: str) -> list[int]:
        if not self.apart or len(text) <= CUT_CHARS:
            return self.model.encode(text)
        return list(chain.from_iterable(map(self.model.encode, self._parts(text))))

    def encode(self, text: str) -> Encoding:
        """Ids, and of each piece the span of original UTF-8 bytes it covers."""
        ids = self.ids(text)
        if self.plain and ids and MARK not in text and self.unknown.isdisjoint(ids):
            stop = np.cumsum(size := self.originals[ids])
            if stop[-1] != len(text.encode()) + 1:  # one more for the dummy prefix
                raise ValueError("the pieces do not cover the text")
            return Encoding(ids, np.maximum(stop - size - 1, 0), stop - 1)
        norm, start, end = self.normalizer.run(text.encode())
        size = self.lengths[ids] if ids else np.zeros(0, np.int64)
        if ids and not self.unknown.isdisjoint(ids):  # an unknown piece's length is its surface's
            shown = [x.surface if x.id in self.unknown else None for x in self.model.encode(text, return_type="proto").pieces]
            size = np.array([len(s.encode()) if s is not None else n for s, n in zip(shown, size, strict=True)], np.int64)
        stop = np.cumsum(size)
        if len(norm) != (stop[-1] if len(stop) else 0):
            raise ValueError("the pieces do not cover the normalised text")
        begin = stop - size
        if not len(ids):
            return Encoding(ids, begin, stop)
        return Encoding(ids, start[begin], end[stop - 1])

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with arrays ``ids``, ``starts`` and ``ends`` (original UTF-8 byte spans of the pieces)."""
    outputs = ("ids", "starts", "ends")
    kept = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            made = [own.encode(x or "") for x in batch.column("text").to_pylist()]
            arrays = [pa.array([getattr(x, f) for x in made], pa.list_(pa.int32())) for f in ("ids", "starts", "ends")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *outputs])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with the text that its ``ids`` decode to, as ``decoded``."""
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """A row of digests for each document: the encoding, its spans and its decoding
    are made and summed up in one pass, so no array leaves the worker.

    ``covered_bytes`` counts the original bytes under the pieces' spans.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            count, ids, decoded, covered = [], [], [], []
            for cell in batch.column(1):
                made = own.encode(cell.as_py())
                count.append(len(made.ids))
                ids.append(hashlib.sha256(",".join(map(str, made.ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(made.ids).encode()).hexdigest())
                # spans of bytes of one character or replacement may be equal; they rise otherwise
                fresh = np.maximum(made.starts[1:], made.ends[:-1])
                first = made.ends[0] - made.starts[0] if count[-1] else 0
                covered.append(int(first + np.maximum(made.ends[1:] - fresh, 0).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(covered, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text("text").alias("text")).mapInArrow(run, schema)
