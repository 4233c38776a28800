"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised here, by the rules compiled into the model: at each place the
longest prefix that the character map (a double array) knows is replaced, and for every
normalised byte the place in the original is recorded. The pieces of the normalised
text are then projected to spans of original bytes. Segmentation is the library's own,
on the model with its normaliser switched off.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame

from catalog_fusion.llm.tables import bound_batches, result_schema, whole_text

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
#: Tokens of one batch of results.
_BATCH_TOKENS = 1 << 20

# Field numbers and piece types of the model file, fixed by its format.
_PIECES, _NORMALIZER = 1, 3
_PIECE, _PIECE_TYPE = 1, 3
_CHARS_MAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5
_USER_DEFINED, _BYTE = 4, 6
_NORMAL, _UNKNOWN = 1, 2
_TRAINER, _SPACE_AS_SUFFIX = 2, 24


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a serialised message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharsMap:
    """The compiled map: longest known prefix to its replacement."""

    def __init__(self, blob: bytes, protected: frozenset[bytes] = frozenset()):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :]
        #: Symbols that stay as they are, longest first.
        self.protected = sorted(protected, key=len, reverse=True)
        first = {s[0] for s in self.protected}
        if self.units:
            root = self._offset(self.units[0])
            first |= {b for b in range(256) if self.units[root ^ b] & 0x800000FF == b}
        chars = b"".join(re.escape(bytes([b])) for b in sorted(first))
        self.may_start = re.compile(b"[" + chars + b"]") if first else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of ``data[at:]``."""
        for symbol in self.protected:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        text = found[1]
        return found[0], self.texts[text : self.texts.index(b"\0", text)]

    def replaced(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The mapped bytes, and for each the original place it stems from."""
        if self.may_start is None:
            return data, np.arange(len(data), dtype=np.int32)
        out, places, at = [], [], 0
        while at < len(data):
            hit = self.may_start.search(data, at)
            start = hit.start() if hit else len(data)
            if start > at:
                out.append(data[at:start])
                places.append(np.arange(at, start, dtype=np.int32))
                at = start
                continue
            rule = self.longest(data, at)
            if rule is None:  # one character as it is
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                out.append(data[at : at + size])
                places.append(np.full(size, at, np.int32))
            else:
                size, text = rule
                out.append(text)
                places.append(np.full(len(text), at, np.int32))
            at += size
        return b"".join(out), np.concatenate(places) if places else np.zeros(0, np.int32)


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str):
        with open(model, "rb") as file:
            data = file.read()
        self._build(data)

    @classmethod
    def from_bytes(cls, data: bytes) -> PieceCoder:
        coder = cls.__new__(cls)
        coder._build(data)
        return coder

    def _build(self, data: bytes) -> None:
        pieces = []
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for number, value in message_fields(data):
            if number == _PIECES:
                pieces.append(dict(message_fields(value)))
            elif number == _NORMALIZER:
                spec |= dict(message_fields(value))
            elif number == _TRAINER:
                trainer |= dict(message_fields(value))
        if trainer.get(_SPACE_AS_SUFFIX):
            raise ValueError("models with space as a suffix are not supported")
        kinds = [p.get(_PIECE_TYPE, _NORMAL) for p in pieces]
        names = [p[_PIECE] for p in pieces]
        self.dummy_prefix = bool(spec.get(_DUMMY_PREFIX, 1))
        self.remove_extra = bool(spec.get(_REMOVE_EXTRA, 1))
        self.space = _SPACE_BYTES if spec.get(_ESCAPE, 1) else b" "
        self.map = CharsMap(
            bytes(spec.get(_CHARS_MAP, b"")),
            frozenset(n for n, k in zip(names, kinds, strict=True) if k == _USER_DEFINED),
        )
        #: Normalised bytes that a piece stands for; of the unknown piece it varies.
        self.widths = np.array([1 if k == _BYTE else len(n) for n, k in zip(names, kinds, strict=True)], np.int32)
        self.unknown = kinds.index(_UNKNOWN)
        # Later values of a message's fields win, so this ends normalisation in the library.
        off = bytes([_DUMMY_PREFIX << 3, 0, _REMOVE_EXTRA << 3, 0, _ESCAPE << 3, 0, _CHARS_MAP << 3 | 2, 0])
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=data + bytes([_NORMALIZER << 3 | 2, len(off)]) + off)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the original place of each and of the end."""
        mapped, places = self.map.replaced(data)
        consumed = len(data)
        codes = np.frombuffer(mapped, np.uint8)
        blank = codes == 32
        if self.remove_extra and len(codes):
            # Of a run of spaces the first stays, at the ends none.
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            solid = np.flatnonzero(~blank)
            low, high = (solid[0], solid[-1] + 1) if len(solid) else (0, 0)
            keep[:low] = False
            keep[high:] = False
            consumed = int(places[high]) if high < len(places) else consumed
            codes, places, blank = codes[keep], places[keep], blank[keep]
        if not len(codes):
            return b"", np.array([consumed], np.int32)
        text = codes.tobytes().replace(b" ", self.space)
        origin = np.repeat(places, np.where(blank, len(self.space), 1))
        if self.dummy_prefix:
            text = self.space + text
            origin = np.concatenate((np.full(len(self.space), places[0], np.int32), origin))
        return text, np.append(origin, np.int32(consumed))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and end of each piece in the text's UTF-8 bytes."""
        normal, origin = self.normalize(text.encode())
        normal = normal.decode()
        ids = np.asarray(self.raw.encode(normal, return_type="numpy"), np.int32)
        widths = self.widths[ids]
        if (ids == self.unknown).any():  # the model has no bytes to fall back on
            widths = np.array([len(s.encode()) for s in self.raw.encode(normal, return_type=str)], np.int32)
        ends = np.cumsum(widths)
        return ids, origin[ends - widths], origin[ends]

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids)


@functools.lru_cache(maxsize=4)
def piece_coder(model: str) -> PieceCoder:
    return PieceCoder(model)


def encode_texts(documents: DataFrame, model: str, key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids``, ``starts``, ``ends`` and ``decoded`` of every row.

    ``key`` is a column's name, or any expression, then named ``key``. ``model`` is a path that every executor has. ``ids`` are those of the library
    without begin or end ids, ``starts`` and ``ends`` the span of each piece in the
    text's UTF-8 bytes (the pieces of a character that falls back to bytes have one
    each), ``decoded`` what the library decodes from ``ids``. Null and empty texts have
    empty arrays and an empty string; repeated rows are encoded each; a long text is a
    batch of its own. An empty table gives no rows, and other columns are not read.
    """
    bound_batches(documents.sparkSession)
    value = documents[key] if isinstance(key, str) else key
    source = documents.select(value.alias("key"), whole_text(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        numbers = pa.int32()

        def packed(keys: list, rows: list[tuple[np.ndarray, ...]], texts: list[str]) -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0] + [len(r[0]) for r in rows]), numbers)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c).astype(np.int32, copy=False))) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *lists, pa.array(texts, pa.string())], names=["key", "ids", "starts", "ends", "decoded"])

        for batch in batches:
            keys, rows, texts, tokens, begun = batch.column(0), [], [], 0, 0
            for i, value in enumerate(batch.column(1)):
                rows.append(coder.encode(value.as_py()))
                texts.append(coder.decode(rows[-1][0].tolist()))
                tokens += len(rows[-1][0])
                if tokens >= _BATCH_TOKENS or i + 1 == len(batch):
                    yield packed([keys.slice(begun, i + 1 - begun)], rows, texts)
                    rows, texts, tokens, begun = [], [], 0, i + 1

    result = source.mapInArrow(encode, result_schema(source, "ids array<int>, starts array<int>, ends array<int>, decoded string"))
    return result.withColumnRenamed("key", key) if isinstance(key, str) else result
