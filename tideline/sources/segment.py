"""Segment payloads of foreign stores: import and export. Inside the library Parquet does this work."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.errors import InvalidPayload

# The payload's format (fixed values): magic, version; little-endian header of flags, schema hash, chunk id, first and
# last time, rows; columns time, value, quality, each name, zero byte, 32-bit length and data; CRC-32 at the end.
MAGIC, VERSION = b"TTS_SEGMENT_", 1
HEADER = struct.Struct("<12sBHIqqqQ")


def encode_delta(values: np.ndarray) -> bytes:
    """32-bit count, then 64-bit differences, the first to 0."""
    v = np.asarray(values, np.int64)
    return struct.pack("<I", len(v)) + np.diff(v, prepend=np.int64(0)).astype("<i8").tobytes()


def decode_delta(data: bytes) -> np.ndarray:
    return np.cumsum(_column(data, "<i8"))


def encode_xor(values: np.ndarray) -> bytes:
    """32-bit count, then each value's bits against those of the one before."""
    bits = np.asarray(values, "<f8").view("<u8")
    return struct.pack("<I", len(bits)) + (bits ^ np.concatenate((np.zeros(1, "<u8"), bits[:-1]))[: len(bits)]).tobytes()


def decode_xor(data: bytes) -> np.ndarray:
    return np.bitwise_xor.accumulate(_column(data, "<u8")).view("<f8")


def encode_int32(values: np.ndarray) -> bytes:
    v = np.asarray(values, "<i4")
    return struct.pack("<I", len(v)) + v.tobytes()


def _column(data: bytes, kind: str) -> np.ndarray:
    if len(data) < 4:
        raise InvalidPayload("a column without a count")
    n = struct.unpack_from("<I", data)[0]
    if len(data) < 4 + n * np.dtype(kind).itemsize:
        raise InvalidPayload("a column is cut short")
    return np.frombuffer(data, kind, n, 4).copy()


def encode(chunk_id: int, times: np.ndarray, values: np.ndarray, qualities: np.ndarray) -> bytes:
    if not len(times) == len(values) == len(qualities):
        raise InvalidPayload("columns differ in length")
    first, last = (int(np.min(times)), int(np.max(times))) if len(times) else (0, 0)
    parts = [HEADER.pack(MAGIC, VERSION, 0, 0, chunk_id, first, last, len(times))]
    for name, data in ((b"time", encode_delta(times)), (b"value", encode_xor(values)), (b"quality", encode_int32(qualities))):
        parts += [name, b"\0", struct.pack("<I", len(data)), data]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def decode(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """times, values, qualities; the checksum must hold."""
    if len(payload) < HEADER.size + 4 or payload[:12] != MAGIC:
        raise InvalidPayload("not a segment")
    if payload[12] != VERSION:
        raise InvalidPayload(f"unknown segment version {payload[12]}")
    if struct.unpack("<I", payload[-4:])[0] != zlib.crc32(payload[:-4]):
        raise InvalidPayload("checksum mismatch")
    rows, at, columns = HEADER.unpack_from(payload)[7], HEADER.size, {}
    while at < len(payload) - 4:
        end = payload.index(b"\0", at)
        size = struct.unpack_from("<I", payload, end + 1)[0]
        columns[payload[at:end].decode()] = payload[end + 5 : end + 5 + size]
        at = end + 5 + size
    try:
        out = decode_delta(columns["time"]), decode_xor(columns["value"]), _column(columns["quality"], "<i4")
    except KeyError as missing:
        raise InvalidPayload(f"no column {missing}") from None
    return tuple(x[:rows] for x in out)


def packed_sizes(rows: int) -> dict[str, int]:
    """Bytes of the packed columns without counts."""
    return {"ts_ns": 8 * rows, "value_real": 8 * rows, "quality": 4 * rows}


def read_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Points of segment payloads, with the other columns beside them: ts_us, value_real, quality."""
    rest = [c for c in df.columns if c != payload]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(payload)
            for i, data in enumerate(batch.column(at).to_pylist()):
                if data is None:
                    continue
                t, v, q = decode(data)
                beside = batch.select(rest).take(pa.array(np.full(len(t), i)))
                yield pa.RecordBatch.from_arrays([*beside.columns, pa.array(t), pa.array(v), pa.array(q)], names=[*rest, "ts_us", "value_real", "quality"])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in rest] + ["ts_us long", "value_real double", "quality int"])
    return df.mapInArrow(points, ddl)
