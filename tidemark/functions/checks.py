"""Checksums, varints and identifiers of the log's binary format."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Reflected polynomial of CRC-32C (a fixed value).
CASTAGNOLI = 0x82F63B78


def _table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CASTAGNOLI if byte & 1 else 0)
        out.append(byte)
    return out


TABLE = _table()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C (Castagnoli); Spark's own ``crc32`` is the IEEE polynomial."""
    crc ^= 0xFFFFFFFF
    for byte in data:
        crc = TABLE[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_many(blobs: list[bytes]) -> list[int]:
    """CRC-32C of many byte strings at once: one step a byte position, vectorised over the strings."""
    if not blobs:
        return []
    table = np.array(TABLE, dtype=np.uint32)
    sizes = np.array([len(b) for b in blobs])
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(blobs) or b"\0", dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
    sizes = sizes[order]
    crc = np.full(len(blobs), 0xFFFFFFFF, dtype=np.uint32)
    active = len(blobs)
    for i in range(int(sizes[0])):
        while active and sizes[active - 1] <= i:
            active -= 1
        crc[:active] = table[(crc[:active] ^ flat[starts[:active] + i]) & 0xFF] ^ (crc[:active] >> np.uint32(8))
    out = np.empty(len(blobs), dtype=np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out.tolist()


def zigzag(value: Column) -> Column:
    """Signed to unsigned order of varints, as a 64-bit pattern."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1).cast("long")))


def write_unsigned(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def read_unsigned(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position); raises ValueError where the varint is cut off or too long."""
    value, shift = 0, 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def write_varint(value: int) -> bytes:
    return write_unsigned((value << 1 ^ value >> 63) & 0xFFFFFFFFFFFFFFFF)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value, at = read_unsigned(data, at)
    return value >> 1 ^ -(value & 1), at


def producer_id(node: Column, counter: Column) -> Column:
    """Eight bits of node above forty of counter."""
    return F.shiftleft(node.cast("long").bitwiseAND(F.lit(0xFF)), 40).bitwiseOR(counter.cast("long").bitwiseAND(F.lit(0xFFFFFFFFFF)))


def compression(attributes: Column) -> Column:
    """0 none, 1 gzip, 2 snappy, 3 lz4, 4 zstd."""
    return attributes.bitwiseAND(F.lit(7))


def is_transactional(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(16)) != 0


def is_control(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(32)) != 0


def topic_id(name: Column, version: Column) -> Column:
    """A 128-bit id of a topic and the version that created it, as hex."""
    return F.substring(F.sha2(F.concat_ws("\0", name, version.cast("string")), 256), 1, 32)


def varint_size(value: Column) -> Column:
    """Bytes that an unsigned varint takes: one for every seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def buffer_class(size: Column) -> Column:
    """The smallest power of two from 4 KiB on that holds ``size``, and 16 MiB at most."""
    classes = F.array(*[F.lit(1 << k).cast("long") for k in range(12, 25)])
    return F.coalesce(F.get(F.filter(classes, lambda c: c >= size), F.lit(0)), F.lit(1 << 24).cast("long"))


def with_crc32c(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the CRC-32C of a column of strings or bytes, many at a time; a null has none."""
    import pyarrow as pa

    place, schema = df.columns.index(column), StructType([*df.schema.fields, StructField(name, LongType())])

    def run(batches):
        for batch in batches:
            raw = batch.column(place).cast(pa.binary()).to_pylist()
            sums = iter(crc32c_many([x for x in raw if x is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(sums) for x in raw], pa.int64())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
