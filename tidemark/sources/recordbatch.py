"""Record batches of format 2: codec, and DataFrames from files of them.

A batch is a 61-byte header (base offset, length, leader epoch, magic, CRC-32C over all that follows, attributes,
last offset delta, first and greatest time, producer id and epoch, first sequence, count) and its records, which may
be compressed as a whole.  All numbers are big-endian; records use zigzag varints; length -1 means null.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.checks import crc32c, crc32c_many, read_varint, write_varint

HEADER = struct.Struct(">qiibIhiqqqhii")
MAGIC = 2
#: Where the checksum's range begins.
SUMMED_FROM = 21
NONE, GZIP, SNAPPY, LZ4, ZSTD = range(5)
TRANSACTIONAL, CONTROL = 16, 32
ABORT, COMMIT = 0, 1
#: The framing that some writers put around snappy blocks (a fixed value).
XERIAL = b"\x82SNAPPY\x00"


@dataclass
class Record:
    ts_delta: int = 0
    offset_delta: int = 0
    key: bytes | None = None
    value: bytes | None = None
    headers: list[tuple[bytes, bytes | None]] = field(default_factory=list)


@dataclass
class Header:
    base_offset: int
    batch_length: int
    leader_epoch: int
    magic: int
    crc: int
    attributes: int
    last_offset_delta: int
    first_timestamp: int
    max_timestamp: int
    producer_id: int
    producer_epoch: int
    base_sequence: int
    record_count: int

    @property
    def size(self) -> int:
        return self.batch_length + 12


def compress(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind == GZIP:
        return gzip.compress(data, mtime=0)
    if kind == SNAPPY:
        return pa.compress(data, codec="snappy", asbytes=True)
    if kind == LZ4:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as stream:
            stream.write(data)
        return sink.getvalue().to_pybytes()
    if kind == ZSTD:
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    raise ValueError(f"compression {kind}")


def raw_snappy(data: bytes) -> bytes:
    size, shift, at = 0, 0, 0
    while True:
        byte = data[at]
        at += 1
        size |= (byte & 0x7F) << shift
        if byte < 0x80:
            return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True) if size else b""
        shift += 7


def decompress(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind == GZIP:
        return gzip.decompress(data)
    if kind == SNAPPY:
        if not data.startswith(XERIAL):
            return raw_snappy(data)
        out, at = [], 16
        while at < len(data):
            (size,) = struct.unpack_from(">i", data, at)
            out.append(raw_snappy(data[at + 4 : at + 4 + size]))
            at += 4 + size
        return b"".join(out)
    if kind == LZ4:
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()
    if kind == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compression {kind}")


def sized(data: bytes | None) -> bytes:
    return write_varint(-1) if data is None else write_varint(len(data)) + data


def encode_record(r: Record) -> bytes:
    body = b"\0" + write_varint(r.ts_delta) + write_varint(r.offset_delta) + sized(r.key) + sized(r.value) + write_varint(len(r.headers))
    body += b"".join(sized(k) + sized(v) for k, v in r.headers)
    return write_varint(len(body)) + body


def encode_batch(records: list[Record], base_offset: int = 0, first_timestamp: int = 0, producer_id: int = -1, producer_epoch: int = -1, base_sequence: int = -1, attributes: int = 0, leader_epoch: int = 0) -> bytes:
    """A whole batch; the attributes' low bits name the compression."""
    payload = compress(attributes & 7, b"".join(map(encode_record, records)))
    newest = first_timestamp + max((r.ts_delta for r in records), default=0)
    tail = struct.pack(">hiqqqhii", attributes, max(len(records) - 1, 0), first_timestamp, newest, producer_id, producer_epoch, base_sequence, len(records)) + payload
    return struct.pack(">qiibI", base_offset, len(tail) + 9, leader_epoch, MAGIC, crc32c(tail)) + tail


def encode_marker(kind: int, base_offset: int, timestamp: int, producer_id: int, producer_epoch: int) -> bytes:
    """A control batch that ends a transaction."""
    marker = Record(key=struct.pack(">hh", 0, kind), value=struct.pack(">hi", 0, 0))
    return encode_batch([marker], base_offset, timestamp, producer_id, producer_epoch, -1, TRANSACTIONAL | CONTROL)


def control_type(key: bytes | None) -> int | None:
    """0 abort, 1 commit; None for keys that are no marker's."""
    if key is None or len(key) < 4:
        return None
    kind = struct.unpack_from(">hh", key)[1]
    return kind if kind in (ABORT, COMMIT) else None


def read_header(data: bytes, at: int = 0) -> Header | None:
    """The header at a position; None where it is cut off, not of this format or shorter than a header."""
    if at + HEADER.size > len(data):
        return None
    header = Header(*HEADER.unpack_from(data, at))
    return header if header.magic == MAGIC and header.size >= HEADER.size else None


def frames(data: bytes) -> Iterator[tuple[int, Header, bytes]]:
    """(position, header, bytes) of each whole batch from the start on; ends at the first that is none."""
    at = 0
    while (header := read_header(data, at)) is not None and at + header.size <= len(data):
        yield at, header, data[at : at + header.size]
        at += header.size


def decode_records(batch: bytes, header: Header) -> list[Record]:
    data = decompress(header.attributes & 7, batch[HEADER.size :])
    at, out = 0, []

    def piece() -> bytes | None:
        nonlocal at
        size, at = read_varint(data, at)
        if size < 0:
            return None
        if at + size > len(data):
            raise ValueError("a record is cut off")
        at += size
        return data[at - size : at]

    for _ in range(header.record_count):
        _, at = read_varint(data, at)
        at += 1
        ts, at = read_varint(data, at)
        offset, at = read_varint(data, at)
        key, value = piece(), piece()
        n, at = read_varint(data, at)
        out.append(Record(ts, offset, key, value, [(piece() or b"", piece()) for _ in range(n)]))
    return out


BATCHES = "path string, position long, base_offset long, batch_length int, leader_epoch int, crc long, attributes int, last_offset_delta int, first_timestamp long, max_timestamp long, producer_id long, producer_epoch int, base_sequence int, record_count int, crc_ok boolean, data binary"


def read_batches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per whole batch of the files under ``path``; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BATCHES.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 2, *[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 2, *[pa.int64()] * 3, *[pa.int32()] * 3, pa.bool_(), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(frames(content))
                sums = crc32c_many([b[SUMMED_FROM:] for _, _, b in found])
                rows = [(name, at, h.base_offset, h.batch_length, h.leader_epoch, h.crc, h.attributes, h.last_offset_delta, h.first_timestamp, h.max_timestamp, h.producer_id, h.producer_epoch, h.base_sequence, h.record_count, h.crc == c, b) for (at, h, b), c in zip(found, sums, strict=True)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(run, BATCHES)


def recovered(batches: DataFrame) -> DataFrame:
    """What recovery keeps of each file: the batches before the first bad checksum or break in the offsets."""
    order = Window.partitionBy("path").orderBy("position")
    before = F.lag(F.col("base_offset") + F.col("last_offset_delta")).over(order)
    bad = ~F.col("crc_ok") | (before.isNotNull() & (F.col("base_offset") != before + 1))
    return batches.withColumn("_bad", bad.cast("int")).withColumn("_cut", F.max("_bad").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_bad", "_cut")


RECORDS = "base_offset long, offset long, ts_ms long, key binary, value binary, headers array<struct<key: binary, value: binary>>, producer_id long, producer_epoch int, sequence int, is_txn boolean, is_control boolean, control_type int"


def explode_records(batches: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Batches to records, once; everything behind stays columnar.  Columns ``keep`` of the batches go with them."""
    keep = keep or []
    pair = pa.struct([("key", pa.binary()), ("value", pa.binary())])
    schema = pa.schema([("base_offset", pa.int64()), ("offset", pa.int64()), ("ts_ms", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("headers", pa.list_(pair)), ("producer_id", pa.int64()), ("producer_epoch", pa.int32()), ("sequence", pa.int32()), ("is_txn", pa.bool_()), ("is_control", pa.bool_()), ("control_type", pa.int32())])
    source = batches.select(*keep, "data")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, which = [], []
                for n, data in enumerate(part.column(len(keep)).to_pylist()):
                    h = read_header(data)
                    control = bool(h.attributes & CONTROL)
                    own = [{"base_offset": h.base_offset, "offset": h.base_offset + r.offset_delta, "ts_ms": h.first_timestamp + r.ts_delta, "key": r.key, "value": r.value, "headers": [{"key": k, "value": v} for k, v in r.headers], "producer_id": h.producer_id, "producer_epoch": h.producer_epoch, "sequence": -1 if h.base_sequence < 0 else h.base_sequence + r.offset_delta, "is_txn": bool(h.attributes & TRANSACTIONAL), "is_control": control, "control_type": control_type(r.key) if control else None} for r in decode_records(data, h)]
                    found += own
                    which += [n] * len(own)
                told = pa.RecordBatch.from_pylist(found, schema=schema)
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(which, pa.int64())) for i in range(len(keep))], *told.columns], names=[*keep, *schema.names])

    return source.mapInArrow(run, kept + RECORDS)


def encode_rows(log: DataFrame, compression) -> DataFrame:
    """partition, base_offset, data: every batch of a log as bytes, and a control batch for every marker.

    ``log``: partition, offset, batch, ts_ms, key, value, producer_id, producer_epoch, is_txn, is_control,
    control_type; ``compression``: a column that says how a batch is compressed.  A batch is one group, as large as its
    writer made it.
    """
    own = F.when(F.col("is_control"), F.col("offset"))
    record = F.struct("offset", "ts_ms", F.encode(F.col("key"), "UTF-8").alias("key"), F.encode(F.col("value"), "UTF-8").alias("value"))
    first = [F.first(c).alias(c) for c in ("producer_id", "producer_epoch", "is_txn", "is_control", "control_type", "kind")]
    grouped = log.withColumn("kind", compression).withColumn("own", own).groupBy("partition", "batch", "own").agg(F.array_sort(F.collect_list(record)).alias("records"), *first)
    schema = pa.schema([("partition", pa.int64()), ("base_offset", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    base = r["records"][0]
                    if r["is_control"]:
                        data = encode_marker(r["control_type"], base["offset"], base["ts_ms"], r["producer_id"], r["producer_epoch"])
                    else:
                        records = [Record(x["ts_ms"] - base["ts_ms"], x["offset"] - base["offset"], x["key"], x["value"]) for x in r["records"]]
                        data = encode_batch(records, base["offset"], base["ts_ms"], r["producer_id"], r["producer_epoch"], 0, r["kind"] | (TRANSACTIONAL if r["is_txn"] else 0))
                    out.append({"partition": r["partition"], "base_offset": base["offset"], "data": data})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return grouped.select("partition", "records", "producer_id", "producer_epoch", "is_txn", "is_control", "control_type", "kind").mapInArrow(run, "partition long, base_offset long, data binary")


def read_headers(batches: DataFrame, keep: list[str]) -> DataFrame:
    """The header of each row's batch (column ``data``), and whether its checksum holds."""
    names = ["base_offset", "last_offset_delta", "record_count", "first_timestamp", "max_timestamp", "producer_id", "producer_epoch", "base_sequence", "attributes", "crc_ok"]
    kinds = [pa.int64(), *[pa.int32()] * 2, *[pa.int64()] * 3, *[pa.int32()] * 3, pa.bool_()]
    source = batches.select(*keep, "data")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw = batch.column(len(keep)).to_pylist()
            heads, sums = [read_header(x) for x in raw], crc32c_many([x[SUMMED_FROM:] for x in raw])
            columns = [[getattr(h, n) for h in heads] for n in names[:-1]] + [[h.crc == c for h, c in zip(heads, sums, strict=True)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*keep, *names])

    return source.mapInArrow(run, kept + "base_offset long, last_offset_delta int, record_count int, first_timestamp long, max_timestamp long, producer_id long, producer_epoch int, base_sequence int, attributes int, crc_ok boolean")


def segment_files(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> list[str]:
    """The segment files that may hold offsets of [start, end), told by the base offsets in their names; contents are
    not read."""
    names = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("path").collect()]
    bases = sorted((int(n.rsplit("/", 1)[1].split(".")[0]), n) for n in names)
    return [n for (base, n), (after, _) in zip(bases, [*bases[1:], (float("inf"), "")], strict=True) if after > start and (end is None or base < end)]


def read_range(spark: SparkSession, path: str, start: int, end: int | None = None) -> DataFrame:
    """Records of [start, end) from one partition's folder of segments: only files that may hold them are read, and
    of those only batches that do are decoded."""
    files = segment_files(spark, path, start, end)
    if not files:
        return spark.createDataFrame([], RECORDS)
    batches = read_batches(spark, files).where(F.col("base_offset") + F.col("last_offset_delta") >= start)
    if end is not None:
        batches = batches.where(F.col("base_offset") < end)
    records = explode_records(batches.where("crc_ok")).where(F.col("offset") >= start)
    return records if end is None else records.where(F.col("offset") < end)
