"""The controller's log and snapshots in their binary forms.

The log is a row of segments of frames.  A frame has a header of 32 bytes (little-endian: mark, version, kind, term,
index, size and CRC-32C of what follows).  Reading the last segment ends at the first frame that is cut off or damaged;
in any other segment such a frame is an error.  Frames of unknown kinds are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.checks import crc32c, crc32c_many

#: Fixed values of the format.
MAGIC, VERSION = 0x4C575242, 1
HARD_STATE, ENTRY = 1, 2
HEAD = struct.Struct("<IHHQQII")
STATE = struct.Struct("<QQQ")  # term, vote, commit

LOG_ROW = "segment long, kind int, term long, index long, vote long, commit long, payload binary"
IMAGE = "version long, nodes array<struct<node:int,host:string,port:int>>, assignments array<struct<topic:string,partition:int,replicas:array<int>,leader:int,epoch:int,tiered:boolean,retention_ms:long,retention_bytes:long>>"


class DamagedLog(ValueError):
    """A frame that is not the log's last cannot be read."""


def frame(kind: int, term: int, index: int, payload: bytes, crc: int | None = None) -> bytes:
    return HEAD.pack(MAGIC, VERSION, kind, term, index, len(payload), crc32c(payload) if crc is None else crc) + payload


def hard_state(term: int, vote: int, commit: int) -> bytes:
    return STATE.pack(term, vote, commit)


def read_state(payload: bytes) -> tuple[int, int, int] | None:
    return STATE.unpack_from(payload) if len(payload) >= STATE.size else None


def frames(content: bytes) -> tuple[list[tuple[int, int, int, bytes]], int]:
    """The frames (kind, term, index, payload) of a segment's sound beginning, and its length in bytes."""
    found, sums, ends, at = [], [], [], 0
    while at + HEAD.size <= len(content):
        magic, version, kind, term, index, size, crc = HEAD.unpack_from(content, at)
        at += HEAD.size + size
        if magic != MAGIC or version != VERSION or at > len(content):
            break
        found.append((kind, term, index, content[at - size : at]))
        sums.append(crc)
        ends.append(at)
    real = crc32c_many([payload for *_, payload in found])
    sound = next((i for i, (a, b) in enumerate(zip(sums, real, strict=True)) if a != b), len(found))
    return found[:sound], ends[sound - 1] if sound else 0


def write_segments(entries: DataFrame) -> DataFrame:
    """Segments (segment, content) of entries: segment, seq, kind, term, index, vote, commit, payload.  A hard state's
    payload is its term, vote and commit, its index 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for batch in batches:
            for segment, kind, term, index, vote, commit, payload in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if segment != own and parts:
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([own], pa.int64()), "content": [b"".join(parts)]})
                    parts = []
                own = segment
                parts.append(frame(kind, term, 0, hard_state(term, vote, commit)) if kind == HARD_STATE else frame(kind, term, index, payload or b""))
        if parts:
            yield pa.RecordBatch.from_pydict({"segment": pa.array([own], pa.int64()), "content": [b"".join(parts)]})

    dealt = entries.repartition("segment").sortWithinPartitions("segment", "seq")
    return dealt.select("segment", "kind", "term", "index", "vote", "commit", "payload").mapInArrow(run, "segment long, content binary")


def replay(segments: DataFrame) -> DataFrame:
    """What the segments hold, a row a frame; raises ``DamagedLog`` where another segment than the last is damaged."""
    last = segments.agg(F.max("segment")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, sound = frames(content)
                if sound < len(content) and segment != last:
                    raise DamagedLog(f"segment {segment} is damaged at byte {sound}")
                rows = []
                for kind, term, index, payload in found:
                    if kind == HARD_STATE and (state := read_state(payload)):
                        own, vote, commit = state
                        rows.append((segment, kind, own, index, vote, commit, None))
                    elif kind == ENTRY:
                        rows.append((segment, kind, term, index, None, None, payload))
                names = ["segment", "kind", "term", "index", "vote", "commit", "payload"]
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    return segments.select("segment", "content").mapInArrow(run, LOG_ROW)


def text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack(">h", len(raw)) + raw


def maybe(value: int | None) -> bytes:
    return struct.pack(">?Q", value is not None, value or 0)


def write_image(version: int, nodes: list[dict], assignments: list[dict]) -> bytes:
    """A snapshot of the cluster: big-endian numbers, texts behind their length, an option behind its mark."""
    out = [struct.pack(">QI", version, len(nodes))]
    for n in nodes:
        out += [struct.pack(">i", n["node"]), text(n["host"]), struct.pack(">i", n["port"])]
    out.append(struct.pack(">I", len(assignments)))
    for a in assignments:
        replicas = a["replicas"]
        out += [text(a["topic"]), struct.pack(f">iI{len(replicas)}i", a["partition"], len(replicas), *replicas)]
        out += [struct.pack(">ii?", a["leader"], a["epoch"], a["tiered"]), maybe(a["retention_ms"]), maybe(a["retention_bytes"])]
    return b"".join(out)


def read_image(content: bytes) -> tuple[int, list[dict], list[dict]]:
    """(version, nodes, assignments); ValueError where the snapshot is cut off."""
    at = 0

    def take(kind: str) -> tuple:
        nonlocal at
        field = struct.Struct(">" + kind)
        at += field.size
        if at > len(content):
            raise ValueError("the snapshot is cut off")
        return field.unpack_from(content, at - field.size)

    def name() -> str:
        return take(f"{take('h')[0]}s")[0].decode(errors="replace")

    def option() -> int | None:
        there, value = take("?Q")
        return value if there else None

    version, count = take("QI")
    nodes = [{"node": take("i")[0], "host": name(), "port": take("i")[0] & 0xFFFF} for _ in range(count)]
    assignments = []
    for _ in range(take("I")[0]):
        topic, (partition, width) = name(), take("iI")
        replicas = list(take(f"{width}i"))
        leader, epoch, tiered = take("ii?")
        assignments.append({"topic": topic, "partition": partition, "replicas": replicas, "leader": leader, "epoch": epoch, "tiered": tiered, "retention_ms": option(), "retention_bytes": option()})
    return version, nodes, assignments


def write_images(images: DataFrame) -> DataFrame:
    """``version``, ``nodes`` and ``assignments`` of each row as a snapshot: content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"content": pa.array([write_image(*row) for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)], pa.binary())})

    return images.select("version", "nodes", "assignments").mapInArrow(run, "content binary")


def read_images(contents: DataFrame) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(IMAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_image(content) for content in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in read], schema.field(c).type) for c in range(3)], schema=schema)

    return contents.select("content").mapInArrow(run, IMAGE)
