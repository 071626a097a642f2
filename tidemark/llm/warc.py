"""WARC archives compressed with Zstandard.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then comes one Zstandard
frame per record.  Spark's writers carry the archives as rows ``(archive, content)`` of a Parquet table in the
shared folder, so any store that Spark can reach will do and a lost executor only repeats its own archives.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest id is a ``response``, the others
are ``revisit`` records: they keep the HTTP head (with the full payload's length) and name the response.  Payloads are
equal if their SHA-1, length and a second 64-bit hash are.  Groups are found on these alone; payloads then meet their
group's row by its key and a salt, so a payload of any number of copies is spread over ``SALTS`` keys.

Defined results: a null payload is empty; a null url is an empty target; rows without an id never stand for a group
that has an id; rows that repeat the smallest id are responses each; every record has a record id of its own - the
response that others name is called by id and digest alone, and where whole rows repeat it, they name what the ids of
its repetitions begin with; payloads are kept whole, whatever their length; an empty
table gives no archives; other columns, whatever they are named, take no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import bounded_sample, materialise, quoted
from tidemark.llm.workers import sliced, tidy

DICTIONARY_MAGIC = 0x184D2A5D
#: Rows that the dictionary is trained on, the bytes taken of each, and its size.
DICTIONARY_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 8192, 32768
ARCHIVE_BYTES = 8 << 20
SALTS = 32
LEVEL = 3
#: Bytes given to the decoder at a time: what lies behind a frame is copied back.
FEED = 8192
WARC_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; none if there are too few to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if len(s) >= 8], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """A record; ``place`` tells it from others of the same id and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest}{place}>", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}:{digest}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; raises ValueError where a header, a length or a digest doesn't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ValueError(f"no {needed}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block = rest[:length]
    if fields.get("warc-block-digest", "sha1:" + sha1_base32(block)) != "sha1:" + sha1_base32(block):
        raise ValueError("the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (size != len(payload) or digest != sha1_base32(payload)):
        raise ValueError("the payload's length or digest differs")
    page = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">").split(":")[0]) else None
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if kind == "response" else None}


def open_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    import zstandard

    at, dictionary = 0, None
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_MAGIC:
            body = content[8 : 8 + size]
            if len(body) != size:
                raise ValueError("the dictionary frame is cut off")
            if body[:4] == b"\x28\xb5\x2f\xfd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            dictionary, at = zstandard.ZstdCompressionDict(body) if body else None, 8 + size
    tool = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        frame, parts = tool.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("a frame is cut off")
            parts.append(frame.decompress(view[at : at + FEED]))
            at += len(view[at : at + FEED])
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Archives of all rows: ``archive`` (string), ``records`` (long), ``content`` (binary), on shared storage."""
    text = lambda c: F.col(quoted(c))
    base = pages.select(text(id_col).cast("long").alias("page_id"), text(url_col).cast("string").alias("url"), F.coalesce(F.encode(text(body_col), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("key", F.struct(F.sha1("payload").alias("sha"), F.length("payload").alias("size"), F.xxhash64("payload").alias("hash"))).withColumn("tag", F.xxhash64("url"))
    rows = base.where(F.col("key.size") >= min_bytes).groupBy("key", "page_id", "tag").count()
    first = rows.groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "tag", "count")).alias("least"), F.sum("count").alias("copies")).where("copies > 1")
    tag = F.when(F.col("least.count") == 1, F.col("least.tag"))
    first = first.select("key", F.col("least.page_id").alias("first_id"), tag.alias("first_tag"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    named = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("tag") == F.col("first_tag"))
    ready = salted.join(first, ["key", "salt"], "left").select("page_id", "url", "payload", "first_id", named.alias("named"))
    heads = base.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("head"))
    samples = [bytes(r["head"]) for r in bounded_sample(heads, DICTIONARY_ROWS, "page_id", "url").collect()]
    words = train_dictionary(samples)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=LEVEL)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words
        frames, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:05d}-{number:05d}.warc.zst"], "records": [len(frames)], "content": [lead + b"".join(frames)]})

        for batch in sliced(batches, 2, 256):
            for page_id, url, payload, first_id, named in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                again = first_id is not None and page_id != first_id
                place = "" if named else f":{part}-{number}-{len(frames)}"
                frame = tool.compress(record("revisit" if again else "response", page_id, url, payload, sha1_base32(payload), first_id if again else None, place))
                frames.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield flush()
                    frames, size, number = [], 0, number + 1
        if frames:
            yield flush()

    return materialise(ready.mapInArrow(tidy(pack), "archive string, records long, content binary"), "warc")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record, checked: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds[n]) for n in names])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in open_archive(content.as_py()):
                    own = parse(raw)
                    rows.append({n: own[n] for n in names})
                    size += len(raw) if payloads else 0
                    if len(rows) >= 4096 or size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("content").mapInArrow(tidy(unpack), ddl)
