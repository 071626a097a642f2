import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import checks
from tidemark.sources import recordbatch as rb

RECORDS = [rb.Record(0, 0, b"k1", b"hello-world"), rb.Record(5, 1, None, b"v2", [(b"h", b"1"), (b"n", None)]), rb.Record(9, 2, b"", b"")]


def test_known_checksum():
    assert checks.crc32c(b"123456789") == 0xE3069283
    assert checks.crc32c_many([b"a", b"", b"123456789"]) == [checks.crc32c(b"a"), 0, 0xE3069283]


@given(st.integers(-(2**63), 2**63 - 1))
def test_varint_round_trip(value):
    data = checks.write_varint(value)
    assert checks.read_varint(data, 0) == (value, len(data))


@pytest.mark.parametrize("kind", range(5))
def test_batch_round_trip(kind):
    batch = rb.encode_batch(RECORDS, 42, 1000, 7, 1, 3, kind | rb.TRANSACTIONAL)
    ((at, header, raw),) = rb.frames(batch + b"cut off")
    assert (at, raw) == (0, batch) and header.crc == checks.crc32c(raw[rb.SUMMED_FROM :])
    assert (header.base_offset, header.record_count, header.max_timestamp) == (42, 3, 1009)
    assert rb.decode_records(raw, header) == RECORDS


def test_xerial_snappy():
    blocks = [b"abc" * 50, b"xyz"]
    framed = rb.XERIAL + struct.pack(">ii", 1, 1) + b"".join(struct.pack(">i", len(c := rb.compress(rb.SNAPPY, b))) + c for b in blocks)
    assert rb.decompress(rb.SNAPPY, framed) == b"".join(blocks)


def test_markers():
    marker = rb.encode_marker(rb.COMMIT, 9, 5, 3, 2)
    header = rb.read_header(marker)
    assert header.attributes & rb.CONTROL and rb.control_type(rb.decode_records(marker, header)[0].key) == rb.COMMIT
    assert rb.control_type(None) is None and rb.control_type(b"\0") is None


def test_files(spark, tmp_path):
    good = b"".join(rb.encode_batch(RECORDS, 3 * i, 1000 + i, 7, 0, 3 * i, rb.ZSTD) for i in range(4))
    torn = bytearray(good + rb.encode_batch(RECORDS, 12) + rb.encode_batch(RECORDS, 15))
    torn[len(good) + 70] ^= 1  # the fifth batch's sum no longer holds
    (tmp_path / "00000000000000000000.log").write_bytes(bytes(torn) + b"\0\0\0")
    (tmp_path / "00000000000000000100.log").write_bytes(rb.encode_batch(RECORDS, 100) + rb.encode_batch(RECORDS, 110) + rb.encode_marker(0, 103, 1, 1, 1))
    batches = rb.read_batches(spark, str(tmp_path))
    assert batches.count() == 9
    kept = rb.recovered(batches)
    assert sorted(r[0] for r in kept.select("base_offset").collect()) == [0, 3, 6, 9, 100]
    rows = rb.explode_records(kept).orderBy("offset").collect()
    assert [r.offset for r in rows] == [*range(12), 100, 101, 102]
    assert rows[1].key is None and bytes(rows[2].key) == b"" and rows[1].headers[1].value is None and rows[4].sequence == 4


@settings(max_examples=30)
@given(st.lists(st.tuples(st.none() | st.binary(max_size=20), st.none() | st.binary(max_size=40)), min_size=1, max_size=10), st.integers(0, 4))
def test_any_records(pairs, kind):
    records = [rb.Record(i, i, k, v) for i, (k, v) in enumerate(pairs)]
    batch = rb.encode_batch(records, attributes=kind)
    assert rb.decode_records(batch, rb.read_header(batch)) == records


def test_columns(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(checks.unzigzag(checks.zigzag(F.lit(-5).cast("long"))).alias("z"), checks.producer_id(F.lit(3), F.lit(9)).alias("p"), checks.compression(F.lit(20)).alias("c"), checks.is_transactional(F.lit(20)).alias("t"), checks.is_control(F.lit(20)).alias("m"), F.length(checks.topic_id(F.lit("a"), F.lit(1))).alias("n")).first()
    assert (row.z, row.p, row.c, row.t, row.m, row.n) == (-5, (3 << 40) + 9, 4, True, False, 32)
