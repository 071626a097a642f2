"""The controller's log and snapshots, logins, and decisions that the catalogue's queries do not reach."""

import pytest

from tidemark.functions import scram
from tidemark.operators import control
from tidemark.sources import controllog


def test_login_of_the_rfc():
    """The exchange that RFC 7677 prints."""
    import base64

    keys = scram.keys_of("pencil", base64.b64decode("W22ZaJ0SNY7soEsUEjb6gQ=="))
    first = "n=user,r=rOprNGfwEbeRWgbNEkqO"
    told = scram.challenge(first, keys, "%hvYDpWUa2RaTCAfuxFIlj)hNlF$k0")
    assert told == "r=rOprNGfwEbeRWgbNEkqO%hvYDpWUa2RaTCAfuxFIlj)hNlF$k0,s=W22ZaJ0SNY7soEsUEjb6gQ==,i=4096"
    bare = "c=biws,r=rOprNGfwEbeRWgbNEkqO%hvYDpWUa2RaTCAfuxFIlj)hNlF$k0"
    sent = scram.proof("pencil", first, told, bare)
    assert sent == "dHzbZapWIk4jUhN+Ute9ytag9zjfMHgsqmmiz7AndVQ="
    assert scram.answer(keys, first, told, f"{bare},p={sent}") == "v=6rriTRBi23WpRR/wtup+mMhUZUn/dB5nLTJRsjl95G4="
    assert scram.answer(keys, first, told, f"{bare},p={scram.proof('pen', first, told, bare)}") is None
    assert scram.answer(keys, first, told, f"{bare},p=*") is None and scram.answer(keys, first, told, bare) is None


def test_listed_users():
    assert set(scram.users_of("ann:a,bob:b:c,:x,eve:,,plain")) == {"ann", "bob"}
    assert scram.users_of("bob:b:c")["bob"] == scram.keys_of("b:c", scram.salt_of("bob"))


def segment():
    return [controllog.frame(2, 3, i, b"x" * i) for i in range(5)]


def test_torn_and_damaged_ends():
    whole = b"".join(segment())
    size = len(whole) - len(segment()[-1])
    assert len(controllog.frames(whole)[0]) == 5
    for cut in range(size, len(whole)):
        assert controllog.frames(whole[:cut]) == (controllog.frames(whole)[0][:4], size)
    broken = bytearray(whole)
    broken[len(segment()[0]) + 32] ^= 1  # the payload of the second frame
    assert controllog.frames(bytes(broken)) == (controllog.frames(whole)[0][:1], len(segment()[0]))
    broken = bytearray(whole)
    broken[0] ^= 1
    assert controllog.frames(bytes(broken)) == ([], 0)


def test_only_the_last_segment_may_end_early(spark):
    whole = b"".join(segment())
    rows = spark.createDataFrame([(0, whole), (1, whole[:-1])], "segment long, content binary")
    assert controllog.replay(rows).count() == 9
    unknown = spark.createDataFrame([(0, controllog.frame(9, 1, 1, b"?") + whole)], "segment long, content binary")
    assert controllog.replay(unknown).count() == 5
    bad = spark.createDataFrame([(0, whole[:-1]), (1, whole)], "segment long, content binary")
    with pytest.raises(Exception, match="segment 0 is damaged"):
        controllog.replay(bad).collect()
    assert controllog.replay(rows.limit(0)).count() == 0


def test_snapshot_round_trip():
    nodes = [{"node": 1, "host": "é" * 10, "port": 65535}, {"node": 2, "host": "", "port": 0}]
    some = {"topic": "t", "partition": 0, "replicas": [], "leader": -1, "epoch": 0, "tiered": False, "retention_ms": None, "retention_bytes": 0}
    image = controllog.write_image(7, nodes, [some, some | {"replicas": [1, 2], "tiered": True, "retention_ms": 2**63}])
    assert controllog.write_image(*controllog.read_image(image)) == image
    assert controllog.read_image(image)[1] == nodes
    with pytest.raises(ValueError):
        controllog.read_image(image[:-1])


def test_upload_windows(spark):
    rows = [(1, 1, 0, 60), (1, 2, 500, 60), (1, 3, 999, 40), (1, 4, 1000, 500), (1, 5, 1001, 100), (1, 6, 1002, 1), (2, 1, 1, 101), (None, 1, 0, None)]
    df = spark.createDataFrame(rows, "store long, seq long, at_ms long, bytes long")
    said = {(r[0], r[1]): r[2] for r in control.upload_delays(df, 100).collect()}
    assert said == {(1, 1): 0, (1, 2): 200, (1, 3): 0, (1, 4): 0, (1, 5): 0, (1, 6): 10, (2, 1): 10, (None, 1): 0}
    assert {r[2] for r in control.upload_delays(df, 0).collect()} == {0}
