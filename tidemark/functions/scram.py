"""Logins by SCRAM-SHA-256 (RFC 5802 and 7677): keys kept for a user, a client's proof and a server's answer."""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITERATIONS, SALT_BYTES = 4096, 16


class Keys(NamedTuple):
    """What a server keeps of a password."""

    salt: bytes
    iterations: int
    stored: bytes
    server: bytes


def signed(key: bytes, message: bytes) -> bytes:
    return hmac.digest(key, message, "sha256")


def either(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


def salt_of(user: str) -> bytes:
    return hashlib.sha256(user.encode()).digest()[:SALT_BYTES]


def keys_of(password: str, salt: bytes, iterations: int = ITERATIONS) -> Keys:
    salted = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations)
    return Keys(salt, iterations, hashlib.sha256(signed(salted, b"Client Key")).digest(), signed(salted, b"Server Key"))


def users_of(listed: str) -> dict[str, Keys]:
    """``name:password`` pairs between commas; pairs without a name or a password are left out."""
    pairs = (entry.partition(":") for entry in listed.split(","))
    return {user: keys_of(password, salt_of(user)) for user, _, password in pairs if user and password}


def challenge(first_bare: str, keys: Keys, nonce: str) -> str:
    """The server's first message to a client's (without its header)."""
    asked = attributes(first_bare).get("r", "")
    return f"r={asked}{nonce},s={base64.b64encode(keys.salt).decode()},i={keys.iterations}"


def attributes(message: str) -> dict[str, str]:
    return {part[0]: part[2:] for part in message.split(",") if part[1:2] == "="}


def proof(password: str, first_bare: str, server_first: str, final_bare: str) -> str:
    """What a client sends to show that it knows the password."""
    told = attributes(server_first)
    salted = hashlib.pbkdf2_hmac("sha256", password.encode(), base64.b64decode(told["s"]), int(told["i"]))
    client = signed(salted, b"Client Key")
    message = ",".join((first_bare, server_first, final_bare)).encode()
    return base64.b64encode(either(client, signed(hashlib.sha256(client).digest(), message))).decode()


def answer(keys: Keys, first_bare: str, server_first: str, final: str) -> str | None:
    """The server's last message, or None where the proof fails or cannot be read."""
    final_bare, found, sent = final.rpartition(",p=")
    try:
        raw = base64.b64decode(sent, validate=True)
    except ValueError:
        return None
    if not found or len(raw) != len(keys.stored):
        return None
    message = ",".join((first_bare, server_first, final_bare)).encode()
    client = either(raw, signed(keys.stored, message))
    if not hmac.compare_digest(hashlib.sha256(client).digest(), keys.stored):
        return None
    return f"v={base64.b64encode(signed(keys.server, message)).decode()}"


def logins(attempts: DataFrame, nonce: str = "server") -> DataFrame:
    """Attempts (user, password: the one on record, offered) as the exchange answers them: salt in hex and accepted.
    An unknown user (null password) is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, accepted = [], []
            for user, password, offered in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                salts.append(salt_of(user).hex())
                if password is None:
                    accepted.append(False)
                    continue
                keys, first = keys_of(password, salt_of(user)), f"n={user},r=client"
                told = challenge(first, keys, nonce)
                bare = f"c=biws,r={attributes(told)['r']}"
                accepted.append(answer(keys, first, told, f"{bare},p={proof(offered or '', first, told, bare)}") is not None)
            yield pa.RecordBatch.from_pydict({"user": batch.column(0), "salt": pa.array(salts, pa.string()), "accepted": pa.array(accepted, pa.bool_())})

    return attempts.where("user IS NOT NULL").select(F.col("user").cast("string"), F.col("password").cast("string"), F.col("offered").cast("string")).mapInArrow(run, "user string, salt string, accepted boolean")
