"""Text addresses of binary keys: a version byte, the key and a CRC16, in base 32.

Spark has no base 32, and ``conv`` takes some 3 microseconds for each 40 bits (45 an address, measured); so both ways are one
Arrow function each, over whole batches in numpy, and all else is read from what ``decode`` gives.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

#: Version bytes of the kinds of address. Fixed values of the format.
VERSIONS = {"account": 6 << 3, "seed": 18 << 3, "muxed": 12 << 3, "pre_auth_tx": 19 << 3, "hash_x": 23 << 3, "signed_payload": 15 << 3, "contract": 2 << 3, "pool": 11 << 3, "claimable": 1 << 3}
#: The kind that a first letter stands for. Fixed values of the format.
KINDS = {"G": "account", "S": "seed", "M": "muxed", "T": "pre_auth_tx", "X": "hash_x", "P": "signed_payload", "C": "contract", "L": "pool", "B": "claimable"}
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", np.uint8)
_VALUES = np.full(256, 255, np.uint8)
_VALUES[_LETTERS] = np.arange(32)
_KIND_OF = {v: k for k, v in VERSIONS.items()}


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it stands in there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _crc(rows: np.ndarray) -> np.ndarray:
    """The CRC16 of each row of bytes, by the polynomial 0x1021."""
    crc = np.zeros(len(rows), np.uint16)
    for column in rows.T:
        x = (crc >> 8) ^ column
        x ^= x >> 4
        crc = (crc << 8) ^ (x << 12) ^ (x << 5) ^ x
    return crc


def _spell(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes in base 32, the last letter filled with zero bits."""
    bits = np.unpackbits(rows, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 5))).reshape(len(rows), -1, 5)
    return _LETTERS[bits @ np.array([16, 8, 4, 2, 1], np.uint8)]


def encode_all(version: int, keys: list[bytes | None]) -> list[str | None]:
    out: list[str | None] = [None] * len(keys)
    sizes = np.array([-1 if k is None else len(k) for k in keys])
    for size in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == size).tolist()
        own = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), size)
        body = np.concatenate([np.full((len(at), 1), version, np.uint8), own], axis=1)
        crc = _crc(body)
        text = _spell(np.concatenate([body, (crc & 255).astype(np.uint8)[:, None], (crc >> 8).astype(np.uint8)[:, None]], axis=1))
        width, data = text.shape[1], text.tobytes().decode()
        for k, i in enumerate(at):
            out[i] = data[k * width : k * width + width]
    return out


def decode_all(texts: list[str | None]) -> list[tuple[int, bytes] | None]:
    """Version and key of each address; null for what ``encode_all`` would not have written."""
    out: list[tuple[int, bytes] | None] = [None] * len(texts)
    raw = [b"" if t is None else t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes[sizes >= 5]).tolist():
        at = np.flatnonzero(sizes == size)
        values = _VALUES[np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint8).reshape(len(at), size)]
        fine = (values < 32).all(1)
        at, values = at[fine], values[fine]
        if not len(at):
            continue
        bits = np.unpackbits(values[:, :, None], axis=2)[:, :, 3:].reshape(len(at), -1)
        whole = bits.shape[1] // 8
        if -(-whole * 8 // 5) != size:  # no number of bytes is written so
            continue
        rows = np.packbits(bits[:, : whole * 8], axis=1)
        crc = _crc(rows[:, :-2])
        fine = ~bits[:, whole * 8 :].any(1) & (rows[:, -2] == crc & 255) & (rows[:, -1] == crc >> 8)
        for i, row in zip(at[fine].tolist(), rows[fine], strict=True):
            out[i] = int(row[0]), row[1:-2].tobytes()
    return out


@lru_cache(maxsize=32)
def _encoder(version: int, session: str):
    @F.pandas_udf("string")
    def spelled(keys: pd.Series) -> pd.Series:
        return pd.Series(encode_all(version, [None if k is None else bytes(k) for k in keys]), dtype=object)

    return spelled


@lru_cache(maxsize=32)
def _decoder(session: str):
    @F.pandas_udf("version int, kind string, key binary")
    def read(texts: pd.Series) -> pd.DataFrame:
        found = decode_all([t if isinstance(t, str) else None for t in texts])
        versions = pd.array([x and x[0] for x in found], "Int32")
        return pd.DataFrame({"version": versions, "kind": pd.Series([x and _KIND_OF.get(x[0]) for x in found], dtype=object), "key": pd.Series([x and x[1] for x in found], dtype=object)})

    return read


def _session() -> str:
    """One function object a session, so that equal calls are seen to be equal and made once."""
    return SparkSession.active().sparkContext.applicationId


def encode(kind: str, key: Column) -> Column:
    """The address of a binary key; null for null."""
    return _encoder(VERSIONS[kind], _session())(key)


def decode(address: Column) -> Column:
    """What an address says: a struct of ``version``, ``kind`` (null for versions of no kind) and ``key``, all null if it is not exactly what ``encode`` makes."""
    return _decoder(_session())(address)


def kind_of(address: Column) -> Column:
    """The kind of an address by its first letter, null for others; whether it is valid is for ``decode`` to say."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.substring(address, 1, 1))


def muxed_parts(address: Column) -> Column:
    """The account and the number behind a muxed address; nulls if it is none."""

    d = decode(address)
    fine = (d["kind"] == "muxed") & (F.octet_length(d["key"]) == 40)
    number = F.conv(F.hex(F.substring(d["key"], 33, 8)), 16, 10).cast("decimal(20,0)")
    return F.struct(encode("account", F.when(fine, F.substring(d["key"], 1, 32))).alias("account"), F.when(fine, number).alias("id"))


def signed_payload(key: Column, payload: Column) -> Column:
    """A signer's key (32 bytes) and a payload of 1 to 64 bytes as an address: key, length, payload filled up to four bytes; else null."""
    size = F.octet_length(payload)
    filled = F.rpad(F.hex(payload), (F.ceil(size / 4) * 8).cast("int"), F.lit("0"))
    whole = F.unhex(F.concat(F.hex(key), F.lpad(F.hex(size), 8, "0"), filled))
    return encode("signed_payload", F.when((F.octet_length(key) == 32) & size.between(1, 64), whole))


def signed_payload_parts(address: Column) -> Column:
    """Key and payload of such an address; nulls if it is none, or not filled up with zeros."""

    def told(d: Column) -> Column:
        raw = F.hex(d["key"])
        size = F.conv(F.substring(raw, 65, 8), 16, 10).cast("int")
        rest = F.substring(raw, F.lit(73) + size * 2, F.length(raw))
        fine = (d["kind"] == "signed_payload") & (F.length(raw) >= 72) & F.substring(raw, 65, 6).eqNullSafe("000000") & size.between(1, 64) & (F.length(raw) == F.lit(72) + F.ceil(size / 4) * 8) & rest.rlike("^0*$")
        return F.struct(F.when(fine, F.unhex(F.substring(raw, 1, 64))).alias("key"), F.when(fine, F.unhex(F.substring(raw, F.lit(73), size * 2))).alias("payload"))

    return once(decode(address), told)


def encoder(kind: str):
    return lambda key: encode(kind, key)


def decoder(kind: str | None = None):
    """The key of an address of ``kind`` (none: of any version); null for all else."""
    if kind is None:
        return lambda address: decode(address)["key"]
    return lambda address: once(decode(address), lambda d: F.when(d["version"] == VERSIONS[kind], d["key"]))
