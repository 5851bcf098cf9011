"""Ids that are digests of what they stand for: fixed-width encodings in built-in functions, then SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Numbers that mark what is digested. Fixed values of the format.
REVOCATION, CONTRACT = 7, 8
FROM_ASSET, CONSTANT_PRODUCT = 1, 0


def word(value: Column | int) -> Column:
    """A 32-bit number in hex, high byte first."""
    return F.lit(f"{value & 0xFFFFFFFF:08X}") if isinstance(value, int) else F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 9, 8)


def long_word(value: Column) -> Column:
    """A 64-bit number in hex, high byte first."""
    return F.lpad(F.hex(value.cast("long")), 16, "0")


def network_id(passphrase: Column) -> Column:
    return F.unhex(F.sha2(passphrase, 256))


def _account(key: Column) -> Column:
    return F.concat(word(0), F.hex(key))


def asset_bytes(code: Column, issuer: Column) -> Column:
    """An asset's encoding: a null code is the native one; codes of up to 4 bytes are filled to 4, longer ones to 12. ``issuer`` is a key of 32 bytes.

    Null for codes of no byte or of more than 12, and for issuers of other lengths.
    """
    size = F.octet_length(code)
    code_hex = F.hex(F.encode(code, "UTF-8"))
    filled = F.when(size.between(1, 4), F.concat(word(1), F.rpad(code_hex, 8, "0"))).when(size.between(5, 12), F.concat(word(2), F.rpad(code_hex, 24, "0")))
    issued = F.when(F.octet_length(issuer) == 32, F.concat(filled, _account(issuer)))
    return F.unhex(F.when(code.isNull(), word(0)).otherwise(issued))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.unhex(F.concat(*parts)), 256))


def contract_id(asset: Column, network: Column) -> Column:
    """The id of the contract that stands for an asset (``asset_bytes``) on a network (``network_id``)."""
    return _digest(word(CONTRACT), F.hex(network), word(FROM_ASSET), F.hex(asset))


def pool_id(asset_a: Column, asset_b: Column, fee: Column | int) -> Column:
    """The id of the pool of two assets (``asset_bytes``); null unless the first sorts before the second."""
    return F.when(asset_a < asset_b, _digest(word(CONSTANT_PRODUCT), F.hex(asset_a), F.hex(asset_b), word(fee)))


def revoked_balance_id(*, account: Column, sequence: Column, op_index: Column, pool: Column, asset: Column) -> Column:
    """The id of the claimable balance that a revoked trust line makes of a pool share: by the transaction's account and sequence."""
    return _digest(word(REVOCATION), _account(account), long_word(sequence), word(op_index), F.hex(pool), F.hex(asset))
