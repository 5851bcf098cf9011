"""Addresses one by one, with the standard library."""

import base64
import binascii


def encode_one(version, key):
    body = bytes([version]) + key
    return base64.b32encode(body + binascii.crc_hqx(body, 0).to_bytes(2, "little")).decode().rstrip("=")


def decode_one(text):
    try:
        raw = base64.b32decode(text + "=" * (-len(text) % 8))
    except (binascii.Error, ValueError):
        return None
    if len(raw) < 3 or encode_one(raw[0], raw[1:-2]) != text:
        return None
    return raw[0], raw[1:-2]
