"""Nested contract values as VARIANT: an object with one field, named after the kind of value.

``{"symbol": "transfer"}``, ``{"i128": "-5"}``, ``{"u64": "7"}``, ``{"bool": true}``, ``{"bytes": "0aff"}``, ``{"string": "x"}``,
``{"address": "G..."}``, ``{"void": null}``, ``{"vec": [..]}``, ``{"map": [{"key": .., "val": ..}, ..]}``,
``{"instance": {"executable": .., "storage": [{"key": .., "val": ..}, ..]}}``, ``{"ledger_key_contract_instance": null}``. Numbers wider
than 32 bits are texts. A vec or map that is null is not one without elements.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

ENTRIES = "array<struct<key:variant,val:variant>>"
WIDE = ("i64", "u64", "i128", "u128", "i256", "u256", "timepoint", "duration")


def parsed(text: Column) -> Column:
    """The value in a JSON text; null where it is no JSON."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """What is at a path of a value; null where nothing is, or nothing of that type."""
    return F.try_variant_get(value, path, kind)


def has(value: Column, kind: str) -> Column:
    """Is the value of this kind? False for null."""
    return F.coalesce(F.try_variant_get(value, f"$.{kind}", "variant").isNotNull(), F.lit(False))


def text_of(value: Column, kind: str) -> Column:
    """The content of a value of this kind as text; null for other kinds."""
    return F.try_variant_get(value, f"$.{kind}", "string")


def whole(value: Column, kind: str = "i128") -> Column:
    """A whole number of this kind as its decimal text; null for other kinds and for text that is no number."""
    text = text_of(value, kind)
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]{0,77})$"), text)


def flag(value: Column) -> Column:
    return F.try_variant_get(value, "$.bool", "boolean")


def blob(value: Column) -> Column:
    """The bytes of a value of bytes."""
    text = text_of(value, "bytes")
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))


def items(value: Column) -> Column:
    """The elements of a vec; null for other kinds and for the null vec."""
    return F.try_variant_get(value, "$.vec", "array<variant>")


def entries(value: Column, path: str = "$.map") -> Column:
    """The entries of a map in their order, as structs of ``key`` and ``val``; null for other kinds and for the null map."""
    return F.try_variant_get(value, path, ENTRIES)


def canonical(value: Column) -> Column:
    """A text that two values share exactly if they are equal: same kinds, same contents, elements and entries in the same order."""
    return F.to_json(value)


def same(a: Column, b: Column) -> Column:
    """Deep equality. Maps with their entries in another order differ."""
    return canonical(a) == canonical(b)


def _said(value: dict) -> str:
    (kind, x), *more = value.items()
    if more:
        return "unknown"
    pairs = lambda entries: "[" + " ".join(f"{{{_said(e['key'])} {_said(e['val'])}}}" for e in entries) + "]"
    if kind == "bool":
        return "true" if x else "false"
    if kind == "void":
        return "(void)"
    if kind == "error":
        (what, code), *_ = x.items()
        return f"{what}({code})"
    if kind == "vec":
        return "nil" if x is None else "[" + " ".join(map(_said, x)) + "]"
    if kind == "map":
        return "nil" if x is None else pairs(x)
    if kind == "ledger_key_contract_instance":
        return "(LedgerKeyContractInstance)"
    if kind == "ledger_key_nonce":
        return f"{int(x):X}"
    if kind == "instance":
        runs = x["executable"]
        out = "(StellarAssetContract)" if runs == "stellar_asset" else str(next(iter(runs.values())))
        return f"{out}: {pairs(x['storage'])}" if x.get("storage") else out
    return str(x)


def rendered(value: Column) -> Column:
    """A value as text for people: bytes in hex, vecs ``[a b]``, maps ``[{k v} {k v}]``, nothing ``(void)``, other kinds ``unknown``.

    Values nest to any depth, which no built-in function follows, so this one runs in Arrow batches; it is for output only.
    """

    @F.pandas_udf("string")
    def render(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return _said(json.loads(text))
            except (AttributeError, KeyError, TypeError, ValueError, StopIteration):
                return "unknown"

        return texts.map(one)

    return render(canonical(value))
