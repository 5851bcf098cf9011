"""Asset names: ``native`` or ``code:issuer``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical(code: Column, issuer: Column) -> Column:
    return F.when(code.isNull() | (code == "native"), F.lit("native")).otherwise(F.concat_ws(":", code, issuer))


def display(kind: Column, code: Column, issuer: Column) -> Column:
    return F.when(kind == "native", F.lit("native")).otherwise(F.concat_ws("/", kind, code, issuer))


def parse_list(text: Column) -> Column:
    """A comma-separated list as (code, issuer) structs; parts that are neither native nor ``code:issuer`` have null codes."""

    def one(part: Column) -> Column:
        part = F.trim(part)
        bits = F.split(part, ":")
        good = (F.size(bits) == 2) & bits[0].rlike("^[A-Za-z0-9]{1,12}$") & (F.char_length(bits[1]) > 0)
        return F.when(F.lower(part) == "native", F.struct(F.lit("native").alias("code"), F.lit(None).cast("string").alias("issuer"))).otherwise(F.struct(F.when(good, bits[0]).alias("code"), F.when(good, F.get(bits, F.lit(1))).alias("issuer")))

    return F.transform(F.filter(F.split(text, ","), lambda p: F.trim(p) != ""), one)


def parse_one(text: Column) -> Column:
    """A single ``native`` or ``code:issuer`` as a struct; null parts for other text, also for lists."""
    return F.when(~F.contains(text, F.lit(",")), F.get(parse_list(text), F.lit(0)))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def constant_case(kebab: Column) -> Column:
    return F.upper(F.replace(kebab, F.lit("-"), F.lit("_")))


def address_parts(text: Column) -> Column:
    """``name*domain`` as a struct; null parts where there is not exactly one star or a part is empty."""
    bits = F.split(text, r"\*")
    good = (F.size(bits) == 2) & (F.get(bits, F.lit(0)) != "") & (F.get(bits, F.lit(1)) != "")
    return F.struct(F.when(good, F.get(bits, F.lit(0))).alias("name"), F.when(good, F.get(bits, F.lit(1))).alias("domain"))
