"""Positions in the ledger as one sortable number, cursors, and object keys of ledger files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bits of the parts of a position below the ledger sequence. Fixed values of the format.
TX_BITS, OP_BITS = 20, 12
#: Sequences are unsigned 32-bit numbers and so are held in longs.
MAX_SEQUENCE = 4294967295


def position(ledger: Column, tx: Column, op: Column) -> Column:
    """``ledger << 32 | tx << 12 | op``; a part out of its range is an error."""
    ledger, tx, op = (c.cast("long") for c in (ledger, tx, op))
    bad = (ledger < 0) | (ledger >= 1 << 31) | (tx < 0) | (tx >= 1 << TX_BITS) | (op < 0) | (op >= 1 << OP_BITS)
    packed = F.shiftleft(ledger, TX_BITS + OP_BITS).bitwiseOR(F.shiftleft(tx, OP_BITS)).bitwiseOR(op)
    return F.when(bad, F.raise_error(F.lit("position out of range")).cast("long")).otherwise(packed)


def ledger_of(pos: Column) -> Column:
    return F.shiftright(pos, TX_BITS + OP_BITS)


def tx_of(pos: Column) -> Column:
    return F.shiftright(pos, OP_BITS).bitwiseAND(F.lit((1 << TX_BITS) - 1))


def op_of(pos: Column) -> Column:
    return pos.bitwiseAND(F.lit((1 << OP_BITS) - 1))


def after_ledger(ledger: Column) -> Column:
    """The last position of a ledger."""
    return F.shiftleft(ledger.cast("long"), 32).bitwiseOR(F.lit((1 << 32) - 1))


def next_op(pos: Column) -> Column:
    """The following operation's position; after the last operation number the next ledger begins."""
    return F.when(op_of(pos) == (1 << OP_BITS) - 1, F.shiftleft(ledger_of(pos) + 1, 32)).otherwise(pos + 1)


def position_range(first: Column, last: Column) -> tuple[Column, Column]:
    """From (included) and to (left out) positions of the ledgers ``first`` to ``last``; ledger 1 starts at 0."""
    return F.when(first == 1, F.lit(0).cast("long")).otherwise(F.shiftleft(first.cast("long"), 32)), F.shiftleft(last.cast("long") + 1, 32)


def cursor(pos: Column, index: Column) -> Column:
    """An event's cursor, which sorts as text."""
    return F.format_string("%019d-%010d", pos, index.cast("long"))


def cursor_parts(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "-")
    return parts[0].cast("long"), parts[1].cast("long")


def file_start(sequence: Column, per_file: int) -> Column:
    return F.floor(sequence / per_file).cast("long") * per_file


def file_end(sequence: Column, per_file: int) -> Column:
    return F.least(file_start(sequence, per_file) + per_file - 1, F.lit(MAX_SEQUENCE))


def object_key(sequence: Column, *, per_file: int, files_per_partition: int, extension: str = "zst") -> Column:
    """The path of the file that holds ``sequence``: newest first in listings, as names begin with the complement in hex."""
    per_partition = per_file * files_per_partition

    def span(first: Column, last: Column) -> Column:
        return F.concat(F.lpad(F.hex(F.lit(MAX_SEQUENCE) - first), 8, "0"), F.lit("--"), first.cast("string"), F.when(last > first, F.concat(F.lit("-"), last.cast("string"))).otherwise(F.lit("")))

    name = F.concat(span(file_start(sequence, per_file), file_end(sequence, per_file)), F.lit(f".xdr.{extension}"))
    if files_per_partition <= 1:
        return name
    return F.concat(span(file_start(sequence, per_partition), file_end(sequence, per_partition)), F.lit("/"), name)


def key_range(key: Column) -> tuple[Column, Column]:
    """First and last sequence that an object key names."""
    pattern = r"--(\d+)(?:-(\d+))?\.xdr\."
    first = F.regexp_extract(key, pattern, 1)
    last = F.regexp_extract(key, pattern, 2)
    return F.try_to_number(first, F.lit("9999999999")).cast("long"), F.coalesce(F.try_to_number(last, F.lit("9999999999")), F.try_to_number(first, F.lit("9999999999"))).cast("long")


def is_checkpoint(sequence: Column, every: int = 64) -> Column:
    return F.pmod(sequence + 1, F.lit(every)) == 0


def next_checkpoint(sequence: Column, every: int = 64) -> Column:
    """The first checkpoint at or after ``sequence``, at most the greatest sequence."""
    return F.least(F.ceil((sequence + 1) / every).cast("long") * every - 1, F.lit(MAX_SEQUENCE))


def previous_checkpoint(sequence: Column, every: int = 64) -> Column:
    """The last checkpoint before or at ``sequence``, the first one if there is none."""
    return F.greatest(F.floor((sequence + 1) / every).cast("long") * every - 1, F.lit(every - 1).cast("long"))


def category_path(category: Column, checkpoint: Column, extension: str = "xdr.gz") -> Column:
    """Where an archive keeps a checkpoint's file of a category."""
    h = F.lower(F.lpad(F.hex(checkpoint.cast("long")), 8, "0"))
    return F.concat_ws("/", category, F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2), F.concat(category, F.lit("-"), h, F.lit(f".{extension}")))


def path_prefixes(first: Column, last: Column, every: int = 64) -> Column:
    """The distinct folders (three hex levels) of the checkpoints from ``first`` to ``last``; a folder is what the last two hex digits leave."""
    if not 1 <= every <= 256:
        raise ValueError("a folder must hold a checkpoint")

    def folder(n: Column) -> Column:
        h = F.lower(F.lpad(F.hex(n), 6, "0"))
        return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2))

    return F.transform(F.sequence(F.shiftright(next_checkpoint(first, every), 8), F.shiftright(next_checkpoint(last, every), 8)), folder)


def path_prefix_text(first: Column, last: Column, every: int = 64) -> Column:
    """``path_prefixes`` as one text, parted by commas, in their order (which is the order of their text); null where ``last`` comes first.

    Made of whole second levels of 256 folders, each of them one replacement in a fixed text, as ranges can be long; the
    first and the last lose what lies outside.
    """
    if not 1 <= every <= 256:
        raise ValueError("a folder must hold a checkpoint")
    low, high = (F.shiftright(next_checkpoint(x, every), 8) for x in (first, last))
    level = "".join(f",@{k:02x}" for k in range(256))
    size = len("00/00/00,")

    def upper(n: Column) -> Column:
        h = F.lower(F.lpad(F.hex(n), 4, "0"))
        return F.concat(F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"))

    text = F.array_join(F.transform(F.sequence(F.shiftright(low, 8), F.shiftright(high, 8)), lambda n: F.replace(F.lit(level), F.lit("@"), upper(n))), "")
    start = low.bitwiseAND(F.lit(255)) * size + 2  # places count from 1, and the first is a comma
    return F.when(low <= high, F.substring(text, start.cast("int"), ((high - low + 1) * size - 1).cast("int")))
