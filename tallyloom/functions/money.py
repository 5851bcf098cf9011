"""Exact arithmetic on amounts and rational prices. Amounts are 64-bit integers of 10**-7 units."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.staged import staged

UNIT_DIGITS = 7
MAX_AMOUNT = 9223372036854775807


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _fit(wide: Column, what: str) -> Column:
    """``wide`` as a long, or an error: casts and ``div`` of decimals would wrap without one."""
    return F.when(wide > F.lit(MAX_AMOUNT).cast("decimal(38,0)"), F.raise_error(F.lit(what)).cast("long")).otherwise(wide.cast("long"))


def _checked(x: Column, n: Column, d: Column, value: Column) -> Column:
    return F.when((x < 0) | (n < 0) | (d <= 0), F.raise_error(F.lit("fraction of a negative, or by zero")).cast("long")).otherwise(value)


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs, both above or at 0."""
    return F.call_function("div", a, b)


def _short(x: Column, n: Column, d: Column) -> Column:
    """Is this a sound fraction whose product 63 bits hold?"""
    return (x >= 0) & (n >= 0) & (d > 0) & (x <= _div(F.lit(MAX_AMOUNT), F.greatest(n, F.lit(1).cast("long"))))


def mul_floor(x: Column, n: Column, d: Column) -> Column:
    """The floor of x * n / d, exact in 128 bits; a negative, a zero divisor or a result above 64 bits is an error."""
    x, n, d = (c.cast("long") for c in (x, n, d))
    product = _wide(x) * _wide(n)
    wide = _checked(x, n, d, _fit(F.floor((product - F.pmod(product, _wide(d))) / _wide(d)).cast("decimal(38,0)"), "result above 64 bits"))
    return F.when(_short(x, n, d), _div(x * n, d)).otherwise(wide)


def mul_ceil(x: Column, n: Column, d: Column) -> Column:
    """The ceiling of x * n / d, like ``mul_floor``."""
    x, n, d = (c.cast("long") for c in (x, n, d))
    product = _wide(x) * _wide(n)
    rest = F.pmod(product, _wide(d))
    down = F.floor((product - rest) / _wide(d)).cast("decimal(38,0)")
    wide = _checked(x, n, d, _fit(down + F.when(rest > 0, 1).otherwise(0), "result above 64 bits"))
    return F.when(_short(x, n, d), _div(x * n, d) + F.when(x * n % d > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).otherwise(wide)


def buying_units(amount: Column, needed: Column, n: Column, d: Column) -> tuple[Column, Column]:
    """What an offer of ``amount`` at n / d can take of ``needed``: (bought, sold).

    With n > d a unit sold is worth more than one bought and the amount is the bound itself; else the bound is rounded
    to what can be paid back. Each step stands several times in the next, so tables go by ``with_buying_units``.
    """
    bound = F.when(n > d, amount).otherwise(mul_ceil(mul_floor(amount, n, d), d, n))
    bought = F.least(bound, needed)
    return bought, mul_ceil(bought, n, d)


def with_buying_units(rows: DataFrame, *, amount: str = "amount", needed: str = "needed", n: str = "n", d: str = "d") -> DataFrame:
    """``rows`` with ``bought`` and ``sold`` as by ``buying_units``, each step made once a row."""
    c = F.col
    rows = staged(rows, {"__paid": F.when(c(n) <= c(d), mul_floor(c(amount), c(n), c(d)))})
    rows = staged(rows, {"bought": F.least(F.when(c(n) > c(d), c(amount)).otherwise(mul_ceil(c("__paid"), c(d), c(n))), c(needed))})
    return staged(rows, {"sold": mul_ceil(c("bought"), c(n), c(d))}).drop("__paid")


def price_equal(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    return n1.cast("long") * d2.cast("long") == n2.cast("long") * d1.cast("long")


def price_cheaper(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    return n1.cast("long") * d2.cast("long") < n2.cast("long") * d1.cast("long")


def floor_div(top: Column, bottom: Column) -> Column:
    """floor(top / bottom) of decimals without a fraction, bottom above 0, as decimal(38,0); exact where 38 digits hold ``top``."""
    return F.floor((top - F.pmod(top, bottom)) / bottom).cast("decimal(38,0)")


def price_order(n: Column, d: Column) -> Column:
    """A key by which fractions of 63-bit numbers sort exactly: the whole part and 126 bits after it, as two fractions differ by more.

    Three longs; where the divisor has 31 bits, the bits come by 31 or 32 from divisions of longs, else from decimals.
    """
    n, d = n.cast("long"), d.cast("long")
    short = (n >= 0) & d.between(1, 1 << 31)
    rests = [n % d]
    for bits in (32, 31, 32):
        rests.append(F.shiftleft(rests[-1], bits) % d)
    part = lambda i: F.shiftleft(_div(F.shiftleft(rests[i], 32), d), 31).bitwiseOR(_div(F.shiftleft(rests[i + 1], 31), d))
    wide_n, wide_d, step = n.cast("decimal(38,0)"), _wide(d), F.lit(str(1 << 63)).cast("decimal(19,0)")
    more = (F.pmod(wide_n, wide_d).cast("decimal(19,0)") * step).cast("decimal(38,0)")
    last = (F.pmod(more, wide_d).cast("decimal(19,0)") * step).cast("decimal(38,0)")
    made = {"whole": (_div(n, d), wide_n), "near": (part(0), more), "far": (part(2), last)}
    return F.struct(*[F.when(short, few).otherwise(floor_div(many, wide_d).cast("long")).alias(name) for name, (few, many) in made.items()])


def float_text(x: Column) -> Column:
    """A double with seven decimals."""
    return F.format_string("%.7f", x)


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's steps, two at a time and as many as the smaller number can take; 94 are enough for 64-bit numbers."""
    a, b = a.cast("long"), b.cast("long")
    turns = F.when((a > 0) & (b > 0), F.ceil(F.log2(F.least(a, b).cast("double")) * 0.72025).cast("int") + 2).otherwise(47)
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def twice(acc: Column, _: Column) -> Column:
        rest = F.pmod(acc["x"], acc["y"])
        return F.when(acc["y"] == 0, acc).otherwise(F.when(rest == 0, pair(acc["y"], rest)).otherwise(pair(rest, F.pmod(acc["y"], rest))))

    return F.aggregate(F.sequence(F.lit(1), turns), pair(a, b), twice)["x"]


def price_text(n: Column, d: Column) -> Column:
    """n / d with seven decimals, halves away from zero."""
    return F.round(n.cast("decimal(19,0)") / d.cast("decimal(10,0)"), UNIT_DIGITS).cast("decimal(30,7)").cast("string")


def parse_amount(text: Column) -> Column:
    """Units of a decimal text; more than seven decimals, other text or a value above 64 bits is null."""
    fine = text.rlike(r"^-?\d{1,12}(\.\d{1,7})?$")
    return F.when(fine, (text.try_cast("decimal(27,7)") * F.lit(10_000_000)).try_cast("long"))


def amount_text(units: Column) -> Column:
    """Units as a decimal with seven places."""
    return (units.cast("decimal(19,0)") / F.lit(10_000_000).cast("decimal(8,0)")).cast("decimal(20,7)").cast("string")


def long_amount_text(digits: Column) -> Column:
    """An integer text of any length divided by 10**7, as text with seven places, exact."""
    bare = F.regexp_replace(digits, "^-", "")
    padded = F.lpad(bare, F.greatest(F.char_length(bare), F.lit(UNIT_DIGITS + 1)), F.lit("0"))
    at = F.char_length(padded) - UNIT_DIGITS
    return F.concat(F.when(digits.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.substring(padded, F.lit(1), at), F.lit("."), F.substring(padded, at + 1, F.lit(UNIT_DIGITS)))


def from_halves(high: Column, low: Column) -> Column:
    """A signed 128-bit number from its signed high and unsigned low 64 bits (low as a decimal), where 38 digits hold it; else null."""
    return F.try_add(F.try_multiply(high.cast("decimal(19,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(38,0)"), low.cast("decimal(20,0)")).cast("decimal(38,0)")


def text_from_halves(high: Column, low: Column) -> Column:
    """A signed 128-bit number from its signed high and unsigned low 64 bits (low as a decimal), as text, exact over the whole range.

    2**64 is 10**19 and some, so the number is a * 10**19 + b with b from products that 38 digits hold.
    """
    step = F.lit("1" + "0" * 19).cast("decimal(20,0)")
    rest = (high.cast("decimal(19,0)") * F.lit("8446744073709551616").cast("decimal(19,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")
    down = F.pmod(rest, step).cast("decimal(20,0)")
    up = (high.cast("decimal(19,0)") + floor_div(rest, step)).cast("decimal(21,0)")
    below = high < 0
    a = F.when(below, F.when(down > 0, -up - 1).otherwise(-up)).otherwise(up).cast("decimal(21,0)")
    b = F.when(below & (down > 0), step - down).otherwise(down).cast("decimal(20,0)")
    digits = F.when(a > 0, F.concat(a.cast("string"), F.lpad(b.cast("string"), 19, "0"))).otherwise(b.cast("string"))
    return F.concat(F.when(below, F.lit("-")).otherwise(F.lit("")), digits)


def wide_text_from_halves(high: Column, low: Column) -> Column:
    """``text_from_halves`` for a high part of up to 38 digits (a decimal without a fraction), so for numbers beyond 128 bits too.

    The magnitude is H * 2**64 + L, H is h1 * 10**19 + h0 and 2**64 is 10**19 and some, so it has three digits of 10**19,
    each from products that 38 digits hold.
    """
    step, more, two64 = (F.lit(x).cast("decimal(20,0)") for x in ("1" + "0" * 19, "8446744073709551616", "18446744073709551616"))
    low, below = low.cast("decimal(20,0)"), high < 0
    high = high.cast("decimal(38,0)")
    size = F.when(below, F.lit(0).cast("decimal(1,0)") - high).otherwise(high).cast("decimal(38,0)")  # ``abs`` and minus signs keep 34 digits
    borrow = below & (low > 0)
    size, rest = F.when(borrow, size - 1).otherwise(size).cast("decimal(38,0)"), F.when(borrow, two64 - low).otherwise(low).cast("decimal(20,0)")
    near, far = F.pmod(size, step).cast("decimal(19,0)"), floor_div(size, step).cast("decimal(19,0)")
    part = lambda x, y: (x * more.cast("decimal(19,0)")).cast("decimal(38,0)") + y
    first = part(near, rest).cast("decimal(38,0)")
    second = part(far, near + floor_div(first, step)).cast("decimal(38,0)")
    third = far + floor_div(second, step)
    digit = lambda x: F.lpad(x.cast("decimal(20,0)").cast("string"), 19, "0")
    digits = F.concat(third.cast("decimal(20,0)").cast("string"), digit(F.pmod(second, step)), digit(F.pmod(first, step)))
    return F.concat(F.when(below, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(digits, "^0+(?=.)", ""))


def parse_raw(text: Column) -> Column:
    """An integer text of up to 38 digits as a decimal; null for other text."""
    return F.when(text.rlike(r"^-?\d{1,38}$"), text.try_cast("decimal(38,0)"))


def pool_payout(reserve_in: Column, reserve_out: Column, received: Column, fee_bps: Column) -> Column:
    """What a constant-product pool pays for ``received``: floor((1 - F) * Y * x / (X + x - F * x)).

    Null where an input is negative or zero, the fee is not in [0, 10000), the product needs more than 38 digits, or
    nothing is paid.
    """
    keep = (F.lit(10_000) - fee_bps).cast("decimal(5,0)")
    top = F.try_multiply(F.try_multiply(keep, _wide(received)).cast("decimal(24,0)"), _wide(reserve_out)).cast("decimal(38,0)")
    bottom = (_wide(reserve_in) * F.lit(10_000).cast("decimal(5,0)") + keep * _wide(received)).cast("decimal(26,0)")
    paid = F.floor((top - F.pmod(top, bottom)) / bottom).cast("decimal(38,0)")
    fine = (reserve_in > 0) & (reserve_out > 0) & (received > 0) & (fee_bps >= 0) & (fee_bps < 10_000)
    return F.when(fine & (paid > 0) & (paid <= F.lit(MAX_AMOUNT)), paid.cast("long"))


def pool_expectation(reserve_in: Column, reserve_out: Column, paid: Column, fee_bps: Column) -> Column:
    """What a constant-product pool takes to pay ``paid``: ceil(X * y / ((Y - y) * (1 - F))); null where it cannot."""
    keep = (F.lit(10_000) - fee_bps).cast("decimal(5,0)")
    top = F.try_multiply(F.try_multiply(_wide(reserve_in), F.lit(10_000).cast("decimal(5,0)")).cast("decimal(24,0)"), _wide(paid)).cast("decimal(38,0)")
    bottom = ((_wide(reserve_out) - _wide(paid)) * keep).cast("decimal(26,0)")
    rest = F.pmod(top, bottom)
    taken = F.floor((top - rest) / bottom).cast("decimal(38,0)") + F.when(rest > 0, 1).otherwise(0)
    fine = (reserve_in > 0) & (reserve_out > 0) & (paid > 0) & (paid < reserve_out) & (fee_bps >= 0) & (fee_bps < 10_000)
    return F.when(fine, F.when(taken <= F.lit(MAX_AMOUNT) - reserve_in, taken.cast("long")))


def nearest_price(text: str | None) -> tuple[int, int] | None:
    """The last continued-fraction approximation n / d of a decimal text whose parts fit 31 bits; null if there is none."""
    try:
        left = Fraction(text)
    except (TypeError, ValueError, ZeroDivisionError):
        return None
    top, bottom, best = (0, 1), (1, 0), None
    while left >= 0:
        whole = left.numerator // left.denominator
        top, bottom = (top[1], whole * top[1] + top[0]), (bottom[1], whole * bottom[1] + bottom[0])
        if max(top[1], bottom[1]) > 2147483647:
            break
        best = (top[1], bottom[1])
        if left == whole:
            break
        left = 1 / (left - whole)
    return best if best and best[0] > 0 and best[1] > 0 else None


def parse_price(text: Column) -> Column:
    """Decimal texts as rational prices."""

    @F.pandas_udf("struct<n:int,d:int>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest_price(t) or (None, None) for t in texts], columns=["n", "d"]).astype("Int32")

    return parse(text)
