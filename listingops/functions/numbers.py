"""Money, time, checksums and colour arithmetic as columns. Money is whole cents in bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingops.sources import dims


def cents_text(cents: Column) -> Column:
    """Cents as euros with two decimals; null as the empty text."""
    return F.coalesce((cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string"), F.lit(""))


def cents_of_text(text: Column) -> Column:
    """Euro text as cents, half to even; null where it is no finite number."""
    number = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15), F.rint(number * 100).cast("long"))


def gross_profit(state: Column, price: Column, cost_snapshot: Column) -> Column:
    """Price less the frozen cost, only of a sale that stands and has a price."""
    return F.when((state == "vendida") & price.isNotNull(), price - cost_snapshot)


def chosen_price_cents(price: Column) -> Column:
    return F.when(price > 0, F.rint(price * 100).cast("long"))


def cost_cents(cost: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.rint(F.coalesce(cost, F.lit(0.0)) * 100).cast("long"))


def usage_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """US dollars; prices are for a million tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def seconds_between(a: Column, b: Column) -> Column:
    """From a to b; null where either is. Times without a zone are taken as UTC."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return (micros(b) - micros(a)) / 1e6


def ean_valid(digits: Column) -> Column:
    """The check digit of EAN-8, UPC-12, EAN-13 and GTIN-14: weights 3 and 1 from the right."""
    body = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.substring(body, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    right = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == F.substring(digits, F.length(digits), F.lit(1)).try_cast("int")
    return F.when(digits.rlike("^[0-9]+$") & F.length(digits).isin(*dims.EAN_LENGTHS), right).otherwise(F.lit(False))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of sRGB channels 0 to 255."""

    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    def root(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x, y, z = (root(v) for v in ((lr * 0.4124 + lg * 0.3576 + lb * 0.1805) / 0.95047, lr * 0.2126 + lg * 0.7152 + lb * 0.0722, (lr * 0.0193 + lg * 0.1192 + lb * 0.9505) / 1.08883))
    return y * 116 - 16, (x - y) * 500, (y - z) * 200


def hash_bits(phash: Column) -> Column:
    """A 16-digit hex perceptual hash as 64 bits; null where it is not one."""
    return F.when(phash.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(phash, 16, -10).cast("long"))
