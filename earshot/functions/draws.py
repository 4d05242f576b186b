"""Seeded draws that depend on a row's key alone: the same on any partitioning, and the same in other SQL engines.

A draw is the MD5 of seed, salt and key, joined by bars; its first eight hexadecimal digits make a number in [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticket(key: Column, salt: str, seed: int = 0) -> Column:
    """A string to rank keys by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")))


def uniform(key: Column, salt: str, seed: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    u = F.conv(F.substring(ticket(key, salt, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return u if (low, high) == (0.0, 1.0) else F.lit(float(low)) + u * F.lit(float(high - low))


def whole(key: Column, salt: str, n: Column | int, seed: int = 0) -> Column:
    """A whole number in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(key, salt, seed) * n).cast("bigint")


def normal(key: Column, salt: str, seed: int = 0) -> Column:
    """A standard normal draw (Box-Muller)."""
    u, v = uniform(key, salt + ".u", seed), uniform(key, salt + ".v", seed)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def distinct(key: Column, salt: str, size: Column, n: int, seed: int = 0) -> Column:
    """An array of (nth, number): min(n, size) different numbers in [0, size), each as likely as another.

    One number is drawn in each of ``n`` equal parts of the range, and all are turned by one drawn step, so that a draw
    costs n whatever the size.
    """
    turn = whole(key, f"{salt}.turn", size, seed)

    def one(i: Column) -> Column:
        low, high = F.floor(size * i / n), F.floor(size * (i + 1) / n)
        drawn = low + whole(F.concat_ws("/", key.cast("string"), i.cast("string")), salt, high - low, seed)
        return F.struct(i.alias("nth"), F.when(high > low, F.pmod(drawn + turn, size)).alias("number"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), lambda x: x["number"].isNotNull())
