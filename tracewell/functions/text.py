"""Labels of nodes as text: tokens, prefixes, weights, hashed features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(*parts: Column) -> Column:
    """Attributes joined by a space; a missing one is the text None."""
    return F.concat_ws(" ", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def path_tokens(text: Column) -> Column:
    """Back slashes as slashes, slashes as tokens of their own, then split at white space."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"\\+", "/"), "/", " / ")
    return F.array_remove(F.split(spaced, r"[ \t\r\n]+"), "")


def net_tokens(text: Column) -> Column:
    """Addresses: dots and colons as tokens of their own."""
    return F.array_remove(F.split(F.regexp_replace(text, r"([.:])", r" $1 "), r"[ \t\r\n]+"), "")


def prefixes(text: Column, sep: str) -> Column:
    """Every prefix of a path or an address, shortest first."""
    parts = F.array_remove(F.split(text, "\\" + sep), "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def token_weights(n: Column, percentage: float) -> Column:
    """An arithmetic series of n weights that sums to 1 and falls by percentage / 100 / n from one token to the next."""
    d = -percentage / (100.0 * n)
    first = 1.0 / n - d * (n - 1) / 2.0
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: first + i * d)).otherwise(F.array().cast("array<double>"))


def hashed(tokens: Column, dims: int) -> Column:
    """Signed feature hashing to dims numbers, with Euclidean length 1."""
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dims))
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.when(slot(t) == i, sign(t)).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    return F.transform(raw, lambda x: x / norm)


def one_hot(index: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == index).cast("int"))


def positional(position: Column, dims: int) -> Column:
    """Sines and cosines of a position, alternating."""
    angle = lambda i: position / F.pow(F.lit(10000.0), 2.0 * F.floor(i / 2) / dims)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))
