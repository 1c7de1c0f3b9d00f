"""Column expressions: seeded hashes and vector arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed: int, *keys: Column) -> Column:
    """A hash of the keys that any engine can repeat: ``md5('key|key|seed')``."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))


def hash_unit(seed: int, *keys: Column) -> Column:
    """A number from 0 up to 1 made of the first 32 bits of ``seeded_md5``."""
    return F.conv(F.substring(seeded_md5(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is worked out once a row: inside a lambda an expression would be worked out anew for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def l2_normalise(a: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    return bound(a, lambda v: bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def quantise_int8(a: Column) -> Column:
    """Clipped to [-1, 1], scaled by 127 and cut towards zero."""
    return F.transform(a, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 127).cast("tinyint"))


def dequantise(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.lit(127.0))


def onehot_label(a: Column) -> Column:
    """The click flag of a two-element one-hot list; anything else is null."""
    return F.when(F.size(a) == 2, F.get(a, 1).cast("tinyint"))


def argmax(a: Column) -> Column:
    """Position of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def pad_left(a: Column, length: int, pad: int = -1) -> Column:
    """The newest ``length`` elements, right-aligned."""
    kept = F.slice(a, -F.least(F.size(a), F.lit(length)), F.least(F.size(a), F.lit(length)))
    return F.when(F.size(a) == 0, F.array_repeat(F.lit(pad).cast("bigint"), length)).otherwise(
        F.concat(F.array_repeat(F.lit(pad).cast("bigint"), F.lit(length) - F.least(F.size(a), F.lit(length))), kept)
    )


def normalise_key(k: Column) -> Column:
    """Callers without a name share one key."""
    plain = F.lower(F.trim(F.coalesce(k, F.lit(""))))
    return F.when(plain.isin("", "unknown"), F.lit("__anonymous__")).otherwise(k)


def client_key(forwarded: Column, peer: Column) -> Column:
    """The first entry of a forwarded list, else the peer, else ``unknown``."""
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    return F.coalesce(F.nullif(first, F.lit("")), peer, F.lit("unknown"))
