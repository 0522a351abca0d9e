"""Keys to groups: native by default, BLAKE2b where another store's grouping must be met."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def next_prime(n: int) -> int:
    """The least prime that is not under n."""
    if n < 1:
        raise ValueError("the number of groups must be positive")
    n = max(n, 2)
    while not is_prime(n):
        n += 1
    return n


def group_of(key: str, groups: int, method: str = "md5") -> int:
    raw = key.encode()
    if method == "blake2b":
        return int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "big") % groups
    return int(hashlib.md5(raw).hexdigest()[:8], 16) % groups


def group_column(key: Column | str, groups: int, method: str = "md5") -> Column:
    """The same as an expression; md5 stays in generated code."""
    key = F.col(key) if isinstance(key, str) else key
    if method == "blake2b":
        return F.pandas_udf(lambda s: pd.Series([group_of(x, groups, "blake2b") for x in s], dtype="int32"), "int")(key)
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % groups).cast("int")


def new_generation(current: set[str] | frozenset[str] = frozenset()) -> str:
    """A token unlike the current ones; the letter in front keeps partition inference from reading a number."""
    while (token := "g" + uuid.uuid4().hex[:13]) in current:
        pass
    return token


def packed_size(key: Column, value: Column) -> Column:
    """Bytes of a member in a packed group: a 13-byte frame, the key, the value."""
    return F.lit(13) + F.octet_length(key) + F.octet_length(value)
