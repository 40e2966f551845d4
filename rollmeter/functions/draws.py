"""Stateless draws: the same in every engine, on every executor and in every order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(n: Column | int, *key: Column | int | str) -> Column:
    """A number below n, from the first 32 bits of md5 of the key's parts joined by colons."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def order_key(seed: int | str, *ids: Column) -> Column:
    """A sort key that shuffles rows by seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in ids)).cast("binary"))


def sample_seed(model: Column | int, sample: Column, item: Column) -> Column:
    model = model if isinstance(model, Column) else F.lit(model)
    return (model * 1_000_000 + sample * 10_000 + item).cast("bigint")
